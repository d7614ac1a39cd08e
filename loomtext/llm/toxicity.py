"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

Over all labelled texts that may be learned from, and for each class c, with D = DISCOUNT:

  S(w)     the shared backoff: in how many of the two classes w occurs (1 or 2; 1 for a word of neither), over the sum
  P_c(w)   max(K_c(w) - D, 0) / K_c + rest_c * S(w); K_c(w) is the number of distinct words before w in class c
  P_c(w|h) max(n_c(hw) - D, 0) / n_c(h) + gamma_c(h) * P_c(w); n_c(hw) is the number of texts with the bigram, and
           n_c(h) the sum of these

What toxic texts never have is left to the backoff in both classes: words without a context there, and bigrams with
fewer than LEAST distinct words before them there (so that copies of one passage don't make an expression). rest and
gamma give the backoff all that is not spent, so both models sum to one.

A toxic text is an ordinary one with a share of toxic expressions. So its likelihood is (1 - share) P_0(w|h) +
share T(w|h), and T, the toxic part, is the maximum-likelihood one given P_1 over the words that toxic texts have: it
spends nothing on words that P_0 explains, which takes the text's language and topic out of the comparison. Its
closed form is share T = (1 - share) max(P_1 / tau - P_0, 0), with the tau at which T sums to one. A text's
difference is the mean over its words of log likelihood as toxic minus as ordinary: log(1 - share) for words that P_0
explains or toxic texts never had, log(1 - share) + log(P_1 / P_0) - log(tau) for others. A logistic curve over asinh of the difference turns it
into the score; it is fitted on an eighth of the labelled texts, by id, that are scored by models counted without
them. The models that score have counted all.

Words are lower-cased runs of letters (ASCII folded, all characters above ASCII count as letters); words and bigrams
are keyed by 64-bit hashes. Counts stay in DataFrames; what grows with toxic texts and is sent to the workers (words
and bigrams beyond tau) is sent in slices of at most SENT, one pass over the texts for each.

Defined results: a null or wordless text has a difference of zero; null labels are left out, of several labels
of one id the highest counts; without both classes all scores are the smoothed share of label 1; repeated rows
are each scored; a null id is carried as null; further columns are ignored, whatever their names; very long texts are
scored whole; equal differences give equal scores, and a score of THRESHOLD counts as toxic; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._util import discard, join_sized, materialize
from .quality import logistic

#: Words and bigrams that are sent to the workers at once at most; more are sent in slices.
SENT = 2_000_000
#: Differences are counted in whole units, so that sums don't depend on their order or on slices.
UNIT = 1 << 20
DISCOUNT = 0.75
#: Distinct words before a bigram in toxic texts, from which it is estimated and not left to the backoff.
LEAST = 3
#: The share of toxic expressions among the words of a toxic text.
SHARE = 0.01
THRESHOLD = 0.5
#: Labelled texts that the logistic curve is fitted on at most, the first by a hash of their id.
CURVE_ROWS = 20_000
_FLUSH = 1 << 21
#: Keys whose counts travel in one row.
_BLOCK = 1 << 13
#: Steps per unit of log(P_1 / P_0) in which tau is looked for.
_STEPS = 100


def bigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, of the words before them (0 for a row's first) and of their bigrams; the rows' bounds."""
    w, bounds = T.word_hashes(raw, off, gap=T.NOT_LETTER)
    before = np.zeros_like(w)
    before[1:] = w[:-1]
    before[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
    pair = T.mix(before * T._ODD[0] + w * T._ODD[1])
    return w.view(np.int64), before.view(np.int64), pair.view(np.int64), bounds


def _chunks(batches):
    """(words, words before, bigrams, bounds, row range, batch) of a chunk of rows at a time."""
    for b in batches:
        raw, off = T.texts(b, "text")
        for lo, hi in T.chunks(off):
            yield *bigrams(raw, off[lo : hi + 1]), lo, hi, b
    T.trim()


def _longs(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _contexts(labelled: DataFrame) -> DataFrame:
    """(w, b, of): every distinct bigram b of a word w; bit `kind` of `of` is set where a text of that kind has it."""

    def flush(parts):
        if parts:
            w, b, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((b, w))  # rows of a word side by side compress well
            w, b, of = w[order], b[order], of[order]
            at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            yield _longs(w=w[at], b=b[at], of=np.bitwise_or.reduceat(of, at))

    def run(batches):
        parts, held = [], 0
        for w, _, b, bounds, lo, hi, batch in _chunks(batches):
            if len(w):
                parts.append((w, b, np.repeat(np.int8(1) << batch.column(1).slice(lo, hi - lo).to_numpy(), np.diff(bounds))))
                held += len(w)
            if held > _FLUSH:
                yield from flush(parts)
                parts, held = [], 0
        yield from flush(parts)

    return labelled.select("text", "kind").mapInArrow(run, "w long, b long, of byte").groupBy("w", "b").agg(F.bit_or("of").alias("of"))


def _inventory(toxic: DataFrame) -> DataFrame:
    """(b, h, w): the bigrams of toxic texts that stand behind LEAST distinct words at least."""

    def behind(batches):
        for _, h, b, bounds, *_ in _chunks(batches):
            g = np.zeros_like(h)
            g[1:] = h[:-1]
            g[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
            order = np.lexsort((g, b))
            b, g = b[order], g[order]
            at = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (g[1:] != g[:-1])))) if len(b) else order
            yield _longs(b=b[at], g=g[at])

    seen = toxic.select("text").mapInArrow(behind, "b long, g long").distinct()
    several = materialize(seen.groupBy("b").agg(F.count("*").alias("n")).where(f"n >= {LEAST}").select("b"), "several")
    out = None
    for part in _slices(several, "b", several.count()):
        sent = toxic.sparkSession.sparkContext.broadcast(_sorted_longs(part, "b")[0])

        def parts(batches, sent=sent):
            for w, h, b, *_ in _chunks(batches):
                at = np.unique(b, return_index=True)[1]
                at = at[_found(sent.value, b[at])[1]]
                yield _longs(b=b[at], h=h[at], w=w[at])

        rows = toxic.select("text").mapInArrow(parts, "b long, h long, w long")
        out = rows if out is None else out.union(rows)
    return out.distinct()


def _sorted_longs(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    t = df.select(*columns).toArrow()
    cols = [t.column(c).to_numpy() for c in columns]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


def _slices(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    parts = max(1, -(-n // SENT))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table, and where they are right."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _text_counts(labelled: DataFrame, keys: DataFrame, history: bool) -> DataFrame:
    """(key, n0 .. n3): per kind the number of texts with a bigram; for a history, of distinct bigrams over the texts.

    A task counts into an array over the sorted keys, SENT at most, and sends what it has counted in blocks.
    """
    spark, out = labelled.sparkSession, None
    for part in _slices(keys, "key", keys.count()):
        sent = spark.sparkContext.broadcast(_sorted_longs(part, "key")[0])

        def run(batches, sent=sent):
            known = sent.value
            n = np.zeros((len(known), 4), np.uint32)
            for _, h, b, bounds, lo, hi, batch in _chunks(batches):
                of = batch.column(1).slice(lo, hi - lo).to_numpy()
                at, good = _found(known, h if history else b)
                at, row = at[good], np.repeat(np.arange(hi - lo), np.diff(bounds))[good]
                # Each bigram of a text once, whatever its number.
                first = np.unique(T.mix(b[good].view(np.uint64) + row.astype(np.uint64) * T._ODD[2]), return_index=True)[1]
                cell, more = np.unique(at[first] * 4 + of[row[first]], return_counts=True)
                n.reshape(-1)[cell] += more.astype(np.uint32)
            for i in range(0, len(known), _BLOCK):
                if n[i : i + _BLOCK].any():
                    packed = zlib.compress(n[i : i + _BLOCK].T.tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed], pa.binary())], names=["block", "counts"])

        def add(batches, sent=sent):
            at, n = None, None

            def rows():
                some = n.any(axis=0)
                return _longs(key=sent.value[at : at + _BLOCK][some], **{f"n{k}": n[k][some] for k in range(4)})

            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if i != at:
                        if n is not None:
                            yield rows()
                        at, n = i, 0
                    n = n + np.frombuffer(zlib.decompress(raw), np.uint32).reshape(4, -1).astype(np.int64)
            if n is not None:
                yield rows()

        blocks = labelled.select("text", "kind").mapInArrow(run, "block long, counts binary").repartition("block")
        rows = blocks.sortWithinPartitions("block").mapInArrow(add, "key long, n0 long, n1 long, n2 long, n3 long")
        out = rows if out is None else out.union(rows)
    return out


@dataclass
class Model:
    words: DataFrame | None = None  # (w, x): log(P_1(w) / P_0(w)) where it counts, in units
    grams: DataFrame | None = None  # (b, w, x): log(P_1(w|h) / P_0(w|h)) of the bigrams that are estimated, in units
    histories: tuple = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))  # h and log(gamma_1 / gamma_0)
    n: int = 0
    tau: int = 0
    share: float = SHARE
    scale: float = 1.0
    slope: float = 0.0
    shift: float = 0.0

    def slices(self) -> int:
        return max(1, -(-self.n // SENT))

    def tables(self, i: int) -> tuple:
        if self.words is None:
            return (*(np.zeros(0, np.int64),) * 4,)
        own = lambda d: d.where(F.pmod("w", F.lit(self.slices())) == i)
        return *_sorted_longs(own(self.words), "w", "x"), *_sorted_longs(own(self.grams), "b", "x")

    def curve(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(x / self.scale) + self.shift, -500, 500)))


def _differences(docs: DataFrame, model: Model, kind: str, scored: bool) -> DataFrame:
    """(k, x) of (k, text): the difference of the mean log likelihoods, or its score; a pass for each slice of the tables."""
    last, names = model.slices() - 1, ["k", "text", "t"]
    cur = docs.select("k", "text", F.lit(0).cast("long").alias("t"))
    plain = Model(n=model.n, tau=model.tau, share=model.share, scale=model.scale, slope=model.slope, shift=model.shift)
    for i in range(last + 1):
        sent = docs.sparkSession.sparkContext.broadcast((model.tables(i), model.histories))

        def run(batches, sent=sent, end=i == last, i=i):
            (words, word_x, grams, gram_x), (hist, hist_x) = sent.value
            for w, h, b, bounds, lo, hi, batch in _chunks(batches):
                at, good = _found(words, w)
                x = np.where(good, word_x[at] if len(words) else 0, -(1 << 60))
                at, good = _found(hist, h)
                x += np.where(good, hist_x[at] if len(hist) else 0, 0)
                at, good = _found(grams, b)
                x = np.maximum(np.where(good, gram_x[at] if len(grams) else 0, x) - plain.tau, 0)
                total = np.concatenate(([0], np.cumsum(x)))
                t = batch.column(2).slice(lo, hi - lo).to_numpy() + total[bounds[1:]] - total[bounds[:-1]]
                k = batch.column(0).slice(lo, hi - lo)
                if not end:
                    yield pa.RecordBatch.from_arrays([k, batch.column(1).slice(lo, hi - lo), pa.array(t)], names=names)
                    continue
                n = np.diff(bounds)
                out = np.where(n > 0, t / UNIT / np.maximum(n, 1) + math.log(1 - plain.share), 0.0)
                yield pa.RecordBatch.from_arrays([k, pa.array(plain.curve(out) if scored else out, pa.float64())], names=["k", "x"])

        if i == last:
            return cur.mapInArrow(run, f"k {kind}, x double")
        done = materialize(cur.mapInArrow(run, f"k {kind}, text string, t long"), "partly-scored")
        discard(cur)
        cur = done


def build(words: DataFrame, grams: DataFrame, histories: DataFrame, share: float = SHARE) -> Model:
    """The models of words (w, k0, k1), bigrams (b, h, w, n0, n1) and histories (h, n0, n1)."""
    own = [F.when((F.col("k1") > 0) & (F.col(f"k{c}") > 0), F.col(f"k{c}") - DISCOUNT).otherwise(0.0) for c in (0, 1)]
    both = (F.col("k0") > 0).cast("int") + (F.col("k1") > 0).cast("int")
    all_0, all_1, own_0, own_1, kinds = (x or 0 for x in words.agg(F.sum("k0"), F.sum("k1"), F.sum(own[0]), F.sum(own[1]), F.sum(both)).first())
    if not all_0 or not all_1:
        return Model(share=share)
    rest = [1 - own_0 / all_0, 1 - own_1 / all_1]
    p = [own[c] / float(total) + F.lit(rest[c]) * both / F.lit(float(kinds + 1)) for c, total in ((0, all_0), (1, all_1))]
    known = materialize(words.where("k1 > 0").select("w", p[0].alias("p0"), p[1].alias("p1")), "known-words")
    # tau: the toxic part spends share / (1 - share) * tau of P_1's mass beyond tau * P_0.
    bins = known.groupBy(F.floor(F.log(F.col("p1") / F.col("p0")) * _STEPS).cast("int").alias("at")).agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1")).collect()
    at, m0, m1 = (np.array([r[c] for r in sorted(bins)], float) for c in range(3))
    grid = np.arange(max(0, int(at[-1]) + 1) + 1)
    beyond = [np.concatenate((m[::-1].cumsum()[::-1], [0.0]))[np.searchsorted(at, grid)] for m in (m0, m1)]
    tau = int(np.flatnonzero(beyond[1] - np.exp(grid / _STEPS) * (beyond[0] + share / (1 - share)) <= 0)[0]) / _STEPS
    unit = lambda c: F.round(c * UNIT).cast("long")
    spent = grams.groupBy("h").agg(*(F.sum(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))).alias(f"s{c}") for c in (0, 1)))
    gamma = [F.when(F.col(f"t{c}") > 0, 1 - F.col(f"s{c}") / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)]
    hist = histories.select("h", F.col("n0").alias("t0"), F.col("n1").alias("t1")).join(spent, "h").select("h", "t0", "t1", gamma[0].alias("g0"), gamma[1].alias("g1"))
    hist = materialize(hist, "histories")
    held = [F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0) + F.col(f"g{c}") * F.col(f"p{c}") for c in (0, 1)]
    grams = join_sized(join_sized(grams, hist, "h"), known, "w").select("b", "w", unit(F.log(held[1] / held[0])).alias("x"))
    histories = _sorted_longs(hist.select("h", unit(F.log(F.col("g1") / F.col("g0"))).alias("x")), "h", "x")
    x, least = unit(F.log(F.col("p1") / F.col("p0"))), round(tau * UNIT) - max([0, *histories[1].tolist()])
    beyond = known.select("w", x.alias("x")).where(F.col("x") > least)
    beyond, grams = materialize(beyond, "words"), materialize(grams, "grams")
    return Model(beyond, grams, histories, max(beyond.count(), grams.count()), round(tau * UNIT), share)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", share: float = SHARE, curve_rows: int = CURVE_ROWS) -> Model:
    """Count all labelled texts that `learn`, over `doc_id`, admits; an eighth of them, by id, fits the curve as well."""
    known = labels.select(labels[id_col].alias("doc_id"), (labels[label_col] > 0).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        known = known.where(learn)
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).cast("int")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("kind", (F.col("label") + 2 * fold).cast("byte"))
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    labelled = join_sized(docs, known, "doc_id").select("doc_id", "text", "kind")
    of = lambda *bits: F.count_if(F.col("of").bitwiseAND(F.lit(sum(1 << b for b in bits))) > 0)
    words = materialize(_contexts(labelled).groupBy("w").agg(of(0).alias("k0"), of(1).alias("k1"), of(0, 2).alias("a0"), of(1, 3).alias("a1")), "contexts")
    grams = materialize(_inventory(labelled.where("kind IN (1, 3)")), "inventory")
    counts = _text_counts(labelled, grams.select(F.col("b").alias("key")), False)
    grams = materialize(grams.join(counts.withColumnRenamed("key", "b"), "b"), "grams")
    histories = materialize(_text_counts(labelled, grams.select(F.col("h").alias("key")).distinct(), True).withColumnRenamed("key", "h"), "histories")
    half = build(words, grams, histories, share)
    every = [(F.col(f"n{c}") + F.col(f"n{c + 2}")).alias(f"n{c}") for c in (0, 1)]
    model = build(words.select("w", F.col("a0").alias("k0"), F.col("a1").alias("k1")), grams.select("b", "h", "w", *every), histories.select("h", *every), share)
    picked = known.where("kind >= 2").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(curve_rows)
    rows = join_sized(docs, materialize(picked.select("doc_id", "label"), "curve"), "doc_id").select(F.col("label").alias("k"), "text")
    got = _differences(rows, half, "int", scored=False).toArrow()
    x, y = got.column("x").to_numpy().astype(float), got.column("k").to_numpy().astype(float)
    if len(set(y)) < 2 or half.words is None:
        n = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        rate = (n[1] + 1) / (n[0] + 2)
        model.slope, model.shift = 0.0, math.log(rate / (1 - rate))
    else:
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        model.scale = float(np.median(np.abs(x[x != 0]))) if x.any() else 1.0
        model.slope, model.shift = logistic(np.arcsinh(x / model.scale), np.where(y > 0, 1.0, -1.0))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(docs[id_col].alias("k"), docs[text_col].alias("text"))
    return _differences(narrow, model, kind, scored=True).toDF(id_col, "score")
