"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators: byte 1- to 3-grams and word 1- and 2-grams of the whole text, letters in either case apart, hashed into
SIZE buckets, and of word 2-grams also whether both words are the same, which no single 2-gram shows. Each indicator
is scaled by its class log-count ratio, rows are brought to length one, and a linear hinge-loss model is fitted by
dual coordinate descent; a logistic curve fitted on rows that the model did not see turns margins into scores.

The fit uses at most `sample` labelled rows, the first by a hash of their id. Scoring reads every whole text. Rows of
the fit come to the driver, and stay there, as 16-bit steps from bucket to bucket; it unfolds and scales one at a time.

Defined results: null or empty texts have no indicators and get the score of a zero margin plus bias; null
labels are left out, of several labels of one id the lowest counts; with one class only, or no labelled row,
every score is the smoothed share of label 1; repeated rows are each scored, and equal texts score the same; a score
of THRESHOLD counts as good; very long texts are read whole, one at a time; a null id is carried as null; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._util import trim_driver

#: Buckets of the hashed indicators; the last one says that a word follows itself.
SIZE = 1 << 20
#: Counts that every indicator starts with in either class.
PRIOR = 10.0
COST = 5.0
#: Labelled rows that a fit uses at most.
SAMPLE = 8_000
THRESHOLD = 0.7
#: A step that leads on without a bucket.
WIDE = (1 << 16) - 1


def indicators(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Per row the distinct buckets of its n-gram indicators, in order of first appearance."""
    lo = int(off[0])
    b = raw[lo : int(off[-1])].astype(np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    grams = [b + np.uint64(1 << 32), two + np.uint64(2 << 32), (two[:-1] | b[2:] << np.uint64(16)) + np.uint64(3 << 32)]
    grams = [_bucket(g) for g in grams]
    h, bounds = T.word_hashes(raw, off, fold=False)
    words = [_bucket(h), _bucket(h[:-1] * T._ODD[0] + h[1:] * T._ODD[1])]
    same = h[1:] == h[:-1]
    place, out = np.zeros(SIZE, np.int32), []
    for i in range(len(off) - 1):
        s, e, first, last = int(off[i]) - lo, int(off[i + 1]) - lo, int(bounds[i]), int(bounds[i + 1])
        own = [g[s : max(s, e - n)] for n, g in enumerate(grams)] + [w[first : max(first, last - n)] for n, w in enumerate(words)]
        if same[first : max(first, last - 1)].any():
            own.append(_SAME)
        x = np.concatenate(own)
        at = np.arange(len(x), dtype=np.int32)
        place[x[::-1]] = at[::-1]  # the first place of each bucket
        out.append(x[place[x] == at])
    return out


_SAME = np.array([SIZE - 1], np.int64)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (T.mix(x) % np.uint64(SIZE - 1)).astype(np.int64)


def steps(x: np.ndarray) -> np.ndarray:
    """Sorted buckets as 16-bit steps from each to the next, the first from 0; wider ones take several."""
    d = np.diff(x, prepend=0)
    more = d // WIDE
    out = np.full(len(x) + int(more.sum()), WIDE, np.uint16)
    out[np.arange(len(x)) + np.cumsum(more)] = d % WIDE
    return out


class Unfolded(Sequence):
    """The buckets of rows that are held as steps, made anew whenever a row is read."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        s = self.rows[i]
        return np.cumsum(s, dtype=np.int32)[s != WIDE]


class Scaled(Sequence):
    """(buckets, values) of the rows at the places `at`: their buckets' ratios, brought to length one, made anew whenever a row is read."""

    def __init__(self, rows: Sequence[np.ndarray], at: np.ndarray, ratio: np.ndarray):
        self.rows, self.at, self.ratio = rows, at, ratio

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.rows[self.at[i]]
        v = self.ratio[x]
        return x, (v / max(float(np.sqrt((v**2).sum())), 1e-6)).astype(np.float32)


@dataclass
class Model:
    """margin = sum(weight) / sqrt(sum(square)) + bias over a row's indicators; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        return float(self.weight[x].sum() / math.sqrt(max(float(self.square[x].sum()), 1e-12))) + self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def dual_coordinate_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12) -> np.ndarray:
    """Weights of the hinge-loss machine over sparse rows (indices, values), the last weight being the bias."""
    w, a = np.zeros(size + 1), np.zeros(len(rows))
    order = np.random.default_rng(7)
    square = np.array([v @ v + 1 for _, v in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            k, v = rows[i]
            new = min(max(a[i] - (y[i] * (w[k] @ v + w[-1]) - 1) / square[i], 0.0), cost[i])
            if d := (new - a[i]) * y[i]:
                w[k] += d * v
                w[-1] += d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1 = float((y > 0).sum())
    n0 = len(y) - n1
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        scale = min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(rows: Sequence[np.ndarray], labels: list[int]) -> Model:
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    zero = np.zeros(SIZE, np.float32)
    share = ((y > 0).sum() + 1) / (len(y) + 2)
    constant = Model(zero, zero, 0.0, 1.0, math.log(share / (1 - share)))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        return constant
    count = {s: np.full(SIZE, PRIOR) for s in (1.0, -1.0)}
    for i in np.flatnonzero(~held):
        count[y[i]][rows[i]] += 1
    r = np.log(count[1.0] / count[1.0].sum())
    r -= np.log(count[-1.0] / count[-1.0].sum())
    del count
    yf = y[~held]
    cost = np.full(len(yf), COST)
    w = dual_coordinate_descent(Scaled(rows, np.flatnonzero(~held), r), yf, cost, SIZE)
    model = Model((w[:-1] * r).astype(np.float32), (r**2).astype(np.float32), float(w[-1]), 1.0, 0.0)
    if len(set(y[held])) == 2:
        model.slope, model.shift = logistic(np.array([model.margin(rows[i]) for i in np.flatnonzero(held)]), y[held])
    else:
        model.slope = 4.0
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows; `learn`, over `doc_id`, says which rows may be learned from."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        for b in batches:
            raw, off = T.texts(b, "text")
            for lo, hi in T.chunks(off):
                rows = [steps(np.sort(x)).tobytes() for x in indicators(raw, off[lo : hi + 1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])
        T.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    got = picked.mapInArrow(run, f"doc_id {kind}, label int, x binary").toArrow()
    ids, known = got.column("doc_id").to_pylist(), got.column("label").to_pylist()
    x = Unfolded([np.frombuffer(v.as_buffer(), np.uint16) for v in got.column("x")])
    del got
    place = [hash_order(i) for i in ids]
    equal = Counter(place)
    order = sorted(range(len(ids)), key=lambda i: (place[i], x[i].tobytes() if equal[place[i]] > 1 else b""))
    model = fit_rows(Unfolded([x.rows[i] for i in order]), [known[i] for i in order])
    del x
    T.trim()
    trim_driver(docs.sparkSession)
    return model


def hash_order(x) -> int:
    import zlib

    return zlib.crc32(f"fold {x}".encode())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            raw, off = T.texts(b, "text")
            for lo, hi in T.chunks(off):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([m.score(x) for x in indicators(raw, off[lo : hi + 1])], pa.float64())], names=["k", "score"])
        T.trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("k"), docs[text_col].alias("text")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least `threshold`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        m = sent.value
        for b in batches:
            raw, off = T.texts(pa.RecordBatch.from_arrays([b.column(at)], names=["text"]), "text")
            good = [m.score(x) >= threshold for lo, hi in T.chunks(off) for x in indicators(raw, off[lo : hi + 1])]
            yield b.filter(pa.array(good, pa.bool_()))
        T.trim()

    return docs.mapInArrow(run, docs.schema)
