"""Language identification by rank-order n-gram profiles.

A profile lists the PROFILE most frequent 1- to 3-grams of lower-cased letters, all else being one gap; ties go
to the smaller n-gram code. A text is compared to each language by the out-of-place distance of its own most
frequent n-grams: the difference of ranks, PROFILE for an n-gram the language's profile lacks.

n-grams are exact (three code points of 21 bits in one number). Counts cover all texts that may be learned from,
summed within tasks first. The score is the runner-up's share of the two smallest distances.

Defined results: null texts and texts without a letter are `und` with score 0; rows with a null language are not
learned from; without any profile all are `und`; equal distances go to the language that sorts first; repeated
rows are each predicted; a null id is carried as null; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
_FLUSH = 1 << 20


@cache
def _fold() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for all that is no letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def codes(text: str) -> np.ndarray:
    """All 1- to 3-grams of a text as numbers, with repetitions; gaps collapse to one and frame the text."""
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.empty(len(c), bool)
    keep[:1] = True
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c = np.concatenate(([0], c[keep], [0]))
    one = c[c > 0]
    if not len(one):
        return one
    b = c + 1
    two = b[:-1] << 21 | b[1:]
    return np.concatenate((one, two, two[:-1] << 21 | b[2:]))


def profile(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, by falling count."""
    k, n = np.unique(codes(text), return_counts=True)
    return k[np.lexsort((k, -n))[:size]]


class Profiles:
    """The languages' n-grams as one sorted array of codes with a rank per language."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.codes = np.array(sorted({c for x in ranked.values() for c in x}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.codes)), -1, np.int64)
        for i, name in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, np.array(ranked[name], np.int64))] = np.arange(len(ranked[name]))

    def predict(self, text: str | None, size: int = PROFILE) -> tuple[str, float]:
        own = profile(text or "", size)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        far = np.where(rank < 0, size, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        order = np.argsort(far, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0 - float(far[0]) / (size * len(own))
        a, b = float(far[order[0]]), float(far[order[1]])
        return self.languages[order[0]], b / (a + b) if a + b else 0.5


def fit(docs: DataFrame, learn: Column | None = None, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles of all languages from all texts that `learn`, over the columns of docs, admits."""
    known = docs if learn is None else docs.where(learn)
    known = known.select(known[lang_col].alias("lang"), known[text_col].alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def counted(lang, grams):
        k, n = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def run(batches):
        grams: dict[str, list] = {}
        held: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = codes(text)
                grams.setdefault(lang, []).append(c)
                held[lang] = held.get(lang, 0) + len(c)
                if held[lang] > _FLUSH:
                    yield counted(lang, grams.pop(lang))
                    held[lang] = 0
        for lang, own in grams.items():
            yield counted(lang, own)

    counts = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: r["r"]):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = sent.value
        for b in batches:
            got = [p.predict(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["k", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("k"), docs[text_col].alias("text")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", id_col)
