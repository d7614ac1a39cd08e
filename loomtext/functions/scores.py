"""Scores over vectors and texts."""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def normalise(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-8)))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, brought to length one."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zero = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
    return normalise(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def accepts(llm_win: Column, novelty: Column) -> Column:
    """The default rule: half the judge's vote plus half the novelty must exceed one half."""
    return 0.5 * llm_win + 0.5 * novelty > 0.5


def metropolis(current: Column, llm_win: Column, novelty: Column, u: Column, bonus: float = 4.0) -> Column:
    """struct(score, accepted): the first is taken; then with probability exp(new - current), at most one."""
    new = llm_win + novelty + F.when((llm_win == 1) & (novelty > 0), bonus * novelty).otherwise(0.0)
    p = F.least(F.lit(1.0), F.exp(new - current))
    return F.struct(new.alias("score"), (current.isNull() | (p > u)).alias("accepted"))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.replace(c, F.lit("."), F.lit(" ")), r"(?U)\s+"), lambda x: x != ""))


def rouge1_recall(hyp: Column, ref: Column) -> Column:
    """The share of the reference's distinct tokens in the hypothesis; 100, which no rule keeps, if either has none."""
    h, r = _tokens(hyp), _tokens(ref)
    return F.when((F.size(h) == 0) | (F.size(r) == 0), 100.0).otherwise(F.size(F.array_intersect(h, r)) / F.size(r))


def rank_weight(rank: Column) -> Column:
    return F.lit(0.3) + 1 / rank


def token_budget(n: Column, reasoning: Column) -> Column:
    return F.when(reasoning, F.greatest(n, F.lit(4096), 4 * n)).otherwise(n)


def backoff_seconds(attempt: int) -> int:
    return min(2**attempt + 1, 60)


@lru_cache(1024)
def _searched(b: str) -> list[str]:
    """What difflib searches of a text: from 200 letters on, only what stands between letters that are more than a hundredth of it."""
    common = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= 200 else set()
    return ["".join(g) for kept, g in groupby(b, lambda c: c not in common) if kept]


def longest_match(a: str, b: str) -> int:
    """The size of difflib's longest match, by searches for whole strings, at most two for each letter of b that counts.

    Among matches of the letters that count, difflib takes the first in a, then the first in b, and extends it by all letters.
    """
    pieces, k = _searched(b), 0
    for p in pieces:
        lo = 0
        while lo + k < len(p):
            if p[lo : lo + k + 1] in a:
                k += 1
            else:
                lo += 1
    if len(b) < 200:
        return k
    i = j = 0
    if k:
        i = min(x for c in {p[n : n + k] for p in pieces for n in range(len(p) - k + 1)} if (x := a.find(c)) >= 0)
        j = b.find(a[i : i + k])
    while i and j and a[i - 1] == b[j - 1]:
        i, j, k = i - 1, j - 1, k + 1
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    return k


def text_difference_of(a: str | None, b: str | None) -> float:
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 0.0
    return float(max(len(a), len(b)) - longest_match(a, b))


@F.pandas_udf(T.DoubleType())
def text_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longer length less the longest contiguous match of the lower-cased, stripped texts."""
    return pd.Series([text_difference_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def closest(cutoff: float):
    """A function of (text, candidates) giving the candidate most like the text, or null below the cutoff."""

    @F.pandas_udf(T.StringType())
    def best(text: pd.Series, candidates: pd.Series) -> pd.Series:
        out = [(difflib.get_close_matches(t, list(c), n=1, cutoff=cutoff) or [None])[0] if t is not None and c is not None else None for t, c in zip(text, candidates, strict=True)]
        return pd.Series(out, dtype="object")

    return best


def vendi_of_gram(gram: np.ndarray, n: int) -> float:
    """exp of the entropy of the eigenvalues of X'X / n, which are those of XX' / n."""
    p = np.linalg.eigvalsh(gram / n)
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum())) if len(p) else 1.0


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def vendi_of(x: np.ndarray) -> float:
    x = unit_rows(np.asarray(x, float))
    return vendi_of_gram(x.T @ x, len(x)) if x.shape[1] <= len(x) else vendi_of_gram(x @ x.T, len(x))
