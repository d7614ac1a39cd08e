"""Diversity of embeddings: Vendi scores from distributed Gram sums, novelty against a bounded history."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.scores import accepts, cosine, unit_rows, vendi_of, vendi_of_gram

HISTORY, SUBSAMPLE = 1024, 300


def vendi(df: DataFrame, vector: str, by: str) -> DataFrame:
    """(by, n, vendi) of each group.

    Tasks add up d x d Gram matrices of unit vectors, one row per group and task; groups are never gathered.
    """

    def partial(batches):
        grams: dict = {}
        counts: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            rows = unit_rows(np.array(b.column(1).to_pylist(), float)) if b.num_rows else np.zeros((0, 0))
            groups: dict = {}
            for i, k in enumerate(keys):
                groups.setdefault(k, []).append(i)
            for k, ix in groups.items():
                x = rows[ix]
                grams[k] = grams.get(k, 0) + x.T @ x
                counts[k] = counts.get(k, 0) + len(x)
        if grams:
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), kind), pa.array(list(counts.values()), pa.int64()), pa.array([g.ravel().tolist() for g in grams.values()], pa.list_(pa.float64()))], names=["k", "n", "gram"])

    from pyspark.sql.pandas.types import to_arrow_type

    t = df.schema[by].dataType
    kind = to_arrow_type(t)
    parts = df.where(F.col(vector).isNotNull()).select(F.col(by).alias("k"), F.col(vector).alias("v")).mapInArrow(partial, f"k {t.simpleString()}, n long, gram array<double>")
    cells = parts.select("k", "n", F.posexplode("gram").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))

    def finish(batches):
        for b in batches:
            out = [vendi_of_gram(np.array(g).reshape(int(round(len(g) ** 0.5)), -1), n) for g, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["k", "n", "vendi"])

    whole = cells.groupBy("k").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("gram"))
    return whole.mapInArrow(finish, f"k {t.simpleString()}, n long, vendi double").withColumnRenamed("k", by)


def newest(df: DataFrame, order: str, n: int = HISTORY, by: list[str] | None = None) -> DataFrame:
    """The n newest rows, of the table (a top-k) or of each group (limited within tasks first)."""
    if not by:
        return df.orderBy(F.desc(order)).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def novelty(pairs: DataFrame, history: DataFrame, old: str, new: str, key: str, out: str = "novelty", seed: int = 42) -> DataFrame:
    """Add max(0, Vendi(H + new) - Vendi(H + old)), H at most SUBSAMPLE of the history's rows (`vec`), by keyed draw.

    Without a history it is 1 - cosine. H is bounded, so it is sent to the tasks; each pair costs two rank-one updates.
    """
    h = [r["vec"] for r in draws.sample_global(history, "seq", "history", SUBSAMPLE, seed).select("vec").collect()]
    if not h:
        return pairs.withColumn(out, 1 - cosine(F.col(old), F.col(new)))
    x = unit_rows(np.array(h, float))
    sent = pairs.sparkSession.sparkContext.broadcast((x.T @ x, len(x)))

    @F.pandas_udf("double")
    def gain(a, b):
        import pandas as pd

        gram, n = sent.value

        def score(v):
            u = unit_rows(np.array([v], float))
            return vendi_of_gram(gram + u.T @ u, n + 1)

        return pd.Series([max(0.0, score(q) - score(p)) for p, q in zip(a, b, strict=True)])

    return pairs.withColumn(out, gain(old, new))


def accepted(pairs: DataFrame, llm: str = "llm_win", novelty: str = "novelty") -> DataFrame:
    return pairs.withColumn("accepted", accepts(F.col(llm), F.col(novelty)))


__all__ = ["accepted", "newest", "novelty", "vendi", "vendi_of"]
