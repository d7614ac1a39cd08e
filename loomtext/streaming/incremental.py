"""Resuming and state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def unprocessed(rows: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the outputs so far, errors included; order and failures don't matter."""
    for d in done:
        rows = rows.join(d.select(key).distinct(), key, "left_anti")
    return rows


def after_mark(rows: DataFrame, done: DataFrame, mark: str) -> DataFrame:
    """Rows above the highest mark written so far, for outputs in strict order."""
    top = done.agg(F.coalesce(F.max(mark), F.lit(-1)).alias("__top"))
    return rows.join(F.broadcast(top)).where(F.col(mark) > F.col("__top")).drop("__top")


def file_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str, files: int = 64):
    """Run `step` over files as they come, each once; a batch that is repeated writes its rows again to the same place."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        step(batch.dropDuplicates([key])).write.mode("overwrite").json(f"{out}/batch={number}")

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


class NewestVectors(StatefulProcessor):
    """Keeps the newest `size` vectors of each key, and reports how many it holds."""

    def __init__(self, size: int = 1024):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("vectors", "seq long, vec array<float>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) + [(int(s), list(v)) for d in rows for s, v in zip(d["seq"], d["vec"], strict=True)]
        held.sort(key=lambda x: -x[0])
        self.rows.put([(int(s), [float(x) for x in v]) for s, v in held[: self.size]])
        yield pd.DataFrame({"key": [key[0]], "held": [min(len(held), self.size)]})

    def close(self) -> None:
        pass


class RunningScore(StatefulProcessor):
    """The acceptance chain of each key: the first is taken, later ones with probability exp(new - current), at most one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import math

        cur = self.score.get()[0] if self.score.exists() else None
        out = []
        for d in rows:
            for s, new, u in sorted(zip(d["seq"], d["score"], d["u"], strict=True)):
                ok = cur is None or min(1.0, math.exp(min(new - cur, 0.0))) > u
                cur = float(new) if ok else cur
                out.append((key[0], int(s), bool(ok), cur))
        if cur is not None:
            self.score.update((cur,))
        yield pd.DataFrame(out, columns=["key", "seq", "accepted", "current"])

    def close(self) -> None:
        pass


def counted(df: DataFrame, name: str, error: str):
    """(df, observation): counts of rows and failures, gathered while the rows are written."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), F.count_if(F.col(error).isNotNull()).alias("failed")), o
