"""Run statistics and what the viewers count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_route, word_count


def success_rate(df: DataFrame, error: str) -> DataFrame:
    ok = F.count_if(F.col(error).isNull())
    return df.agg(ok.alias("n_success"), F.count_if(F.col(error).isNotNull()).alias("n_failed"), F.round(100 * ok / F.count("*"), 1).alias("success_rate"))


def status_counts(df: DataFrame, error: str) -> DataFrame:
    return df.groupBy(error_route(F.col(error)).alias("status")).agg(F.count("*").alias("n"))


def viewer_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in columns))


def target_sums(df: DataFrame, *arrays: str) -> DataFrame:
    """Sums of the sizes of array columns; null counts as empty."""
    return df.agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(F.when(F.col(a).isNotNull(), F.size(a))), F.lit(0)).alias(f"n_{a}") for a in arrays))


def longest_sequence(df: DataFrame, key: str, sequences: str, extra: int = 200) -> DataFrame:
    """The most words of any sequence, and the token limit that follows."""
    most = F.array_max(F.transform(sequences, lambda s: word_count(s["seq"])))
    return df.select(key, most.alias("max_words"), (most + extra).alias("token_cap"))


def marks(df: DataFrame, mark: str) -> DataFrame:
    return df.agg(F.min(mark).alias("first"), F.max(mark).alias("last"), F.count("*").alias("n"))


def row_at(df: DataFrame, index: str, k: int) -> DataFrame:
    return df.where(F.col(index) == k)
