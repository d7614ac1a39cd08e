"""Keyed draws: every random choice is a hash of a seed, a key and the name of the place that draws.

The same seed gives the same draws under any partitioning, and in any engine that has SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a draw's integer: eight hex digits.
RANGE = 1 << 32


def draw(key: Column, site: str | Column, seed: int = 42) -> Column:
    """A whole number in [0, 2**32)."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{site}") if isinstance(site, str) else F.concat(F.lit(":"), site))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def uniform(key: Column, site: str, seed: int = 42) -> Column:
    """A number in [0, 1)."""
    return draw(key, site, seed) / F.lit(float(RANGE))


def bernoulli(key: Column, site: str, p: float, seed: int = 42) -> Column:
    return uniform(key, site, seed) < p


def choice(key: Column, site: str, values: Column, seed: int = 42) -> Column:
    """One element of an array, each as likely; null for an empty one."""
    return F.when(F.size(values) > 0, F.get(values, (draw(key, site, seed) % F.size(values)).cast("int")))


def weighted_choice(key: Column, site: str, values: list, weights: list[float], seed: int = 42) -> Column:
    """One of the values; weights need not add up to one."""
    u, total, out = uniform(key, site, seed), sum(weights), F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(u < sum(weights[: i + 1]) / total, F.lit(values[i])).otherwise(out)
    return out


def weighted_pair(key: Column, site: str, a: Column, b: Column, wa: Column, wb: Column, seed: int = 42) -> Column:
    """a or b, by weights that are columns."""
    return F.when(uniform(key, site, seed) * (wa + wb) < wa, a).otherwise(b)


def sample_rows(df: DataFrame, key: str, site: str, k: int | Column, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """k rows of each group without replacement: those with the smallest draws."""
    w = Window.partitionBy(*(by or [])).orderBy(draw(F.col(key), site, seed), F.col(key))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def sample_global(df: DataFrame, key: str, site: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of the whole table: a top-k, not a sort."""
    return df.orderBy(draw(F.col(key), site, seed), F.col(key)).limit(k)


def random_date(key: Column, site: str, first: str, last: str, seed: int = 42) -> Column:
    """A date from `first`, inclusive, to `last`, exclusive."""
    days = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date"))
    return F.date_add(F.lit(first).cast("date"), (draw(key, site, seed) % days).cast("int"))


def random_age(key: Column, site: str = "age", low: int = 19, high: int = 85, seed: int = 42) -> Column:
    return (F.lit(low) + draw(key, site, seed) % (high - low + 1)).cast("int")


def beta_2_5(key: Column, site: str, seed: int = 42) -> Column:
    """A Beta(2, 5) number: the second smallest of six uniform ones."""
    return F.get(F.array_sort(F.array(*(uniform(key, f"{site}:{i}", seed) for i in range(6)))), 1)


def selection_count(key: Column, n_groups: Column, method: str, seed: int = 42) -> Column:
    """How many attributes a method takes: a Beta(2, 5) share of half the groups; abstract rounds up, drop to even, keep down."""
    x = beta_2_5(key, f"n_{method}", seed) * n_groups / 2
    return {"abstract": F.ceil(x), "drop": F.bround(x, 0), "keep": F.floor(x)}[method].cast("int")
