"""Sinks: appended JSONL, split by success, and a flat CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "[unknown] no reason was given"


def append_jsonl(df: DataFrame, path: str, pretty: bool = False) -> None:
    if pretty:
        df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("append").text(path)
    else:
        df.write.mode("append").json(path)


def append_with_visual(df: DataFrame, path: str, suffix: str = "") -> None:
    """A file of rows, and beside it one that is easy to read."""
    append_jsonl(df, path + suffix)
    append_jsonl(df, path + suffix + "_visual", pretty=True)


def append_split(df: DataFrame, folder: str, failed: str) -> None:
    """Rows and errors to folders of their own; an error row without a reason gets one. `failed` is a boolean column."""
    ok, bad = df.where(f"NOT `{failed}`").drop(failed), df.where(f"`{failed}`").drop(failed)
    if not {"error", "error_message"} & set(bad.columns):
        bad = bad.withColumn("error", F.lit(UNKNOWN))
    elif "error" in bad.columns:
        told = F.col("error_message") if "error_message" in bad.columns else F.lit(None).cast("string")
        bad = bad.withColumn("error", F.when(F.col("error").isNull() & told.isNull(), UNKNOWN).otherwise(F.col("error")))
    append_jsonl(ok, f"{folder}/rows")
    append_jsonl(bad, f"{folder}/errors")


def without_fields(mapping: str, *fields: str):
    """A map of structs without some of their fields."""
    return F.transform_values(mapping, lambda k, v: v.dropFields(*fields))


def flat(df: DataFrame, plain: list[str], nested: list[str], pretty: bool = True) -> DataFrame:
    """Plain columns as they are, nested ones as JSON text."""
    return df.select(*plain, *(F.to_json(c, {"pretty": "true"} if pretty else {}).alias(c) for c in nested))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
