"""Parsing of lists and dialogue in model answers."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(s: pd.Series) -> pd.Series:
    def parse(text):
        try:
            x = ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return [v if isinstance(v, str) else json.dumps(v) if isinstance(v, (list, dict)) else str(v) for v in x] if isinstance(x, list) else None

    return s.map(parse, na_action="ignore")


def list_string(c: Column) -> Column:
    """A JSON list, else a Python list literal, else the non-blank lines. Only bracketed texts reach Python."""
    t = strip(c)
    bracketed = t.startswith("[") & t.endswith("]")
    as_json = F.when(bracketed, F.from_json(t, "array<string>", {"mode": "PERMISSIVE"}))
    return F.coalesce(as_json, F.when(bracketed, _literal(F.when(bracketed & as_json.isNull(), t))), _lines(t))


def ordered_list(c: Column) -> Column:
    """Items behind "1. " and so on, wherever they stand, over line ends; without any, list_string()."""
    items = F.transform(F.regexp_extract_all(c, F.lit(r"(?Us)(\d+\.\s+.+?)(?=\d+\.\s|$)"), 1), lambda x: strip(F.regexp_replace(x, r"(?U)^\d+\.\s+", "")))
    return F.when(F.size(items) > 0, items).otherwise(list_string(c))


def unordered_list(c: Column) -> Column:
    """Items behind "* " or "- ", wherever they stand; without any, list_string()."""
    items = F.transform(F.regexp_extract_all(c, F.lit(r"(?Us)([*\-]\s+.+?)(?=[*\-]\s|$)"), 1), lambda x: strip(F.regexp_replace(x, r"(?U)^[*\-]\s+", "")))
    return F.when(F.size(items) > 0, items).otherwise(list_string(c))


def strict_ordered(c: Column) -> Column:
    """Items of the lines that start with a number and a dot."""
    hit = F.filter(_lines(c), lambda x: F.regexp_like(x, F.lit(r"^\d+\.\s+\S")))
    return F.transform(hit, lambda x: F.regexp_replace(x, r"^\d+\.\s+", ""))


def strict_unordered(c: Column) -> Column:
    hit = F.filter(_lines(c), lambda x: F.regexp_like(x, F.lit(r"^[*\-]\s+\S")))
    return F.transform(hit, lambda x: F.regexp_replace(x, r"^[*\-]\s+", ""))


def list_format(c: Column) -> Column:
    """ordered, unordered or none, by the first non-blank line."""
    first = F.get(_lines(c), 0)
    return F.when(F.regexp_like(first, F.lit(r"^\d+\.\s")), "ordered").when(F.regexp_like(first, F.lit(r"^[*\-]\s")), "unordered").otherwise("none")


def markdown_list(c: Column) -> Column:
    f = list_format(c)
    return F.when(f == "ordered", strict_ordered(c)).when(f == "unordered", strict_unordered(c)).otherwise(_lines(c))


def key_values(c: Column) -> Column:
    """map<number, map<key, value>> of lines "1. key: value", asterisks left out."""
    items = F.filter(_lines(F.replace(c, F.lit("*"), F.lit(""))), lambda x: F.regexp_like(x, F.lit(r"^\d+\.\s*[^:]+:")))
    pairs = F.transform(
        items,
        lambda x: F.struct(
            F.regexp_extract(x, r"^(\d+)\.", 1).cast("int").alias("n"),
            F.create_map(strip(F.regexp_extract(x, r"^\d+\.\s*([^:]+):", 1)), strip(F.regexp_extract(x, r"^\d+\.\s*[^:]+:(.*)$", 1))).alias("kv"),
        ),
    )
    return F.map_from_entries(pairs)


def choice_numbers(c: Column) -> Column:
    """The numbers that start lines."""
    hit = F.filter(_lines(F.replace(c, F.lit("*"), F.lit(""))), lambda x: F.regexp_like(x, F.lit(r"^\d+\.")))
    return F.transform(hit, lambda x: F.regexp_extract(x, r"^(\d+)\.", 1).cast("int"))


def choice_keys(c: Column) -> Column:
    hit = F.filter(_lines(F.replace(c, F.lit("*"), F.lit(""))), lambda x: F.regexp_like(x, F.lit(r"^\d+\.\s*[^:]+:")))
    return F.transform(hit, lambda x: strip(F.regexp_extract(x, r"^\d+\.\s*([^:]+):", 1)))


def speakers(c: Column) -> Column:
    """What stands before the last colon of each line that has one."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^(.+):"), 1), strip)


def utterances(c: Column) -> Column:
    """What stands behind the last colon of each line that ends in a line feed."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^.+:\s*(.*)\n"), 1), strip)
