"""Spans in texts: pattern extraction, merging of overlaps, rewriting, and the mapping of what was changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Personal data patterns without word boundaries, which regex dialects treat differently.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{13,16}",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}


def _located(found: str, between: str, name: str) -> Column:
    """array<struct<attr_type, start, end, span>> from a pattern's matches and the texts between them, so no match is searched again."""
    f, b = F.col(found), F.col(between)
    none = F.array().cast("array<struct<attr_type:string,start:int,end:int,span:string>>")
    at = F.aggregate(
        F.sequence(F.lit(0), F.size(f) - 1),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, i: F.struct(
            (s["at"] + F.length(F.get(b, i)) + F.length(F.get(f, i))).alias("at"),
            F.concat(s["out"], F.array(F.struct(F.lit(name).alias("attr_type"), (s["at"] + F.length(F.get(b, i))).alias("start"), (s["at"] + F.length(F.get(b, i)) + F.length(F.get(f, i))).alias("end"), F.get(f, i).alias("span")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(F.size(f) > 0, at).otherwise(none)


def pattern_spans(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, attr_type, start, end, span) of all pattern matches; 0-based, end exclusive.

    Matches are columns of their own, mentioned more than once, so each pattern is searched once; the texts between
    are split where there are matches only. explode() would have the optimizer compute its array again in a filter.
    """
    patterns = patterns or PII
    d = df.select(F.col(key), F.col(text).alias("__t"))
    for i, p in enumerate(patterns.values()):
        d = d.withColumn(f"__f{i}", F.regexp_extract_all("__t", F.lit(f"({p})"), 1))
    for i, p in enumerate(patterns.values()):
        d = d.withColumn(f"__b{i}", F.when(F.size(f"__f{i}") > 0, F.split("__t", p, -1)))
    all_spans = F.concat(*(_located(f"__f{i}", f"__b{i}", n) for i, n in enumerate(patterns)))
    return d.select(key, F.explode_outer(all_spans).alias("s")).where("s IS NOT NULL").select(key, "s.attr_type", "s.start", F.col("s.end").alias("end"), "s.span")


def valid_spans(df: DataFrame, difference: str = "difference", most: float = 5) -> DataFrame:
    """Spans that run forwards and whose text is close to the answer's."""
    return df.where((F.col("start") <= F.col("end")) & (F.col(difference) <= most))


def islands(df: DataFrame, *by: str) -> DataFrame:
    """Add `island`, numbered in order within the columns `by`: overlapping spans share one, touching ones don't."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_spans(df: DataFrame, key: str, *by: str) -> DataFrame:
    """One row per island: start, end, n_merged, attr_types in order of first appearance, letters in either case equal."""
    i = islands(df, key, *by)
    g = i.groupBy(key, *by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged"), F.array_sort(F.collect_list(F.struct("start", "end", "attr_type"))).alias("__t"))
    types = F.transform("__t", lambda x: x["attr_type"])
    first = F.filter(types, lambda x, n: ~F.exists(F.slice(types, 1, n), lambda y: F.lower(y) == F.lower(x)))
    return g.withColumn("attr_types", first).drop("__t", "island")


def merged_confidence(confidence: Column, length: Column) -> Column:
    """The length-weighted mean confidence of spans that merge."""
    return F.sum(confidence * length) / F.sum(length)


def common_option(a: Column, b: Column) -> Column:
    """The option that two spans share, the smallest of several; null for none."""
    return F.array_min(F.array_intersect(a, b))


def replace_spans(df: DataFrame, spans: DataFrame, key: str, text: str, with_: Column, out: str = "sanitized") -> DataFrame:
    """Every span of a text replaced. `spans` holds disjoint (key, start, end, ...); `with_` is over its columns."""
    per = spans.select(key, F.struct("start", "end", with_.alias("new")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("__s"))
    d = df.join(per, key, "left")
    t = F.col(text)
    folded = F.aggregate(
        "__s",
        F.struct(F.lit("").alias("o"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["o"], t.substr(a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("o"), s["end"].alias("at")),
        lambda a: F.concat(a["o"], t.substr(a["at"] + 1, F.length(t))),
    )
    return d.withColumn(out, F.when(F.col("__s").isNull(), t).otherwise(folded)).withColumn("n_spans", F.when(F.col("__s").isNull(), 0).otherwise(F.size("__s"))).drop("__s")


#: What a type of personal data is called once its value is gone.
GENERAL = {"email": "an email address", "ip": "a network address", "card": "a card number", "phone": "a phone number"}


def placeholder(attr_types: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.array_join(attr_types, "|")), F.lit("]"))


def generalisation(attr_types: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in GENERAL.items() for x in kv))
    return F.array_join(F.transform(attr_types, lambda a: F.coalesce(F.try_element_at(table, a), F.lit("something"))), " or ")


def first_seen(ordinal: str, value: str) -> Column:
    """The distinct values of a group, in order of first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, value))), lambda x: x[value]))


def sequences_by_attribute(found: DataFrame, key: str) -> DataFrame:
    """(key, attr_type, sequence idx in order) from rows (key, attr_type, idx)."""
    return found.groupBy(key, "attr_type").agg(F.array_sort(F.collect_set("idx")).alias("sequences"))


def sequence_mapping(sequences: DataFrame, rewritten: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, idx, original, sanitized, attributes, options, n_spans) of every sequence that has spans."""
    per = found.groupBy(key, "idx").agg(first_seen("start", "attr_type").alias("attributes"), F.array_sort(F.collect_set("option")).alias("options"), F.count("*").alias("n_spans"))
    return per.join(sequences.select(key, "idx", F.col("seq").alias("original")), [key, "idx"]).join(rewritten.select(key, "idx", F.col("seq").alias("sanitized")), [key, "idx"], "left").withColumn("sanitized", F.coalesce("sanitized", "original"))


def under_sanitized(guesses: DataFrame, value: str = "value", guess: str = "guess") -> DataFrame:
    """Rows whose original value still stands in what a model guesses."""
    return guesses.where(F.contains(F.lower(guess), F.lower(value)))
