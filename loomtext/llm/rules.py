"""Quality rules in DataFrame expressions only: plain counts, and a log-likelihood ratio of hashed n-grams.

Word 1- and 2-grams are hashed into BUCKETS values. Two multinomials over the buckets are estimated, one from the
texts labelled as trusted, one from all texts, each smoothed by one count per bucket. A text's score is the sum of
log(trusted / raw) over its n-grams divided by their number. The threshold lies DEVIATIONS standard deviations
below the mean score of the trusted texts, from sums of scores held as whole millionths, so the same input always
gives the same verdicts. Counting and scoring cover all texts.

Defined results: a null text has no words, and base_failed is true; a text without words scores 0; without trusted
texts all scores are 0 and the threshold is 0, so only the base rules decide; null labels are not trusted; repeated
rows are each reported; a null id is carried as null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import join_sized

BUCKETS = 10_000
DEVIATIONS = 6.0
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _buckets(w: str) -> Column:
    """The buckets of all 1- and 2-grams of the array of words."""
    c = F.col(w)
    one = F.transform(c, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.transform(_upto(F.size(c) - 1), lambda i: F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def base_counts(df: DataFrame) -> DataFrame:
    """Add the plain counts of `text`, with `w` its words: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.length(F.regexp_replace(text, _SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")).withColumn("__lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    w = F.col("w")
    df = df.withColumn("__h", F.transform(_upto(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    # Windows found twice stand side by side once sorted; most texts have none, and are not sorted.
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("__s")
    again = F.filter(_upto(F.size(s)), lambda i: (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda i: F.sequence(F.get(s, i)["i"], F.get(s, i)["i"] + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("__h", "__s")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("w", words(F.col("text")))


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float] | None:
    """Per bucket log(trusted / raw), or None where no text is trusted."""
    d = _prepared(docs, id_col, text_col).select("doc_id", "w")
    trusted = labels.where(labels[label_col] == 1).select(labels[id_col].alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("t", F.lit(1))
    marked = join_sized(d, trusted, "doc_id", "left")
    counts = marked.select("t", F.explode_outer(_buckets("w")).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.count("t").alias("t")).collect()
    raw, own = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["k"]] += r["n"]
        own[r["k"]] += r["t"]
    if sum(own) == BUCKETS:
        return None
    a, b = math.log(sum(own)), math.log(sum(raw))
    return [math.log(x) - a - math.log(y) + b for x, y in zip(own, raw, strict=True)]


def _score(w: list[float] | None) -> Column:
    if w is None:
        return F.lit(0.0)
    table = F.array(*(F.lit(x) for x in w)) if len(w) < 100 else F.from_json(F.lit("[" + ",".join(f"{x:.17g}" for x in w) + "]"), "array<double>")
    total = F.aggregate("__k", F.lit(0.0), lambda a, k: a + F.get(table, k))
    return F.when(F.size("__k") > 0, total / F.size("__k")).otherwise(0.0)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the base counts, base_failed, score, threshold and kept of every text."""
    table = weights(docs, labels, id_col, text_col, label_col)
    scored = _prepared(docs, id_col, text_col).withColumn("__k", _buckets("w")).withColumn("score", _score(table)).drop("__k")
    limit = 0.0
    if table is not None:
        good = labels.where(labels[label_col] == 1).select(labels[id_col].alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        x = F.round(F.col("score") * 1_000_000).cast("long")
        r = join_sized(scored.where(F.size("w") >= 50).select("doc_id", "score"), good, "doc_id").agg(F.count("*"), F.sum(x), F.sum((x * x).cast("decimal(38,0)"))).first()
        if r[0]:
            mean = r[1] / r[0]
            limit = round((mean - DEVIATIONS * math.sqrt(max(float(r[2]) / r[0] - mean * mean, 0.0))) / 1_000_000, 6)
    out = base_counts(scored).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= limit)).alias("kept"), "score", F.lit(limit).alias("threshold"))
