"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A text's fingerprints are the
smallest hashes of its K-word sequences over every WINDOW - K + 1 consecutive ones, so two texts that share WINDOW
consecutive words share a fingerprint at aligned places. Training and benchmark fingerprints are joined; texts
with hits are cut into their places, hits are extended word for word to all windows they can lie in, and the words
of matching windows are marked. Items of fewer than WINDOW words, one window each, are fingerprinted whole and
matched with the documents' sequences of the same lengths, of which there are at most WINDOW - 1.

Defined results: a null or wordless text has no words and is never contaminated; a null or wordless item, and an
item with a null id, matches nothing; repeated documents are each reported, repeated items count once by id; a
null document id is carried as null; further columns are ignored; empty tables give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, materialize, small_enough

K, WINDOW = 5, 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; plain lower() only where all characters are ASCII, as it would change others too."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def _places(n: Column) -> Column:
    """0 .. n - 1, empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hashes(ws: str, k: int) -> Column:
    """Hashes of all k-word sequences of the array column ws."""
    return F.transform(_places(F.size(ws) - (k - 1)), lambda i: F.xxhash64(*(F.get(F.col(ws), i + j) for j in range(k))))


def _sequences(ws: str, k: int) -> Column:
    """All k-word sequences as texts. By get(): slice() walks and copies through Scala collections."""
    return F.transform(_places(F.size(ws) - (k - 1)), lambda i: F.concat_ws(" ", *(F.get(F.col(ws), i + j) for j in range(k))))


def _low(h: str, span: int) -> Column:
    return F.transform(_places(F.size(h) - span), lambda i: F.least(F.get(F.col(h), i), F.get(F.col(h), i + span)))


def fingerprints(df: DataFrame, ws: str, out: str) -> DataFrame:
    """Add the distinct window minima of the array of words; `h` holds all sequence hashes.

    What reads these arrays explodes them with explode_outer: explode would have the optimizer push its
    not-empty filter through the projections, each of which would then be computed again per element. For the same
    reason every step mentions its array more than once: an array mentioned once is computed inside the lambda.
    """
    df = df.withColumn("h", _hashes(ws, K)).withColumn("l2", _low("h", 1)).withColumn("l4", _low("l2", 2)).withColumn("l8", _low("l4", 4))
    assert WINDOW - K == 8
    return df.withColumn(out, F.array_distinct(F.transform(_places(F.size("l8") - 1), lambda i: F.least(F.get(F.col("l8"), i), F.get(F.col("h"), i + 8))))).drop("l2", "l4", "l8")


def _sized(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def _around(df: DataFrame, key: str) -> DataFrame:
    """(key, size, x) per place: its hash and the words around it only, so that long texts with many places stay small."""
    reach = WINDOW - K
    h, w = F.col("h"), F.col("w")
    near = lambda i: F.struct(i.alias("at"), F.get(h, i).alias("fp"), F.greatest(F.lit(0), i - reach).alias("base"), F.array(*(F.get(w, F.greatest(F.lit(0), i - reach) + j) for j in range(K + 2 * reach))).alias("near"))
    return df.select(key, F.size("w").alias("size"), F.transform("places", near).alias("xs")).select(key, "size", F.explode_outer("xs").alias("x")).where("x IS NOT NULL")


def hits(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(row, w, item_id, a, b): words [a, b) of a document row are a window of an item. docs: (row, w), bench: (item_id, w)."""
    long_items = fingerprints(bench.where(F.size("w") >= WINDOW), "w", "fps")
    prints = materialize(long_items.select("item_id", F.explode_outer("fps").alias("fp")).where("fp IS NOT NULL"), "bench-prints")
    lengths = [r["n"] for r in bench.where((F.size("w") > 0) & (F.size("w") < WINDOW)).groupBy(F.size("w").alias("n")).count().collect()]
    fits = small_enough(prints)
    known = prints.select("fp").distinct()
    marked = fingerprints(docs, "w", "fps").select("row", F.explode_outer("fps").alias("fp")).where("fp IS NOT NULL")
    rows = marked.join(_sized(known, fits), "fp").groupBy("row").agg(F.collect_set("fp").alias("found"))
    # Texts with a hit, their places of hit fingerprints, and each place's alignment with every place in an item.
    rows = materialize(rows, "hit-rows")
    some = docs.join(_sized(rows, small_enough(rows, BROADCAST_ROWS // 10)), "row")
    some = some.withColumn("h", _hashes("w", K)).withColumn("places", F.filter(_places(F.size("h")), lambda i: F.array_contains("found", F.get("h", i))))
    at = _around(some, "row").selectExpr("row", "size", "x.at AS p", "x.fp AS fp", "x.base AS base", "x.near AS near")
    of = _around(long_items.withColumn("places", _places(F.size("h"))), "item_id")
    of = of.selectExpr("item_id", "size AS length", "x.at AS q", "x.fp AS fp", "x.base AS origin", "x.near AS like")
    of = of.join(_sized(known, fits), "fp")
    first = F.greatest(F.lit(0), F.col("p") - (WINDOW - K), F.col("p") - F.col("q"))
    last = F.least(F.col("p"), F.col("size") - WINDOW, F.col("p") - F.col("q") + F.col("length") - WINDOW)
    aligned = at.join(_sized(of, fits), "fp").withColumn("first", first).withColumn("last", last).where("first <= last")
    grown = aligned.withColumn("starts", F.expr(f"filter(sequence(first, last), s -> forall(sequence(0, {WINDOW - 1}), j -> get(near, s - base + j) = get(like, s - p + q - origin + j)))"))
    out = grown.select("row", "item_id", F.explode_outer("starts").alias("a")).where("a IS NOT NULL").withColumn("b", F.col("a") + WINDOW)
    for n in sorted(lengths):
        own = bench.where(F.size("w") == n).select("item_id", F.concat_ws(" ", "w").alias("whole"))
        short = docs.where(F.size("w") >= n).select("row", F.posexplode_outer(_sequences("w", n)).alias("a", "whole"))
        out = out.union(short.join(_sized(own, small_enough(own)), "whole").select("row", "item_id", "a", (F.col("a") + n).alias("b")))
    return out.distinct()


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, n_words, n_hit, item_ids array<string>) of every document row, where `row` is (id, copy hash) of the row."""
    d = _rows(docs, id_col, text_col).withColumn("w", words(F.col("text")))
    found = hits(d.select("row", "w"), _items(bench, item_col, item_text))
    per = found.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per = per.select("row", "item_ids", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"] - 1))))).cast("long").alias("n_hit"))
    per = materialize(per, "contaminated")
    out = d.select("doc_id", "row", F.size("w").cast("long").alias("n_words")).join(_sized(per, small_enough(per, BROADCAST_ROWS // 10)), "row", "left")
    return out.select("doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def _items(bench: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id, w) of all items with an id and words."""
    return bench.select(bench[item_col].cast("string").alias("item_id"), words(bench[item_text]).alias("w")).where("item_id IS NOT NULL").where(F.size("w") > 0)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key that equal rows share and others don't: results are the same for equal rows."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return d.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text"))))


def _is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, bench: DataFrame, **names: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    c = contamination(docs, bench, **names)
    return c.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), _is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without any benchmark window, with all their columns: one hit word is enough to drop a row, however long it is.

    That is stricter than `contaminated` in report(), which asks for a twentieth of the words.
    """
    d = _rows(docs, id_col, text_col).select("row", words(F.col("text")).alias("w"))
    bad = materialize(hits(d, _items(bench, item_col, item_text)).select(F.col("row").alias("__row")).distinct(), "bad-rows")
    key = F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.hex(F.xxhash64(docs[text_col])))
    keyed = docs.select(F.struct("*").alias("__doc"), key.alias("__row"))
    kept = keyed.join(_sized(bad, small_enough(bad)), "__row", "left_anti")
    return kept.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))
