"""The queries of this folder's operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, langid, quality, rules, secrets, sharding, sstable, toxicity
from ._util import crc_mod

#: Every pair of documents that shares a shingle, counted; then the transitive closure of the links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.v AS d, r.root FROM r JOIN e ON e.u = r.d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.d = d.doc_id
GROUP BY d.doc_id, n.n
"""

#: Every window of every item, as words, met with every window of the same length of every document.
DECONTAM_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+least(len(w), 13)-1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS i FROM d, k WHERE len(w) >= k.n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


#: Sharding keeps every row as it is.
SHARDING_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), crc_mod(F.col("doc_id"), 4) == 2
    out = quality.score(docs, quality.fit(docs, _labels(spark, sf_dir), learn=~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_docs(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), crc_mod(F.col("doc_id"), 5) == 0
    out = toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir), learn=~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_docs(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _docs(spark, sf_dir), crc_mod(F.col("doc_id"), 3) == 1
    out = langid.predict(docs, langid.fit(docs, learn=~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches, are compacted, and are read back with a digest of their text."""
    s = sharding.ShardSet(spark)
    s.append_arrivals(_docs(spark, sf_dir).withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "arrival")
    s.compact()
    return s.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(spark, sstable.write(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_toxicity, op4_quality_rules, op5_secrets, op6_langid, op7_decontaminate, op8_sharding, op9_bpe, op10_token_tables)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD_SQL, "op7_decontaminate": DECONTAM_SQL, "op8_sharding": SHARDING_SQL}
