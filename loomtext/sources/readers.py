"""Sources: JSONL, text and dictionary files, and file catalogs. Paths go to Spark's readers only."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import rstrip


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def generated_run(spark: SparkSession, folder: str, run: str, schema: str = schemas.GENERATED) -> DataFrame:
    return jsonl(spark, f"{folder}/{run}.jsonl", schema)


def filtered_run(spark: SparkSession, folder: str, name: str, schema: str = schemas.GENERATED) -> DataFrame:
    return jsonl(spark, f"{folder}/{name}", schema)


def names(spark: SparkSession, path: str) -> DataFrame:
    """name, F, M, the counts as integers however they are written."""
    raw = spark.read.schema("name STRING, F STRING, M STRING").json(path)
    return raw.select("name", F.col("F").cast("double").cast("int").alias("F"), F.col("M").cast("double").cast("int").alias("M"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """`value`, one row per line, without trailing white space."""
    return spark.read.text(path).select(rstrip(F.col("value")).alias("value"))


def whole_text(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else spark.read.text(path, wholetext=True)


def event_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """event, pivotal_attributes of a JSON array; of a repeated event the last counts."""
    raw = spark.read.option("multiLine", True).schema("event STRING, pivotal_attributes MAP<STRING,STRING>").json(path)
    numbered = raw.withColumn("__i", F.monotonically_increasing_id())
    return numbered.groupBy("event").agg(F.max_by("pivotal_attributes", "__i").alias("pivotal_attributes"))


def category_attributes(spark: SparkSession, path: str) -> DataFrame:
    """category, attrs of one-key JSON lines; of a repeated key the last line counts."""
    return _last_entries(spark, path, "MAP<STRING, ARRAY<STRING>>").withColumnsRenamed({"k": "category", "v": "attrs"})


def attribute_values(spark: SparkSession, path: str) -> DataFrame:
    """attr, level, values of JSON lines of maps; of a repeated attribute the last line counts."""
    last = _last_entries(spark, path, "MAP<STRING, MAP<STRING, ARRAY<STRING>>>")
    return last.select(F.col("k").alias("attr"), F.explode("v").alias("level", "values"))


def _last_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.text(path).withColumn("__i", F.monotonically_increasing_id())
    return raw.select("__i", F.explode(F.from_json("value", kind)).alias("k", "v")).groupBy("k").agg(F.max_by("v", "__i").alias("v"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An optional JSONL file: empty, with the schema, where it is missing."""
    return jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): blank lines are skipped, unreadable ones set apart with their text."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r._corrupt_record IS NULL AND r IS NOT NULL").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r._corrupt_record IS NOT NULL OR r IS NULL").select("value")


def catalog(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """name, path, bytes, n_lines of the files below a folder, by name; a missing folder gives none.

    Blank lines count; empty files have none.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], "name STRING, path STRING, bytes LONG, n_lines LONG")
    # The file system lists the files (scans leave empty ones out); the lines are counted by Spark.
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing, found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listing.hasNext():
        s = listing.next()
        if fnmatch.fnmatchcase(str(s.getPath().getName()), pattern):
            found.append((str(s.getPath().toString()), str(s.getPath().toUri().getPath()), int(s.getLen())))
    files = spark.createDataFrame(found, "path string, k string, bytes long")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    counted = text.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_lines"))
    bare = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?/+", "/")
    out = files.join(counted.select(bare.alias("k"), "n_lines"), "k", "left")
    return out.select(F.element_at(F.split("k", "/"), -1).alias("name"), "path", "bytes", F.coalesce("n_lines", F.lit(0)).alias("n_lines")).orderBy("name", "path")


def inside(folder: str, path: str) -> bool:
    """Whether a path lies in a folder: by its parts, so siblings with a common prefix don't pass."""
    import posixpath

    root = posixpath.normpath(folder).split("/")
    return posixpath.normpath(posixpath.join(folder, path)).split("/")[: len(root)] == root


def load(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The readable rows of one file of a catalog."""
    if not inside(folder, name):
        raise PermissionError(f"{name} is outside {folder}")
    path = f"{folder}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return tolerant_jsonl(spark, path, schema)[0]
