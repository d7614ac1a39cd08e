"""Generating records: seeds, profiles, priors, drafts, refinement and attributes, over the model seam.

Every step takes and gives a DataFrame; rows that fail carry `error` and skip the model from then on, and
success_and_errors() parts them at the end. Prompts are this library's own wording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, parse
from ..functions.scores import accepts
from ..functions.text import composite_hash, strip_fences, text_hash, validate
from ..operators import reshape
from ..values import MORALITY, MORALITY_WEIGHTS
from .seam import Model, complete, failed

MARITAL = ["Single", "Married", "Divorced", "Widowed"]
INCOME = ["Lower", "Lower middle", "Middle", "Upper middle", "Upper"]
STYLES = ["formal", "formal", "formal", "informal"]

PROFILE = "Write a profile as JSON with the keys profile (name/value pairs) and events.\nSeed: {}\nEvents: {}"
TYPES = "List record types, numbered, that would mention {} of this person.\nProfile: {}"
SITUATION = "Describe the situation in which this record comes about.\nType: {}\nShared: {}\nProfile: {}"
FORMAT = "Name a {} format for this record.\nType: {}\nSituation: {}"
DRAFT = "Write the record.\nType: {}\nSituation: {}\nFormat: {}"
REFINE = "Rewrite the record to be more specific and varied.\nType: {}\nRecord: {}"
JUDGE = "Which record is better, 1 or 2?\n1: {}\n2: {}"
ATTRIBUTES = "List the attributes of the record as a JSON object of names and values.\nRecord: {}"
GROUPS = "Group these attributes as JSON, [{{\"cluster_name\": ..., \"attributes\": [indices]}}].\nAttributes: {}"
FINAL = "Finish the record in its format.\nFormat: {}\nRecord: {}"


def seeds(spark: SparkSession, n: int, names: DataFrame, languages: list[str], blood_types: list[str], countries: list[str] | None = None, other_characteristics: bool = False, seed: int = 42) -> DataFrame:
    """n seed rows: id and an attribute map, each drawn by the row's number."""
    k = F.col("seed_id")
    table = names.select(F.struct("name", "F", "M").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    d = spark.range(n).select(F.col("id").alias("seed_id")).join(F.broadcast(table)).withColumn("r", draws.choice(k, "name", F.col("rs"), seed))
    arr = lambda xs: F.array(*(F.lit(x) for x in xs))
    values = {
        "First Name": F.col("r.name"),
        "Date": F.date_format(draws.random_date(k, "date", "2000-01-01", "2023-12-31", seed), "yyyy-MM-dd"),
        "Age": draws.random_age(k, seed=seed).cast("string"),
        "Marital Status": draws.choice(k, "marital", arr(MARITAL), seed),
        "Income Class": draws.choice(k, "income", arr(INCOME), seed),
        "Morality level": draws.weighted_choice(k, "morality", MORALITY, MORALITY_WEIGHTS, seed),
        "Native Language": draws.choice(k, "language", arr(languages), seed),
        "Blood Type": draws.choice(k, "blood", arr(blood_types), seed),
    }
    if other_characteristics:
        values |= {
            "Sex at Birth": draws.weighted_pair(k, "sex", F.lit("female"), F.lit("male"), F.col("r.F"), F.col("r.M"), seed),
            "Country of Birth": draws.choice(k, "country", arr(countries or []), seed),
            "Disability Status": draws.choice(k, "disability", arr(["Yes", "No"]), seed),
        }
    return d.select("seed_id", F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v))).alias("seed"))


def _ask(df: DataFrame, prompt: Column, out: str, model: Callable[[], Model], stage: str) -> DataFrame:
    """Ask for rows without an error; an empty answer becomes the stage's error."""
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    asked = complete(df.withColumn("__p", F.when(F.col("error").isNull(), prompt)), "__p", out, model)
    return asked.withColumn("error", F.coalesce("error", F.when(failed(F.col(out)), F.lit(f"fail:{stage}")))).drop("__p")


def profiles(seeded: DataFrame, events: Column, model: Callable[[], Model]) -> DataFrame:
    """Adds profile (map), event_list, profile_text and profile_id; unreadable JSON is an error."""
    d = _ask(seeded, reshape.fill(PROFILE, F.to_json("seed"), events), "profile_text", model, "profile")
    shape = "profile ARRAY<STRUCT<name: STRING, value: STRING>>, events ARRAY<STRUCT<event: STRING, attributes: ARRAY<STRUCT<name: STRING, value: STRING>>>>"
    d = d.withColumn("__j", F.from_json(strip_fences(F.col("profile_text")), shape))
    d = d.withColumn("error", F.coalesce("error", F.when(F.col("__j.profile").isNull(), F.lit("fail:profile_json"))))
    event = lambda e: F.struct(e["event"].alias("event"), reshape.split_list_values(reshape.entries_to_map(e["attributes"])).alias("attributes"))
    d = d.withColumn("profile", reshape.entries_to_map(F.col("__j.profile"))).withColumn("event_list", F.transform("__j.events", event))
    return d.withColumn("profile_id", text_hash(F.col("profile_text"))).drop("__j")


def share_attribute(df: DataFrame, seed: int = 42) -> DataFrame:
    """Adds attr_to_share, one entry of the profile that may be shared."""
    return df.withColumn("attr_to_share", draws.choice(F.col("seed_id"), "share", F.map_entries(reshape.shareable(F.col("profile"))), seed))


def priors(df: DataFrame, model: Callable[[], Model], retry: Callable[[], Model] | None = None, top_n: int = 10, seed: int = 42) -> DataFrame:
    """Adds record_type, situation, format; each step stops at the first error. An empty list of types is asked for once more."""
    attr = F.concat_ws(": ", reshape.spaced(F.col("attr_to_share.key")), F.col("attr_to_share.value"))
    prompt = reshape.fill(TYPES, attr, F.to_json("profile"))
    d = _ask(df, prompt, "types_text", model, "types").withColumn("types", F.slice(parse.ordered_list(F.col("types_text")), 1, top_n))
    if retry:
        empty = F.col("error").isNull() & (F.size("types") == 0)
        d = complete(d.withColumn("__p", F.when(empty, prompt)), "__p", "__again", retry).withColumn("types", F.when(empty, F.slice(parse.ordered_list(F.col("__again")), 1, top_n)).otherwise(F.col("types"))).drop("__p", "__again")
    d = d.withColumn("record_type", draws.choice(F.col("seed_id"), "type", F.col("types"), seed)).withColumn("error", F.coalesce("error", F.when(F.col("record_type").isNull(), F.lit("fail:no_types"))))
    d = _ask(d, reshape.fill(SITUATION, F.col("record_type"), attr, F.to_json("profile")), "situation", model, "situation").withColumn("situation_id", text_hash(F.col("situation")))
    style = draws.choice(F.col("seed_id"), "style", F.array(*(F.lit(s) for s in STYLES)), seed)
    return _ask(d, reshape.fill(FORMAT, style, F.col("record_type"), F.col("situation")), "format", model, "format")


def drafts(df: DataFrame, model: Callable[[], Model], retry: Callable[[], Model] | None = None) -> DataFrame:
    """Adds record_text; one more try for an empty answer."""
    prompt = reshape.fill(DRAFT, F.col("record_type"), F.col("situation"), F.col("format"))
    d = df.withColumn("__p", F.when(F.col("error").isNull(), prompt))
    d = complete(d, "__p", "record_text", model)
    if retry:
        d = complete(d.withColumn("__q", F.when(failed(F.col("record_text")), F.col("__p"))), "__q", "__again", retry).withColumn("record_text", F.coalesce("__again", "record_text")).drop("__q", "__again")
    return d.withColumn("error", F.coalesce("error", F.when(failed(F.col("record_text")), F.lit("fail:draft")))).drop("__p")


def judge(df: DataFrame, old: str, new: str, out: str, model: Callable[[], Model], site: str, seed: int = 42) -> DataFrame:
    """Adds 1 where the model prefers the new record, else 0; which one is shown first is drawn."""
    swap = draws.bernoulli(F.col("seed_id"), f"swap:{site}", 0.5, seed)
    prompt = reshape.fill(JUDGE, F.when(swap, F.col(new)).otherwise(F.col(old)), F.when(swap, F.col(old)).otherwise(F.col(new)))
    d = complete(df.withColumn("__p", F.when(F.col("error").isNull() & F.col(new).isNotNull(), prompt)), "__p", "__v", model)
    vote = F.when(F.contains("__v", F.lit("2")), ~swap).when(F.contains("__v", F.lit("1")), swap).otherwise(F.lit(False))
    return d.withColumn(out, vote.cast("int")).drop("__p", "__v")


def refine(df: DataFrame, model: Callable[[], Model], judge_model: Callable[[], Model], novelty: Callable[[DataFrame, str, str], DataFrame], steps: int = 2, seed: int = 42) -> DataFrame:
    """`steps` proposals, each taken if half the vote plus half the novelty exceeds one half; keeps both lists.

    `novelty` adds the column `novelty` for an old and a new text column.
    """
    none = F.array().cast("array<string>")
    d = df.withColumn("accepted_records", none).withColumn("rejected_records", none)
    for i in range(steps):
        d = complete(d.withColumn("__p", F.when(F.col("error").isNull(), reshape.fill(REFINE, F.col("record_type"), F.col("record_text")))), "__p", "__new", model).drop("__p")
        d = d.withColumn("__new", F.when(~failed(F.col("__new")), F.col("__new")))
        d = novelty(judge(d, "record_text", "__new", "llm_win", judge_model, str(i), seed), "record_text", "__new")
        ok = F.coalesce(accepts(F.col("llm_win"), F.col("novelty")), F.lit(False))
        d = d.withColumn("__ok", ok & F.col("__new").isNotNull())
        d = d.withColumn("accepted_records", F.when(F.col("__ok"), F.array_append("accepted_records", F.col("__new"))).otherwise(F.col("accepted_records")))
        d = d.withColumn("rejected_records", F.when(~F.col("__ok") & F.col("__new").isNotNull(), F.array_append("rejected_records", F.col("__new"))).otherwise(F.col("rejected_records")))
        d = d.withColumn("record_text", F.when(F.col("__ok"), F.col("__new")).otherwise(F.col("record_text"))).drop("__new", "__ok", "llm_win", "novelty")
    return d.withColumn("error", F.coalesce("error", validate(F.col("record_text"))))


def finish(df: DataFrame, model: Callable[[], Model]) -> DataFrame:
    return _ask(df, reshape.fill(FINAL, F.col("format"), F.col("record_text")), "final_text", model, "final")


def attributes(df: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """Adds profile_attrs, event_attrs and grouped_attributes; a record without event attributes is an error."""
    d = _ask(df, reshape.fill(ATTRIBUTES, F.col("record_text")), "__a", model, "attributes")
    d = d.withColumn("event_attrs", F.from_json(strip_fences(F.col("__a")), "map<string,string>"))
    d = d.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.size("event_attrs"), F.lit(0)) < 1, F.lit("skip:no_event_attrs"))))
    named = F.map_filter("profile", lambda k, v: F.contains(F.lower("record_text"), F.lower(v)))
    d = d.withColumn("profile_attrs", reshape.add_full_name(named)).withColumn("all_attrs", reshape.combine_attributes(F.col("profile_attrs"), F.col("event_attrs")))
    listed = F.to_json(F.transform(F.map_entries("all_attrs"), lambda e, i: F.struct(i.alias("index"), e["key"].alias("name"))))
    d = _ask(d, F.concat(F.lit(GROUPS.split("{}")[0].replace("{{", "{").replace("}}", "}")), listed), "__g", model, "groups")
    d = d.withColumn("clusters", F.from_json(strip_fences(F.col("__g")), "array<struct<cluster_name: string, attributes: array<int>>>"))
    groups, errors = reshape.resolve_clusters(d.where("error IS NULL"), "all_attrs", "clusters", "seed_id")
    d = d.join(groups.withColumnRenamed("grouped", "grouped_attributes"), "seed_id", "left").join(errors.groupBy("seed_id").agg(F.min("error").alias("__e")), "seed_id", "left")
    return d.withColumn("error", F.coalesce("error", F.concat(F.lit("fail:"), F.col("__e")))).drop("__a", "__g", "__e")


def envelope(df: DataFrame) -> DataFrame:
    """The generated record."""
    return df.select(
        composite_hash(F.col("profile_text"), F.col("situation"), F.col("record_text")).alias("id"),
        "format",
        F.struct(F.col("seed").alias("initial_demographic_seed"), F.to_json("event_list").alias("events_string"), F.col("profile_text").alias("generated_profile_string"), "profile", "event_list", F.col("profile_id").alias("id"), F.struct(F.col("attr_to_share.key").alias("attr_type"), F.col("attr_to_share.value").alias("attr_value")).alias("attr_to_share")).alias("profile"),
        F.struct(F.col("situation").alias("text"), F.lit(None).cast("string").alias("prompt"), F.col("situation_id").alias("id")).alias("situation"),
        F.struct(F.col("record_text").alias("text"), F.lit(None).cast("string").alias("prompt"), F.col("record_type").alias("type"), text_hash(F.col("record_text")).alias("id"), "accepted_records", "rejected_records", F.struct(F.col("profile_attrs").alias("profile"), F.col("event_attrs").alias("event")).alias("attributes"), "grouped_attributes").alias("record"),
    )


def success_and_errors(df: DataFrame, key: str = "seed_id") -> tuple[DataFrame, DataFrame]:
    bad = df.where("error IS NOT NULL").select(F.col(key).cast("string").alias("record_id"), F.lit("generate").alias("stage"), F.substring_index("error", ":", 1).alias("severity"), "error")
    return envelope(df.where("error IS NULL")), bad
