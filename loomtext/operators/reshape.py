"""Reshaping of nested records. Maps merge with the later value winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..values import DEFAULT_INSTRUCTION, EXCLUDED_KEYS, LIST_KEYS, TYPE_INSTRUCTIONS


def merge_maps(a: Column, b: Column) -> Column:
    """a and b, b's values winning; independent of the session's rule for repeated keys."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def entries_to_map(pairs: Column, name: str = "name", value: str = "value") -> Column:
    """A list of name/value structs as a map; of repeated names the last counts."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y[name] == x[name]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x[name], x[value])))


def split_list_values(attrs: Column) -> Column:
    """Comma-separated texts of list keys as JSON lists, parts trimmed, empty ones dropped; other values stay."""
    parts = lambda v: F.to_json(F.filter(F.transform(F.split(v, ","), strip), lambda x: x != ""))
    return F.transform_values(attrs, lambda k, v: F.when(k.isin(*LIST_KEYS), parts(v)).otherwise(v))


def reformat_event(extras: Column, attributes: Column) -> Column:
    """An event's attributes: its other top-level values, overridden by the named ones."""
    return merge_maps(extras, split_list_values(entries_to_map(attributes)))


def combine_attributes(profile: Column, event: Column) -> Column:
    return merge_maps(profile, event)


def add_full_name(attrs: Column, first: str = "first_name", last: str = "last_name", full: str = "full_name") -> Column:
    has = lambda k: F.map_contains_key(attrs, k)
    return F.when(~has(full) & has(first) & has(last), merge_maps(attrs, F.create_map(F.lit(full), F.concat_ws(" ", attrs[first], attrs[last])))).otherwise(attrs)


def shareable(attrs: Column) -> Column:
    """The attributes without keys that are never shared."""
    return F.map_filter(attrs, lambda k, v: ~k.isin(*EXCLUDED_KEYS))


def indexed(attrs: Column) -> Column:
    """The entries as array<struct<ordinal, key, value>>, in their order."""
    return F.transform(F.map_entries(attrs), lambda e, i: F.struct(i.alias("ordinal"), e["key"].alias("key"), e["value"].alias("value")))


def explode_attributes(df: DataFrame, attrs: str, *keep: str) -> DataFrame:
    """One row per entry: kept columns, ordinal, attr_type, attr_value."""
    return df.select(*keep, F.posexplode_outer(F.map_entries(F.col(attrs))).alias("ordinal", "e")).where("e IS NOT NULL").select(*keep, "ordinal", F.col("e.key").alias("attr_type"), F.col("e.value").alias("attr_value"))


def resolve_clusters(df: DataFrame, attrs: str, clusters: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(groups, errors) of clusters of attribute indices; clusters may overlap, an index out of range is an error.

    groups: key, grouped map<cluster, map<attr, value>>; errors: key, stage, severity, error.
    """
    one = df.select(key, F.map_entries(attrs).alias("es"), F.explode(clusters).alias("c"))
    flat = one.select(key, "es", F.col("c.cluster_name").alias("g"), F.posexplode("c.attributes").alias("o", "i"))
    found = flat.withColumn("e", F.when((F.col("i") >= 0) & (F.col("i") < F.size("es")), F.get("es", F.col("i"))))
    errors = found.where("e IS NULL").select(key, F.lit("group").alias("stage"), F.lit("fail").alias("severity"), F.concat(F.lit("no attribute "), F.col("i").cast("string")).alias("error")).distinct()
    inner = found.where("e IS NOT NULL").groupBy(key, "g").agg(F.sort_array(F.collect_list(F.struct("o", "e"))).alias("x"))
    inner = inner.select(key, "g", entries_to_map(F.transform("x", lambda x: F.struct(x["e"]["key"].alias("name"), x["e"]["value"].alias("value")))).alias("m"))
    groups = inner.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "m"))).alias("grouped"))
    return groups.join(errors.select(key).distinct(), key, "left_anti"), errors


def explode_groups(df: DataFrame, grouped: str, key: str) -> DataFrame:
    """map<group, map<attr, value>> as rows: key, group_name, ordinal, attr_type, attr_value."""
    g = df.select(key, F.explode(grouped).alias("group_name", "m"))
    return g.select(key, "group_name", F.posexplode(F.map_entries("m")).alias("ordinal", "e")).select(key, "group_name", "ordinal", F.col("e.key").alias("attr_type"), F.col("e.value").alias("attr_value"))


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """All leaves of nested structs as columns named by their path."""

    def leaves(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))

    return df.select(*leaves(df.schema, []))


def flatten_variant(df: DataFrame, json: str, key: str, depth: int = 8) -> DataFrame:
    """(key, path, value) of all leaves of a JSON object with open keys, down to `depth` levels."""
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    out = None
    for i in range(depth):
        level.createOrReplaceTempView("__variant")
        rows = df.sparkSession.sql(f"SELECT `{key}`, concat(t.path, CASE WHEN t.path = '' THEN '' ELSE '.' END, x.key) AS path, x.value AS v FROM __variant t, LATERAL variant_explode(t.v) x WHERE x.key IS NOT NULL")
        rows = rows.withColumn("nested", F.schema_of_variant("v").startswith("OBJECT"))
        leaves = rows.where("NOT nested" if i + 1 < depth else "true").select(key, "path", F.to_json("v").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = rows.where("nested").select(key, "path", "v")
    return out


def instruction_for(attr_type: Column) -> Column:
    """What an extraction prompt says for an attribute type."""
    table = F.create_map(*(F.lit(x) for kv in TYPE_INSTRUCTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(attr_type)), F.lit(DEFAULT_INSTRUCTION))


def zip_shorter(a: Column, b: Column, left: str = "left", right: str = "right") -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias(left), y.alias(right)))


def attach_answers(attrs: Column, answers: Column) -> Column:
    """array<struct<attr, answer>>: the i-th answer to the i-th attribute, null where there is none."""
    return F.transform(attrs, lambda x, i: F.struct(x.alias("attr"), F.get(answers, i).alias("answer")))


def spaced(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def target_labels(groups: Column, singles: Column) -> Column:
    """Group names, then "key with spaces, value" of single attributes; null parts count as empty."""
    none = F.array().cast("array<string>")
    own = F.transform(F.map_entries(singles), lambda e: F.concat_ws(", ", spaced(e["key"]), e["value"]))
    return F.concat(F.coalesce(groups, none), F.coalesce(own, none))


def keep_sentence(target: Column) -> Column:
    return F.concat(F.lit("Keep "), target, F.lit(" as it is."))


def drop_sentence(target: Column) -> Column:
    return F.concat(F.lit("Remove all mentions of "), target, F.lit("."))


def fill(template: str, *slots: Column) -> Column:
    """A template with {} slots filled in order."""
    parts = template.split("{}")
    assert len(parts) == len(slots) + 1
    return F.concat(F.lit(parts[0]), *(x for s, p in zip(slots, parts[1:], strict=True) for x in (F.coalesce(s.cast("string"), F.lit("")), F.lit(p))))


def nest(df: DataFrame, key: str, order: str, *fields: str, name: str = "items") -> DataFrame:
    """One row per key, its rows as an ordered array of structs."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def unnest(df: DataFrame, key: str, items: str, inner: str | None = None) -> DataFrame:
    """One row per element, and per element of an inner array; empty arrays give no rows."""
    out = df.select(key, F.posexplode(items).alias("pos", "item"))
    if inner:
        out = out.select(key, "pos", "item", F.posexplode(f"item.{inner}").alias("inner_pos", "inner_item"))
    return out


def profile_log(df: DataFrame, record: str, profile: str) -> DataFrame:
    return df.select(F.struct(F.col(record).alias("record"), F.col(profile).alias("profile")).alias("log"))
