"""Choosing attributes to abstract, drop or keep, reproducibly.

Attributes are in long form: record_id, group_name (null for single ones), attr_type, attr_value, ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.scores import closest, rank_weight, rouge1_recall

#: Shares of group choices against single choices, by method.
GROUP_SHARE = {"abstract": 0.5, "drop": 0.7, "keep": 0.8}


def rank_weights(df: DataFrame, *by: str, order: str = "ordinal") -> DataFrame:
    """Add rank and weight: 0.3 + 1 / rank, over their sum in the group."""
    w = Window.partitionBy(*by)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(order))).withColumn("__w", rank_weight(F.col("rank")))
    return out.withColumn("weight", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def normalise_weights(df: DataFrame, weight: str, *by: str) -> DataFrame:
    return df.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))


def cut_top(df: DataFrame, *by: str, rank: str = "rank") -> DataFrame:
    """The first two thirds of a group, rounded down, of more than three; all of fewer."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("__n", n).where((F.col("__n") <= 3) | (F.col(rank) <= F.floor(F.col("__n") * 2 / 3))).drop("__n")


def draw_attributes(df: DataFrame, n: str, *by: str, key: str = "record_id", site: str = "attr", mode: str = "observed", seed: int = 42) -> DataFrame:
    """n draws from each group, as distinct rows.

    "observed": each draw uniform, with replacement, so fewer than n rows may come back. "weighted": without
    replacement, by `weight`, as the ranks intend.
    """
    w = Window.partitionBy(*by)
    if mode == "weighted":
        u = draws.uniform(F.concat_ws(":", key, "attr_type"), site, seed)
        order = -F.log(F.greatest(u, F.lit(1e-12))) / F.col("weight")
        return df.withColumn("__r", F.row_number().over(w.orderBy(order, "attr_type"))).where(F.col("__r") <= F.col(n)).drop("__r")
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy("ordinal", "attr_type")) - 1).withColumn("__n", F.count("*").over(w))
    each = F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    picks = F.transform(each, lambda j: draws.draw(F.col(key), F.concat(F.lit(f"{site}:"), j.cast("string")), seed) % F.col("__n"))
    return numbered.where(F.array_contains(picks, F.col("__i").cast("long"))).drop("__i", "__n")


def resolve_names(df: DataFrame, answer: str, candidates: str, out: str, group: bool = True) -> DataFrame:
    """Add the candidate closest to a model's answer: 0.8 alike for groups, 0.2 for attributes. Exact answers skip Python."""
    best = closest(0.8 if group else 0.2)
    exact = F.array_contains(candidates, F.col(answer))
    fuzzy = best(F.when(~exact, F.col(answer)), F.when(~exact, F.col(candidates)))
    return df.withColumn(out, F.when(exact, F.col(answer)).otherwise(fuzzy))


def select(attrs: DataFrame, method: str, seed: int = 42, mode: str = "observed") -> DataFrame:
    """The targets of one method: whole groups or single attributes, as a record's draw says.

    Result: record_id, group_name, attr_type, attr_value, ordinal, sanitization.
    """
    rec = attrs.groupBy("record_id").agg(F.count_distinct("group_name").alias("n_groups"))
    rec = rec.withColumn("n", F.greatest(draws.selection_count(F.col("record_id"), F.greatest(F.col("n_groups"), F.lit(2)), method, seed), F.lit(1)))
    rec = rec.withColumn("by_group", draws.bernoulli(F.col("record_id"), f"group_{method}", GROUP_SHARE[method], seed) & (F.col("n_groups") > 0))
    groups = attrs.where("group_name IS NOT NULL").groupBy("record_id", "group_name").agg(F.min("ordinal").alias("ordinal")).withColumn("attr_type", F.col("group_name"))
    groups = cut_top(rank_weights(groups.join(rec.where("by_group"), "record_id"), "record_id"), "record_id")
    chosen = draw_attributes(groups, "n", "record_id", site=f"groups_{method}", mode=mode, seed=seed).select("record_id", "group_name")
    from_groups = attrs.join(chosen, ["record_id", "group_name"]).select("record_id", "group_name", "attr_type", "attr_value", "ordinal")
    single = attrs.where("group_name IS NULL").join(rec.where("NOT by_group"), "record_id")
    single = draw_attributes(cut_top(rank_weights(single, "record_id"), "record_id"), "n", "record_id", site=f"single_{method}", mode=mode, seed=seed)
    out = from_groups.unionByName(single.select("record_id", "group_name", "attr_type", "attr_value", "ordinal"))
    return out.withColumn("sanitization", F.lit(method))


def remove_selected(attrs: DataFrame, selected: DataFrame) -> DataFrame:
    """The pool without what was selected: a group takes its members' single attributes along, a single one leaves groups alone."""
    groups = selected.where("group_name IS NOT NULL").select("record_id", F.col("group_name").alias("__g")).distinct()
    keys = selected.select("record_id", F.col("attr_type").alias("__k")).distinct()
    left = attrs.join(groups, (attrs["record_id"] == groups["record_id"]) & (attrs["group_name"] == groups["__g"]), "left_anti")
    return left.join(keys, (left["record_id"] == keys["record_id"]) & left["group_name"].isNull() & (left["attr_type"] == keys["__k"]), "left_anti")


#: Which choice wins for an attribute chosen more than once: the order in which choices are observed to be
#: written (single choices after groups, abstract after drop), or the order of strictness.
PRIORITY = {"observed": {"abstract": 3, "drop": 2, "keep": 1}, "strict": {"drop": 3, "abstract": 2, "keep": 1}}


def resolve_options(chosen: DataFrame, order: str = "observed") -> DataFrame:
    """One option per record and attribute type."""
    table = F.create_map(*(F.lit(x) for kv in PRIORITY[order].items() for x in kv))
    p = table[F.col("sanitization")] + (F.when(F.col("group_name").isNull(), 10).otherwise(0) if order == "observed" else F.lit(0))
    best = F.max_by(F.struct("attr_value", "sanitization", "group_name", "ordinal"), F.struct(p, F.coalesce("group_name", F.lit(""))))
    return chosen.groupBy("record_id", "attr_type").agg(best.alias("b")).select("record_id", "attr_type", "b.*")


def keep_by_overlap(attrs: DataFrame, selected: DataFrame, seed: int = 42) -> DataFrame:
    """Attributes or groups to keep: none of their tokens among the selected values, keys not selected; one or two.

    Result: record_id, name, is_group, text. A record without selected values keeps nothing.
    """
    text = selected.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "attr_type", "attr_value"))), lambda x: x["attr_value"]), " ").alias("selected_text"))
    joined = lambda d, name, flag: d.groupBy("record_id", F.col(name).alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "attr_type", "attr_value"))), lambda x: x["attr_value"]), " ").alias("text"), F.lit(flag).alias("is_group"), F.min("ordinal").alias("ordinal"))
    pool = joined(attrs.where("group_name IS NULL"), "attr_type", False).unionByName(joined(attrs.where("group_name IS NOT NULL"), "group_name", True))
    scored = pool.join(text, "record_id").withColumn("score", rouge1_recall(F.col("selected_text"), F.col("text"))).where("score = 0")
    w = Window.partitionBy("record_id")
    n = F.when(draws.bernoulli(F.col("record_id"), "keep_n", 0.5, seed), 1).otherwise(2)
    ranked = scored.withColumn("__r", F.row_number().over(w.orderBy(draws.draw(F.concat_ws(":", "record_id", "name"), "keep", seed), "name"))).where(F.col("__r") <= n)
    keys = selected.select("record_id", F.col("attr_type").alias("name")).distinct()
    left = ranked.join(keys, ["record_id", "name"], "left_anti")
    any_group = F.max("is_group").over(w)
    grouped = any_group & draws.bernoulli(F.col("record_id"), "keep_group", 0.5, seed)
    return left.withColumn("__g", grouped).where(F.col("is_group") == F.col("__g")).select("record_id", "name", "is_group", "text")


def contains_either_way(left: DataFrame, right: DataFrame, key: str, a: str, b: str, order: str) -> DataFrame:
    """For each left row the first right row of its record whose text holds the left one, or is held by it."""
    j = left.join(right, key).where(F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)))
    return j.withColumn("__r", F.row_number().over(Window.partitionBy(key, a).orderBy(order))).where("__r = 1").drop("__r")


def pair_sequences(sequences: DataFrame, targets: DataFrame, key: str = "record_id") -> DataFrame:
    """Every sequence worth reading with every target of its own record: an equi-join, no global product."""
    from ..functions.text import is_skipped_sequence

    return sequences.where(~is_skipped_sequence(F.col("seq"))).join(targets, key)


def lookup(df: DataFrame, table: DataFrame, key: str | list[str], value: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """(found, errors): a dictionary lookup whose missing keys become error rows."""
    j = df.join(table, key, "left")
    keys = [key] if isinstance(key, str) else key
    missing = F.concat(F.lit("no entry for "), F.concat_ws(", ", *keys))
    return j.where(F.col(value).isNotNull()), j.where(F.col(value).isNull()).select(*keys, F.lit(stage).alias("stage"), F.lit("fail").alias("severity"), missing.alias("error"))


def build_instruction(targets: DataFrame, strategies: DataFrame, seed: int = 42) -> DataFrame:
    """(record_id, instruction): per target a sentence, or all strategies in one; keep targets in a quarter of the records."""
    line = F.when(F.col("sanitization") == "drop", F.concat(F.lit("Remove "), F.col("label"))).when(F.col("sanitization") == "keep", F.concat(F.lit("Keep "), F.col("label"))).otherwise(F.concat(F.lit("Generalize "), F.col("label"), F.lit(": "), F.coalesce("strategy", F.lit("make it less specific"))))
    t = targets.join(strategies, ["record_id", "label"], "left").where((F.col("sanitization") != "keep") | draws.bernoulli(F.col("record_id"), "with_keep", 0.25, seed))
    per = t.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"), F.coalesce("strategy", F.lit("")).alias("strategy")))).alias("x"))
    lines = F.array_join(F.transform("x", lambda x: F.concat(x["line"], F.lit("."))), " ")
    plain = F.array_join(F.filter(F.transform("x", lambda x: x["strategy"]), lambda s: s != ""), " ")
    templated = draws.bernoulli(F.col("record_id"), "templated", 0.5, seed) | (plain == "")
    return per.select("record_id", F.when(templated, lines).otherwise(plain).alias("instruction"))


def with_examples(instruction: Column, examples: Column, key: Column, seed: int = 42) -> Column:
    return F.when(draws.bernoulli(key, "with_examples", 0.5, seed) & examples.isNotNull(), F.concat_ws("\n", instruction, examples)).otherwise(instruction)
