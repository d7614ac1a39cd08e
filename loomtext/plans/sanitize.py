"""Sanitizing records: segment, select, find spans, rewrite, rebuild, instruct, probe.

Segments are keyed by record and index, so copies of a sequence are all sanitized. Any answer that is empty counts
as no answer. One span that can't be found, or a target without spans, fails its record, as an error row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import after_marker, fix_punctuation, is_none_answer, keep_leading_space, locate_span, split_answers
from ..operators import reshape, segment, select, spans
from ..storage import materialized
from .seam import Model, complete, failed

EXTRACT = "Copy the parts of the target text that reveal the value, parted by ||, or answer none.\nType: {}\nValue: {}\nHint: {}\nTarget: {}"
STRATEGY = "In one sentence, how should this be made less specific?\nType: {}\nValue: {}\nSeen in: {}"
ABSTRACT = "Rewrite the sequence by the strategy.\nStrategy: {}\nSpans: {}\nSequence: {}"
DROP = "Rewrite the sequence without the value.\nValue: {}\nSpans: {}\nSequence: {}"
RANK = "Number these attributes from most to least sensitive.\n{}"
PROBE = "What is the {} of the person in this text? Answer with the value.\nText: {}"
CLOSEST = "Which of these attributes is {} these? Answer with a numbered list.\nAttributes: {}\nThese: {}"


def weigh(attrs: DataFrame, model: Callable[[], Model] | None = None) -> DataFrame:
    """Weights of a record's attributes: all one, or by the model's ranking."""
    if model is None:
        return attrs.withColumn("weight", F.lit(1.0))
    per = attrs.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "attr_type"))).alias("x")).withColumn("names", F.transform("x", lambda x: x["attr_type"]))
    asked = complete(per.withColumn("__p", reshape.fill(RANK, F.array_join("names", "\n"))), "__p", "__a", model).withColumn("answers", parse.ordered_list(F.col("__a")))
    each = asked.select("record_id", "names", F.posexplode("answers").alias("ordinal", "answer"))
    named = select.resolve_names(each, "answer", "names", "attr_type", group=False).where("attr_type IS NOT NULL")
    first = named.groupBy("record_id", "attr_type").agg(F.min("ordinal").alias("ordinal"))
    ranked = select.rank_weights(first, "record_id").select("record_id", "attr_type", "weight")
    return attrs.join(ranked, ["record_id", "attr_type"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def choose(attrs: DataFrame, seed: int = 42, mode: str = "observed", order: str = "observed") -> DataFrame:
    """Targets of all three methods, one option per attribute: abstract, then drop from what is left, then keep."""
    attrs = materialized(attrs, "attributes")
    a = materialized(select.select(attrs, "abstract", seed, mode), "abstract")
    rest = materialized(select.remove_selected(attrs, a), "rest")
    d = materialized(select.select(rest, "drop", seed, mode), "drop")
    chosen = a.unionByName(d)
    kept = select.keep_by_overlap(select.remove_selected(rest, d), chosen, seed)
    k = attrs.join(kept.where("NOT is_group").select("record_id", F.col("name").alias("attr_type")), ["record_id", "attr_type"]).where("group_name IS NULL")
    g = attrs.join(kept.where("is_group").select("record_id", F.col("name").alias("group_name")), ["record_id", "group_name"])
    keep = k.unionByName(g).select("record_id", "group_name", "attr_type", "attr_value", "ordinal").withColumn("sanitization", F.lit("keep"))
    return materialized(select.resolve_options(chosen.unionByName(keep), order), "targets")


def find_spans(sequences: DataFrame, targets: DataFrame, model: Callable[[], Model]) -> tuple[DataFrame, DataFrame]:
    """(spans, errors): spans are record_id, idx, attr_type, attr_value, sanitization, start, end, span, confidence."""
    pairs = select.pair_sequences(sequences, targets.where("sanitization <> 'keep'"))
    asked = complete(pairs.withColumn("__p", reshape.fill(EXTRACT, F.col("attr_type"), F.col("attr_value"), reshape.instruction_for(F.col("attr_type")), F.concat("seq", "terminator"))), "__p", "answer", model)
    said = asked.where(~failed(F.col("answer")) & ~is_none_answer(F.col("answer"))).withColumn("found", F.explode(split_answers(F.col("answer"))))
    said = said.withColumn("s", locate_span(F.col("seq"), F.col("found"), F.col("attr_value")))
    good = said.where("s IS NOT NULL").select("record_id", "idx", "attr_type", "attr_value", "sanitization", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.span", "s.confidence")
    lost = said.where("s IS NULL").select("record_id", F.lit("extract").alias("stage"), F.lit("fail").alias("severity"), F.concat(F.lit("no span for "), "attr_type").alias("error"))
    without = targets.where("sanitization <> 'keep'").join(good.select("record_id", "attr_type").distinct(), ["record_id", "attr_type"], "left_anti")
    empty = without.select("record_id", F.lit("extract").alias("stage"), F.lit("fail").alias("severity"), F.concat(F.lit("nothing found for "), "attr_type").alias("error"))
    errors = lost.unionByName(empty).distinct()
    return good.join(errors.select("record_id").distinct(), "record_id", "left_anti"), errors


def merged_spans(found: DataFrame) -> DataFrame:
    """Overlapping spans of a sequence as one; the text is the source's, the confidence weighted by length."""
    i = spans.islands(found, "record_id", "idx")
    g = i.groupBy("record_id", "idx", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        spans.merged_confidence(F.col("confidence"), F.greatest(F.col("end") - F.col("start"), F.lit(1))).alias("confidence"),
        spans.first_seen("start", "attr_type").alias("attr_types"),
        F.array_sort(F.collect_set("sanitization")).alias("options"),
    )
    return g.drop("island")


def strategies(found: DataFrame, sequences: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """(record_id, attr_type, strategy): asked for what is abstracted, fixed for what is dropped."""
    seen = found.join(sequences.select("record_id", "idx", "seq"), ["record_id", "idx"])
    per = seen.groupBy("record_id", "attr_type", "attr_value", "sanitization").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("idx", "seq"))), lambda x: x["seq"]), " ").alias("text"))
    label = F.concat_ws(", ", reshape.spaced(F.col("attr_type")), "attr_value")
    asked = complete(per.withColumn("__p", F.when(F.col("sanitization") == "abstract", reshape.fill(STRATEGY, F.col("attr_type"), F.col("attr_value"), F.col("text")))), "__p", "__a", model)
    return asked.select("record_id", "attr_type", "attr_value", "sanitization", F.when(F.col("sanitization") == "abstract", after_marker(F.col("__a"), "Instruction:")).otherwise(reshape.drop_sentence(label)).alias("strategy"))


def rewrite(sequences: DataFrame, found: DataFrame, plans: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """Sequences rewritten, one target after another: each rewrite starts from the text that the one before left.

    As many rounds as the sequence with most targets has; a sequence without a target in a round passes it. Each round is
    written out, so many rounds don't make one long plan.
    """
    work = found.groupBy("record_id", "idx", "attr_type").agg(F.array_join(spans.first_seen("start", "span"), "; ").alias("texts")).join(plans, ["record_id", "attr_type"])
    order = F.row_number().over(Window.partitionBy("record_id", "idx").orderBy("attr_type"))
    work = work.withColumn("round", order)
    work = materialized(work, "work")
    rounds = work.agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    cur = sequences
    for i in range(1, rounds + 1):
        step = work.where(F.col("round") == i).select("record_id", "idx", "texts", "strategy", "sanitization", "attr_value")
        j = cur.join(step, ["record_id", "idx"], "left")
        prompt = F.when(F.col("sanitization") == "drop", reshape.fill(DROP, F.col("attr_value"), F.col("texts"), F.col("seq"))).when(F.col("sanitization").isNotNull(), reshape.fill(ABSTRACT, F.col("strategy"), F.col("texts"), F.col("seq")))
        j = complete(j.withColumn("__p", prompt), "__p", "__new", model, clean=True)
        new = F.when(~failed(F.col("__new")), after_marker(F.col("__new"), "Sanitized Text:", "Sanitized text:", "sanitized text:"))
        cur = materialized(j.withColumn("seq", F.coalesce(new, F.col("seq"))).select(*sequences.columns), "rewritten")
    return cur


def restored(original: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Rewritten sequences with the original's end marks and leading blanks; untouched ones are untouched."""
    o = original.select("record_id", "idx", F.col("seq").alias("__o"))
    j = rewritten.join(o, ["record_id", "idx"])
    fixed = keep_leading_space(F.col("__o"), fix_punctuation(F.col("__o"), F.col("seq")))
    return j.withColumn("seq", F.when(F.col("seq") == F.col("__o"), F.col("seq")).otherwise(fixed)).drop("__o")


def rebuilt(sequences: DataFrame) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("idx", "seq", "terminator")))
    return sequences.groupBy("record_id").agg(s.alias("s")).select("record_id", segment.rebuild(F.col("s")).alias("text"))


def probe(records: DataFrame, targets: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """What a model guesses for each target from the original text; see spans.under_sanitized()."""
    j = targets.join(records.select("record_id", "text"), "record_id")
    return complete(j.withColumn("__p", reshape.fill(PROBE, reshape.spaced(F.col("attr_type")), F.col("text"))), "__p", "guess", model).drop("__p", "text")


def keep_by_model(attrs: DataFrame, selected: DataFrame, model: Callable[[], Model], closest: bool = False) -> DataFrame:
    """Attributes to keep that a model names as farthest from (or closest to) the selected ones, matched by containment."""
    listed = lambda d, out: d.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("attr_type")), "\n").alias(out))
    per = listed(attrs, "pool").join(listed(selected, "these"), "record_id")
    asked = complete(per.withColumn("__p", reshape.fill(CLOSEST, F.lit("closest to" if closest else "farthest from"), F.col("pool"), F.col("these"))), "__p", "__a", model)
    said = asked.select("record_id", F.explode(parse.ordered_list(F.col("__a"))).alias("answer"))
    hit = select.contains_either_way(said, attrs.select("record_id", "attr_type", "attr_value", "ordinal"), "record_id", "answer", "attr_type", "ordinal")
    return hit.join(selected.select("record_id", "attr_type"), ["record_id", "attr_type"], "left_anti").drop("answer")


def abstract_only(plans: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """Attribute values rewritten by their strategies, without a text around them."""
    return complete(plans.withColumn("__p", reshape.fill(ABSTRACT, F.col("strategy"), F.lit(""), F.col("attr_value"))), "__p", "abstracted", model).drop("__p")


def run(records: DataFrame, attrs: DataFrame, model: Callable[[], Model], seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, mapping, errors) of records (record_id, text) and their attributes in long form.

    A record without targets comes back as it is, but for outer white space; one with an error is in errors only.
    """
    cut = materialized(segment.explode_sequences(segment.segments(records, "text"), "record_id"), "sequences")
    targets = choose(attrs, seed)
    found, errors = find_spans(cut, targets, model)
    found, errors = materialized(found, "spans"), materialized(errors, "errors")
    good = cut.join(errors.select("record_id").distinct(), "record_id", "left_anti")
    plans = strategies(found, good, model)
    new = materialized(restored(good, rewrite(good, found, plans, model)), "rewritten")
    mapping = spans.sequence_mapping(good, new, found.withColumnRenamed("sanitization", "option"), "record_id")
    return rebuilt(new), mapping, errors
