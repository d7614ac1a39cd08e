"""Text functions. White space means Unicode white space throughout, as in Python's str methods."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..values import ABBR_PATTERNS, MARKER, REFUSALS, SKIPPED_SEQUENCES


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def clean_whitespace(c: Column) -> Column:
    """Blank lines between line ends collapse to one; blanks before a line end go."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\n\s+\n", "\n\n"), r"(?U)[^\S\r\n]+\n", "\n")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def text_hash(c: Column) -> Column:
    """Hex SHA-256 of a text."""
    return F.sha2(c, 256)


def composite_hash(*cols: Column) -> Column:
    """Hex SHA-256 of texts joined by blank lines."""
    return F.sha2(F.concat_ws("\n\n", *cols), 256)


def keyed_id(prefix: str, key: Column) -> Column:
    """prefix_<32 hex digits>, the same for the same key."""
    return F.concat(F.lit(prefix + "_"), F.md5(key.cast("string")))


def is_refusal(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.coalesce(low.startswith(REFUSALS[0]) | low.startswith(REFUSALS[1]), F.lit(False))


def is_too_short(c: Column, least: int = 32) -> Column:
    return word_count(F.coalesce(c, F.lit(""))) < least


def validate(c: Column, least: int = 32) -> Column:
    """The first check a record fails, or null: refusal before length."""
    return F.when(is_refusal(c), F.lit("fail:refusal")).when(is_too_short(c, least), F.lit("skip:too_short"))


def is_skipped_sequence(c: Column) -> Column:
    return c.isin(*SKIPPED_SEQUENCES)


def is_none_answer(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\.+|\.+$", "") == "none"


def error_route(c: Column) -> Column:
    """ok, skipped or error, by an error message."""
    return F.when(c.isNull(), "ok").when(c.startswith("skip:"), "skipped").otherwise("error")


def fix_punctuation(orig: Column, text: Column) -> Column:
    """Give a rewritten text the end marks of the original; blank texts stay."""
    end = lambda c, mark: rstrip(c).endswith(mark)
    t = F.when(end(orig, ".") & ~end(text, "."), F.concat(rstrip(text), F.lit("."))).when(~end(orig, ".") & end(text, "."), F.regexp_replace(rstrip(text), r"\.+$", "")).otherwise(text)
    for mark in ("?", "!"):
        t = F.when(end(orig, mark) & ~end(t, mark), F.concat(rstrip(t), F.lit(mark))).otherwise(t)
    return F.when(strip(text) == "", text).otherwise(t)


def keep_leading_space(orig: Column, text: Column) -> Column:
    """Give a rewritten text the leading blanks of an original that starts with a space."""
    n = F.length(orig) - F.length(F.regexp_replace(orig, r"(?U)^\s+", ""))
    return F.when(orig.startswith(" "), F.concat(F.repeat(F.lit(" "), n), strip(text))).otherwise(text)


def clean_completion(c: Column) -> Column:
    """A model's answer without thoughts and role marks; null becomes empty."""
    t = F.element_at(F.split(strip(F.coalesce(c, F.lit(""))), "</think>"), -1)
    return strip(F.regexp_replace(strip(t), r"(?i)^(assistant(?![a-rt-z0-9_])|</assistant>)\s*", ""))


def strip_fences(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def after_marker(c: Column, *markers: str) -> Column:
    """What stands between a marker and its next occurrence or the end, stripped, by the first of the markers that is there; without any, the stripped text."""
    out = strip(c)
    for m in reversed(markers):
        out = F.when(F.contains(c, F.lit(m)), strip(F.split_part(c, F.lit(m), F.lit(2)))).otherwise(out)
    return out


def strategy_class(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("drop")), "drop").when(F.contains(low, F.lit("keep")), "keep").otherwise("abstract")


def titled_key(c: Column) -> Column:
    """Underscores become spaces, every word's first letter a capital; other letters stay."""
    words = F.split(F.replace(c, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def highlight(c: Column, needle: str, left: str = "<mark>", right: str = "</mark>") -> Column:
    """Mark every occurrence of a literal, letters in either case."""
    return F.regexp_replace(c, "(?i)(" + re.escape(needle) + ")", f"{left}$1{right}") if needle else c


# Masking of dots that end no sentence. Each step sees what the steps before it left.

_STEPS = [(name, re.compile(p)) for name, p in ABBR_PATTERNS]
_UNMASK = re.compile("_(?:" + "|".join(dict.fromkeys(n for n, _ in ABBR_PATTERNS)) + ")_DOT_")


def mask_text(text: str) -> str:
    for name, pattern in _STEPS:
        text = pattern.sub(lambda m, n=name: m.group(0).replace(".", MARKER.format(n)), text)
    return text


def unmask_text(text: str) -> str:
    return _UNMASK.sub(".", text)


@F.pandas_udf(T.StringType())
def _mask(s: pd.Series) -> pd.Series:
    return s.map(mask_text, na_action="ignore")


def mask_dots(c: Column) -> Column:
    """Texts without a dot, and nulls, never reach Python."""
    return F.when(F.contains(c, F.lit(".")), _mask(c)).otherwise(c)


def unmask_dots(c: Column) -> Column:
    return F.regexp_replace(c, _UNMASK.pattern, ".")


# Span location: exact, then without quotes, then without marks; 0-based, end exclusive.


def lowered(c: Column) -> Column:
    """Small letters, one for each letter, so that places stay: lower() makes two of a dotted capital I and ends words in another sigma."""
    return F.lower(F.replace(F.replace(c, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def locate_span(seq: Column, found: Column, attr: Column) -> Column:
    """struct(start, end, span, confidence) of an answer in a sequence; null where it can't be found.

    1.0: the answer as it is, letters in either case; 0.95: stripped of quotes; 0.9: without * " and dots;
    0.3: for an answer starting with "none", the attribute value itself.
    """
    low = lowered(seq)

    def position(part: Column, confidence: float) -> Column:
        p = lowered(part)
        i = F.position(p, low)
        return F.when((p != "") & (i > 0), F.struct((i - 1).cast("int").alias("start"), (i - 1 + F.length(p)).cast("int").alias("end"), seq.substr(i, F.length(p)).alias("span"), F.lit(confidence).alias("confidence")))

    bare = F.regexp_replace(strip(found), "^[\"']+|[\"']+$", "")
    plain = strip(F.regexp_replace(found, '[*".]', ""))
    fallback = F.when(F.lower(strip(found)).startswith("none"), position(attr, 0.3))
    return F.coalesce(fallback, position(found, 1.0), position(bare, 0.95), position(plain, 0.9))


def split_answers(c: Column) -> Column:
    """Several spans in one answer stand between double bars; empty ones are dropped."""
    return F.filter(F.transform(F.split(c, r"\|\|"), strip), lambda x: x != "")
