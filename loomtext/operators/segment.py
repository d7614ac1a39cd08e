"""Cutting texts into short sequences, and putting them together again.

A text is split at blank lines; a piece below the limit is a sequence. A longer one is halved, by lines if it has
several, else by sentences, until every part is below the limit. Parts keep every character (the delimiter at a
cut becomes the sequence's terminator or stays with it), so rebuild(segment(x)) is x without outer white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_text, strip, unmask_text

LIMIT = 512
_SENTENCE = re.compile(r"(?<=\.)\s+")
_SEQUENCES = "array<struct<seq:string,terminator:string,idx:int,start:int>>"
_FIELDS = pa.struct([("seq", pa.string()), ("terminator", pa.string()), ("idx", pa.int32()), ("start", pa.int32())])
#: Bytes of text that are Python objects at once; a longer text is taken alone.
AT_ONCE = 1 << 19


def runs(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """A batch in order, in runs of so many bytes at most or of one text."""
    lo, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > lo and held + n > most:
            yield texts.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    yield texts.slice(lo)


def _lists(cut: Callable[[str], list], returns: str, kind: pa.DataType) -> Callable[[Column], Column]:
    """A function of a column of texts that gives a list for each. Lists leave by runs, so a task's memory is that of
    one Arrow batch and one run, however many rows and whatever texts it has."""

    @F.arrow_udf(returns)
    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for run in runs(batch):
                yield pa.array([None if t is None else cut(t) for t in run.to_pylist()], pa.list_(kind))

    return lists


def halves_by_line(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key, idx, seq): texts halved by lines until below the limit or down to one line.

    Halving needs no other row, so there is no shuffle; texts below the limit never reach Python.
    """

    def parts(ls: list[str]) -> list[str]:
        whole = "\n".join(ls)
        if len(whole) < limit or len(ls) < 2:
            return [whole]
        m = len(ls) // 2
        return parts(ls[:m]) + parts(ls[m:])

    cut = _lists(lambda t: parts(t.split("\n")), "array<string>", pa.string())
    t = F.coalesce(F.col(text), F.lit(""))
    is_long = (F.length(t) >= limit) & F.contains(t, F.lit("\n"))
    d = df.select(F.col(key), F.when(is_long, cut(F.when(is_long, t))).otherwise(F.array(t)).alias("__parts"))
    return d.select(key, F.posexplode_outer("__parts").alias("idx", "seq"))


def _halved(part: str, limit: int, cuts: re.Pattern) -> list[str]:
    """Halve at the cuts until every part is short or has none; the parts joined are the text."""
    ends = [m.end() for m in cuts.finditer(part)]
    ends = [e for e in ends if e < len(part)]
    if len(part) < limit or not ends:
        return [part]
    at = ends[len(ends) // 2]
    return _halved(part[:at], limit, cuts) + _halved(part[at:], limit, cuts)


_LINE = re.compile(r"\n")


def _masked_cuts(part: str) -> list[int]:
    """Where sentences end: white space behind a dot that masking leaves alone."""
    if "." not in part:
        return []
    masked, at, seen, out = mask_text(part), 0, 0, []
    for m in _SENTENCE.finditer(masked):
        at, seen = at + len(unmask_text(masked[seen : m.end()])), m.end()
        if at < len(part):
            out.append(at)
    return out


def _sentences(part: str, limit: int) -> list[str]:
    cuts = [0, *_masked_cuts(part), len(part)]

    def go(a: int, b: int) -> list[str]:
        if cuts[b] - cuts[a] < limit or b - a < 2:
            return [part[cuts[a] : cuts[b]]]
        m = (a + b) // 2
        return go(a, m) + go(m, b)

    return go(0, len(cuts) - 1)


def segment_text(text: str | None, limit: int = LIMIT) -> list[dict]:
    """The sequences of one text: seq, terminator, idx, start, with text[start:start + len(seq)] == seq."""
    text, out, at = text or "", [], 0
    pieces = text.split("\n\n")
    for n, piece in enumerate(pieces):
        end = "\n\n" if n + 1 < len(pieces) else ""
        if len(piece) < limit:
            parts = [piece]
        elif "\n" in piece.strip("\n"):
            parts = _halved(piece, limit, _LINE)
        else:
            parts = _sentences(piece, limit)
        for i, part in enumerate(parts):
            body = part
            last = i + 1 == len(parts)
            tail = end if last else part[len(part.rstrip()) :]
            if not last:
                body = part[: len(part) - len(tail)]
            out.append({"seq": body, "terminator": tail, "idx": len(out), "start": at})
            at += len(body) + len(tail)
    return out


def segments(df: DataFrame, text: str, limit: int = LIMIT, out: str = "sequences") -> DataFrame:
    """Add the array of sequences of a text; texts of one short piece never reach Python."""

    cut = _lists(lambda t: segment_text(t, limit), _SEQUENCES, _FIELDS)
    t = F.coalesce(F.col(text), F.lit(""))
    pieces = F.split(t, "\n\n")
    plain = F.transform(
        pieces,
        lambda p, i: F.struct(
            p.alias("seq"),
            F.when(i + 1 < F.size(pieces), "\n\n").otherwise("").alias("terminator"),
            i.alias("idx"),
            F.length(F.array_join(F.slice(pieces, 1, i), "\n\n")).cast("int").alias("x"),
        ),
    )
    plain = F.transform(plain, lambda p: F.struct(p["seq"], p["terminator"], p["idx"], F.when(p["idx"] > 0, p["x"] + 2).otherwise(0).alias("start"))).cast(_SEQUENCES)
    is_long = F.exists(pieces, lambda p: F.length(p) >= limit)
    return df.withColumn(out, F.when(is_long, cut(F.when(is_long, t))).otherwise(plain))


def rebuild(sequences, seq: str = "seq"):
    """The text of an array of sequences, stripped."""
    return strip(F.array_join(F.transform(F.array_sort(sequences, lambda a, b: a["idx"] - b["idx"]), lambda s: F.concat(s[seq], s["terminator"])), ""))


def explode_sequences(df: DataFrame, key: str, sequences: str = "sequences") -> DataFrame:
    """One row a sequence. explode() would have the optimizer cut all texts once more, to filter out those without any."""
    return df.select(key, F.explode_outer(sequences).alias("s")).where("s IS NOT NULL").select(key, "s.idx", "s.seq", "s.terminator", "s.start")
