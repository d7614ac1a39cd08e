"""Secret scans over a trigram inverted index.

Each rule's regex is parsed into a Boolean query of byte trigrams (letters lower-cased) that any match must
contain. Documents are the shards of the index: a task indexes a slice of rows, with postings for the trigrams
that some rule asks for, intersects and joins them by the query, and runs a rule's regex over its candidates
only. A rule whose regex has no mandatory trigram runs over every text.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive, whole matches,
ordered by start and then by the rules' order; equal rows get equal results; a null id is carried as null;
further columns are ignored (redact() keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as P
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T

# The three base rules.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

_BREAK = r"(?:\s|\\[nr])"
#: A private key from its BEGIN line to its END line; without one before the next BEGIN, over the base64 that follows:
#: long runs, then whole short lines or a padded end. Line ends may be escaped, as in JSON.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BREAK}*(?:Proc-Type|DEK-Info): [^\n\\]*)*"
    rf"(?:(?:{_BREAK}*[A-Za-z0-9+/]{{16,}})+={{0,2}}(?:(?:\r?\n|\\n)[A-Za-z0-9+/]+={{0,2}}(?=\s*\n|\\n|\s*\Z)|{_BREAK}*[A-Za-z0-9+/]+={{1,2}})?)?)"
)


@dataclass(frozen=True)
class Rule:
    """`accept` drops failing matches; `fast`, if given, finds the accepted matches of `regex` sooner."""

    name: str
    regex: str
    flags: int = re.ASCII
    accept: Callable[[re.Match], bool] | None = None
    fast: str | None = None


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


#: The base rules, then what the scan adds. A run of [0-9a-f] has 24 characters or is no match, so hex needs no short runs.
RULES = (
    Rule("assign", ASSIGN, re.ASCII | re.IGNORECASE, _long_value),
    Rule("access", ACCESS, re.ASCII, _long_access),
    Rule("hex", HEX, re.ASCII, lambda m: m.end() - m.start() >= 24, r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", PEM),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.ASCII | re.IGNORECASE),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")

#: Alternatives of exact strings that a part of a regex may expand to while trigrams are derived.
_MOST = 64


def _and(*qs):
    """Queries are True (anything), a trigram, ("and", ...) or ("or", ...)."""
    flat = []
    for q in qs:
        flat += [] if q is True else list(q[1:]) if isinstance(q, tuple) and q[0] == "and" else [q]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*qs):
    if not qs or any(q is True for q in qs):
        return True
    qs = list(dict.fromkeys(qs))
    return qs[0] if len(qs) == 1 else ("or", *qs)


def _of_strings(strings: set[str]):
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass
class _Part:
    """What a part of a regex may match: exactly `exact`, or else something meeting `query`."""

    exact: set[str] | None = None
    query: object = True
    head: set[str] = field(default_factory=lambda: {""})
    tail: set[str] = field(default_factory=lambda: {""})


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _any() -> _Part:
    return _Part()


def _loose(p: _Part) -> _Part:
    if p.exact is None:
        return p
    return _Part(None, _of_strings(p.exact), {s[:2] if len(s) > 2 else s for s in p.exact} if all(len(s) >= 2 for s in p.exact) else {""}, {s[-2:] for s in p.exact} if all(len(s) >= 2 for s in p.exact) else {""})


def _concat(parts: list[_Part]) -> _Part:
    out = _Part({""})
    for p in parts:
        if out.exact is not None and p.exact is not None and len(out.exact) * len(p.exact) <= _MOST:
            out = _Part({a + b for a in out.exact for b in p.exact})
            continue
        seam_left = out.exact if out.exact is not None else out.tail
        seam_right = p.exact if p.exact is not None else p.head
        seam = {a + b for a in seam_left for b in seam_right} if len(seam_left) * len(seam_right) <= _MOST else {""}
        a, b = _loose(out), _loose(p)
        seam_query = _of_strings(seam) if all(len(s) >= 3 for s in seam) else True
        head = seam if out.exact is not None and all(seam) and seam != {""} else a.head
        tail = seam if p.exact is not None and all(seam) and seam != {""} else b.tail
        out = _Part(None, _and(a.query, b.query, seam_query), {s[:8] for s in head}, {s[-8:] for s in tail})
    return out


def _part(op, av) -> _Part:
    if op is C.LITERAL:
        return _Part({_lower(chr(av))}) if av < 128 else _any()
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in av:
            if kind is C.LITERAL and x < 128:
                chars.add(_lower(chr(x)))
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                chars |= {_lower(chr(c)) for c in range(x[0], x[1] + 1)}
            else:
                return _any()
        return _Part(chars) if len(chars) <= 8 else _any()
    if op is C.SUBPATTERN:
        return _concat([_part(*x) for x in av[3]])
    if op is C.BRANCH:
        parts = [_concat([_part(*x) for x in b]) for b in av[1]]
        if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST:
            return _Part(set().union(*(p.exact for p in parts)))
        parts = [_loose(p) for p in parts]
        return _Part(None, _or(*(p.query for p in parts)), set().union(*(p.head for p in parts)), set().union(*(p.tail for p in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = av
        p = _concat([_part(*x) for x in body])
        if low == 0:
            return _Part({"", *p.exact}) if high == 1 and p.exact is not None else _any()
        if low == high and p.exact is not None and len(p.exact) == 1:
            return _Part({next(iter(p.exact)) * low})
        p = _loose(p)
        return _Part(None, p.query, p.head, p.tail)
    if op is C.AT:
        return _Part({""})
    return _any()


def trigram_query(regex: str):
    """The Boolean trigram query of a regex: True where nothing is mandatory."""
    return _loose(_concat([_part(*x) for x in P.parse(regex)])).query


def _trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*(_trigrams(x) for x in q[1:]))


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Scanner:
    """A set of rules with their queries and compiled patterns; built once per task."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.queries = [trigram_query(r.regex) for r in rules]
        self.patterns = [re.compile(r.fast or r.regex, r.flags) for r in rules]
        self.grams = sorted(set().union(*(_trigrams(q) for q in self.queries)))
        self.slot = np.zeros(1 << 24, np.uint8)
        assert len(self.grams) < 255
        for i, g in enumerate(self.grams):
            a, b, c = g.encode()
            self.slot[a << 16 | b << 8 | c] = i + 1

    def postings(self, raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """For each asked trigram the sorted rows that contain it."""
        lo = int(off[0])
        b = _LOWER[raw[lo : int(off[-1])]]
        if len(b) < 3:
            return {}
        found = self.slot[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(off, at + lo, "right") - 1
        inside = at + lo + 3 <= off[row + 1]
        key = np.unique(found[at[inside]].astype(np.int64) * len(off) + row[inside])
        gram = key // len(off)
        return {self.grams[int(g) - 1]: key[gram == g] % len(off) for g in np.unique(gram)}

    def _rows(self, q, post: dict[str, np.ndarray]) -> np.ndarray:
        if isinstance(q, str):
            return post.get(q, np.zeros(0, np.int64))
        rows = [self._rows(x, post) for x in q[1:]]
        if q[0] == "or":
            return np.unique(np.concatenate(rows))
        rows.sort(key=len)
        out = rows[0]
        for x in rows[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out

    def scan(self, raw: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per row its spans (start, rule, end), ordered."""
        n = len(off) - 1
        post, out = self.postings(raw, off), [[] for _ in range(n)]
        texts: dict[int, str] = {}
        data = raw.data
        for k, (q, rule, pattern) in enumerate(zip(self.queries, self.rules, self.patterns, strict=True)):
            for i in range(n) if q is True else self._rows(q, post).tolist():
                if i not in texts:
                    texts[i] = str(data[int(off[i]) : int(off[i + 1])], "utf-8")
                for m in pattern.finditer(texts[i]):
                    if rule.accept is None or rule.accept(m):
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def _joined(spans, rules, only=None) -> str:
    return ",".join(f"{rules[k].name}:{s}:{e}" for s, k, e in spans if only is None or rules[k].name in only)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every whole text."""

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            raw, off = T.texts(b, "text")
            for lo, hi in T.chunks(off):
                spans = [[{"kind": rules[k].name, "start": s, "end": e} for s, k, e in x] for x in scanner.scan(raw, off[lo : hi + 1])]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, kind)], names=["k", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("k"), docs[text_col].alias("text")).mapInArrow(run, f"k {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("k", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans string) of every whole text."""

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            raw, off = T.texts(b, "text")
            for lo, hi in T.chunks(off):
                found = scanner.scan(raw, off[lo : hi + 1])
                counts = [pa.array([sum(rules[k].name == name for _, k, _ in x) for x in found], pa.int64()) for name in BASE]
                base = pa.array([hashlib.sha256(_joined(x, rules, BASE).encode()).hexdigest() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *counts, base, pa.array([_joined(x, rules) for x in found], pa.string())], names=["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("k"), docs[text_col].alias("text")).mapInArrow(run, f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("k", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every union of overlapping spans replaced by the mark."""
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets in the text replaced; texts without any stay as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            raw, off = T.texts(pa.RecordBatch.from_arrays([b.column(at)], names=["text"]), "text")
            found = [x for lo, hi in T.chunks(off) for x in scanner.scan(raw, off[lo : hi + 1])]
            if any(found):
                new = [redacted(t, x, mark) if x else t for t, x in zip(b.column(at).to_pylist(), found, strict=True)]
                b = pa.RecordBatch.from_arrays([pa.array(new, c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
