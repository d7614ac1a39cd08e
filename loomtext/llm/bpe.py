"""Byte-level BPE with the tiktoken library and a local rank file: encode, decode, digests.

Every text is encoded whole: null counts as empty, an empty text has no ids, equal texts get equal rows,
repeated rows stay repeated, a null id is carried as null, further columns are ignored, an empty table
gives an empty result. Texts above `long_text` characters are cut at safe boundaries first, so that one
call into the library holds a bounded piece; the ids are those of the uncut text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T

#: Longer texts are encoded in pieces of about this many characters.
LONG_TEXT = 65_536

#: A cut after a non-space and before a space: no alternative of the pattern reaches from a non-space over a
#: space, and a run of white space stays whole in the right-hand piece.
_SAFE = re.compile(r"\S(?= )")

_loaded: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The encoder of a rank file, loaded once per worker process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def safe_pieces(text: str, most: int = LONG_TEXT) -> Iterator[str]:
    """Cut a text into pieces of about `most` characters whose encodings, joined, are the text's own."""
    at = 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most - 1)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def encode_text(enc, text: str, most: int = LONG_TEXT) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, most):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode_text(enc, t or "", long_text) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the raw bytes of every list of ids; null counts as empty."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["k", "bytes"])

    kind = ids.schema[id_col].dataType.simpleString()
    return _narrow(ids, id_col, ids_col).mapInArrow(run, f"k {kind}, bytes binary").withColumnRenamed("k", id_col)


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), long_text: int = LONG_TEXT) -> DataFrame:
    """(id, carried columns, n_tokens, ids, lossless): the ids of every whole text, decoded again and compared."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = [t or "" for t in part.column(0).to_pylist()]
                ids = [encode_text(enc, t, long_text) for t in texts]
                same = [enc.decode_bytes(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=[*part.schema.names[1:], "n_tokens", "ids", "lossless"])
        T.trim()

    kept = [id_col, *carry]
    shape = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    narrow = docs.select(docs[text_col].alias("t"), *(docs[c].alias(f"c{i}") for i, c in enumerate(kept)))
    return narrow.mapInArrow(run, f"{shape}, n_tokens long, ids array<int>, lossless boolean").toDF(*kept, "n_tokens", "ids", "lossless")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and the digests of both, in one pass."""

    def run(batches):
        enc = encoding(path, pattern)
        digits = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            n, own, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode_text(enc, t or "", long_text)
                n.append(len(ids))
                own.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", id_col)


def _narrow(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(df[c].alias("kv"[i]) for i, c in enumerate(cols)))
