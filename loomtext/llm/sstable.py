"""Token ids in sorted-string-table shards.

Documents are range-partitioned by id; each partition writes one file, in ascending id order:

    data blocks | Bloom filter | block index | footer

A key is the id as 8 big-endian bytes, sign bit flipped, so that bytes sort as numbers do. A block is a
zstd-compressed run of entries `shared u8, rest u8, count u32, rest bytes of the key, count ids as u16 or u32`,
`shared` being the bytes that a key has in common with the one before it in the block. The index holds each
block's last key, offset and size; the footer the sizes of the parts, counts, first id and id width. A lookup
asks the Bloom filter, searches the index by bisection and reads one block.

Tasks write to names of their own, so a repeated or speculative task never touches a finished file; the manifest
names the files that count and is written last, by a rename. Files are reached by pyarrow's file systems.

Texts are encoded as the tokenizers library encodes them whole, added tokens' strings included, which become their
ids. So that no word is encoded twice, texts are cut at places where the pre-tokenizer always cuts, and the ids of
short pieces are kept by each worker within KEPT_BYTES.

Defined results: null and empty texts hold the end id only; ids are taken as whole numbers, and rows with a null id,
or one that is no number, have no key and are left out; several rows of one id stand in the order of a hash of their
texts, equal rows in the order of reading, and may go over several shards; very long texts are encoded whole, one at
a time; further columns are ignored, whatever their names; an empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._util import hadoop_fs, new_path

END_ID = 0
BLOCK_BYTES = 1 << 16
#: Rows and bytes of text that one shard is cut for; the number of shards follows the input.
SHARD_CHARS = 32_000_000
MAGIC = b"LTSST001"
_FOOTER = struct.Struct("<QQQQQqI8s")
_INDEX = struct.Struct(">QQI")
_ENTRY = struct.Struct("<BBI")
_BLOOM_BITS, _BLOOM_HASHES = 10, 7

#: Bytes of text encoded at once; bytes that a worker's kept pieces may take, after which it starts anew; longest kept piece.
CHUNK_BYTES, KEPT_BYTES, KEPT_PIECE = 1 << 23, 200 << 20, 64
#: What a kept piece takes besides its own letters.
_ENTRY_BYTES = 180

# Kinds of bytes for cutting: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 apostrophe, 5 part of a longer character.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_KIND[128:] = 5
#: Kinds before and after a cut. The pre-tokenizer never joins a letter, a digit or another mark to a following one of
#: another kind, but an apostrophe to letters, and white space to what follows it.
_CUT = np.zeros((6, 6), bool)
_CUT[1, [2, 3, 4]] = _CUT[2, [1, 3, 4]] = _CUT[3, [1, 2]] = True
_CUT[[1, 2, 3, 4], 0] = True

_loaded: dict[str, tuple] = {}


def pieces(raw: np.ndarray, off: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start in `raw`, with the end behind the last, and the rows' bounds within them.

    Encoding pieces one by one gives the ids of the row. `whole` marks rows that must not be cut.
    """
    lo, hi = int(off[0]), int(off[-1])
    b, rows = raw[lo:hi], off - lo
    kind = _KIND[b]
    cut = np.zeros(len(b), bool)
    cut[1:] = _CUT[kind[:-1], kind[1:]]
    # White space after a longer character that can't be white space itself: two bytes from C3 on, three from E4 on.
    late = np.flatnonzero((kind[1:] == 0) & (kind[:-1] == 5)) + 1
    late = late[late > 2]
    two, three = b[late - 2], b[late - 3]
    cut[late[(two >= 0xC3) & (two < 0xE0) | (two < 0xC0) & (three >= 0xE4) & (three < 0xF0)]] = True
    for i in np.flatnonzero(whole):
        cut[rows[i] : rows[i + 1]] = False
    cut[rows[:-1][rows[:-1] < rows[1:]]] = True
    at = np.flatnonzero(cut)
    return np.append(at, len(b)) + lo, np.searchsorted(at, rows)


class Encoder:
    """Ids of texts by a tokenizer file. Pieces between safe cuts are encoded once and kept, up to KEPT_BYTES.

    Cuts are made for plain byte-level BPE only, without a normalizer or an added prefix; rows that hold an added
    token, and all rows of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each worker has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.kind = np.uint32 if self.tok.get_vocab_size() > 1 << 16 else np.uint16
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.held = 0
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _whole(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, not self.plain)
        if self.plain and self.added is not None:
            lo = int(off[0])
            for m in self.added.finditer(memoryview(raw)[lo : int(off[-1])]):
                # An added token may not reach over a row's end, but a row where it seems to is encoded rightly too.
                out[np.searchsorted(off, lo + m.start(), "right") - 1] = True
        return out

    def _kept(self, new: list[str]) -> None:
        """Encode pieces and keep them."""
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), self.kind, int(size.sum()))
            n = len(self.slots)
            self.flat = _grown(self.flat, self.used + len(flat))
            self.starts, self.sizes = _grown(self.starts, n + len(part)), _grown(self.sizes, n + len(part))
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[n : n + len(part)] = self.used + np.cumsum(size) - size
            self.sizes[n : n + len(part)] = size
            self.used += len(flat)
            self.slots.update(zip(part, range(n, n + len(part)), strict=True))
            self.held += sum(map(len, part)) + len(part) * _ENTRY_BYTES + flat.nbytes

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the rows' bounds within them."""
        at, rows = pieces(raw, off, self._whole(raw, off))
        if len(at) < 2:
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        lo = int(at[0])
        text = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer((at - lo).astype(np.int32)), pa.py_buffer(raw[lo : int(at[-1])])])
        coded = text.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > KEPT_BYTES:
            self._clear()
        short = [w for w in words if len(w) <= KEPT_PIECE and w not in self.slots]
        self._kept(short)
        slot = np.fromiter((self.slots.get(w, -1) for w in words), np.int64, len(words))
        own = np.flatnonzero(slot < 0)  # long pieces, which are not kept
        flat, start, size = self.flat, self.starts[slot], self.sizes[slot]
        if len(own):
            ids = [np.array(e.ids, self.kind) for i in own for e in self.tok.encode_batch_fast([words[i]], add_special_tokens=False)]
            size[own] = [len(x) for x in ids]
            start[own] = self.used + np.cumsum(size[own]) - size[own]
            flat = np.concatenate((flat[: self.used], *ids))
        which = coded.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n)
        out = flat[np.repeat(start[which] - (end - n), n) + np.arange(int(end[-1]))]
        return out, np.concatenate(([0], end))[rows]


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _key(doc_id: int) -> bytes:
    return struct.pack(">Q", doc_id + (1 << 63))


def _bloom_slots(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(_BLOOM_HASHES)]


class Writer:
    """Writes one table; add() in ascending id order."""

    def __init__(self, out, kind):
        import zstandard

        self.out, self.kind, self.zip = out, kind, zstandard.ZstdCompressor(level=1)
        self.at = self.n = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block: list[bytes] = []
        self.held = 0
        self.last = b""
        self.first_id = None

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key = _key(doc_id)
        assert key >= (self.keys[-1] if self.keys else key), "ids must ascend"
        shared = 0
        while shared < 8 and self.block and key[shared] == self.last[shared]:
            shared += 1
        self.block += [_ENTRY.pack(shared, 8 - shared, len(ids)), key[shared:], ids.astype(self.kind).tobytes()]
        self.held += 14 - shared + ids.nbytes
        self.last = key
        self.keys.append(key)
        self.first_id = doc_id if self.first_id is None else self.first_id
        self.n += 1
        self.tokens += len(ids)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append(_INDEX.pack(int.from_bytes(self.last, "big"), self.at, len(data)))
            self.at += len(data)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, _BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in set(self.keys):
            for s in _bloom_slots(k, bits):
                bloom[s >> 3] |= 1 << (s & 7)
        index = b"".join(self.index)
        self.out.write(bloom.tobytes())
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.at, bits, len(index), self.n, self.tokens, self.first_id or 0, np.dtype(self.kind).itemsize, MAGIC))
        self.out.close()


@dataclass
class Reader:
    """Reads one table from an open random-access file."""

    file: object

    def __post_init__(self):
        import zstandard

        self.zip = zstandard.ZstdDecompressor()
        size = self.file.size()
        self.file.seek(size - _FOOTER.size)
        self.data, self.bits, n_index, self.n, self.tokens, self.first_id, width, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        self.kind = np.uint32 if width == 4 else np.uint16
        self.file.seek(self.data)
        self.bloom = self.file.read((self.bits + 7) // 8)
        index = self.file.read(n_index)
        self.index = [_INDEX.unpack_from(index, i) for i in range(0, n_index, _INDEX.size)]

    def _block(self, i: int):
        _, at, size = self.index[i]
        self.file.seek(at)
        raw = self.zip.decompress(self.file.read(size), max_output_size=1 << 31)
        at, key = 0, b""
        while at < len(raw):
            shared, rest, count = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield int.from_bytes(key, "big") - (1 << 63), np.frombuffer(raw, self.kind, count, at)
            at += count * np.dtype(self.kind).itemsize

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The id lists stored under a key: none if there is no such key."""
        key = _key(doc_id)
        if any(not self.bloom[s >> 3] >> (s & 7) & 1 for s in _bloom_slots(key, self.bits)):
            return []
        number = int.from_bytes(key, "big")
        i, out = bisect.bisect_left([k for k, _, _ in self.index], number), []
        while i < len(self.index):
            own = [x for d, x in self._block(i) if d == doc_id]
            out += own
            if not own or self.index[i][0] > number:
                break
            i += 1
        return out


def _open(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, shard_chars: int = SHARD_CHARS) -> str:
    """Encode and write all documents; returns the folder, whose MANIFEST.json names the shards in id order."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    d = docs.select(docs[id_col].try_cast("long").alias("k"), docs[text_col].alias("text")).where("k IS NOT NULL")
    total = d.agg(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    # Rows of one id may fill several shards: the hash of their text, then their place, orders and parts them.
    d = d.select("k", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    ranged = d.repartitionByRange(int(max(2, -(-total // shard_chars))), "k", "h", "i").sortWithinPartitions("k", "h", "i").select("k", "text")
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], encode.kind)
        system, path = _open(folder)
        name, writer = f"{uuid.uuid4().hex}.sst", None
        for b in batches:
            raw, off = T.texts(b, "text")
            keys = b.column(0).to_pylist()
            for lo, hi in T.chunks(off, CHUNK_BYTES):
                ids, at = encode(raw, off[lo : hi + 1])
                if writer is None:
                    writer = Writer(system.open_output_stream(f"{path}/{name}"), encode.kind)
                for i in range(lo, hi):
                    writer.add(keys[i], np.concatenate((ids[at[i - lo] : at[i - lo + 1]], end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([writer.first_id], pa.int64()), pa.array([writer.n], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["name", "part", "first_id", "n", "tokens"])

    # A row per shard comes back; the rows are the only names of files that count.
    found = sorted(ranged.mapInArrow(run, "name string, part int, first_id long, n long, tokens long").collect(), key=lambda r: r["part"])
    files, start = [], 0
    for r in found:
        files.append(r.asDict() | {"start": start})
        start += r["tokens"]
    fs, final = hadoop_fs(spark, f"{folder}/MANIFEST.json")
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.MANIFEST-{uuid.uuid4().hex}")
    out = fs.create(half, False)
    out.write(json.dumps({"format": MAGIC.decode(), "shards": files}).encode())
    out.close()
    if not fs.rename(half, final):
        raise FileExistsError(f"{folder} has a manifest already")
    return folder


def manifest(folder: str) -> list[dict]:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/MANIFEST.json") as f:
        return json.loads(f.read())["shards"]


def read(spark: SparkSession, folder: str, emit_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, from the files."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if emit_ids else "")
    shards = manifest(folder)
    if not shards:
        return spark.createDataFrame([], kind)
    names = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long").repartition(len(shards), "name")

    def batch(rows):
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
        if emit_ids:
            cols.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    def run(batches):
        system, path = _open(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{name}") as f:
                    rows = []
                    for k, ids in Reader(f):
                        wide = ids.astype("<u4")
                        rows.append((k, start, len(ids), zlib.crc32(wide.tobytes()), *([wide.astype(np.int32).tolist()] if emit_ids else [])))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    return names.mapInArrow(run, kind)


def lookup(folder: str, doc_id: int) -> list[np.ndarray]:
    """The id lists of one document: bisect the manifest for the shards that may hold it, then each shard's index."""
    shards = manifest(folder)
    first = [s["first_id"] for s in shards]
    out: list[np.ndarray] = []
    system, path = _open(folder)
    for s in shards[max(0, bisect.bisect_left(first, doc_id) - 1) : bisect.bisect_right(first, doc_id)]:
        with system.open_input_file(f"{path}/{s['name']}") as f:
            out += Reader(f).get(doc_id)
    return out
