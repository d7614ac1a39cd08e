"""Exact n-gram Jaccard join by grouped prefixes.

A text's set is its distinct k-word shingles (64-bit hashes); two sets link when
`100 * |intersection| >= percent * |union|`. The steps:

1. One pass hashes every text into its set key, its smallest shingles (pins) and a count sketch of all shingles
   (fixed size, summed over all texts). The sketch orders shingles from rare to frequent; any counts give a right
   order, better counts only give shorter candidate lists, so the sketch's collisions never change a result.
2. Texts with equal sets fall into one class. Every class is compared with one other class, the pivot that shares
   most pins with it and with others; pairs that hold are contracted into components.
3. Classes with equal prefix and size fall into one group. A second pass posts the prefix shingles of groups, and
   with them the groups' members, in one exchange; shingles that only one group posts are dropped in it, and
   postings that the length and position filters let meet no other one.
   Shingles that the sketch calls hot are kept unseen and dealt by group, so that no task gathers them.
4. Of what remains open (shingles that groups of different components post) every group is compared with one other,
   the pivot that shares most prefix shingles with it and with others, if the filters of step 5 let them link. A family
   of thousands of copies is settled in linear work here. What is open is looked for among what was open before.
5. What is open after that is joined under the length, position and signature filters; surviving group pairs expand
   to member classes and are verified.

Verifying sends each pair's sets to the place of one of them, once, in salted parts of at most SALT pairs; a task
holds two sets at a time.

Defined results: null or blank texts have an empty set, link with nothing and are their own component; fewer than
k words form one shingle; equal texts and repeated rows share a class; ids are taken as whole numbers, and a null
id, or one that is no number, never links and gets a null component; further columns are ignored, whatever their
names; very long texts are hashed whole, one at a time; an empty table gives an empty result. Nothing depends on
ties: of equal counts the shingle's hash decides, of equal pivots the class key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._util import connected, discard, join_sized, materialize

WORDS, PERCENT = 5, 75
#: The count sketch has 2**SKETCH_BITS counters, in blocks of 2**BLOCK_BITS.
SKETCH_BITS, BLOCK_BITS = 22, 15
#: Smallest shingles of a set that choose its first pivot; bits of a set's signature.
PINS, SIGNATURE = 6, 512
#: Pairs that are verified in one place, about; places that one row of a text serves, about; bytes sent at once.
SALT, SERVED, SENT_BYTES = 4096, 256, 1 << 24


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), _signed(np.concatenate(parts) if parts else []))


def _sets_of(batches, k: int):
    """(row range of a batch, the batch, sets) of a chunk of rows at a time."""
    for b in batches:
        raw, off = T.texts(b, "text")
        for lo, hi in T.chunks(off):
            yield b.slice(lo, hi - lo), T.shingle_sets(raw, off[lo : hi + 1], k)
    T.trim()


def _keys_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    names = ["doc_id", "n", "ck", "pins", "block", "counts"]

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint8)
        for b, sets in _sets_of(batches, k):
            n = [len(s) for s in sets]
            if sum(n):
                at, more = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 255)
            keys = [T.set_key(s) for s in sets]
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), _lists([s[:PINS] for s in sets]), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = counts.reshape(-1, 1 << BLOCK_BITS)
        for i in np.flatnonzero(parts.any(axis=1)):
            none = pa.nulls(1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1).cast(pa.list_(pa.int64())), pa.array([i], pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, ck long, pins array<long>, block int, counts binary")


def _summed_sketch(blocks: DataFrame) -> np.ndarray:
    """Sum the tasks' sketches (a task counts to 255): within each partition first, then by block; what is held never exceeds the sketch."""

    def add(batches, kind):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), kind)
                total[i] = total[i] + part if i in total else part.astype(np.uint32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["block", "counts"])

    shape = "block int, counts binary"
    once = blocks.mapInArrow(lambda it: add(it, np.uint8), shape)
    out = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint32)
    for r in once.repartition("block").mapInArrow(lambda it: add(it, np.uint32), shape).collect():
        out[r["block"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return out.reshape(-1)


def _levels(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts as levels of one byte, a twelfth of an octave each, which order as well; and the highest level that is not hot."""
    level = lambda c: np.minimum(np.rint(12 * np.log2(c + np.float32(1))), 255).astype(np.uint8)
    return level(counts), int(level(np.float32(8 * float(counts.mean()) + 1000)))


def _prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set, rare shingles first, long enough that linked sets share one of its shingles; and its counts."""
    n = len(s)
    p = n - (n * percent + 99) // 100 + 1
    c = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    if p * 2 < n:
        edge = np.partition(c, p - 1)[p - 1]
        near = c <= edge
        s, c = s[near], c[near]
    order = np.lexsort((s, c))[:p]
    return s[order], c[order]


def _group_key(prefix: np.ndarray, n: int) -> int:
    return T.set_key(prefix ^ np.uint64(n * 2654435761 & (1 << 64) - 1))


def _signature(s: np.ndarray) -> list[int]:
    """The parity of the set's shingles in each of SIGNATURE slots: two of them differ in no more bits than their sets in shingles."""
    odd = np.bincount((s & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _postings(docs: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """(tok, gh, np, kind, sig): prefix shingle, group, size and position in one number, 1 where the shingle is hot;
    and of every group's members (group, class, size, 2, signature)."""
    longs = pa.list_(pa.int64())

    def run(batches):
        (counts, hot), seen, told = sketch.value, set(), set()
        for _, sets in _sets_of(batches, k):
            tok, gh, at, kind, members = [], [], [], [], []
            for s in sets:
                if not len(s):
                    continue
                p, c = _prefix(s, counts, percent)
                g, ck = _group_key(p, len(s)), T.set_key(s)
                if ck not in told:
                    members.append((g, ck, len(s) << 32, _signature(s)))
                if g not in seen:
                    tok.append(p)
                    gh.append(np.full(len(p), g, np.int64))
                    at.append((len(s) << 32) + np.arange(len(p), dtype=np.int64))
                    kind.append((c > hot).astype(np.int8))
                if len(told) < 200_000:
                    told.add(ck)
                    seen.add(g)
            names = ["tok", "gh", "np", "kind", "sig"]
            if members:
                g, ck, n, sig = zip(*members, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(ck, pa.int64()), pa.array(n, pa.int64()), pa.array([2] * len(g), pa.int8()), pa.array(sig, longs)], names=names)
            if tok:
                kind = np.concatenate(kind)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tok)), pa.array(np.concatenate(gh)), pa.array(np.concatenate(at)), pa.array(kind), pa.nulls(len(kind), longs)], names=names)

    return docs.mapInArrow(run, "tok long, gh long, np long, kind byte, sig array<long>")


def _long(x: str, y: str, t: int) -> str:
    """Whether sets of the sizes of x and y can link."""
    return f"100 * least({x}n, {y}n) >= {t} * greatest({x}n, {y}n)"


def _early(x: str, y: str, t: int) -> str:
    """Whether postings x and y of one shingle can be the first shared ones of a linked pair: with what follows it in
    either set, the first one holds the whole overlap."""
    return f"{100 + t} * least({x}n - {x}pos, {y}n - {y}pos) >= {t} * ({x}n + {y}n)"


def _alike(x: str, y: str, t: int) -> str:
    """Whether sets with the signatures of x and y can link; true where one of them has none."""
    bits = " + ".join(f"bit_count({x}sig[{i}] ^ {y}sig[{i}])" for i in range(SIGNATURE // 64))
    return f"coalesce({100 + t} * ({bits}) <= {100 - t} * ({x}n + {y}n), true)"


def _meeting(postings: DataFrame, percent: int) -> DataFrame:
    """Without the postings of a shingle that can't be the first one of a link with any other posting of it: of two,
    what the filters rule out; of more, what is too short or too long for the next in size on either side."""
    own = Window.partitionBy("tok", "part", "kind")
    order, post = own.orderBy("n", "gh"), F.struct("n", "pos")
    beside = postings.withColumns({"low": F.lag(post).over(order), "high": F.lead(post).over(order), "df": F.count("*").over(own)})
    meets = " OR ".join(f"{x} IS NOT NULL AND {_long('', f'{x}.', percent)} AND (df > 2 OR {_early('', f'{x}.', percent)})" for x in ("low", "high"))
    return beside.where(f"kind > 0 OR {meets}").drop("low", "high", "df")


def _named(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("ck"), "comp")


def _with_comp(df: DataFrame, comps: DataFrame) -> DataFrame:
    """Add the component of class `ck`; a class without links is its own."""
    return join_sized(df, comps, "ck", "left").withColumn("comp", F.coalesce("comp", "ck"))


class JaccardJoin:
    """The join of one table with itself. `labels()` gives components, `pairs()` every link between classes."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT):
        spark = docs.sparkSession
        every = docs.select(docs[id_col].try_cast("long").alias("doc_id"), docs[text_col].alias("text"))
        self.docs = every.where("doc_id IS NOT NULL")
        self.words, self.percent = words, percent
        first = materialize(_keys_and_sketch(every, words), "sets")
        self.rows = first.where("ck IS NOT NULL").select("doc_id", "n", "ck")
        own = first.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = materialize(own.groupBy("ck").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), F.first("pins").alias("pins")), "classes")
        self.sketch = spark.sparkContext.broadcast(_levels(_summed_sketch(first.where("block IS NOT NULL").select("block", "counts"))))
        T.trim()

    def _post(self) -> None:
        """Fill `live` (tok, gh, n, pos), the postings that groups share and can meet at, and `members` (gh, ck, n)."""
        post = _postings(self.docs, self.sketch, self.words, self.percent)
        # A hot shingle is shared anyway: its rows are dealt by group, each on its own.
        post = post.withColumn("part", F.when(F.col("kind") == 1, F.col("gh")).otherwise(0))
        post = post.repartition("tok", "part")
        w = Window.partitionBy("tok", "part")
        several = F.min("gh").over(w) < F.max("gh").over(w)
        kept = post.withColumn("several", several).where("kind > 0 OR several").dropDuplicates(["tok", "part", "gh", "np", "kind"])
        kept = _meeting(kept.selectExpr("tok", "part", "gh", "np >> 32 AS n", "np & 4294967295 AS pos", "kind", "several", "sig"), self.percent)
        live = materialize(kept.drop("part"), "live")
        self.live = live.where("kind < 2").select("tok", "gh", "n", "pos")
        self.members = live.where("kind = 2").select(F.col("tok").alias("gh"), F.col("gh").alias("ck"), "n", "several", "sig")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of the distinct class pairs (u, v) those whose sets reach the similarity. Each pair meets at the place of v."""
        k, percent = self.words, self.percent
        parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT).alias("parts"))
        meet = join_sized(pairs, parts, "v").select(F.col("u").alias("ck"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
        host = parts.select(F.col("v").alias("ck"), "v", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
        sent = meet.union(host)
        many = sent.groupBy("ck").agg(F.ceil(F.count("*") / SERVED).alias("rows")).where("rows > 1")
        row = F.pmod(F.xxhash64("v", "part"), F.coalesce("rows", F.lit(1)))
        sent = join_sized(sent, many, "ck", "left").groupBy("ck", row.alias("row")).agg(F.collect_list(F.struct("v", "part")).alias("to"))
        need = materialize(join_sized(sent, self.classes.select("ck", "owner"), "ck").select(F.col("owner").alias("doc_id"), "ck", "to"), "need")

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["v", "part", "ck", "own"])

        def send(batches):
            for b, sets in _sets_of(batches, k):
                rows, held = [], 0
                for s, key, to in zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if len(s) and T.set_key(s) == key:  # another text may have the same id
                        raw = s.tobytes()
                        for t in to:
                            rows.append((t["v"], t["part"], key, raw))
                            held += len(raw)
                            if held >= SENT_BYTES:
                                yield batch(rows)
                                rows, held = [], 0
                if rows:
                    yield batch(rows)

        def meet_all(batches):
            place, host = None, None
            for b in batches:
                us, vs = [], []
                for v, part, ck, raw in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                    s = np.frombuffer(raw.as_buffer(), np.uint64)
                    if ck == v:
                        place, host = (v, part), s.copy()
                    elif place == (v, part):
                        both = len(np.intersect1d(host, s, assume_unique=True))
                        if 100 * both >= percent * (len(host) + len(s) - both):
                            us.append(ck)
                            vs.append(v)
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        texts = join_sized(self.docs, need, "doc_id", rows=100_000).select("doc_id", "text", "ck", "to")
        sets = texts.mapInArrow(send, "v long, part int, ck long, own binary").repartition("v", "part")
        return sets.sortWithinPartitions("v", "part", F.col("ck") != F.col("v")).mapInArrow(meet_all, "u long, v long").distinct()

    def _pin_pivots(self) -> DataFrame:
        """(u, v): for every class the class that shares most pins with it, of those that pins are shared with most."""
        pins = self.classes.select("ck", "n", F.explode("pins").alias("h"))
        df = pins.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        pins = materialize(pins.join(df, "h"), "pins")
        weighed = join_sized(pins, materialize(pins.groupBy("ck").agg(F.sum("df").alias("weight")), "weight"), "ck")
        heavy = weighed.groupBy("h").agg(F.max(F.struct("weight", "ck", "n")).alias("p"))
        near = weighed.join(heavy, "h").where("ck <> p.ck").where(f"100 * least(n, p.n) >= {self.percent} * greatest(n, p.n)")
        near = near.groupBy(F.col("ck").alias("u"), F.col("p.ck").alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
        # Linked sets share most of their smallest shingles; what shares fewer is left to the prefixes.
        near = near.where(f"c >= least(n, {PINS}) / 3")
        return near.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v"))

    def _prefix_pivots(self, opened: DataFrame, span: DataFrame, state: DataFrame, tried: DataFrame) -> DataFrame:
        """(u, v): for every group's first class that of the group it shares most prefix shingles with, of those whose
        shingles are shared most (of a family its original, or the copy least changed); and in a group of several
        components every class with the first. Without pairs that the filters rule out."""
        t = self.percent
        weight = materialize(opened.groupBy("gh").agg(F.sum("df").alias("weight")), "weight")
        heavy = join_sized(opened, weight, "gh").groupBy("tok").agg(F.max(F.struct("weight", "gh", "rep", "n", "pos", "lo", "hi")).alias("p"))
        met = opened.join(heavy, "tok").where("gh <> p.gh AND NOT (lo = hi AND p.lo = p.hi AND lo = p.lo)").where(f"{_long('', 'p.', t)} AND {_early('', 'p.', t)}")
        # A shared shingle that few groups have says most: copies of a copy share its changes.
        met = met.groupBy(F.col("rep").alias("u"), F.col("p.rep").alias("v")).agg(F.sum((F.lit(1 << 30) / F.col("df")).cast("long")).alias("c"))
        met = met.join(tried, ["u", "v"], "left_anti").groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
        own = join_sized(state, span.where("lo <> hi").select("gh", "rep"), "gh").select(F.col("ck").alias("u"), F.col("rep").alias("v"))
        pairs = materialize(met.union(own).where("u <> v").distinct(), "pivots")
        signed = lambda c: self.members.select(F.col("ck").alias(c), F.struct("n", "sig").alias(f"of_{c}"))
        return join_sized(signed("v"), join_sized(signed("u"), pairs, "u"), "v").where(_alike("of_u.", "of_v.", t)).select("u", "v").distinct()

    def _near(self, live: DataFrame, members: DataFrame, apart: str = "true") -> DataFrame:
        """(g, h): pairs of groups, g < h, that pass the length, position and signature filters. Signatures are those of
        groups with one member."""
        t = self.percent
        one = members.groupBy("gh").agg(F.min("ck").alias("a"), F.max("ck").alias("b"), F.first("sig").alias("sig"))
        live = join_sized(live, one.select("gh", F.when(F.col("a") == F.col("b"), F.col("sig")).alias("sig")), "gh")
        x, y = live.alias("x"), live.alias("y")
        j = x.join(y, (F.col("x.tok") == F.col("y.tok")) & F.expr(f"x.gh < y.gh AND {_long('x.', 'y.', t)} AND {_early('x.', 'y.', t)} AND {apart} AND {_alike('x.', 'y.', t)}"))
        return j.select(F.col("x.gh").alias("g"), F.col("y.gh").alias("h")).distinct()

    def _expanded(self, pairs: DataFrame, members: DataFrame, where: str = "true") -> DataFrame:
        """Group pairs (g, h), g = h for pairs within a group, as member class pairs u < v."""
        more = [c for c in ("comp",) if c in members.columns]
        a = members.select(F.col("gh").alias("g"), F.col("ck").alias("a"), *(F.col(c).alias("ca") for c in more))
        b = members.select(F.col("gh").alias("h"), F.col("ck").alias("b"), *(F.col(c).alias("cb") for c in more))
        out = pairs.join(a, "g").join(b, "h").where("a <> b").where(where)
        return out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()

    def _own(self, groups: DataFrame) -> DataFrame:
        """Groups as pairs with themselves, where sets of their size can link without being equal."""
        t = self.percent
        return groups.where(f"100 * (n - 1) >= {t} * (n + 1)").select(F.col("gh").alias("g"), F.col("gh").alias("h")).distinct()

    def pairs(self) -> DataFrame:
        """(u, v): every link between different classes, by class key. As many rows as there are links."""
        self._post()
        near = self._near(self.live, self.members).union(self._own(self.members.where("several")))
        return self._verified(materialize(self._expanded(near, self.members), "todo"))

    def _components(self) -> DataFrame:
        """(ck, comp) of all classes that have links: pivots by pins, pivots by prefixes, then the join of what is open."""
        tried = materialize(self._pin_pivots(), "todo")
        links = materialize(self._verified(tried), "links")
        comps = _named(connected(links))
        self._post()
        live, done = self.live, []
        for last in (False, True):
            state = materialize(_with_comp(self.members, comps), "state")
            span = materialize(state.groupBy("gh", "n").agg(F.min("ck").alias("rep"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "span")
            posted = join_sized(live, span.select("gh", "rep", "lo", "hi"), "gh")
            bounds = posted.groupBy("tok").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.count("*").alias("df")).where("low <> high")
            opened = materialize(posted.join(bounds.select("tok", "df"), "tok"), "open")
            if last:
                near = self._near(opened, self.members, "NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)").union(self._own(span.where("lo <> hi")))
                todo = self._expanded(near, state, "ca <> cb")
            else:
                todo = self._prefix_pivots(opened, span, state, tried)
            for t in (tried, tried.select(F.col("v").alias("u"), F.col("u").alias("v"))):
                todo = todo.join(t, ["u", "v"], "left_anti")
            todo = materialize(todo, "todo")
            found = materialize(self._verified(todo), "links")
            tried, links = tried.union(todo), links.union(found)
            if not found.isEmpty():
                comps = _named(connected(links))
            # Components only grow: a shingle that is settled now stays so.
            live = opened.select("tok", "gh", "n", "pos")
            done.append(opened)
            for t in (span, state):
                discard(t)
        for t in done:
            discard(t)
        return comps

    def labels(self) -> DataFrame:
        """(doc_id, n_shingles, component_id): one row per input row; the component is its smallest linked id."""
        comp = _with_comp(self.classes.select("ck", "owner"), self._components())
        low = comp.groupBy("comp").agg(F.min("owner").alias("component_id"))
        named = comp.join(low, "comp").select("ck", "component_id")
        out = self.rows.join(named, "ck", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    return JaccardJoin(docs, id_col, text_col, words, percent).labels()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, with all its columns: the one whose id is the component's smallest.

    Of repeated rows (same id and text) one stays; rows that share an id but not the text stay or go together,
    and stay if one of them stands for its group; rows with a null id and empty texts stay.
    """
    marks = materialize(components(docs, id_col, text_col, words, percent), "components")
    stays = (F.col("doc_id") == F.col("component_id")) | F.col("component_id").isNull()
    ids = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(stays.cast("int")).alias("stays"), F.count("*").alias("rows"))
    gone = materialize(ids.where("stays = 0").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)), "gone")
    out = join_sized(docs, gone, id_col, "left_anti")
    if not ids.where("stays = 1 AND rows > 1").isEmpty():
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(out.where(F.col(id_col).isNull()))
    return out
