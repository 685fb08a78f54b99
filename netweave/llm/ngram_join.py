"""N-gram Jaccard join by token-combination prefixes.

Documents whose word-shingle sets have a Jaccard similarity of ``percent`` or
more are linked; the result is each document's component of links.

1. One pass makes each document's set (64-bit shingle hashes), a 128-bit key of
   the set, a parity sketch of it (one bit or two per shingle) and a count of
   shingles by hash bucket, of a fixed size, summed over all documents.  Equal
   sets are one class, a node of the graph of links, from here on.
2. Shingles are ordered by their count in that table, rare ones first.  A set
   of n shingles can miss at most d = n - ceil(percent * n / 100) of them in a
   partner, so a prefix of d + 1 rare shingles must share one with it: each is
   a signature.  A shingle that more than ``HEAVY`` sets turn out to have in
   their prefix is frequent as well; that bounds the work per rare shingle.
   Where rare shingles do not reach, the prefix is extended by frequent ones.
   These are dealt by their hash to m sub-classes, and every pair inside a
   sub-class is a signature: as the first shingle of a sub-class proves
   nothing, the prefix is longer by one for each sub-class it touches.  m
   follows the size of the set, in overlapping bands, so that two sets that can
   be linked share a band.
3. Signatures are sorted, the only time all of them move, by range partitions
   of (signature, node), which cut a hot signature anywhere, and swept in
   order: the first node of a signature leads the others.  Runs that go on in
   the next partition are joined by two rows per partition.
4. Nodes that share a signature are candidates.  Pairs are dropped by size and
   by their sketches, which differ in no more bits than the sets in shingles;
   sets are made and moved only for nodes of pairs that are left.  First each
   node is compared with the leader it shares most signatures with, a linear
   number of pairs that joins groups of near copies whole; then, as far as they
   are in another component by then, with its other leaders, with one more
   leader per signature, and with every candidate.  No link between components
   is lost, and no group of near copies is expanded into its pairs.

Defined results: null or empty texts and texts without words have an empty set
and are linked with nothing; texts of fewer words than a shingle have one
shingle, their whole sequence; equal sets are linked; rows that repeat a doc_id
count as linked through it; rows without a doc_id get no component id of their
own and link nothing; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import MIX, arrow_map, distinct, having_ids, mix64, Scratch, slices, windows, word_hashes
from netweave.llm.connected import components

#: Buckets of the table of counts, and of one row of it.
SKETCH_BITS, ROW_BITS = 20, 15
#: Tasks whose counts are summed in one step; only the number of steps depends on it.
FAN_IN = 64
#: A shingle is frequent from this count on, over the mean load of a bucket.
FREQUENT, LOADS = 256, 4
#: Sets that may share a single shingle before it counts as frequent, whatever the table says.
HEAVY = 4096
#: Open signatures of a set that its rows carry when pairs are made.
FIRST = 64
#: Similarities that the bands and sketches are made for.
LEAST_PERCENT = 50
#: Sets of a task that are remembered, so that their copies make no signatures again.
SEEN = 1 << 16


def bands(percent: int) -> list[tuple[int, float, float]]:
    """(sub-classes m, least size, largest size); sets that can be linked share a band."""
    tops = [48, *(75 * 16**k for k in range(1, 7))]
    return [(1, 0, tops[0]), *((16**k, percent / 100 * tops[k - 1], tops[k]) for k in range(1, 7))]


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(h) < k:
        return mix64(windows(h, len(h)) + np.uint64(len(h)))
    return distinct(windows(h, k))


def key_of(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set."""
    data = h.tobytes()
    return xxhash.xxh3_64_intdigest(data) - 2**63, xxhash.xxh3_64_intdigest(data, 99) - 2**63


def node_of(h: np.ndarray, clash: frozenset) -> int:
    """The node of a set: the first half of its key, or the second where two sets share the first."""
    first, second = key_of(h)
    return second if first in clash else first


def parity(h: np.ndarray) -> np.ndarray:
    """The parity sketch: bit i is set where an odd number of shingles falls on it.

    It has 64 * 2**j bits, 1.5 a shingle at least; the halves of a longer one
    XORed are the shorter one of the same set.
    """
    bits = 64 << max(0, int(np.ceil(np.log2(max(1.5 * len(h), 64) / 64))))
    at = (mix64(h ^ MIX[1]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<i8")


def level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of a power of two, one byte each."""
    return np.minimum(255, 8 * np.log2(1.0 + counts)).astype(np.uint8)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _pass_one(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = pa.int64()
        names = ["id", "n", "k1", "k2", "sketch", "chunk", "counts"]
        for b in slices(batches):
            id_type = b.column(0).type
            n, k1, k2, sketches, seen = [], [], [], [], []
            for value in b.column(1).to_pylist():
                h = shingles(value or "", k)
                first, second = key_of(h) if len(h) else (None, None)
                n.append(len(h))
                k1.append(first)
                k2.append(second)
                sketches.append(parity(h) if len(h) else np.zeros(0, np.int64))
                seen.append(h)
            counts += np.bincount((np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(sketches), none, pa.nulls(b.num_rows, pa.binary())], names=names)
        if counts.any():
            rows = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in counts.reshape(-1, 1 << ROW_BITS)]
            m = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(range(m), pa.int32()), pa.array(rows, pa.binary())], names=names)

    return arrow_map(docs, run, f"id {kind}, n int, k1 long, k2 long, sketch array<long>, chunk int, counts binary")


def _counts(rows: DataFrame) -> np.ndarray:
    """The summed counts: a table of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(data), "<i8")
                total[chunk] = total[chunk] + got if chunk in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in total.values()], pa.binary())], names=["chunk", "counts"])

    n = 1 << (SKETCH_BITS - ROW_BITS)
    tasks = rows.where("chunk = 0").count()
    if tasks > FAN_IN:  # two levels: partial sums of many tasks' rows first, so no task reads them all
        rows = arrow_map(rows.repartition(n * min(8, -(-tasks // FAN_IN)), "chunk", F.pmod(F.xxhash64("counts"), F.lit(8))), run, "chunk int, counts binary")
    parts = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in arrow_map(rows.repartition(parts, "chunk"), run, "chunk int, counts binary").collect():
        out[r[0] << ROW_BITS : (r[0] + 1) << ROW_BITS] += np.frombuffer(zlib.decompress(r[1]), "<i8")
    return out


def single(h: np.ndarray) -> np.ndarray:
    """The signatures of single shingles: odd numbers; those of pairs are even."""
    return mix64(h ^ MIX[2]) | np.uint64(1)


def signatures(h: np.ndarray, levels: np.ndarray, cut: int, percent: int, heavy: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(single, combined) signatures of a set; sets that only equal ones can match have none.

    ``heavy`` are single signatures that turned out to be frequent.
    """
    n = len(h)
    d = n - (percent * n + 99) // 100
    none = np.zeros(0, np.uint64)
    if 100 * n < percent * (n + 1):  # one shingle more or less is too much
        return none, none
    q = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    rare = q <= cut
    if heavy:
        rare &= ~np.isin(single(h), np.array(heavy, np.int64).view(np.uint64))
    order = np.lexsort((h, q, ~rare))
    h, n_rare = h[order], int(rare.sum())
    if n_rare > d:
        return single(h[: d + 1]), none
    out, common = [none], h[n_rare:]
    for m, least, most in bands(percent):
        if least <= n <= most:
            sub = (mix64(common) % np.uint64(m)).astype(np.int64)
            proves = np.ones(len(common), bool)
            proves[np.unique(sub, return_index=True)[1]] = False
            end = int(np.searchsorted(np.cumsum(proves), d + 1 - n_rare)) + 1
            members, sub = common[:end], sub[:end]
            by = np.argsort(sub, kind="stable")
            for group in np.split(members[by], np.flatnonzero(np.diff(sub[by])) + 1):
                if len(group) > 1:
                    i, j = np.triu_indices(len(group), 1)
                    low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                    out.append(mix64(low * MIX[0] + mix64(high + np.uint64(m))) & ~np.uint64(1))
    return single(h[:n_rare]), np.unique(np.concatenate(out))


def _signature_table(docs: DataFrame, levels, cut: int, k: int, percent: int, clash: frozenset) -> DataFrame:
    """(sig, node, n) for docs (text, heavy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in slices(batches):
            found, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for value, heavy in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingles(value or "", k)
                node = node_of(h, clash)
                if not len(h) or node in done:
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(node)
                both = np.concatenate(signatures(h, levels.value, cut, percent, heavy))
                found.append(both)
                nodes.append(np.full(len(both), node))
                sizes.append(np.full(len(both), len(h), np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["sig", "node", "n"])

    return arrow_map(docs.select("text", "heavy"), run, "sig long, node long, n int")


def _single_table(docs: DataFrame, k: int, clash: frozenset) -> DataFrame:
    """(node, sig): the single signature of every shingle, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            sets = [shingles(value or "", k) for value in b.column(0).to_pylist()]
            at = np.repeat([node_of(h, clash) for h in sets], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(single(np.concatenate(sets)).view(np.int64))], names=["node", "sig"])

    return arrow_map(docs.select("text"), run, "node long, sig long")


def _set_table(docs: DataFrame, k: int, clash: frozenset) -> DataFrame:
    """(node, hashes): whole sets, one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(value or "", k) for value in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h, clash) for h in sets], pa.int64()), _lists([h.view(np.int64) for h in sets])], names=["node", "hashes"])

    return arrow_map(docs.select("text"), run, "node long, hashes array<long>").dropDuplicates(["node"])


_SWEPT = "sig long, lead long, lead_n int, node long, n int, part int, edge int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, node, n) in order: each member of a signature with its leader, the first one.

    Signatures of one node alone give no row.  ``edge`` marks the rows that
    tell of a partition's first (1) and last (2) signature.
    """
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    part = TaskContext.get().partitionId()

    def rows(sig, lead, lead_n, node, n, edge):
        m = len(sig)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, t)) for x, t in zip((sig, lead, lead_n, node, n, np.full(m, part), np.full(m, edge)), (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32))], names=names)

    run = None  # the open signature: sig, lead, lead_n, last node, whether its leader has a row
    for b in batches:
        sig, node, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(sig):
            continue
        before = run or (None, 0, 0, None, False)
        starts = np.concatenate([[sig[0] != before[0]], sig[1:] != sig[:-1]]) if run else np.concatenate([[True], sig[1:] != sig[:-1]])
        if run is None:
            yield rows(sig[:1], node[:1], n[:1], node[:1], n[:1], 1)
        again = ~starts & np.concatenate([[node[0] == before[3]], node[1:] == node[:-1]])
        at = np.flatnonzero(starts)
        owner = np.cumsum(starts)  # 0: the signature open from the batch before
        lead = np.concatenate([[before[1]], node[at]])[owner]
        lead_n = np.concatenate([[before[2]], n[at]])[owner]
        member = ~starts & ~again
        told = np.zeros(len(at) + 1, bool)
        told[owner[member]] = True
        own = np.flatnonzero(told[1:])  # signatures of this batch whose leader gets its row
        s, l, ln = sig[at][own], node[at][own], n[at][own]
        if told[0] and not before[4]:
            s, l, ln = np.append(s, before[0]), np.append(l, before[1]), np.append(ln, before[2])
        yield rows(np.concatenate([s, sig[member]]), np.concatenate([l, lead[member]]), np.concatenate([ln, lead_n[member]]), np.concatenate([l, node[member]]), np.concatenate([ln, n[member]]), 0)
        run = (int(sig[-1]), int(lead[-1]), int(lead_n[-1]), int(node[-1]), bool(told[owner[-1]]) or (owner[-1] == 0 and before[4]))
    if run:
        yield rows([run[0]], [run[1]], [run[2]], [run[1]], [run[2]], 2)


def _members(sigs: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, lead, lead_n, node, n): the nodes of every signature that two nodes or more share."""
    swept = scratch.store(sigs.select("sig", "node", "n").repartitionByRange("sig", "node").sortWithinPartitions("sig", "node").mapInArrow(_sweep, _SWEPT), "swept")
    crossing, open_ = [], None  # signatures that go on in the next partition: with their leader, a member
    ends: dict[int, dict] = {}
    for r in swept.where("edge > 0").select("part", "edge", "sig", "lead", "lead_n").collect():  # two rows a partition
        ends.setdefault(r.part, {})[r.edge] = r[2:]
    for part in sorted(ends):
        first, last = ends[part][1], ends[part][2]
        goes_on = open_ and first[0] == open_[0]
        if goes_on:
            crossing += [(*open_, *open_[1:]), (*open_, *first[1:])]
        open_ = open_ if goes_on and last[0] == first[0] else last
    members = swept.where("edge = 0").select("sig", "lead", "lead_n", "node", "n")
    if not crossing:
        return members
    ends_of = sigs.sparkSession.createDataFrame(crossing, members.schema)
    true = F.broadcast(ends_of.select("sig", F.col("lead").alias("_lead"), F.col("lead_n").alias("_lead_n")).distinct())  # one row a partition at most
    moved = members.join(true, "sig").select("sig", F.col("_lead").alias("lead"), F.col("_lead_n").alias("lead_n"), "node", "n")
    return members.join(true, "sig", "left_anti").unionByName(moved.unionByName(ends_of).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * shared >= percent * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sketches_fit(percent: int):
    """Whether two sketches (sa, sb) differ in no more bits than linked sets (of na and nb shingles) can in shingles."""
    bits, a, b = lambda: F.lit(0), F.col("sa"), F.col("sb")
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    half = lambda x: xor(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2))
    # Sizes within a factor of two: one sketch is at most twice as long as the other.
    differ = F.when(F.size(a) > F.size(b), xor(half(a), b)).when(F.size(a) < F.size(b), xor(a, half(b))).otherwise(xor(a, b))
    count = F.aggregate(differ, bits(), lambda total, x: total + F.bit_count(x))
    return (100 + percent) * count <= (100 - percent) * (F.col("na") + F.col("nb"))


class _Join:
    """The steps of one join over stored tables."""

    def __init__(self, texts: DataFrame, k: int, percent: int):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
        self.spark, self.texts, self.k, self.percent = texts.sparkSession, texts, k, percent
        self.scratch = Scratch(self.spark, "ngram-join")
        made = self.scratch.store(_pass_one(texts, k), "sets")
        self.rows = made.where("chunk is null").select("id", "n", "k1", "k2")
        usable = made.where("k1 is not null and id is not null")
        classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        classes = self.scratch.store(classes, "classes")
        # Sets that share half of their key: none to be expected up to thousands of millions of sets, a few beyond.
        self.clash = frozenset(r[0] for r in classes.groupBy("k1").count().where("count > 1").select("k1").collect())
        self.nodes = classes.withColumn("node", F.when(F.col("k1").isin(list(self.clash)), F.col("k2")).otherwise(F.col("k1")) if self.clash else F.col("k1"))
        total = _counts(made.where("chunk is not null").select("chunk", "counts"))
        self.levels = self.spark.sparkContext.broadcast(level(total))  # one byte a bucket: a fixed size
        self.cut = int(level(np.array([FREQUENT + LOADS * total.mean()]))[0])

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(id, text) for a stored table of nodes."""
        ids = self.scratch.store(self.nodes.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("id")), "wanted")
        return having_ids(self.texts, ids, "id")

    def all_members(self) -> DataFrame:
        """The members of all signatures, once no single shingle is shared by more than HEAVY sets.

        A shingle that more sets hold in their prefix than the counts let expect
        is frequent from then on.  Only sets with such a shingle in their prefix
        change, and they learn of all such shingles they hold, so all sets go by
        one order.
        """
        scratch, none = self.scratch, F.lit(None).cast("array<long>")
        make = lambda texts: _signature_table(texts, self.levels, self.cut, self.k, self.percent, self.clash)
        sigs, heavy = scratch.store(make(self.texts.where("id is not null").select("text", none.alias("heavy"))), "signatures"), None
        while True:
            members = _members(sigs, scratch)
            new = scratch.store(members.where("sig % 2 <> 0").groupBy("sig").count().where(F.col("count") > HEAVY).select("sig"), "frequent")
            if not new.limit(1).count():
                scratch.free(sigs)
                return members
            heavy = new if heavy is None else scratch.store(heavy.unionByName(new).distinct(), "heavy")
            held = lambda: scratch.store(sigs.where("sig % 2 <> 0").join(heavy, "sig", "left_semi").select("node").distinct(), "changed")  # noqa: B023, E731
            # Most of what the next rounds would find: shingles that many of these sets hold anywhere.
            near = _single_table(self.texts_of(held()), self.k, self.clash).groupBy("sig").count().where(F.col("count") > HEAVY).select("sig")
            heavy = scratch.store(heavy.unionByName(near).distinct(), "heavy")
            changed = held()
            texts = self.texts_of(changed)
            theirs = _single_table(texts, self.k, self.clash).join(heavy, "sig").groupBy("node").agg(F.collect_set("sig").alias("heavy"))
            theirs = scratch.store(theirs.join(self.nodes.select("node", F.col("rep").alias("id")), "node").select("id", "heavy"), "theirs")
            again = make(texts.join(theirs, "id"))
            after = scratch.store(sigs.join(changed, "node", "left_anti").unionByName(again), "signatures")
            scratch.free(sigs)
            sigs = after

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches allow a link."""
        of = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return pairs.join(of("b"), "b").join(of("a"), "a").where(_sketches_fit(self.percent)).select(*pairs.columns)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (stored) that are links."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        return _verified(pairs, _set_table(self.texts_of(ends), self.k, self.clash), self.percent)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) in two components."""
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id; ``percent`` is from 50 to 100."""
    join = _Join(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), k, percent)
    scratch, nodes = join.scratch, join.nodes
    members = join.all_members()
    led = members.where("lead <> node").where(_sizes_fit("lead_n", "n", percent)).groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    led = scratch.store(join.fitting(led), "led")
    best = scratch.store(led.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b"), "best")
    # Sets that one doc_id has are linked through it, each with the least of them.
    own = scratch.store(join.rows.where("k1 is not null and id is not null").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node"), "ids")
    several = own.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("id", "a")
    by_id = own.join(several, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = scratch.store(join.linked(best).unionByName(by_id), "links")
    found, tested = components(links, scratch), best

    def look(pairs: DataFrame) -> None:
        """Test the pairs, and take what is linked into the components."""
        nonlocal links, found, tested
        more = scratch.store(join.linked(pairs), "links")
        tested = scratch.store(tested.unionByName(pairs), "tested")
        if more.limit(1).count():
            links = scratch.store(links.unionByName(more), "links")
            found = components(links, scratch)

    others = scratch.store(_apart(led.select("a", "b"), found).join(best, ["a", "b"], "left_anti"), "others")
    if others.limit(1).count():
        look(others)
    for leaders in (1, 2):  # all members of a signature have been compared with so many of them
        placed = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("sig", "lead", "node", "n", F.coalesce("component", "node").alias("component"))
        placed = scratch.store(placed, "placed")
        other = F.min(F.when(F.col("node") != F.col("lead"), F.struct(F.xxhash64("node", "sig").alias("x"), "node", "n", "component"))).alias("other")
        mixed = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), other)
        mixed = mixed.where((F.col("low") != F.col("high")) & (F.col("size") > leaders + 1)).select("sig", "other")
        if leaders == 1:
            pairs = placed.join(mixed, "sig").where("component <> other.component and node <> lead").select(F.col("other.node").alias("a"), F.col("node").alias("b"), F.col("other.n").alias("na"), F.col("n").alias("nb")).where(_sizes_fit("na", "nb", percent))
            pairs = join.fitting(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        else:
            part = scratch.store(placed.join(mixed, "sig").where("node <> lead and node <> other.node").select("sig", "node", "n", "component"), "open")
            # A pair is made at the least signature that both nodes have here, as far as their FIRST least ones tell; beyond, it may be made more than once.
            own = part.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, FIRST).alias("sigs")).join(nodes.select("node", "sketch"), "node")
            side = lambda x: part.join(own, "node").select("sig", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("sketch").alias(f"s{x}"), F.col("sigs").alias(f"g{x}"))
            apart = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _sizes_fit("na", "nb", percent)
            once = F.coalesce(F.array_min(F.array_intersect("ga", "gb")) >= F.col("sig"), F.lit(True))
            pairs = side("a").join(side("b"), "sig").where(apart & _sketches_fit(percent) & once).select("a", "b").distinct()
        pairs = scratch.store(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        scratch.free(placed)
        if pairs.limit(1).count():
            look(pairs)
    placed = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.join(found.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("least"))
    named = scratch.store(placed.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "rep").alias("component_id")), "components")
    return join.rows.join(named, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component (its least doc_id), with all their columns.

    Rows without a doc_id stay.
    """
    found = link_components(docs, id_col, text, k, percent)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return having_ids(docs, Scratch(docs.sparkSession, "near-copies").store(gone, "gone"), id_col, without=True)
