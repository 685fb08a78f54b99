"""Exact dedup by content-defined chunk recipes.

1. Each text is cut where a rolling hash of its last 16 bytes says so, so equal
   passages are cut alike wherever they stand.  A document becomes a recipe of
   chunk digests; only digests leave the task, never the text.
2. Chunks with the same 64-bit hash and the same SHA-256 are one chunk; its
   identifier is the place where it is first found.  A hash that two different
   chunks share therefore gets two identifiers (it is verified by SHA-256).
3. Documents are equal when their ordered identifier lists are equal.

Defined results: null text counts as empty and equals other empty texts; the
row with the largest doc_id stays (null ids lose to any id); of rows that
repeat the same doc_id and text exactly one is kept; very long texts are cut
into chunks as any other; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import arrow_map, having_ids, Scratch, slices

#: Chunk sizes in bytes: at least, on average beyond that, at most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
WINDOW = 16
#: Bytes of a text whose marks are looked for at a time.
STRETCH = 1 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the bytes alone."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    found = []
    for at in range(0, n, STRETCH):  # a stretch, and the bytes before it that its first hashes cover
        low = max(0, at - WINDOW + 1)
        h = _GEAR[np.frombuffer(data[low : at + STRETCH], np.uint8)]
        for w in (1, 2, 4, 8):  # h[i] becomes the hash of bytes i-15..i
            h[w:] += h[:-w] << np.uint32(w)
        marks = np.flatnonzero((h[at - low :] >> np.uint32(8)) & np.uint32(mean - 1) == 0) + 1 + at
        found += marks[marks >= least].tolist()
    ends, last = [], 0
    for m in [*found, n]:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least or m == n:
            last = m
            ends.append(last)
    return ends if ends[-1] == n else [*ends, n]


def recipe(data: bytes) -> tuple[list[int], list[bytes]]:
    """The 64-bit hashes and SHA-256 digests of the chunks of a text, in order."""
    hashes, digests, last = [], [], 0
    for end in cut_points(data):
        chunk = data[last:end]
        hashes.append(xxhash.xxh3_64_intdigest(chunk) - 2**63)
        digests.append(hashlib.sha256(chunk).digest())
        last = end
    return hashes, digests


def recipes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document: its id, the digest of its text and its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            whole, hashes, digests, sizes = [], [], [], []
            for value in b.column(1).to_pylist():
                data = (value or "").encode()
                whole.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
                h, d = recipe(data)
                hashes.append(h)
                digests.append(d)
            columns = [b.column(0), pa.array(whole, pa.string()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_sha256", "n_bytes", "hashes", "digests"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text)), run, f"id {kind}, text_sha256 string, n_bytes long, hashes array<long>, digests array<binary>")
    return out.withColumn("row", F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    made = scratch.store(recipes(docs, id_col, text), "recipes")
    chunks = made.select("row", F.posexplode(F.arrays_zip("hashes", "digests")).alias("pos", "c")).select("row", "pos", F.col("c.hashes").alias("hash"), F.col("c.digests").alias("digest"))
    # The identifier of a chunk: the place it is first found at.
    ids = scratch.store(chunks.groupBy("hash", "digest").agg(F.min(F.struct("row", "pos")).alias("chunk"), F.count("*").alias("n")).where("n > 1").drop("n"), "chunks")
    placed = chunks.join(ids, ["hash", "digest"], "left").select("row", "pos", F.coalesce("chunk", F.struct("row", "pos")).alias("chunk"))
    lists = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("list"))
    lists = lists.select("row", F.transform("list", lambda x: x["chunk"]).alias("list"))
    listed = scratch.store(
        made.select("row", "id", "text_sha256").join(lists, "row", "left").withColumn("list", F.coalesce("list", F.array().cast(lists.schema["list"].dataType))),
        "lists",
    )
    stays = F.max(F.struct(F.col("id"), F.col("row"))).alias("stays")
    groups = scratch.store(listed.groupBy("list").agg(stays, F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    joined = listed.join(groups, "list", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("stays.id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Of rows that repeat both doc_id and text the one stays whose columns have
    the largest 64-bit hash.  Only ids and digests of groups are moved; texts
    are hashed where they are.
    """
    scratch = Scratch(docs.sparkSession, "drop-copies")
    found = scratch.store(exact_groups(docs, id_col, text), "groups").where("group_size > 1")
    pairs = scratch.store(found.groupBy(id_col, "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "pairs")
    gone = scratch.store(pairs.where("not kept").select(id_col, "text_sha256"), "gone")
    twice = scratch.store(pairs.where("kept and n > 1").select(id_col, "text_sha256"), "twice")
    mark = lambda df: F.sha2(F.coalesce(df[text], F.lit("")).cast("binary"), 256)
    stay = having_ids(docs, gone, id_col, mark(docs), without=True)
    again = having_ids(stay, twice, id_col, mark(stay))
    every = [again[f"`{c}`"] for c in again.columns]
    one = again.groupBy(again[id_col].alias("k0"), mark(again).alias("k1")).agg(F.max_by(F.struct(*every), F.xxhash64(*every)).alias("r"))
    return having_ids(stay, twice, id_col, mark(stay), without=True).unionByName(one.select("r.*"))
