"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one step of an Arrow task looks at; bounds its memory.
SLICE_ROWS = 256
#: Bytes of an Arrow batch on its way to Python, so that a batch of very long texts stays small.
BATCH_BYTES = 8 << 20
#: Rows that a Parquet reader decodes at a time, and bytes of a row group that a writer holds until it is full: each task
#: has both in the heap beside its Arrow batches, and Spark's own 4,096 rows and 128 MB are too much there for whole texts.
READ_ROWS, GROUP_BYTES = 512, 16 << 20
#: Entries of a memo table before it starts afresh; a worker holds several tables.
MEMO_ROWS = 120_000
#: Longest word, in bytes or characters, that a memo table keeps; with MEMO_ROWS it bounds the table's bytes.
MEMO_WORD = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests) a temporary folder is made where that is unset,
    and remembered in the session; on a cluster it has to be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("netweave.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="netweave-")
        spark.conf.set("netweave.shared.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage for good.

    A lost executor costs at most the stage that was running: what was stored
    is read back from the shared folder, never recomputed.  Tables that a
    result is read from stay there; who runs the session removes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def store(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{label}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._netweave_path = path
        return kept

    def free(self, *tables: DataFrame) -> None:
        """Give back the space of stored tables that no later step reads."""
        for df in tables:
            self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(df._netweave_path)


#: Most rows, and most bytes of their values, of a stored table of ids that is sent to all executors.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def _is_small(ids: DataFrame) -> bool:
    """Whether a stored table of ids may be broadcast: its rows are counted and their bytes added up."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`") if kind in ("string", "binary") else F.col(f"`{c}`").cast("string")), F.lit(0)) for c, kind in ids.dtypes), F.lit(16))
    rows, size = ids.limit(SMALL_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= SMALL_ROWS and size <= SMALL_BYTES


def having_ids(df: DataFrame, ids: DataFrame, *columns: str | Column, without: bool = False) -> DataFrame:
    """The rows of ``df`` whose columns, or expressions, are (or are not) in the stored table ``ids``, column by column.

    A small table of ids is broadcast, so that the rows, whole texts, stay where
    they are; a larger one is joined by a shuffle of both sides.
    """
    few = _is_small(ids)
    named = ids.toDF(*(f"_id_{i}" for i in range(len(columns))))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same &= (df[f"`{c}`"] if isinstance(c, str) else c).eqNullSafe(named[f"_id_{i}"])
    return df.join(F.broadcast(named) if few else named, same, "left_anti" if without else "left_semi")


def ascii_lower(column):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_map(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, read from and written to Parquet in small pieces."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    conf.set("parquet.block.size", str(GROUP_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a table of known words costs more than hashing them."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multipliers for mixing 64-bit hashes.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix64(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and fold, twice)."""
    h = (h ^ (h >> np.uint64(32))) * MIX[3]
    h = (h ^ (h >> np.uint64(29))) * MIX[0]
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence of word hashes (k <= len)."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= MIX[0]
        out ^= out >> np.uint64(32)
        out += h[j : j + n]
    return mix64(out)


def distinct(h: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def held_out(doc_id):
    """The contracts' held-out fold: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


#: Bytes of words whose n-grams are made at a time: each takes some 100 bytes on the way.
GRAM_BYTES = 1 << 19


def _grams(data: bytes, owner: np.ndarray, room: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of bytes that start at the first ``len(owner)`` bytes and end within ``room``."""
    data, n_starts = np.frombuffer(data, np.uint8).astype(np.uint64), len(owner)
    packed, hashes, owners = data[:n_starts].copy(), [], []
    for n in range(1, min(most, len(data)) + 1):
        if n > 1:
            more = data[n - 1 : n - 1 + n_starts]
            packed[: len(more)] |= more << np.uint64(8 * (n - 1))
        if n >= least:
            whole = room >= n
            hashes.append(mix64(packed[whole] + np.uint64(n << 58)))
            owners.append(owner[whole])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners])


def gram_stretches(words: list[bytes], least: int, most: int, stretch: int = GRAM_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hash, index of the word) of every n-gram of bytes of ``<word>``, most <= 8, some words or a stretch of a long one at a time."""
    at = 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) + 2 <= stretch):
            size += len(words[end]) + 2
            end += 1
        data = b"<" + b"><".join(words[at:end]) + b">"
        if end == at + 1:  # one word, of any length
            for start in range(0, size, stretch):
                n = min(stretch, size - start)
                yield _grams(data[start : start + n + most - 1], np.full(n, at), size - start - np.arange(n), least, most)
        else:
            sizes = np.array([len(w) + 2 for w in words[at:end]])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield _grams(data, owner + at, np.cumsum(sizes)[owner] - np.arange(size), least, most)
        at = end


def gram_counts(words: list[bytes], least: int, most: int, buckets: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, bucket, times) of the n-grams of words, hashed into ``buckets``, by word; only ``live`` buckets if given.

    A bucket of a word may come more than once; those of long words are added up as they are made.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def together() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])

    for hashes, owner in gram_stretches(words, least, most):
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        if live is not None:
            kept = live[bucket]
            bucket, owner = bucket[kept], owner[kept]
        key = owner * buckets + bucket
        long = len(owner) and owner[0] == owner[-1]  # a word of its own, or a stretch of one
        held.append(np.unique(key, return_counts=True) if long else (key, np.ones(len(key), np.int64)))
        if sum(len(k) for k, _ in held) > 4 * GRAM_BYTES:
            keys, times = together()
            keys, inverse = np.unique(keys, return_inverse=True)
            held = [(keys, np.bincount(inverse, times, len(keys)).astype(np.int64))]
    keys, times = together()
    owner = keys // buckets
    order = np.argsort(owner, kind="stable")
    return owner[order], (keys % buckets)[order], times[order]
