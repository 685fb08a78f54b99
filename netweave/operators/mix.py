"""Composition of data sets: unions, seeded samples, shuffles and mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.windows import interleave

#: Fixed values of the arithmetic hash; products stay inside 64 bits.
_A, _B, _M = 1103515245, 12345, 2147483647


def order_hash(order: str, seed: int) -> Column:
    """A pseudo-random rank from an integer column, the same in any engine."""
    mixed = (F.pmod(F.col(order), F.lit(_M)) * _A + F.lit(_B + 7919 * seed)) % _M
    return (mixed * 48271 + F.lit(seed)) % _M


def sample_n(df: DataFrame, n: int, order: str, seed: int) -> DataFrame:
    """``n`` rows without replacement: those with the least hash, ties by ``order``.

    No task sorts the sample.  Counts by the hash's upper bits, and then by the
    whole hash in the bucket where the n-th row lies, find the last hash that is
    in; only rows of that one hash are ordered.
    """
    hashed = df.withColumn("_h", order_hash(order, seed))
    low, left = _cut(hashed, F.shiftright("_h", _LOW_BITS), n)
    if low is None:
        return df
    inside = hashed.where(F.shiftright("_h", _LOW_BITS) == low)
    last, left = _cut(inside, F.col("_h"), left)
    ties = hashed.where(F.col("_h") == last).orderBy(order).limit(left)
    return hashed.where(F.col("_h") < last).unionByName(ties).drop("_h")


#: Bits of the hash below its upper ones: at most 2 ** 16 counts reach the driver.
_LOW_BITS = 16


def _cut(df: DataFrame, bucket: Column, n: int) -> tuple[int | None, int]:
    """(bucket of the n-th row in order of buckets, rows wanted from it); None if there are fewer rows."""
    for r in df.groupBy(bucket.alias("b")).count().orderBy("b").toLocalIterator():
        if n <= r["count"]:
            return r["b"], n
        n -= r["count"]
    return None, n


def sample_share(df: DataFrame, share: float, order: str, seed: int) -> DataFrame:
    """The floor(share * rows) rows with the least hash."""
    return sample_n(df, int(share * df.count()), order, seed)


def union_by_name(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _segments(*parts: DataFrame) -> DataFrame:
    return union_by_name(*(p.withColumn("segment", F.lit(i)) for i, p in enumerate(parts)))


def mix_a(benign: DataFrame, attack: DataFrame, order: str, seed: int = 1) -> DataFrame:
    """Half of the benign rows, then all attack rows."""
    return _segments(sample_share(benign, 0.5, order, seed), attack)


def mix_b(benign: DataFrame, attack: DataFrame, order: str, seed: int = 1) -> DataFrame:
    """All attack rows, then half of the benign ones."""
    return _segments(attack, sample_share(benign, 0.5, order, seed))


def mix_c(benign: DataFrame, attack: DataFrame, order: str, seed: int = 1) -> DataFrame:
    """30 % of the attack and 70 % of the benign rows, in a shuffled order (``rank_key``)."""
    both = union_by_name(sample_share(attack, 0.3, order, seed), sample_share(benign, 0.7, order, seed))
    return both.withColumn("rank_key", order_hash(order, seed + 1))


def mix_d(benign: DataFrame, attack: DataFrame, order: str, block: int = 500) -> DataFrame:
    """Blocks of benign and attack rows in turn; sort by (block, segment, rn)."""
    return interleave(_segments(benign, attack), "segment", order, block)


def mix_bmb(benign: DataFrame, mixed: DataFrame, order: str, sizes: tuple[int, int, int] = (300, 200, 300), seeds: tuple[int, int, int] = (10, 11, 12)) -> DataFrame:
    """Benign, mixed and benign samples one after the other."""
    sources = (benign, mixed, benign)
    return _segments(*(sample_n(s, n, order, seed) for s, n, seed in zip(sources, sizes, seeds)))
