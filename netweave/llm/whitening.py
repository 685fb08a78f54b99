"""Whitening of embeddings by a randomised range finder.

Vectors are put on a grid of whole numbers, so that their number and sums are
exact.  A random block of directions, some more than components wanted, is
multiplied by the covariance in passes over all centred rows: each pass turns
the block towards the leading directions and, by Rayleigh-Ritz inside it, gives
values, vectors and their residuals.  If the residuals are still too large after
``PASSES``, the block is expanded to the full dimension, where one more pass
makes Rayleigh-Ritz exact.

Each task adds up one small matrix; Spark sums them, and the driver sees a
matrix of dimension x block, whatever the number of rows.

Defined results: null and empty vectors, and those that hold a null, NaN or
infinite entry, are left out; vectors of different lengths, or with entries of
2^40 or more, are an error; repeated rows count each; a direction without
variance has whitened value and explained share 0 and does not count in
identity_error (a table of equal vectors has only such); null ids stay; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import arrow_map

COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 8, 4, 13
#: Largest residual of a Ritz pair, relative to the largest value, that counts as converged.
TOLERANCE = 1e-13
#: The grid on which vectors are put.
STEPS, SHIFT, LARGEST = 1024.0, 100_000, float(1 << 40)


def usable(column: str) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & finite, F.lit(False))


def grid(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers: floor(1024 c) + 100000."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError("embedding entries of 2^40 or more")
    return (np.floor(STEPS * values).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


class _Rows:
    """The vectors that take part, with passes over all of them."""

    def __init__(self, vectors: DataFrame, id_col: str, column: str):
        self.df = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("v")).where(usable("v"))

    def total(self, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """The sum over all rows of a matrix that each block of rows gives."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                if b.num_rows:
                    part = of(grid(b.column(0)))
                    out = part if out is None else out + part
            if out is not None:
                i, j = np.indices(out.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(out.ravel())], names=["i", "j", "x"])

        cells = arrow_map(self.df.select("v"), run, f"i int, j int, x {kind}").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
        out = np.zeros((1 + max(r["i"] for r in cells), 1 + max(r["j"] for r in cells)), np.int64 if kind == "long" else np.float64)
        for r in cells:
            out[r["i"], r["j"]] = r["x"]
        return out


def _ritz(block: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values (falling) and unit vectors inside a block whose image is known, and the largest residual of those wanted."""
    inner = block.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    vectors = block @ turn
    miss = np.linalg.norm(image @ turn - vectors * values, axis=0).max() if wanted else 0.0
    return values, vectors, float(miss)


def leading(covariance_times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The leading values and unit vectors of a covariance known by its products with blocks.

    ``covariance_times`` is one pass over all rows.
    """
    wide = min(dim, wanted + oversample)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, wide)))[0]
    for _ in range(passes if wide < dim else 0):
        image = covariance_times(block)
        values, vectors, miss = _ritz(block, image, wanted)
        if miss <= tolerance * max(values[0], 0.0):
            break
        block = np.linalg.qr(image)[0]
    else:
        # Expand by directions outside the block to the full dimension; there the Ritz pairs are exact.
        more = np.random.default_rng(seed + 1).standard_normal((dim, dim - wide))
        block = np.linalg.qr(np.hstack([block, more]))[0]
        values, vectors, _ = _ritz(block, covariance_times(block), wanted)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, **settings) -> DataFrame:
    """Rows (``id_col``, component, n, deviation decimal(38,0), whitened, explained, identity_error).

    ``settings``: oversample, passes, tolerance, seed.
    """
    rows = _Rows(vectors, id_col, column)
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    n, least, dim = rows.df.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if least != dim:
        raise ValueError(f"vectors of {least} and of {dim} entries")
    sums = rows.total(lambda x: x.sum(0, keepdims=True), "long")[0]
    centred = lambda x: (n * x - sums) / n  # noqa: E731  the difference is a whole number, exact

    def covariance_times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ block)

        return rows.total(part) / n

    values, unit = leading(covariance_times, dim, min(components, dim), **settings)
    trace = rows.total(lambda x: (centred(x) ** 2).sum(keepdims=True))[0, 0] / n
    alive = values > dim * np.finfo(float).eps * trace
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1)), 0.0)
    explained = np.where(alive, values / trace if trace else 0.0, 0.0)
    project = lambda x: centred(x) @ unit * scale

    def products(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return w.T @ w

    live = np.flatnonzero(alive)
    error = float(np.abs(rows.total(products)[np.ix_(live, live)] / n - np.eye(len(live))).max()) if len(live) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = grid(b.column(1))
                high, low = exact_squares(n * x - sums)
                white = project(x)
                offsets = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high), pa.array(low), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["vec_id", "high", "low", "white"])

    made = arrow_map(rows.df, run, f"vec_id {kind}, high long, low long, white array<double>")
    shares = F.array(*(F.lit(float(e)) for e in explained))
    deviation = (F.col("high").cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low").cast("decimal(10,0)")).cast("decimal(38,0)")
    out = made.select("vec_id", deviation.alias("deviation"), F.posexplode("white").alias("at", "whitened"))
    return out.select(
        F.col("vec_id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def exact_squares(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of squares of each row of whole numbers, exact, as high * 2^32 + low."""
    rough = (d.astype(np.float64) ** 2).sum(1)
    total = (d * d).sum(1)
    high, low = total >> 32, total & 0xFFFFFFFF
    for i in np.flatnonzero(rough > 2.0**62):  # beyond 64 bits
        high[i], low[i] = divmod(sum(int(x) ** 2 for x in d[i]), 1 << 32)
    return high, low
