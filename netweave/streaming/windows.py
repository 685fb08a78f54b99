"""Streaming: count windows per source, the last rows of a source, one sequence over streams, latency of matched rows.

Count windows are cut by Spark, batch by batch: no task holds all rows of a
source.  Between batches only the rows of each source's incomplete window and
its number of rows are kept; a window is emitted once its last row is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netweave.operators.features import window_features
from netweave.operators.windows import number_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRows(StatefulProcessor):
    """Keeps the last ``size`` rows of a source; holds these and one chunk of a batch at a time."""

    def __init__(self, schema: StructType, order: str, size: int):
        self.row_schema, self.order, self.size = schema, order, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.row_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.row_schema.names
        new = None
        for chunk in rows:
            both = chunk[names] if new is None else pd.concat([new, chunk[names]], ignore_index=True)
            new = both.sort_values(self.order, kind="stable").tail(self.size).copy()
            del both, chunk
        held = pd.DataFrame(list(self.rows.get()), columns=names)
        last = (pd.concat([held, new], ignore_index=True) if len(held) else new).tail(self.size).reset_index(drop=True)
        self.rows.put([tuple(r) for r in last.astype(object).where(last.notna(), None).itertuples(index=False)])
        yield last.assign(wid=0)

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, key: str, order: str, size: int = 500) -> DataFrame:
    """The last ``size`` rows of each source that had new rows."""
    schema = StructType([f for f in stream.schema])
    out = StructType.fromJson(schema.jsonValue()).add("wid", "long")
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=LastRows(schema, order, size), outputStructType=out, outputMode="Update", timeMode="None")


def place(batch: DataFrame, held: DataFrame | None, seen: DataFrame | None, key: str, order: str, size: int) -> DataFrame:
    """Add ``wid``, the window of each row, and ``_after``, the rows of its source so far; held rows come first.

    ``held``: rows of incomplete windows with ``wid``; ``seen``: (``_key``,
    ``_seen``), the rows of a source before the batch, one row per source; Spark broadcasts it if it is small.
    The key is compared inside a struct, as a source without a name is one too.
    """
    last = F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1))
    new = number_rows(batch.withColumns({"_key": F.struct(F.col(key)), "_at": last}), "_key", "_at")
    before = F.lit(0).cast("long")
    if seen is not None:
        new, before = new.join(seen, "_key", "left"), F.coalesce("_seen", before)
    names = [*batch.columns, "wid", "_after"]
    placed = new.withColumns({"wid": F.floor((before + F.col("rn") - 1) / size).cast("long"), "_after": before + F.col("total")}).select(*names)
    if held is None:
        return placed
    fresh = batch.groupBy(F.struct(F.col(key)).alias("_key")).agg(F.count("*").alias("_new"))
    kept = held.withColumn("_key", F.struct(F.col(key))).join(seen, "_key").join(fresh, "_key", "left")
    return kept.withColumn("_after", F.col("_seen") + F.coalesce("_new", F.lit(0))).select(*names).unionByName(placed)


def forget(spark, path: str) -> None:
    """Give back the space of a stored folder, in whatever store it is: an empty table takes its place."""
    spark.createDataFrame([], "none int").write.mode("overwrite").parquet(path)


def score_windows(spark, stream: DataFrame, key: str, order: str, columns: list[str], score, sink, checkpoint: str, size: int = 200, **trigger):
    """Run window features and ``score`` (frame -> frame) on complete windows; ``sink(frame, batch)`` gets the result.

    ``order`` is an integer column; it orders the rows of a batch, batches follow
    each other.  What is kept after a batch lies in ``checkpoint`` under its
    number, for the next one, so a batch that runs again finds what it found before.
    """

    def each(batch: DataFrame, number: int) -> None:
        own, at = batch.sparkSession, lambda n: f"{checkpoint.rstrip('/')}/open-windows/{n}"
        held, seen = (own.read.parquet(f"{at(number - 1)}/{x}") for x in ("held", "seen")) if number else (None, None)
        batch = batch.persist(StorageLevel.DISK_ONLY)
        placed = place(batch, held, seen, key, order, size).persist(StorageLevel.DISK_ONLY)
        try:
            full = (F.col("wid") + 1) * size <= F.col("_after")
            sink(score(window_features(placed.where(full), [key, "wid"], columns)), number)
            placed.where(~full).drop("_after").write.mode("overwrite").parquet(f"{at(number)}/held")
            counts = batch.groupBy(F.struct(F.col(key)).alias("_key")).agg(F.count("*").alias("_seen"))
            counts = counts if seen is None else counts.unionByName(seen).groupBy("_key").agg(F.sum("_seen").alias("_seen"))
            counts.write.mode("overwrite").parquet(f"{at(number)}/seen")
        finally:
            placed.unpersist()
            batch.unpersist()
        if number > 1:
            forget(own, at(number - 2))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fan_in(stream: DataFrame, order: list[str], sink, checkpoint: str, **trigger):
    """Number the rows of a stream, which may be a union of several: one sequence from 1 without gaps.

    Batches follow each other; inside one the rows stand by ``order``.  ``sink(frame,
    batch)`` gets them with ``sequence``.  How many rows there were is kept after
    each batch under its number, so a restart goes on where it was, and a batch
    that runs again gives its rows the same numbers.
    """

    def each(batch: DataFrame, number: int) -> None:
        own, at = batch.sparkSession, lambda n: f"{checkpoint.rstrip('/')}/sequence/{n}"
        before = own.read.parquet(at(number - 1)).first()[0] if number else 0
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            numbered = number_rows(batch.withColumn("_all", F.lit(0)), "_all", order)
            sink(numbered.withColumn("sequence", F.col("rn") + F.lit(before)).drop("_all", "rn", "total"), number)
            batch.agg((F.count("*") + F.lit(before)).alias("n")).write.mode("overwrite").parquet(at(number))
        finally:
            batch.unpersist()
        if number > 1:
            forget(own, at(number - 2))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def match_latency(out: DataFrame, source: DataFrame, on: str, out_time: str, source_time: str, delay: str = "60 seconds") -> DataFrame:
    """Time from a row's first sight to its output: a stream-stream join inside ``delay``."""
    a = out.withWatermark(out_time, delay).alias("o")
    b = source.withWatermark(source_time, delay).alias("s")
    near = (F.col(f"o.{on}") == F.col(f"s.{on}")) & (F.col(f"o.{out_time}") >= F.col(f"s.{source_time}")) & (F.col(f"o.{out_time}") <= F.col(f"s.{source_time}") + F.expr(f"interval {delay}"))
    return a.join(b, near).select(F.col(f"o.{on}").alias(on), F.col(f"o.{out_time}").alias("out_at"), F.col(f"s.{source_time}").alias("seen_at"))


def per_second(stream: DataFrame, time: str, key: str, value, delay: str = "30 seconds") -> DataFrame:
    """Sums and counts per key and second; late rows count for ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 second").alias("w"), key).agg(F.sum(value).alias("total"), F.count("*").alias("conns"))
