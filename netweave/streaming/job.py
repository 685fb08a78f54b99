"""The live formatting job: tail log files, check lines, repair what was caught half-written, write tagged lines.

And what watches a stream: a count of the lines read and a heartbeat.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from netweave.functions.expr import log_type
from netweave.operators.windows import join_on
from netweave.sources import logs, schemas, tail
from netweave.streaming.windows import forget

#: Broken and last lines, about, that one task has.
LINES = 1 << 11


def widths(kind):
    """The number of fields that a log type has."""
    out = F.lit(None).cast("int")
    for name in schemas.FIELDS:
        out = F.when(kind == name, schemas.width(name)).otherwise(out)
    return out


def marked(lines: DataFrame) -> DataFrame:
    """The data lines (file, made, pos, value) with log_type and whether they are corrupt."""
    data = lines.where(logs.is_data(F.col("value"))).select("file", "made", "pos", "value", log_type(F.col("file")).alias("log_type"))
    return data.withColumn("corrupt", logs.is_corrupt(logs.tokens(F.col("value")), widths(F.col("log_type"))))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of marked lines in order, the corrupt ones and the last of each stretch, with the line before in that stretch."""

    def keep(t: pa.Table, last: pa.Array) -> list[pa.RecordBatch]:
        return t.append_column("last", last).filter(pc.or_(t["corrupt"], last)).combine_chunks().to_batches()

    held = None  # the last line so far: whether its stretch goes on is told by the next
    for b in batches:
        t = pa.Table.from_batches([b]).append_column("prev_value", pa.nulls(b.num_rows, pa.string()))
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not t.num_rows:
            continue
        same = [pc.equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)) for c in ("file", "made")]
        goes_on = pc.fill_null(pc.and_(*same), False).combine_chunks()
        before = pc.if_else(goes_on, t["value"].slice(0, t.num_rows - 1), pa.scalar(None, pa.string()))
        t = t.set_column(t.schema.get_field_index("prev_value"), "prev_value", pa.chunked_array([*t["prev_value"].slice(0, 1).chunks, *before.chunks], pa.string()))
        held = t.slice(t.num_rows - 1)
        yield from keep(t.slice(0, t.num_rows - 1), pc.invert(goes_on))
    if held is not None:
        yield from keep(held, pa.array([True]))


def ends(lines: DataFrame) -> DataFrame:
    """Of the data lines (file, made, pos, value) the corrupt ones and the last of each stretch, with log_type, ``corrupt``, ``last`` and prev_value, the line before in the stretch.

    What a partition has of a file is a stretch of its lines in order, as ``tail``
    gives them; lines may be ``marked`` already.  Nothing is shuffled.
    """
    data = lines if "corrupt" in lines.columns else marked(lines)
    data = data.select("file", "made", "pos", "value", "log_type", "corrupt")
    return data.mapInArrow(_ends, data.withColumns({"prev_value": F.lit(None).cast("string"), "last": F.lit(True)}).schema)


def checked(lines: DataFrame, before: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Lines, or their ``ends``, as these, with prev_value also over the stretches: the line before.

    ``before`` has the last data line (file, made, value) that earlier batches read
    of a file.  Of one file only the ends of its stretches meet in one task.
    """
    inside = F.when(F.col("prev_value").isNotNull() & ~F.col("last"), F.col("pos"))
    found = (lines if "last" in lines.columns else ends(lines)).withColumn("__inside", inside)
    if tasks:
        found = found.repartition(tasks, "file", "made", "__inside")
    carried = F.lag("value").over(Window.partitionBy("file", "made", "__inside").orderBy("pos"))
    found = found.withColumn("prev_value", F.coalesce("prev_value", carried)).drop("last", "__inside")
    if before is not None:
        found = join_on(found, before.select("file", "made", F.col("value").alias("__before")), ["file", "made"], "left")
        found = found.withColumn("prev_value", F.coalesce("prev_value", "__before")).drop("__before")
    return found


def last_lines(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(file, made, value): the last data line of each file, of files without new ones the one known before."""
    rows = lines.where(logs.is_data(F.col("value"))).select("file", "made", "value", "pos", F.lit(True).alias("new"))
    if before is not None:
        rows = rows.unionByName(before.select("file", "made", "value", F.lit(None).cast("long").alias("pos"), F.lit(False).alias("new")))
    last = rows.groupBy("file", "made").agg(F.max_by("value", F.struct("new", "pos")).alias("value"), F.max("new").alias("new"))
    return last.withColumn("any", F.max("new").over(Window.partitionBy("file"))).where("new = any").select("file", "made", "value")


def repaired(broken: DataFrame) -> DataFrame:
    """Corrupt lines (file, made, pos, log_type, prev_value, value) with ``fixed``: what now follows the line before.

    Executors read one bounded stretch of the file around each; null where what
    they find lacks the fragment or is corrupt too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ("file", "made", "pos", "prev_value")
            found = [tail.line_after(*r)[0] for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "found"])

    kept = broken.select("file", "made", "pos", "log_type", "prev_value", "value")
    schema = kept.withColumn("found", F.lit(None).cast("string")).schema
    found = kept.mapInArrow(run, schema)
    sound = F.contains("found", "value") & ~logs.is_corrupt(logs.tokens(F.col("found")), widths(F.col("log_type")))
    return found.withColumn("fixed", F.when(sound, F.col("found"))).drop("found")


def format_logs(spark: SparkSession, paths: str, out: str, checkpoint: str, options: dict | None = None, **trigger):
    """Start the job: sound and repaired lines go to ``out``/lines as tagged CSV, the rest to ``out``/quarantine.

    Log types are told by the files' names, several at once.  A batch writes
    into a folder of its own number, so one that runs again replaces its lines;
    the last line of each file is kept in the checkpoint, so a broken line that
    comes first in its batch has one before it, also after a restart.  The job
    fails if no log is there after 60 seconds (option ``wait``).
    """

    def each(batch: DataFrame, number: int) -> None:
        own, at = batch.sparkSession, lambda n: f"{checkpoint.rstrip('/')}/last-lines/{n}"
        before = own.read.parquet(at(number - 1)) if number else None
        batch = marked(batch).persist(StorageLevel.DISK_ONLY)  # the files are read once
        near = ends(batch).persist(StorageLevel.DISK_ONLY)
        try:
            tasks = max(1, math.ceil(near.count() / LINES))
            seen = repaired(checked(near, before, tasks).where("corrupt")).persist(StorageLevel.DISK_ONLY)
            sound = batch.where("not corrupt").select("log_type", "value").unionByName(seen.where("fixed is not null").select("log_type", F.col("fixed").alias("value")))
            tagged = sound.select(logs.csvify(logs.tokens(F.col("value")), F.col("log_type")).alias("value"))
            tagged.write.mode("overwrite").text(f"{out}/lines/batch={number}")
            seen.where("fixed is null").select("file", "value").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
            last_lines(near.coalesce(tasks), before).write.mode("overwrite").parquet(at(number))
            seen.unpersist()
        finally:
            near.unpersist()
            batch.unpersist()
        if number > 1:
            forget(own, at(number - 2))

    lines = tail.tail(spark, paths, **({"wait": 60} | (options or {})))
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Heartbeat(StreamingQueryListener):
    """Counts the rows that each stream has read and logs them after every batch.

    ``spark.streams.addListener(Heartbeat())``
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.batches[name] = event.progress.batchId
        logging.getLogger(__name__).info("%s: %d rows read, batch %d", name, self.rows[name], self.batches[name])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
