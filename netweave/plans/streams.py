"""Registered queries that run as streams over the given tables.

The event table comes in parts by arrival, one run of a stream for each: every
run but the first starts again from the checkpoint of the one before, so each of
these queries is restarted in its middle.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from netweave.functions import expr
from netweave.operators import boosting, models, report, windows
from netweave.plans import oracles as sql
from netweave.plans.models import NUMBERS, window_table
from netweave.sources import schemas, tail
from netweave.sources.flowview import read_flows
from netweave.sources.shared import shared_folder
from netweave.streaming import job
from netweave.streaming import windows as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Parts in which a table arrives.
PARTS = 4
#: How long after a row its output may come, and rows may come late.
NEAR, LATE = 1800, 30


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _timed(flows: DataFrame) -> DataFrame:
    return flows.withColumn("at", F.timestamp_micros("ts_us"))


def _part(rows: DataFrame, of: str = "seq") -> Column:
    """The part in which a row comes, by its place in the range of ``of``."""
    low, high = rows.agg(F.min(of), F.max(of)).first()
    return F.least(F.floor((F.col(of) - F.lit(low or 0)) * PARTS / F.lit((high or 0) - (low or 0) + 1)), F.lit(PARTS - 1)).cast("int")


def _run_parts(spark: SparkSession, tables: dict[str, DataFrame], root: str, start: Callable[[dict[str, DataFrame]], object]) -> None:
    """For each part: the rows of ``tables`` (with ``part``) are added to the streams' folders, and the stream runs until it has read them."""
    for k in range(PARTS):
        for name, rows in tables.items():
            rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{root}/{name}")
        streams = {name: spark.readStream.schema(rows.drop("part").schema).parquet(f"{root}/{name}") for name, rows in tables.items()}
        start(streams).awaitTermination()


def _by_batch(root: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch that runs again replaces its own rows."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{root}/out/batch={number}")


_PARTED = f"{sql.FLOW}, parted AS (SELECT *, least(CAST(floor((seq - min(seq) OVER ()) * {PARTS} / (max(seq) OVER () - min(seq) OVER () + 1)) AS INTEGER), {PARTS - 1}) AS part FROM f)"


@_query(f"WITH {sql.FLOW} SELECT a.seq, CAST(b.ts_us - a.ts_us AS BIGINT) AS latency_us FROM f a JOIN f b ON b.seq = a.seq + 7 WHERE b.ts_us - a.ts_us BETWEEN 0 AND {NEAR * 1_000_000}")
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a row and its output (the row seven later), matched as both streams come in; later outputs than ``NEAR`` are none."""
    root, flows = shared_folder(spark, "stream-latency"), _timed(read_flows(spark, sf_dir)).select("seq", "at")
    part = _part(flows)
    seen = flows.select("seq", F.col("at").alias("seen_at"), part.alias("part"))
    out = flows.select((F.col("seq") - 7).alias("seq"), F.col("at").alias("out_at"), part.alias("part"))

    def start(streams: dict[str, DataFrame]):
        found = streaming.match_latency(streams["out"], streams["seen"], "seq", "out_at", "seen_at", f"{NEAR} seconds")
        return found.writeStream.format("parquet").option("path", f"{root}/found").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    _run_parts(spark, {"seen": seen, "out": out}, root, start)
    return spark.read.parquet(f"{root}/found").select("seq", (F.unix_micros("out_at") - F.unix_micros("seen_at")).alias("latency_us"))


@_query(f"WITH {sql.NUMBERED} SELECT pod, seq FROM n WHERE rn > total - 500")
def stream_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 rows of each source after the whole table has come in, kept in the stream's state between runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    root, flows = shared_folder(spark, "stream-last-rows"), read_flows(spark, sf_dir).select("pod", "seq")

    def start(streams: dict[str, DataFrame]):
        last = streaming.last_rows(streams["rows"], "pod", "seq")
        return last.writeStream.outputMode("update").foreachBatch(_by_batch(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    _run_parts(spark, {"rows": flows.withColumn("part", _part(flows))}, root, start)
    found = spark.read.parquet(f"{root}/out")
    newest = found.groupBy("pod").agg(F.max("batch").alias("batch"))
    return windows.join_on(found, newest, ["pod", "batch"]).select("pod", "seq")


#: One row of thirteen comes a part late.
_DELAYED = "seq % 13 = 0"


@_query(
    f"""WITH {_PARTED}, come AS (SELECT *, least(part + CAST({_DELAYED} AS INTEGER), {PARTS - 1}) AS arrival, ts_us - ts_us % 1000000 AS second_us FROM parted),
marks AS (SELECT arrival, max(max(ts_us)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {LATE * 1_000_000} AS mark FROM come GROUP BY arrival)
SELECT pod, second_us, CAST(sum(orig_pkts) AS BIGINT) AS total, count(*) AS conns FROM come JOIN marks USING (arrival) WHERE mark IS NULL OR second_us + 1000000 > mark GROUP BY 1, 2"""
)
def stream_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and rows per source and second of event time; one row of thirteen comes a part late, and what is over ``LATE`` seconds late does not count."""
    root, flows = shared_folder(spark, "stream-seconds"), _timed(read_flows(spark, sf_dir)).select("pod", "seq", "at", "orig_pkts")
    arrival = F.least(_part(flows) + F.expr(_DELAYED).cast("int"), F.lit(PARTS - 1))

    def start(streams: dict[str, DataFrame]):
        counts = streaming.per_second(streams["rows"], "at", "pod", "orig_pkts", f"{LATE} seconds")
        flat = counts.select("pod", F.unix_micros("w.start").alias("second_us"), "total", "conns")
        return flat.writeStream.outputMode("update").foreachBatch(_by_batch(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()

    _run_parts(spark, {"rows": flows.withColumn("part", arrival)}, root, start)
    found = spark.read.parquet(f"{root}/out")
    newest = found.groupBy("pod", "second_us").agg(F.max_by(F.struct("total", "conns"), "batch").alias("last"))
    return newest.select("pod", "second_us", F.col("last.total").cast("long").alias("total"), F.col("last.conns").alias("conns"))


@_query(f"WITH {_PARTED} SELECT pod, seq, row_number() OVER (ORDER BY part, pod, seq) AS sequence FROM parted")
def stream_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbering over two streams (tcp and udp rows) that no restart breaks: by part, source and row."""
    root, flows = shared_folder(spark, "stream-fan-in"), read_flows(spark, sf_dir).select("pod", "seq", "proto")
    parted = flows.withColumn("part", _part(flows))

    def start(streams: dict[str, DataFrame]):
        return streaming.fan_in(streams["tcp"].unionByName(streams["udp"]), ["pod", "seq"], _by_batch(root), f"{root}/checkpoint", availableNow=True)

    _run_parts(spark, {name: parted.where(F.col("proto") == name) for name in ("tcp", "udp")}, root, start)
    return spark.read.parquet(f"{root}/out").select("pod", "seq", F.col("sequence").cast("long").alias("sequence"))


#: Rows of a log before it rolls over to the next.
ROLL = 1 << 11


@_query(f"WITH {sql.FLOW} SELECT CAST(pod AS VARCHAR) || '-' || CAST(seq // {ROLL} AS VARCHAR) AS source, seq || chr(9) || orig_h || chr(9) || resp_h AS value FROM f")
def tail_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view written as growing logs, rotated while the stream is down, and tailed in three runs."""
    seq = F.col("seq")
    lines = read_flows(spark, sf_dir).select("pod", "seq", F.concat_ws("\t", seq.cast("string"), "orig_h", "resp_h").alias("line"))
    root, logs_at = _mounted(spark, "tailed")

    def run() -> None:
        tailed = tail.tail(spark, f"{logs_at}/*/conn.log").select("source", "value")
        tailed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _grow_logs(lines, logs_at, run)
    return spark.read.parquet(f"{root}/out")


def _mounted(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new shared folder, and the path of its logs; tailing reads mounted files, so the folder has to be one."""
    root = shared_folder(spark, name)
    folder = root.removeprefix("file:")
    if not folder.startswith("/"):
        raise ValueError("logs are tailed on a mounted file system")
    return root, "/" + folder.lstrip("/") + "/logs"


def _grow_logs(lines: DataFrame, folder: str, run: Callable[[], None]) -> None:
    """Write (pod, seq, line) as logs of ``ROLL`` rows at most, in three steps with a ``run`` after each.

    A log's folder names its source and roll.  The first step writes a log's
    first quarter; the second adds the second to the same file; the third adds
    the third, renames the file and writes the last in a new one.  The rows are
    read and ordered once; a quarter, written again, is the same.
    """
    seq = F.col("seq")
    placed = lines.select(F.concat_ws("-", F.col("pod").cast("string"), F.floor(seq / ROLL).cast("string")).alias("log"), F.floor(seq % ROLL / (ROLL // 4)).cast("int").alias("quarter"), "seq", "line")

    def put(file: str, at: int, text: str) -> None:
        with open(file, "r+b" if os.path.exists(file) else "wb") as f:
            f.truncate(at)
            f.seek(at)
            f.write(text.encode())

    def write(step: int) -> Callable[[Iterator[Row]], None]:
        def each(rows: Iterator[Row]) -> None:
            for log, own in groupby(rows, key=lambda r: r["log"]):
                at = f"{folder}/{log}"
                os.makedirs(at, exist_ok=True)
                now, old, new = f"{at}/conn.log", f"{at}/conn.old", f"{at}/next"
                first = old if os.path.exists(old) else now
                for r in own:
                    if r["text"] is not None:
                        put(new if r["quarter"] == 3 else first, r["at"], r["text"])
                if step == 2:
                    for file in (first, new):  # a log may end before its third or last quarter
                        open(file, "ab").close()
                    if first == now:
                        os.rename(now, old)
                    os.rename(new, now)

        return each

    tasks = max(1, math.ceil(placed.count() / windows.SPAN_ROWS))  # by rows: a task writes many short logs
    inside = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    texts = placed.repartition(tasks, "log").groupBy("log", "quarter").agg(F.array_join(inside, "").alias("text"))  # a quarter of a log is short
    so_far = Window.partitionBy("log").orderBy("quarter").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("quarter") == 3, 0).otherwise(F.coalesce(F.sum(F.octet_length("text")).over(so_far), F.lit(0)))
    texts = texts.withColumn("at", place).sortWithinPartitions("log", "quarter").persist(StorageLevel.DISK_ONLY)
    try:
        for step, (low, high) in enumerate(((0, 0), (1, 1), (2, 3))):
            known = texts.where(F.col("quarter") <= high)
            known.select("log", "quarter", "at", F.when(F.col("quarter") >= low, F.col("text")).alias("text")).foreachPartition(write(step))
            run()
    finally:
        texts.unpersist()


_LIVE = "concat_ws(chr(9), ts_us // 1000000 || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0'), 'C' || lpad(CAST(seq AS VARCHAR), 16, '0'), orig_h, orig_p, resp_h, resp_p, proto, coalesce(service, '-'), '-', coalesce(CAST(orig_bytes AS VARCHAR), '-'), coalesce(CAST(resp_bytes AS VARCHAR), '-'), conn_state, '-', '-', '-', '-', orig_pkts, '-', resp_pkts, '-', '-')"


@_query(f"WITH {sql.FLOW}, l AS (SELECT seq, {_LIVE} AS line FROM f) SELECT CASE WHEN seq % 97 = 0 THEN 'set aside' ELSE 'line' END AS kind, CASE WHEN seq % 97 = 0 THEN line[1:30] ELSE 'CONN,' || replace(line, chr(9), ',') END AS value FROM l")
def live_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live job over growing, rotated connection logs: tagged lines, and the half-written ones that no later look made whole."""
    flows = read_flows(spark, sf_dir)
    unset = F.lit("-")
    text = {n: F.coalesce(F.col(n).cast("string"), unset) if n in flows.columns and n != "duration" else unset for n in (schemas.column_name(f) for f, _ in schemas.fields("CONN"))}
    text["ts"] = F.concat(F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"))
    text["uid"] = F.concat(F.lit("C"), F.lpad(F.col("seq").cast("string"), 16, "0"))
    line = F.concat_ws("\t", *text.values())
    lines = flows.select("pod", "seq", F.when(F.col("seq") % 97 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"))
    root, logs_at = _mounted(spark, "live-format")
    _grow_logs(lines, logs_at, lambda: job.format_logs(spark, f"{logs_at}/*/conn.log", f"{root}/out", f"{root}/checkpoint", availableNow=True).awaitTermination())
    tagged = spark.read.text(f"{root}/out/lines").select(F.lit("line").alias("kind"), "value")
    return tagged.unionByName(spark.read.parquet(f"{root}/out/quarantine").select(F.lit("set aside").alias("kind"), "value"))


@_query()
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live scoring: a stored window model, read in each micro-batch, scores complete windows; alerts are written per batch."""
    root = shared_folder(spark, "stream-alerts")
    found, columns = window_table(spark, sf_dir)
    early, _ = models.split_in_time(found, ["pod"], "wid")
    boosting.save(spark, boosting.fit(early, columns, trees=LIVE_TREES), f"{root}/model")
    flows = read_flows(spark, sf_dir).select("pod", "seq", *NUMBERS)

    def score(done: DataFrame) -> DataFrame:
        return boosting.predict(boosting.load(done.sparkSession, f"{root}/model"), done)

    def start(streams: dict[str, DataFrame]):
        return streaming.score_windows(spark, streams["rows"], "pod", "seq", NUMBERS, score, _by_batch(root), f"{root}/checkpoint", availableNow=True)

    _run_parts(spark, {"rows": flows.withColumn("part", _part(flows))}, root, start)
    scored = spark.read.parquet(f"{root}/out").select("pod", "wid", "score")
    return report.alert_json(scored, ["pod", "wid", "score"], F.col("score") > 0.5)


#: Trees of the stored model: the live job is about scoring, the full size is that of ``gbt_windows``.
LIVE_TREES = 50
