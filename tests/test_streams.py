"""Streams in parts, with restarts, late rows and rows without a partner."""

import pytest
from pyspark.sql import functions as F

from netweave.operators import boosting, features, windows
from netweave.streaming import windows as streaming

MINUTE = 60_000_000


def _write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder))


def _run(frame, tmp_path, mode="append"):
    """Run to the end of what is there, from the checkpoint if there is one; the last progress."""
    out = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))
    query = frame.writeStream.outputMode(mode).foreachBatch(out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query.recentProgress


def test_latency_join_with_late_and_unmatched_rows(spark, tmp_path):
    seen, out = "id string, seen_at timestamp", "id string, out_at timestamp"
    at = lambda minutes: F.timestamp_micros(F.lit(int((1000 + minutes) * MINUTE)))
    stamp = lambda rows, name: [(i, spark.range(1).select(at(m)).first()[0]) for i, m in rows]

    def step(first, second):
        _write(spark, tmp_path / "seen", stamp(first, "seen_at"), seen)
        _write(spark, tmp_path / "done", stamp(second, "out_at"), out)
        found = streaming.match_latency(_stream(spark, tmp_path / "done", out), _stream(spark, tmp_path / "seen", seen), "id", "out_at", "seen_at", "10 minutes")
        return _run(found, tmp_path)

    step([("a", 0), ("b", 1), ("never out", 2), ("slow", 3)], [("a", 0.5), ("no source", 1)])
    step([("c", 5)], [("b", 4), ("c", 5.25), ("slow", 14)])  # "slow" comes after more than the ten minutes
    progress = step([("d", 60)], [("d", 61)])
    step([("late", 8), ("e", 70)], [("late", 9), ("e", 71)])  # both streams are past minute 8 by far
    got = {r.id: (r.out_at - r.seen_at).total_seconds() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 30.0, "b": 180.0, "c": 15.0, "d": 60.0, "e": 60.0}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert kept[-1] < 8, kept  # what can find no partner any more is dropped


def test_seconds_drop_exactly_the_late_rows(spark, tmp_path):
    schema = "k string, at timestamp, v long"
    rows = lambda *xs: [(k, spark.range(1).select(F.timestamp_micros(F.lit(int(s * 1e6)))).first()[0], v) for k, s, v in xs]
    for part in ([("a", 100.1, 1), ("a", 100.9, 2), ("b", 140.5, 4)], [("a", 109.5, 8), ("a", 110.2, 16), ("b", 109.999, 32), ("b", 200.0, 64)], [("a", 169.0, 128), ("b", 170.5, 256)]):
        _write(spark, tmp_path / "in", rows(*part), schema)
        _run(streaming.per_second(_stream(spark, tmp_path / "in", schema), "at", "k", "v", "30 seconds"), tmp_path, "update")
    found = spark.read.parquet(str(tmp_path / "out")).select("k", F.unix_seconds("w.start").alias("s"), "total", "batch")
    last = {(r.k, r.s): r.t for r in found.groupBy("k", "s").agg(F.max_by("total", "batch").alias("t")).collect()}
    # After 140.5 the mark is 110.5: seconds that ended by then are closed, 110 is not; after 200 it is 170.
    assert last == {("a", 100): 3, ("b", 140): 4, ("a", 110): 16, ("b", 200): 64, ("b", 170): 256}


def test_live_scores_equal_batch_scores_after_a_restart(spark, tmp_path):
    df = spark.range(0, 1000).selectExpr("id AS seq", "concat('s', id % 3) AS source", "cast((id * 37) % 101 + if(id % 3 = 1, 60, 0) AS double) AS v")
    table = features.window_features(windows.full_tumbling(df, "source", "seq", 50), ["source", "wid"], ["v"])
    columns = [c for c in table.columns if c not in ("source", "wid", "n")]
    model = boosting.fit(table.withColumn("label", (F.col("source") == "s1").cast("int")), columns, trees=15, depth=3, least=0.1)
    boosting.save(spark, model, str(tmp_path / "model"))
    score = lambda done: boosting.predict(boosting.load(done.sparkSession, str(tmp_path / "model")), done)
    sink = lambda f, n: f.select("source", "wid", "score").write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))
    for a, b in ((0, 130), (130, 700), (700, 1000)):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        assert streaming.score_windows(spark, stream, "source", "seq", ["v"], score, sink, str(tmp_path / "check"), size=50, availableNow=True).awaitTermination(120)
    live = {(r.source, r.wid): r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.source, r.wid): r.score for r in boosting.predict(model, table).collect()}
    assert live == pytest.approx(batch) and len(live) == 18 and {k for k, s in live.items() if s > 0.5} == {k for k in live if k[0] == "s1"}


def test_one_sequence_over_streams(spark, tmp_path):
    schema = "source string, pos long"

    def step(first, second, crash=False):
        for name, rows in (("a", first), ("b", second)):
            _write(spark, tmp_path / name, [(name, i) for i in rows], schema)

        def sink(df, n):
            df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))
            if crash:
                raise RuntimeError("stopped after writing")

        both = _stream(spark, tmp_path / "a", schema).unionByName(_stream(spark, tmp_path / "b", schema))
        return streaming.fan_in(both, ["source", "pos"], sink, str(tmp_path / "check"), availableNow=True)

    step([1, 2], [1]).awaitTermination(60)
    with pytest.raises(Exception, match="stopped after writing"):
        step([3], [2, 3], crash=True).awaitTermination(60)
    step([4], []).awaitTermination(60)
    got = [(r.sequence, r.source, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("sequence").collect()]
    assert got == [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "a", 3), (5, "b", 2), (6, "b", 3), (7, "a", 4)]


def test_many_logs_are_written_by_few_tasks(spark, tmp_path):
    """900 rows in 300 logs: few tasks write them, not one each."""
    from netweave.plans import streams

    lines = spark.range(300).selectExpr("id as pod", "explode(sequence(0, 1200, 600)) as seq").selectExpr("pod", "seq", "concat(pod, ' ', seq) as line")
    sc, found = spark.sparkContext, []
    sc.setJobGroup("grow-logs", "grow-logs")
    try:
        streams._grow_logs(lines, str(tmp_path), lambda: found.append(sum(len(f.read_text().splitlines()) for f in tmp_path.glob("*/conn.*"))))
        tracker = sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("grow-logs") for i in tracker.getJobInfo(j).stageIds}
        assert max(info.numTasks for i in stages if (info := tracker.getStageInfo(i))) <= 16
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert found == [300, 600, 900]


def test_logs_are_grown_from_one_reading(spark, tmp_path):
    """The rows are read for their number and once more, not again in each step; the same logs at each step, some of them short."""
    from netweave.plans import streams

    read = spark.sparkContext.accumulator(0)

    def rows(part):
        for i in part:
            read.add(1)
            yield i % 2, i // 2 * 7, f"line {i} \u00e9"

    lines = spark.createDataFrame(spark.sparkContext.parallelize(range(800), 3).mapPartitions(rows), "pod long, seq long, line string")
    found = []

    def run():
        found.append({str(f.relative_to(tmp_path)): f.read_text().splitlines() for f in tmp_path.glob("*/*")})

    streams._grow_logs(lines, str(tmp_path), run)
    assert read.value == 2 * 800
    own = {}
    for i in range(800):
        seq = i // 2 * 7
        own.setdefault((f"{i % 2}-{seq // streams.ROLL}", seq % streams.ROLL // (streams.ROLL // 4)), []).append(f"line {i} \u00e9")
    logs = {log for log, _ in own}
    part = lambda log, *quarters: [x for q in quarters for x in own.get((log, q), [])]
    assert found[0] == {f"{log}/conn.log": part(log, 0) for log in logs}
    assert found[1] == {f"{log}/conn.log": part(log, 0, 1) for log in logs}
    assert found[2] == {f"{log}/conn.old": part(log, 0, 1, 2) for log in logs} | {f"{log}/conn.log": part(log, 3) for log in logs}
    assert any(not part(log, 3) for log in logs)
