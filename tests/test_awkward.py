"""Nulls, clashing names, sparse and unsorted order columns, gaps; and the live job."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netweave.operators import encode, models, profile, report, scoring, windows
from netweave.sources import logs, tail, schemas
from netweave.streaming import job

ROWS = [(None, 3, "a"), (None, None, "b"), ("x", None, "c"), ("x", 10**15, "d"), ("x", 5, "e"), ("y", 1, "f"), ("x", 7, None)]


@pytest.mark.parametrize("span", [1, 2, 1 << 16])
def test_rows_are_numbered_whatever_is_null(spark, span):
    df = spark.createDataFrame(ROWS, "k string, at long, v string").selectExpr("*", "9 AS total", "8 AS rn", "7 AS _span", "6 AS wid")
    got = windows.number_rows(df, "k", "at", span=span).collect()
    assert len(got) == len(ROWS)
    assert {(r.k, r.at): (r.rn, r.total) for r in got} == {(None, 3): (1, 2), (None, None): (2, 2), ("x", 5): (1, 4), ("x", 7): (2, 4), ("x", 10**15): (3, 4), ("x", None): (4, 4), ("y", 1): (1, 1)}
    assert all(r._span == 7 and r.wid == 6 for r in got)
    prev = {(r.k, r.at): r.prev_v for r in windows.lag_rows(df, "k", "at", ["v"], span=span).collect()}
    assert prev == {(None, 3): None, (None, None): "a", ("x", 5): None, ("x", 7): "e", ("x", 10**15): None, ("x", None): "d", ("y", 1): None}


def test_windows_replace_columns_of_their_names(spark):
    df = spark.createDataFrame(ROWS, "k string, at long, v string").selectExpr("*", "9 AS total", "8 AS rn", "'z' AS wid", "5 AS block")
    assert windows.last_n(df, "k", "at", 1).count() == 3
    assert {r.k for r in windows.last_n(df, "k", "at", 1).collect()} == {None, "x", "y"}
    assert windows.hopping(df.withColumn("k2", F.lit(1)), "k", "at", size=2, hop=1).where("k is not null").count() > 0
    assert windows.tumbling(df, "k", "at", 2).columns.count("wid") == 1
    assert windows.number_rows(df, "k", "rn").count() == len(ROWS)


def test_sparse_and_dense_order_values_make_even_spans(spark):
    rng = random.Random(4)
    at = [rng.randrange(10**15) for _ in range(200)] + list(range(300)) + [5] * 100
    df = spark.createDataFrame([("k", a, i) for i, a in enumerate(at)], "k string, at long, i long")
    got = windows.number_rows(df, "k", ["at", "i"], span=50)
    want = {i: n for n, (_, i) in enumerate(sorted((a, i) for i, a in enumerate(at)), 1)}
    assert {r.i: r.rn for r in got.collect()} == want
    spans = windows._spanned(df, "k", ["at"], 50, []).groupBy("__span").count().collect()
    assert max(r["count"] for r in spans) <= 200 and len(spans) > 5


def test_interarrival_follows_time_not_the_order_of_rows(spark):
    df = spark.createDataFrame([(1, "k", 50), (2, "k", 10), (3, "k", 30), (4, None, 7), (5, "k", 30)], "seq long, k string, ts long")
    gaps = {r.seq: r.gap for r in profile.interarrival(df, "k", "ts", "seq").collect()}
    assert gaps == {2: None, 3: 20, 5: 0, 1: 20, 4: None}


def test_profiles_keep_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0, 1, 1), (None, 2.0, 1, 1), ("a", 5.0, 1, 0)], "k string, v double, o long, r long")
    found = {(r.k, r.cls): (r.n, r.p50) for r in profile.class_profile(df, F.col("v"), "o", "r", ["k"]).collect()}
    assert found[None, "both"] == (2, 1.5) and found["a", "orig"] == (1, 5.0) and found["a", "resp"] == (0, -1.0)
    shares = profile.log_profile(df, "k", categories=("o",)).collect()
    assert {(r.k, r["item"]): r.value for r in shares} == {(None, "1"): 1.0, ("a", "1"): 1.0}


def test_rules_per_null_key(spark):
    cols = "k string, duration double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long"
    df = spark.createDataFrame([(k, 1.0 + i, 10 * i, 5, 2, 3) for k in (None, "a") for i in range(20)], cols)
    rules = scoring.build_ruleset(df, ["k"])
    assert rules.count() == 2 and scoring.rule_scores(df, rules, ["k"]).count() == 40


def test_long_gaps_by_hour(spark):
    series = spark.createDataFrame([("k", 10, 1), ("k", 3700, 2), ("k", 3600 * 24 * 400, 4)], "k string, sec long, conns long")
    got = {r.hour: (r.seconds, r.conns) for r in profile.filled_hours(series, ["k"], ["conns"]).collect()}
    assert sum(s for s, _ in got.values()) == 3600 * 24 * 400 - 10 + 1 and len(got) == 24 * 400 + 1
    assert got[0] == (3590, 1) and got[1] == (3600, 2) and got[24 * 400] == (1, 4)


def test_running_moments(spark):
    import numpy as np

    values = [3.0, None, 5.0, 1e5, 1e5 + 1, 7.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    for r in profile.running_moments(df, "k", "i", "v", span=2).collect():
        x = [v for v in values[: r.i + 1] if v is not None]
        assert r.n == len(x) and r.mean == pytest.approx(np.mean(x)) and r.std == pytest.approx(np.std(x), rel=1e-6, abs=1e-3)


def test_vocabulary_is_whole(spark):
    df = spark.createDataFrame([(i, f"v{i:03d}") for i in range(200)] + [(200, None)], "i long, c string")
    assert len(encode.fit_vocabulary(df, ["c"])["c"]) == 201
    with pytest.raises(ValueError):
        encode.fit_vocabulary(df, ["c"], most=50)
    hot, fitted = encode.encode_sparse(df, ["c"])
    assert hot.columns == ["i", "c", "c_hot"] and all(r.c_hot.numNonzeros() == 1 for r in hot.collect())
    other, _ = encode.encode_sparse(spark.createDataFrame([(1, "new")], "i long, c string"), ["c"], fitted)
    assert other.first().c_hot.numNonzeros() == 0


def test_null_policy_and_numeric_columns(spark):
    rows = spark.createDataFrame([(1.0, "a", "b", 1, None), (2.0, None, "b", 1, 1), (3.0, "a", "b", 2, 2)], "ts double, orig_h string, resp_h string, orig_bytes long, resp_bytes long")
    assert [r.ts for r in logs.without_nulls(rows, "CONN").collect()] == [1.0, 3.0]
    assert [r.ts for r in logs.without_nulls(rows, "CONN", complete=True).collect()] == [3.0]
    assert [r.ts for r in logs.without_unset(rows, "CONN").collect()] == [2.0, 3.0]
    assert logs.numeric_columns("DNS")[:4] == ["ts", "orig_p", "resp_p", "trans_id"]


def test_tokens_have_no_limit(spark):
    line = "\t".join(str(i) for i in range(1000))
    df = spark.createDataFrame([(line + "\t\t",)], "value string")
    assert df.select(F.size(logs.tokens(F.col("value"), collapse=True))).first()[0] == 1000


def test_split_in_time_and_evaluation(spark):
    df = spark.createDataFrame([(k, i, float(i % 7), int(k == "bad")) for k in ("good", "bad") for i in range(100)], "k string, at long, x double, label int")
    df = df.withColumn("x", F.col("x") + 20 * F.col("label"))
    early, late = models.split_in_time(df, ["k"], "at", 0.6)
    assert early.count() == 120 and late.count() == 80 and early.agg(F.max("at")).first()[0] < late.agg(F.min("at")).first()[0]
    model = models.fit_row_gbt(early, ["x"], trees=2, depth=2, bins=64)
    rates = {(r.set, r.k): r.rate for r in models.evaluate(model, {"early": early, "late": late}, ["x"], ["k"]).collect()}
    assert rates == {("early", "good"): 0.0, ("early", "bad"): 1.0, ("late", "good"): 0.0, ("late", "bad"): 1.0}


def test_cutoff_from_the_sample(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(300)], "i long, x double")
    forest = models.fit_isolation_forest(df, ["x"], "i", trees=10)
    scores = sorted(r.score for r in models.score_isolation(df, forest, ["x"], ["i"]).collect())
    assert models.sample_cutoff(forest, 0.5) == pytest.approx(scores[149], abs=0.05)


def test_names_of_reports(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["p", "q", None], ["q", "r"]))
    assert sorted(r.name for r in report.all_names(a, b).collect()) == ["p", "q", "r"]


def _conn(uid: str, width: int | None = None) -> str:
    parts = ["1700000000.000000", uid, *(["x"] * (schemas.width("CONN") - 2))]
    return "\t".join(parts[: width or len(parts)])


def test_live_job(spark, tmp_path):
    """Lines are tagged, a half-written one is found again, what stays broken is set aside; the stream is counted."""
    folder = tmp_path / "pod"
    folder.mkdir()
    log = folder / "conn.log"
    good = [_conn(f"C{i:016d}") for i in range(5)]
    log.write_text("#fields\tts\n" + "\n".join(good) + "\n" + _conn("C" + "9" * 16, 3) + "\n")
    beat = job.Heartbeat()
    spark.streams.addListener(beat)
    try:
        run = lambda: job.format_logs(spark, str(log), str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination(120)
        assert run()
        tagged = sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "lines")).collect())
        assert tagged == sorted("CONN," + x.replace("\t", ",") for x in good)
        assert spark.read.parquet(str(tmp_path / "out" / "quarantine")).count() == 1
        with log.open("a") as f:
            f.write(_conn("C" + "8" * 16) + "\n#close\n")
        assert run()
        assert spark.read.text(str(tmp_path / "out" / "lines")).count() == 6
    finally:
        import time

        for _ in range(50):
            if sum(beat.rows.values()) >= 9:
                break
            time.sleep(0.2)
        spark.streams.removeListener(beat)
    assert sum(beat.rows.values()) == 9


def _seen(spark, log, lines):
    made = tail.identity(str(log))
    return spark.createDataFrame([(str(log), made, pos, x) for pos, x in lines], "file string, made string, pos long, value string")


def test_half_written_line_is_repaired(spark, tmp_path):
    whole = [_conn(f"C{i:016d}") for i in range(3)]
    log = tmp_path / "conn.log"
    log.write_text("#fields\tts\n" + "\n".join(whole) + "\n")
    at = [11 + sum(len(x) + 1 for x in whole[:i]) for i in range(3)]
    seen = _seen(spark, log, [(at[0], whole[0]), (at[1], whole[1][:25]), (at[1] + 26, "#close")])
    assert [r.fixed for r in job.repaired(job.checked(seen).where("corrupt")).collect()] == [whole[1]]
    first = _seen(spark, log, [(at[0], whole[0][:30])])  # the first line of a file has none before it
    assert [r.fixed for r in job.repaired(job.checked(first).where("corrupt")).collect()] == [whole[0]]


def test_a_fragment_alone_in_its_batch_is_repaired(spark, tmp_path):
    """The line before it came in an earlier batch, and the log was moved a little and rotated meanwhile."""
    whole = [_conn(f"C{i:016d}") for i in range(4)]
    log, other = tmp_path / "conn.log", tmp_path / "dns.log"
    log.write_text("\n".join(whole) + "\n")
    other.write_text("x\n")
    size = len(whole[0]) + 1
    before = job.last_lines(_seen(spark, log, [(0, whole[0]), (size, whole[1]), (size * 2, "#close")]).unionByName(_seen(spark, other, [(0, "x")])))
    before = job.last_lines(_seen(spark, other, [(2, "y")]), before)
    assert sorted(r.value for r in before.collect()) == sorted([whole[1], "y"])
    fragment = _seen(spark, log, [(2 * size + 3, whole[2][:20])])
    log.rename(tmp_path / "conn.log.1")
    log.write_text("another file\n")
    ready = job.checked(fragment, before)
    assert [(r.prev_value, r.corrupt) for r in ready.collect()] == [(whole[1], True)]
    assert [r.fixed for r in job.repaired(ready).collect()] == [whole[2]]
    lost = job.repaired(job.checked(_seen(spark, other, [(2, "no such line")]), before).where("corrupt")).collect()
    assert [r.fixed for r in lost] == [None]


@pytest.mark.parametrize("records", ["1", "7", "10000"])
def test_only_broken_and_last_lines_are_moved(spark, records):
    """Files in several stretches over several partitions: each broken line has the line before it, sound ones stay where they are."""
    rng, rows = random.Random(3), []
    for f in range(24):
        for i in range(rng.choice((1, 2, 40))):
            line = rng.choice((_conn(f"C{f:03d}{i:013d}"),) * 3 + (f"broken {f} {i}", "#remark", " "))
            rows.append((f"/logs/p{f // 2}/conn.log", f"1:{f}", i * 200, line))  # two files in turn under each path
    seen = spark.createDataFrame(spark.sparkContext.parallelize(rows, 9), "file string, made string, pos long, value string")
    before = spark.createDataFrame([("/logs/p0/conn.log", "1:0", "old"), ("/logs/p1/conn.log", "1:7", "gone"), ("/logs/q/conn.log", "1:99", "other")], "file string, made string, value string")
    last, want = {r[:2]: r.value for r in before.collect()}, set()
    for file, made, pos, line in rows:
        if line.strip() and not line.startswith("#"):
            if line.startswith("broken"):
                want.add((file, made, pos, line, last.get((file, made))))
            last[file, made] = line
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        ready = job.checked(seen, before)
        found = ready.collect()
        known = {(r.file, r.made): r.value for r in job.last_lines(ready, before).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {(r.file, r.made, r.pos, r.value, r.prev_value) for r in found if r.corrupt} == want and len(want) > 20
    assert sum(not r.corrupt for r in found) <= 24 + 8  # at most one a stretch
    files = {r[0] for r in rows if r[3].strip() and not r[3].startswith("#")}
    assert known == {k: v for k, v in last.items() if k[0] not in files or k in {r[:2] for r in rows if r[3].strip() and not r[3].startswith("#")}}


def test_repair_reads_a_stretch_not_the_file(tmp_path):
    log = tmp_path / "conn.log"
    lines = [f"line {i} " + "x" * 80 for i in range(100_000)]
    log.write_text("\n".join(lines) + "\n")
    pos = sum(len(x) + 1 for x in lines[:70_000])
    found, read = tail.line_after(str(log), tail.identity(str(log)), pos, lines[69_999])
    assert found == lines[70_000] and read <= 2 * tail.BLOCK
    assert tail.line_after(str(log), None, pos, "never there")[0] is None
    assert tail.line_after(str(log), None, pos, None)[0] == lines[70_000]
    assert tail.line_after(str(tmp_path / "gone.log"), "1:2", 0, None) == (None, 0)


def test_quantiles_are_those_of_sql_to_the_last_bit(spark):
    """Also where the two values around a rank are neighbours as doubles, so that a comparison with the quantile could turn."""
    import duckdb

    rng, rows = random.Random(3), []
    for k in range(60):
        low = rng.uniform(0.1, 60)
        rows += [(k, v) for v in ([low] * 17 + [math.nextafter(low, 100)] * 20 if k % 2 else [rng.uniform(0, 60) for _ in range(rng.randint(20, 60))])]
    at = profile.PROFILE_QUANTILES
    found = {r["k"]: list(r["q"]) for r in profile.spread_quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", at).collect()}
    con = duckdb.connect()
    for k in range(60):
        own = [v for key, v in rows if key == k]
        want = con.execute(f"SELECT {', '.join(f'quantile_cont(v, {p})' for p in at)} FROM (SELECT unnest(?::DOUBLE[]) AS v)", [own]).fetchall()[0]
        assert found[k] == list(want), k
    one = spark.createDataFrame([(1e308, 1.0, 1.0), (3.0, 7.0, -21.0), (0.1, 10.0, -1.0)], "a double, b double, c double")
    assert [r[0] for r in one.select(profile.fused(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1e308, 0.0, 2.0**-54]
