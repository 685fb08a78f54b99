"""Windows, expressions, spectra, models and streams on small inputs."""

import math
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netweave.functions import expr, spectral, tables, wavelets
from netweave.operators import encode, features, mix, models, profile, report, scoring, windows
from netweave.sources import logs, schemas
from netweave.streaming import windows as streaming


@pytest.mark.parametrize("n", [1, 499, 500, 501, 749, 750, 1001])
def test_hopping_covers_rows(spark, n):
    df = spark.range(n).selectExpr("id AS seq", "0 AS pod")
    got = {r.k: (r.first, r.last) for r in windows.hopping(df, "pod", "seq").groupBy("k").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).collect()}
    want = {k: (250 * k, 250 * k + 499) for k in range(0, (n - 500) // 250 + 1 if n >= 500 else 0)}
    if not want or max(b for _, b in want.values()) < n - 1:
        want[-1] = (max(0, n - 500), n - 1)
    assert got == want


def test_row_numbers_over_spans(spark):
    df = spark.range(1000).selectExpr("id * 7 AS seq", "id % 3 AS pod").repartition(5)
    got = {r.seq: (r.rn, r.total) for r in windows.number_rows(df, "pod", "seq", span=64).collect()}
    for pod in range(3):
        own = sorted(s for s in got if (s // 7) % 3 == pod)
        assert [got[s] for s in own] == [(i + 1, len(own)) for i in range(len(own))]
    prev = {r.seq: r.prev_seq for r in windows.lag_rows(df, "pod", "seq", ["seq"], span=64).collect()}
    assert all(prev[s] == (s - 21 if s >= 21 else None) for s in prev)


def test_window_features_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(450, 2)).round(6)
    df = spark.createDataFrame([(i, "p", float(a), float(b)) for i, (a, b) in enumerate(x)], "seq long, pod string, a double, b double")
    for r in features.window_features(windows.tumbling(df, "pod", "seq"), ["pod", "wid"], ["a", "b"]).collect():
        w = x[200 * r.wid : 200 * r.wid + 200]
        level = np.abs(w).mean(0) + 1e-12
        p = level / level.sum()
        want = [len(w), *(f(w[:, j]) for j in (0, 1) for f in (np.mean, np.std, np.min, np.max)), -(p * np.log(p)).sum()]
        assert np.allclose([r[c] for c in ("n", "mean_a", "std_a", "min_a", "max_a", "mean_b", "std_b", "min_b", "max_b", "entropy")], want)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), np.zeros(1500), [1e9]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(v)) % 2, "v": v}))
    for r in profile.spread_quantiles(df, ["k"], "v", profile.DESCRIBE_QUANTILES, parts=16).collect():
        own = v[np.arange(len(v)) % 2 == r.k]
        assert r.n == len(own) and np.allclose(r.q, np.quantile(own, profile.DESCRIBE_QUANTILES))
    five = spark.createDataFrame([(float(x),) for x in (1, 5, 9, 2, 100)], "v double").select(profile.quantiles(F.col("v"), profile.PROFILE_QUANTILES).alias("q")).first().q
    assert np.allclose(five, [1.04, 1.2, 5, 81.8, 96.36])


def test_exact_quantiles_hold_no_group_in_one_task(spark):
    """Ties, null keys, keys without values; no plan with an aggregate of all distinct values or a row of its own for each tied value."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=900), np.full(900, 0.1), np.full(20, 0.3)])
    keys = [None if i % 3 == 0 else i % 3 for i in range(len(v))]
    rows = [(k, float(x)) for k, x in zip(keys, v)] + [(7, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    own = {k: np.sort([x for j, x in zip(keys, v) if j == k]) for k in (None, 1, 2)}
    got = {r.k: r for r in profile.describe(df, "v", ["k"]).collect()}
    for k, x in own.items():
        assert got[k].n == len(x) and np.allclose([got[k][f"q{round(100 * p):03d}"] for p in profile.DESCRIBE_QUANTILES], np.quantile(x, profile.DESCRIBE_QUANTILES))
        assert got[k].q075 == 0.1  # a tie is the value itself
    assert got[7].n == 0 and got[7].q050 is None
    cut = models.score_cutoff(df, 0.1, "v")
    assert math.isclose(cut, np.quantile(v, 0.9))
    flows = spark.createDataFrame([(1, 5, 3, 2, 1, 0.5)], "pod int, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, duration double")
    flows = flows.withColumns({c: F.lit("x") for c in ("proto", "service", "conn_state")})
    made = [profile.describe(df, "v", ["k"]), profile.class_profile(flows, F.col("duration"), "orig_bytes", "resp_bytes", ["pod"]), profile.conn_profile(flows), scoring.build_ruleset(flows, ["pod"]), profile.spread_quantiles(df, ["k"], "v", (0.5,))]
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in made):
        assert "percentile(" not in plan and "row_number" not in plan


def test_spectrum():
    assert np.allclose(spectral.magnitudes(np.array([3.0, 1, 4, 1, 5, 9, 2]))[1:], [8.14823, 7.10485, 7.08007], atol=1e-5)
    assert set(spectral.metrics(np.array([1.0, 2, 3])).values()) == {0.0}
    wave = spectral.metrics(np.sin(2 * np.pi * 5 * np.arange(100) / 100))
    assert wave["dominant_freq"] == 0.05 and wave["entropy"] < 0.01


def _joined(low, high, n):
    """A series from its halves: the inverse of ``wavelets.halves``."""
    spread = lambda c: np.repeat(c, 2) * np.tile([1, 0], len(c))
    whole = np.convolve(spread(low), wavelets.LOW[::-1]) + np.convolve(spread(high), wavelets.HIGH[::-1])
    return whole[len(wavelets.LOW) - 2 :][:n]


def test_wavelet_packets_can_be_put_together_again():
    for n in (1, 2, 3, 5, 8, 9, 64, 101):
        x = np.random.default_rng(n).normal(size=n)
        assert np.allclose(_joined(*wavelets.halves(x), n), x, atol=1e-10)
    y = np.random.default_rng(0).normal(size=90)
    bands = wavelets.packets(y)
    level = [bands[f] for f in np.argsort([f ^ (f >> 1) for f in range(8)])]  # back from frequency to tree order
    sizes = [90, 48, 27]
    for n in reversed(sizes):
        level = [_joined(a, b, n) for a, b in zip(level[::2], level[1::2])]
    assert np.allclose(level[0], y, atol=1e-9)
    tone = lambda f: int(wavelets.packet_energies(np.cos(np.pi * f * np.arange(512))).argmax())
    assert [tone((b + 0.5) / 8) for b in range(8)] == list(range(8))  # bands stand by frequency
    assert not wavelets.packet_energies(np.ones(7)).any() and set(wavelets.packet_metrics(np.zeros(8)).values()) == {0.0}


def test_continuous_transform_is_its_definition():
    y = np.random.default_rng(2).normal(size=37)
    got = wavelets.continuous(y)
    for s in wavelets.scales(37):
        for b in range(37):
            want = sum(y[i] * np.exp(-(((b - i) / s) ** 2) / 2) * np.cos(5 * (b - i) / s) / np.sqrt(s) for i in range(37) if abs(b - i) <= wavelets.REACH * s)
            assert got[s - 1, b] == pytest.approx(want, abs=1e-9)
    assert set(wavelets.continuous_metrics(y[:3]).values()) == {0.0} and wavelets.continuous_metrics(y[:4])["max_scale"] == 1.0


def test_table_function(spark):
    tables.register(spark)
    rows = [(k, i, float((i * 7 + len(k)) % 5)) for k in ("a", "bb") for i in range(20)] + [("c", 1, 2.0)]
    spark.createDataFrame(rows, "k string, at int, y double").createOrReplaceTempView("series")
    found = {r.k: r for r in spark.sql("SELECT * FROM fft_features(TABLE(series) PARTITION BY k ORDER BY (at DESC), 'k', 'y')").collect()}
    for k in ("a", "bb", "c"):
        y = np.array([v for name, _, v in reversed(rows) if name == k])
        assert found[k].n == len(y) and {m: found[k][m] for m in spectral.METRICS} == spectral.metrics(y)


def test_expressions(spark):
    row = spark.createDataFrame([("-", "T", None, 0.0, 5.0, "60,60,300", "/a/pod-1/conn.log", "key (x) 5 (y)")], "a string, b string, c string, zero double, five double, ttl string, path string, remark string")
    stats = expr.list_stats(expr.list_items(F.col("ttl")))
    got = row.select(
        expr.null_if_unset(F.col("a")), expr.number_or_zero(F.col("a")), expr.flag(F.col("b")), expr.known(F.col("c")), expr.safe_rate(F.col("five"), F.col("zero")), expr.traffic_class(F.col("five"), F.col("zero")),
        stats["count"], stats["mean"], stats["std"], expr.log_type(F.col("path")), expr.parent_name(F.col("path")), expr.without_remarks(F.col("remark")), expr.z_band(F.col("five"), F.lit(0.0), F.lit(2.0)), expr.z_band(F.col("five"), F.lit(0.0), F.lit(0.0)),
        expr.band(F.col("five"), F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(6.0)), expr.missing(F.col("c")), expr.zero_activity(F.col("zero"), F.col("zero")),
    ).first()
    assert tuple(got) == (None, 0.0, 1, "unknown", None, "orig", 3, 140.0, pytest.approx(np.std([60, 60, 300])), "CONN", "pod-1", "key  5", 0.75, 0.0, 0.5, 1, 1)


_HEAD = "1700000000.000000\tCuid000000000000001\t10.0.0.1\t1234\t10.0.0.2\t53\t"
ENCODED = {
    "CONN": (
        [_HEAD + "tcp\tssl\t0.5\t10\t0\tSF\tT\tF\t7\tShAD\t3\t130\t2\t80\t-", _HEAD + "udp\t-\t-\t-\t-\tS0\t-\t-\t0\tD\t1\t40\t0\t0\t-"],
        {"duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "duration_missing", "orig_bytes_missing", "resp_bytes_missing", "missed_bytes_missing", "orig_pkts_missing", "orig_ip_bytes_missing", "resp_pkts_missing", "resp_ip_bytes_missing", "local_orig", "local_resp", "proto_tcp", "proto_udp", "service_ssl", "service_unknown", "conn_state_S0", "conn_state_SF"},
        [
            {"duration": 0.5, "duration_missing": 0, "orig_bytes": 10.0, "resp_bytes": 0.0, "resp_bytes_missing": 0, "missed_bytes": 7.0, "local_orig": 1, "local_resp": 0, "proto_tcp": 1, "proto_udp": 0, "service_ssl": 1, "service_unknown": 0, "conn_state_SF": 1, "orig_ip_bytes": 130.0},
            {"duration": 0.0, "duration_missing": 1, "orig_bytes": 0.0, "orig_bytes_missing": 1, "resp_bytes_missing": 1, "missed_bytes": 0.0, "missed_bytes_missing": 0, "local_orig": 0, "local_resp": 0, "proto_udp": 1, "service_unknown": 1, "conn_state_S0": 1, "resp_pkts": 0.0},
        ],
    ),
    "DNS": (
        [_HEAD + "udp\t17\t0.25\ta.b\t1\tC_INTERNET\t28\tAAAA\t0\tNOERROR\tT\tF\tT\tT\t0\t10.0.0.9,fe80::1,10.0.0.9\t60.0,300.0\tF", _HEAD + "udp\t18\t-\ta.b\t1\tC_INTERNET\t-\t-\t3\tNXDOMAIN\tF\tF\tT\t-\t1\t-\t-\tT"],
        {"rtt", "qclass", "qtype", "rcode", "Z", "rtt_missing", "qclass_missing", "qtype_missing", "rcode_missing", "Z_missing", "AA", "TC", "RD", "RA", "rejected", "proto_udp", "qclass_name_C_INTERNET", "qtype_name_AAAA", "qtype_name_unknown", "rcode_name_NOERROR", "rcode_name_NXDOMAIN", "answers_count", "answers_unique_count", "answers_has_ipv6", "ttls_mean", "ttls_std", "ttls_count", "answers_ttls_mismatch"},
        [
            {"rtt": 0.25, "qtype": 28.0, "AA": 1, "TC": 0, "RD": 1, "RA": 1, "rejected": 0, "answers_count": 3, "answers_unique_count": 2, "answers_has_ipv6": 1, "ttls_mean": 180.0, "ttls_std": 120.0, "ttls_count": 2, "answers_ttls_mismatch": 1, "qtype_name_AAAA": 1, "rcode_name_NOERROR": 1},
            {"rtt": 0.0, "rtt_missing": 1, "qtype": 0.0, "qtype_missing": 1, "AA": 0, "RD": 1, "RA": 0, "rejected": 1, "answers_count": 0, "answers_unique_count": 0, "answers_has_ipv6": 0, "ttls_mean": 0.0, "ttls_std": 0.0, "ttls_count": 0, "answers_ttls_mismatch": 0, "qtype_name_unknown": 1, "rcode_name_NXDOMAIN": 1, "Z": 1.0},
        ],
    ),
    "SSL": (
        [_HEAD + "TLSv13\tTLS_AES\tx25519\ta.b\tT\t-\th2\tT\tCs\tf1,f2\t-\tF", _HEAD + "-\tTLS_AES\t-\ta.b\tF\t-\t-\t-\tC\t-\t-\tT"],
        {"resumed", "established", "sni_matches_cert", "version_TLSv13", "version_unknown", "cipher_TLS_AES", "curve_unknown", "curve_x25519"},
        [{"resumed": 1, "established": 1, "sni_matches_cert": 0, "version_TLSv13": 1, "curve_x25519": 1, "cipher_TLS_AES": 1}, {"resumed": 0, "established": 0, "sni_matches_cert": 1, "version_TLSv13": 0, "version_unknown": 1, "curve_unknown": 1}],
    ),
    "HTTP": (
        [_HEAD + "1\tGET\ta.b\t/x\t-\t1.1\tagent\t-\t0\t512\t200\tOK\t-\t-\t(empty)\t-\t-\tp1,p2\t" + "-\t" * 5 + "-"] * 2,
        {"trans_depth", "request_body_len", "response_body_len", "status_code", "info_code", "info_msg", "tags", "proxied"},
        [{"trans_depth": 1, "request_body_len": 0, "response_body_len": 512, "status_code": 200, "info_code": None, "info_msg": None, "tags": [], "proxied": ["p1", "p2"]}] * 2,
    ),
}


@pytest.mark.parametrize("kind", list(ENCODED))
@pytest.mark.parametrize("text", [False, True])
def test_encoders_on_logs_as_they_are_read(spark, tmp_path, kind, text):
    """A log read and encoded: the columns and values written out, from typed rows and from rows of text."""
    lines, names, values = ENCODED[kind]
    log = tmp_path / f"{kind.lower()}.log"
    log.write_text("\n".join(["#fields\t" + "\t".join(n for n, _ in schemas.fields(kind)), *lines]) + "\n")
    rows, bad = logs.read_log(spark, str(log), kind)
    assert bad.count() == 0 and rows.count() == len(lines)
    if text:  # every column as the log has it
        cells = F.split("value", "\t")
        raw = logs.read_lines(spark, str(log)).where(logs.is_data(F.col("value"))).select("pos", *(F.get(cells, F.lit(i)).alias(schemas.column_name(n)) for i, (n, _) in enumerate(schemas.fields(kind))))
        whole = raw.select("pos", *(expr.null_if_unset(F.col(c)).alias(c) for c in raw.columns if c != "pos"))
    else:
        whole = rows.drop("file")
    run = {"CONN": encode.encode_conn, "DNS": encode.encode_dns, "SSL": encode.encode_ssl}.get(kind)
    found = run(whole, encode.fit_vocabulary(whole, kind)) if run else encode.encode_http(whole)
    assert set(found.columns) == names | {"pos"}
    if kind == "HTTP" and text:
        return
    for r, want in zip(found.orderBy("pos").collect(), values):
        assert {c: r[c] for c in want} == want
    if kind == "CONN":
        assert encode.encode_conn(whole, {}, complete=True).count() == 1
    assert encode.align(found, ["pos", "other"]).columns == ["pos", "other"]


def test_samples_are_exact(spark):
    df = spark.range(5000).withColumnRenamed("id", "seq")
    for n in (0, 1, 1234, 5000, 9000):
        got = mix.sample_n(df, n, "seq", 3)
        assert got.count() == min(n, 5000) == got.distinct().count()
    ranked = [r.seq for r in df.orderBy(mix.order_hash("seq", 3), "seq").limit(700).collect()]
    assert {r.seq for r in mix.sample_n(df, 700, "seq", 3).collect()} == set(ranked)


def test_report_text(spark):
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(["Section one", "mean: 5 (ms)", "std: 2", "Section two", "p99: 7"])], "report string, pos int, value string")
    got = [(r.section, r.key, r.value) for r in report.parse_report(lines).orderBy("section", "key").collect()]
    assert got == [("Section one", "mean", "5"), ("Section one", "std", "2"), ("Section two", "p99", "7")]


def test_chi2_and_mahalanobis(spark):
    assert [round(models.chi2_quantile(p, k), 3) for p, k in ((0.95, 1), (0.997, 3), (0.5, 10))] == [3.841, 13.931, 9.342]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)) @ np.array([[2.0, 0.5], [0, 1]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    mean, cov, n = models.covariance(df, ["a", "b"])
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    amount = models.shrinkage(df, ["a", "b"], mean, cov, n)
    c = x - x.mean(0)
    target = np.trace(cov) / 2
    want = (((c**2).sum(1) ** 2).sum() / n - (cov**2).sum()) / n / ((cov - target * np.eye(2)) ** 2).sum()
    assert math.isclose(amount, min(1, max(0, want)), rel_tol=1e-6)
    inverse = np.linalg.inv(cov)
    got = np.array([r.distance for r in models.mahalanobis(df, ["a", "b"], mean, inverse).collect()])
    assert np.allclose(np.sort(got), np.sort(np.sqrt(np.einsum("ij,jk,ik->i", c, inverse, c))))


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(8, 1, (5, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    forest = models.fit_isolation_forest(df, ["a", "b", "c"], "i", trees=50)
    scored = models.score_isolation(df, forest, ["a", "b", "c"], ["i"])
    cut = models.score_cutoff(scored, 0.01)
    assert {r.i for r in scored.where(F.col("score") > cut).collect()} >= set(range(500, 505))


def test_models_are_saved_and_read(spark, tmp_path):
    df = spark.createDataFrame([(float(i), None if i % 7 == 0 else float(i % 5), int(i > 50)) for i in range(100)], "a double, b double, label int")
    model = models.fit_forest(df, ["a", "b"], numTrees=5, maxDepth=4)
    models.save(model, str(tmp_path / "m"))
    assert models.predict(models.load(str(tmp_path / "m")), df, ["a", "b"]).where("predicted = label").count() >= 98


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, float(i * i % 11)) for i in range(700)]
    df = spark.createDataFrame(rows, "source string, seq long, v double")
    for a, b in ((0, 100), (100, 450), (450, 700)):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    run = streaming.score_windows(spark, stream, "source", "seq", ["v"], lambda x: x, lambda x, _: out.extend(x.collect()), str(tmp_path / "check"), size=50, availableNow=True)
    run.awaitTermination()
    batch = features.window_features(windows.full_tumbling(df, "source", "seq", 50), ["source", "wid"], ["v"]).collect()
    key = lambda r: (r.source, r.wid, r.n, round(r.mean_v, 9), round(r.std_v, 9))
    assert sorted(map(key, out)) == sorted(map(key, batch)) and len(batch) == 12


def test_last_rows_of_a_stream(spark, tmp_path):
    df = spark.range(95).selectExpr("id AS seq", "id % 2 AS source")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streaming.last_rows(stream, "source", "seq", 10).writeStream.format("memory").queryName("lasts").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.seq for r in spark.table("lasts").collect()) == list(range(75, 95))


def test_stream_windows_need_no_task_per_source(spark, tmp_path):
    rows = [(None if i % 3 == 0 else f"s{i % 3}", i, float(i * i % 11)) for i in range(700)]
    df = spark.createDataFrame(rows, "source string, seq long, v double")
    for a, b in ((0, 100), (100, 130), (130, 450), (450, 700)):
        df.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, failed = {}, []

    def sink(x, number):
        out[number] = x.collect()
        if number == 2 and not failed:
            failed.append(number)
            raise ValueError("once")

    start = lambda: streaming.score_windows(spark, stream, "source", "seq", ["v"], lambda x: x, sink, str(tmp_path / "check"), size=50, availableNow=True)
    with pytest.raises(Exception, match="once"):
        start().awaitTermination()
    run = start()
    run.awaitTermination()
    assert not run.lastProgress["stateOperators"]  # rows of a source meet in a task of Python only there
    v = {s: [r[2] for r in rows if r[0] == s] for s in (None, "s1", "s2")}
    want = {(s, w): round(float(np.mean(x[50 * w : 50 * w + 50])), 9) for s, x in v.items() for w in range(len(x) // 50)}
    assert {(r.source, r.wid): round(r.mean_v, 9) for x in out.values() for r in x} == want and sum(map(len, out.values())) == len(want) == 12


def test_last_rows_hold_one_chunk():
    marks, alive = [], []

    class State:
        get = staticmethod(lambda: [])
        put = staticmethod(lambda rows: None)

    def chunks():
        for i in range(20):
            frame = pd.DataFrame({"seq": np.arange(1000 * i, 1000 * i + 1000)})
            marks.append(weakref.ref(frame))
            alive.append(sum(m() is not None for m in marks))
            yield frame
            del frame

    processor = streaming.LastRows(StructType().add("seq", "long"), "seq", 10)
    processor.rows = State()
    (got,) = processor.handleInputRows(("a",), chunks(), None)
    assert list(got.seq) == list(range(19990, 20000)) and max(alive) <= 2
