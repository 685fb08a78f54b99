"""Registered queries over the flow view and the star-schema tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions import expr, spectral, tables, wavelets
from netweave.operators import encode, features, mix, profile, report, scoring, windows
from netweave.plans import oracles as sql
from netweave.plans.oracles import rnd
from netweave.sources import logs
from netweave.sources.flowview import read_flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The numeric columns that windows describe.
NUMBERS = ["orig_p", "resp_p", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration"]


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    """Doubles rounded for comparison: sums depend on the order of rows."""
    return df.withColumns({c: expr.rounded(F.col(c), places) for c in columns})


def _doubles(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "double"]


# --- positional windows and their features ---------------------------------------


@query(f"WITH {sql.NUMBERED} SELECT pod, CAST((rn - 1) // 200 AS BIGINT) AS wid, {sql.window_stats(NUMBERS)} FROM n GROUP BY 1, 2")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.window_features(windows.tumbling(read_flows(spark, sf_dir), "pod", "seq"), ["pod", "wid"], NUMBERS)
    return rounded(found, *_doubles(found))


@query(f"WITH {sql.NUMBERED} SELECT pod, CAST((rn - 1) // 200 AS BIGINT) AS wid, {sql.window_stats(NUMBERS)} FROM n GROUP BY 1, 2 HAVING count(*) = 200")
def window_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.window_features(windows.full_tumbling(read_flows(spark, sf_dir), "pod", "seq"), ["pod", "wid"], NUMBERS)
    return rounded(found, *_doubles(found))


_HOP = "SELECT pod, k, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, abs(arg_max(ts_us, rn) - arg_min(ts_us, rn)) AS elapsed_us FROM {} GROUP BY pod, k"


def _hops(spark: SparkSession, sf_dir: str, tail: bool) -> DataFrame:
    hopped = windows.hopping(read_flows(spark, sf_dir), "pod", "seq", tail=tail)
    return hopped.groupBy("pod", "k").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), windows.elapsed("ts_us", "rn").alias("elapsed_us"))


@query(f"WITH {sql.HOPPED} {_HOP.format('hop')}")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir, tail=True)


@query(f"WITH {sql.HOPPED} {_HOP.format('h')}")
def hopping_windows_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir, tail=False)


@query(f"WITH {sql.NUMBERED} SELECT pod, seq, CAST(rn AS BIGINT) AS rn FROM n WHERE rn > total - 500")
def last_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_n(read_flows(spark, sf_dir), "pod", "seq").select("pod", "seq", "rn")


@query(f"WITH {sql.FLOW} SELECT pod, seq, lag(conn_state) OVER (PARTITION BY pod ORDER BY seq) AS prev_conn_state FROM f")
def previous_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lag_rows(read_flows(spark, sf_dir), "pod", "seq", ["conn_state"]).select("pod", "seq", "prev_conn_state")


@query(
    f"""WITH {sql.FLOW}, g AS (SELECT pod, (ts_us - lag(ts_us) OVER (PARTITION BY pod ORDER BY ts_us, seq)) / 1e6 AS gap FROM f)
SELECT pod, {rnd("avg(gap)")} AS gap_mean, {rnd("stddev_samp(gap)")} AS gap_std, {rnd("CASE WHEN avg(gap) <> 0 THEN stddev_samp(gap) / avg(gap) ELSE 0 END")} AS gap_cv FROM g GROUP BY pod"""
)
def interarrival_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = profile.interarrival(read_flows(spark, sf_dir), "pod", "ts_us", "seq").withColumn("gap", F.col("gap") / 1e6)
    return rounded(gaps.groupBy("pod").agg(*profile.moments(F.col("gap"), "gap")), "gap_mean", "gap_std", "gap_cv")


# --- frequencies and profiles ------------------------------------------------------


@query(f"WITH {sql.FLOW} SELECT orig_h, count(*) AS cnt FROM f GROUP BY orig_h")
def addr_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequency(read_flows(spark, sf_dir), "orig_h")


@query(f"WITH {sql.FLOW} SELECT orig_p, count(*) AS cnt FROM f GROUP BY orig_p")
def port_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequency(read_flows(spark, sf_dir), "orig_p")


@query(f"WITH {sql.FLOW} SELECT resp_h, resp_p, count(*) AS cnt FROM f GROUP BY resp_h, resp_p")
def pair_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequency(read_flows(spark, sf_dir), "resp_h", "resp_p")


@query(
    f"WITH {sql.FLOW} "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS cnt, {rnd('count(*) / sum(count(*)) OVER ()', 6)} AS share FROM f WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("proto", "service", "conn_state"))
)
def relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = read_flows(spark, sf_dir)
    parts = [profile.relative_frequency(flows, c).select(F.lit(c).alias("field"), "value", "cnt", expr.rounded(F.col("share"), 6).alias("share")) for c in ("proto", "service", "conn_state")]
    return mix.union_by_name(*parts)


_Q5 = ", ".join(f"{rnd(f'quantile_cont(duration, {p})')} AS p{round(100 * p):02d}" for p in profile.PROFILE_QUANTILES)


@query(f"WITH {sql.FLOW} SELECT pod, {rnd('avg(duration)')} AS d_mean, {rnd('stddev_samp(duration)')} AS d_std, {rnd('CASE WHEN avg(duration) <> 0 THEN stddev_samp(duration) / avg(duration) ELSE 0 END')} AS d_cv, {_Q5} FROM f GROUP BY pod")
def duration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = read_flows(spark, sf_dir)
    found = profile.with_quantiles(flows.groupBy("pod").agg(*profile.moments(F.col("duration"), "d")), flows, ["pod"], "duration", profile.PROFILE_QUANTILES)
    named = found.select("pod", "d_mean", "d_std", "d_cv", *(F.get("q", F.lit(i)).alias(f"p{round(100 * p):02d}") for i, p in enumerate(profile.PROFILE_QUANTILES)))
    return rounded(named, *_doubles(named))


@query(f"WITH {sql.FLOW} SELECT pod, count(duration) AS n, {_Q5} FROM f GROUP BY pod")
def spread_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles by the way that no task's memory limits."""
    found = profile.spread_quantiles(read_flows(spark, sf_dir), ["pod"], "duration", profile.PROFILE_QUANTILES)
    named = found.select("pod", "n", *(F.get("q", F.lit(i)).alias(f"p{round(100 * p):02d}") for i, p in enumerate(profile.PROFILE_QUANTILES)))
    return rounded(named, *_doubles(named))


def _totals_sql(u: str) -> str:
    return f"WITH {sql.FLOW} SELECT pod, CAST(sum(orig_{u}) AS BIGINT) AS orig_total, CAST(sum(resp_{u}) AS BIGINT) AS resp_total, {rnd(f'sum(orig_{u}) / (sum(resp_{u}) + 1e-9)')} AS ratio FROM f GROUP BY pod"


@query(_totals_sql("bytes"))
def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.totals(read_flows(spark, sf_dir), "orig_bytes", "resp_bytes", ["pod"]), "ratio")


@query(_totals_sql("pkts"))
def packet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.totals(read_flows(spark, sf_dir), "orig_pkts", "resp_pkts", ["pod"]), "ratio")


def _class_profile(spark: SparkSession, sf_dir: str, value, u: str) -> DataFrame:
    found = profile.class_profile(read_flows(spark, sf_dir), value, f"orig_{u}", f"resp_{u}", ["pod"])
    return rounded(found, *_doubles(found))


@query(sql.rounded_profile(sql.volume("bytes"), "bytes"))
def byte_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_profile(spark, sf_dir, profile.volume("orig_bytes", "resp_bytes"), "bytes")


@query(sql.rounded_profile(sql.volume("pkts"), "pkts"))
def packet_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_profile(spark, sf_dir, profile.volume("orig_pkts", "resp_pkts"), "pkts")


@query(sql.rounded_profile(sql.rate("bytes"), "bytes"))
def bps_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_profile(spark, sf_dir, profile.rate("orig_bytes", "resp_bytes", "duration"), "bytes")


@query(sql.rounded_profile(sql.rate("pkts"), "pkts"))
def pps_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_profile(spark, sf_dir, profile.rate("orig_pkts", "resp_pkts", "duration"), "pkts")


@query(sql.rounded_profile(sql.rate("bytes"), "pkts"))
def pps_profile_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet-rate profile with bytes over duration, by packet class."""
    return _class_profile(spark, sf_dir, profile.rate("orig_bytes", "resp_bytes", "duration"), "pkts")


_SECOND = "CAST(floor(ts_us / 1000000.0) AS BIGINT)"


@query(f"WITH {sql.FLOW} SELECT pod, {_SECOND} AS sec, CAST(sum(coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0)) AS BIGINT) AS bytes, count(*) AS conns FROM f GROUP BY 1, 2")
def per_second_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.per_second(read_flows(spark, sf_dir), "ts_us", ["pod"], bytes=F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)))


@query(f"WITH {sql.FLOW} SELECT pod, {_SECOND} AS sec, CAST(sum(orig_pkts + resp_pkts) AS BIGINT) AS pkts, count(*) AS conns FROM f GROUP BY 1, 2")
def per_second_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.per_second(read_flows(spark, sf_dir), "ts_us", ["pod"], pkts=F.col("orig_pkts") + F.col("resp_pkts"))


@query(
    f"""WITH {sql.FLOW}, s AS (SELECT pod, {_SECOND} AS sec, count(*) AS conns FROM f GROUP BY 1, 2),
g AS (SELECT pod, unnest(range(min(sec), max(sec) + 1)) AS sec FROM s GROUP BY pod)
SELECT g.pod, CAST(g.sec // 3600 AS BIGINT) AS hour, count(*) AS seconds, CAST(sum(coalesce(conns, 0)) AS BIGINT) AS conns FROM g LEFT JOIN s USING (pod, sec) GROUP BY 1, 2"""
)
def per_hour_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, the empty ones too, and connections per hour."""
    series = profile.per_second(read_flows(spark, sf_dir), "ts_us", ["pod"]).select("pod", "sec", "conns")
    return profile.filled_hours(series, ["pod"], ["conns"])


@query(f"WITH {sql.FLOW} SELECT pod, count(service) AS known, count(*) FILTER (WHERE service = 'login') AS flagged, {rnd('avg(CAST(service = $$login$$ AS INTEGER))', 6)} AS ratio FROM f GROUP BY pod")
def flag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.flag_ratio(read_flows(spark, sf_dir), F.col("service") == "login", ["pod"])
    return rounded(found, "ratio", places=6)


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


_Q11 = ", ".join(f"{rnd(f'quantile_cont(duration, {p})')} AS q{round(100 * p):03d}" for p in profile.DESCRIBE_QUANTILES)


@query(f"WITH {sql.FLOW} SELECT pod, count(duration) AS n, {rnd('avg(duration)')} AS mean, {rnd('stddev_pop(duration)')} AS std, {_Q11} FROM f GROUP BY pod")
def describe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.describe(read_flows(spark, sf_dir), "duration", ["pod"])
    return rounded(found, *_doubles(found))


@query(
    f"""WITH {sql.FLOW}
SELECT pod, 'duration' AS section, unnest(['mean', 'std', 'cv', 'p01', 'p05', 'p50', 'p95', 'p99']) AS item,
  round(unnest([avg(duration), stddev_samp(duration), stddev_samp(duration) / avg(duration), {', '.join(f'quantile_cont(duration, {p})' for p in profile.PROFILE_QUANTILES)}]), 4) + 0.0 AS value FROM f GROUP BY pod
UNION ALL SELECT pod, 'bytes_totals', 'ratio', {rnd('sum(orig_bytes) / (sum(resp_bytes) + 1e-9)')} FROM f GROUP BY pod
UNION ALL SELECT pod, 'pkts_totals', 'ratio', {rnd('sum(orig_pkts) / (sum(resp_pkts) + 1e-9)')} FROM f GROUP BY pod
"""
    + "".join(f"UNION ALL SELECT pod, '{c}', {c}, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY pod)')} FROM f WHERE {c} IS NOT NULL GROUP BY pod, {c}\n" for c in ("proto", "service", "conn_state"))
)
def conn_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.conn_profile(read_flows(spark, sf_dir)), "value")


@query(
    f"""WITH {sql.FLOW} SELECT pod, 'duration' AS section, unnest(['mean', 'std', 'cv']) AS item, round(unnest([avg(duration), stddev_samp(duration), stddev_samp(duration) / avg(duration)]), 4) + 0.0 AS value FROM f GROUP BY pod
UNION ALL SELECT pod, 'label', 'ratio', {rnd("avg(label)")} FROM f GROUP BY pod
"""
    + "".join(f"UNION ALL SELECT pod, '{c}', {c}, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY pod)')} FROM f WHERE {c} IS NOT NULL GROUP BY pod, {c}\n" for c in ("proto", "service", "resp_h"))
)
def log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that any log type can have: moments, flag ratios, shares of categories."""
    found = profile.log_profile(read_flows(spark, sf_dir), "pod", ("duration",), ("proto", "service", "resp_h"), ("label",))
    return rounded(found, "value")


# --- ruleset scores ------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = read_flows(spark, sf_dir)
    rules = scoring.build_ruleset(flows.where("pod = 0"), ["pod"]).drop("pod")
    return scoring.rule_scores(flows, rules)


_PARTS = ("dur_part", "vol_part", "pkt_part", "bps_part", "pps_part", "score")
_POD0 = sql.scored("CROSS JOIN (SELECT * EXCLUDE (pod) FROM rules WHERE pod = 0)", "seq, pod, label")


@query(f"WITH {_POD0} SELECT seq, {', '.join(f'{rnd(p)} AS {p}' for p in _PARTS)} FROM scored")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("seq", *_PARTS), *_PARTS)


@query(f"WITH {_POD0} SELECT seq, pod, {rnd('score')} AS score FROM scored WHERE round(score, 6) >= 0.5")
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return rounded(scoring.alerts(scores).select("seq", "pod", "score"), "score")


_RATES = "count(*) AS n, count(*) FILTER (WHERE round(score, 6) >= 0.5) AS flagged, " + rnd("avg(CAST(round(score, 6) >= 0.5 AS INTEGER))", 6) + " AS rate"


@query(f"WITH {_POD0} SELECT pod, label, {_RATES} FROM scored GROUP BY pod, label")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return rounded(scoring.detection_rates(scores, ["pod", "label"]), "rate", places=6)


@query(f"WITH {sql.scored('JOIN (SELECT pod AS rule_pod, * EXCLUDE (pod) FROM rules) r ON true', 'rule_pod, pod')} SELECT rule_pod, pod, {_RATES} FROM scored GROUP BY rule_pod, pod")
def rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pod's rows by every pod's ruleset: one row per ruleset is broadcast."""
    flows = read_flows(spark, sf_dir)
    rules = scoring.build_ruleset(flows, ["pod"]).withColumnRenamed("pod", "rule_pod")
    scores = scoring.rule_scores(flows, rules).withColumn("score", F.round("score", 6))
    return rounded(scoring.detection_rates(scores, ["rule_pod", "pod"]), "rate", places=6)


_KNOWN = "(SELECT DISTINCT resp_h, orig_p FROM f WHERE pod = 0)"


def _known(spark: SparkSession, sf_dir: str, unknown: bool) -> DataFrame:
    """All rows against the services and ports that one data set knows."""
    flows = read_flows(spark, sf_dir)
    members = flows.where("pod = 0").select("resp_h", "orig_p").distinct()
    return scoring.known(flows, members, ["resp_h", "orig_p"], unknown).select("seq", "resp_h", "orig_p")


@query(f"WITH {sql.FLOW} SELECT seq, resp_h, orig_p FROM f SEMI JOIN {_KNOWN} USING (resp_h, orig_p)")
def known_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, unknown=False)


@query(f"WITH {sql.FLOW} SELECT seq, resp_h, orig_p FROM f ANTI JOIN {_KNOWN} USING (resp_h, orig_p)")
def known_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir, unknown=True)


# --- spectra ---------------------------------------------------------------------------

#: Per window of 200 rows and pod: what each signal's series is.
_WINDOWED = f"{sql.NUMBERED}, w AS (SELECT *, CAST((rn - 1) // 200 AS BIGINT) AS wid, {_SECOND} AS sec FROM n)"
_AMOUNTS = {"bytes": "sum(coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0))", "pkts": "sum(orig_pkts + resp_pkts)", "conns": "count(*)"}


def _series_sql(signal: str, source: str, keys: str) -> str:
    """(keys, i, y, n): a signal's series in each window of ``source``."""
    if signal == "ts":
        return f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, seq) - 1 AS i, y, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, ts_us, seq, (ts_us - lag(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us, seq)) / 1e6 AS y FROM {source}) WHERE y IS NOT NULL"
    return f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY sec) - 1 AS i, CAST(y AS DOUBLE) AS y, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, sec, {_AMOUNTS[signal]} AS y FROM {source} GROUP BY {keys}, sec)"


def signal_rows(flows: DataFrame, keys: list[str]) -> DataFrame:
    """What the signals of windows are made from."""
    zero = F.lit(0)
    return flows.select(*keys, F.col("ts_us").alias("at"), "seq", (F.coalesce("orig_bytes", zero) + F.coalesce("resp_bytes", zero)).alias("bytes"), (F.col("orig_pkts") + F.col("resp_pkts")).alias("pkts"))


_METRICS = ", ".join(f"{rnd(m)} AS {m}" for m in ("entropy", "dominant_freq", "hf_lf"))


def _spectral_query(signal: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flows = windows.tumbling(read_flows(spark, sf_dir), "pod", "seq")
        found = spectral.signal_metrics(signal_rows(flows, ["pod", "wid"]), ["pod", "wid"]).where(F.col("signal") == signal).drop("signal")
        # Energies of whole numbers are multiples of a half: with fewer places, ties would be rounded by their last bit.
        return rounded(rounded(found.withColumn("energy", F.col("energy") / 1e6), "energy", places=7), *spectral.METRICS[1:])

    run.__name__ = f"spectral_features_{signal}"
    oracle = f"WITH {_WINDOWED}, {sql.dft(_series_sql(signal, 'w', 'pod, wid'), 'pod, wid')}, m AS ({sql.spectral('pod, wid')}) SELECT pod, wid, n, {rnd('energy / 1e6', 7)} AS energy, {_METRICS} FROM m"
    query(oracle)(run)


for _signal in spectral.SIGNALS:
    _spectral_query(_signal)


def _raw_spectrum(signal: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The whole spectrum, mean included, of a sum per second in each window."""
        flows = windows.tumbling(read_flows(spark, sf_dir), "pod", "seq")
        amount = {"bytes": F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)), "pkts": F.col("orig_pkts") + F.col("resp_pkts"), "conns": F.lit(1)}[signal]
        series = profile.per_second(flows, "ts_us", ["pod", "wid"], y=amount)
        return rounded(spectral.spectra(series, ["pod", "wid"], "sec", "y"), "magnitude", places=3)

    run.__name__ = name
    query(f"WITH {_WINDOWED}, {sql.dft(_series_sql(signal, 'w', 'pod, wid'), 'pod, wid')} SELECT pod, wid, CAST(fk AS BIGINT) AS k, {rnd('m', 3)} AS magnitude FROM spec")(run)


for _signal, _name in (("bytes", "dft_magnitudes"), ("pkts", "dft_packets"), ("conns", "dft_conns")):
    _raw_spectrum(_signal, _name)


# --- wavelets, and spectra as a table function ----------------------------------------------


def _byte_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pod, wid, sec, y): bytes per second of windows of 200 rows."""
    flows = windows.tumbling(read_flows(spark, sf_dir), "pod", "seq")
    return profile.per_second(flows, "ts_us", ["pod", "wid"], y=F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)))


_TAPS = ", ".join(f"({j}, {half}, {x!r})" for half, taps in enumerate((wavelets.LOW, wavelets.HIGH)) for j, x in enumerate(taps))


def _split_sql(level: int) -> str:
    """One more level of the packet tree: each output is a sum over the taps, beyond its ends a series is mirrored."""
    before = f"p{level - 1}"
    return f"""p{level} AS (SELECT o.pod, o.wid, 2 * o.b + t.half AS b, o.k AS i, sum(t.x * s.y) AS y, any_value((o.n + 7) // 2) AS n
FROM (SELECT pod, wid, b, max(n) AS n, unnest(range(0, CAST((max(n) + 7) // 2 AS BIGINT))) AS k FROM {before} GROUP BY pod, wid, b) o CROSS JOIN taps t
JOIN {before} s ON s.pod = o.pod AND s.wid = o.wid AND s.b = o.b
  AND s.i = least(((2 * o.k + 1 - t.j) % (2 * o.n) + 2 * o.n) % (2 * o.n), 2 * o.n - 1 - ((2 * o.k + 1 - t.j) % (2 * o.n) + 2 * o.n) % (2 * o.n))
GROUP BY o.pod, o.wid, o.b, t.half, o.k)"""


_BANDS = f"""{_WINDOWED}, y AS ({_series_sql("bytes", "w", "pod, wid")}), taps(j, half, x) AS (VALUES {_TAPS}), p0 AS (SELECT pod, wid, 0 AS b, i, y, n FROM y),
{", ".join(_split_sql(k) for k in range(1, wavelets.LEVELS + 1))},
sums AS (SELECT pod, wid, b, sum(y * y) AS e FROM p{wavelets.LEVELS} GROUP BY pod, wid, b),
bands AS (SELECT a.pod, a.wid, f.f AS band, CASE WHEN a.n < 8 THEN 0.0 ELSE s.e END AS energy FROM (SELECT pod, wid, max(n) AS n FROM y GROUP BY pod, wid) a
          CROSS JOIN (SELECT unnest(range(0, 8)) AS f) f JOIN sums s ON s.pod = a.pod AND s.wid = a.wid AND s.b = xor(f.f, f.f >> 1))"""


@query(f"WITH {_BANDS} SELECT pod, wid, band, {rnd('energy / 1e6')} AS energy FROM bands")
def wavelet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the eight bands of each window's bytes per second."""
    found = wavelets.packet_bands(_byte_series(spark, sf_dir), ["pod", "wid"], "sec", "y")
    return rounded(found.withColumn("energy", F.col("energy") / 1e6), "energy")


@query(
    f"""WITH {_BANDS}, t AS (SELECT pod, wid, sum(energy) AS total, sum(energy + 1e-12) AS mass, max(energy) AS top FROM bands GROUP BY pod, wid)
SELECT pod, wid, {rnd('CASE WHEN any_value(total) = 0 THEN 0 ELSE -sum((energy + 1e-12) / mass * ln((energy + 1e-12) / mass)) END')} AS entropy,
       {rnd('CASE WHEN any_value(total) = 0 THEN 0 ELSE min(band) FILTER (WHERE energy = top) END')} AS max_band, {rnd('CASE WHEN any_value(total) = 0 THEN 0 ELSE any_value(top / (total + 1e-9)) END')} AS concentration
FROM bands JOIN t USING (pod, wid) GROUP BY pod, wid"""
)
def wavelet_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the energy of each window's bytes per second lies over the bands of its wavelet packets."""
    return rounded(wavelets.wavelet_packets(_byte_series(spark, sf_dir), ["pod", "wid"], "sec", "y"), *wavelets.PACKETS)


@query(
    f"""WITH {_WINDOWED}, y AS ({_series_sql("bytes", "w", "pod, wid")}),
times AS (SELECT pod, wid, i AS b, n, unnest(range(1, greatest(2, least({wavelets.MOST_SCALE}, CAST(n // 2 AS BIGINT))))) AS s FROM y WHERE n >= 4),
c AS (SELECT a.pod, a.wid, a.s, a.b, sum(y.y * exp(-0.5 * pow((a.b - y.i) / a.s, 2)) * cos(5 * (a.b - y.i) / a.s) / sqrt(a.s)) ^ 2 AS e
      FROM (SELECT pod, wid, b, CAST(s AS DOUBLE) AS s FROM times) a JOIN y ON y.pod = a.pod AND y.wid = a.wid AND abs(a.b - y.i) <= {wavelets.REACH} * a.s GROUP BY a.pod, a.wid, a.s, a.b),
t AS (SELECT pod, wid, sum(e) AS total, max(s) AS scales FROM c GROUP BY pod, wid),
x AS (SELECT pod, wid, s, sum(e) AS e FROM c GROUP BY pod, wid, s),
m AS (SELECT pod, wid, sum(e + 1e-12) AS mass, max(e) AS top FROM x GROUP BY pod, wid),
whole AS (SELECT pod, wid, -sum(e / (total + 1e-12) * ln(e / (total + 1e-12) + 1e-12)) AS entropy, any_value(total) AS energy FROM c JOIN t USING (pod, wid) GROUP BY pod, wid),
parts AS (SELECT pod, wid, min(s) FILTER (WHERE e = top) AS max_scale, coalesce(sum(e) FILTER (WHERE s <= scales // 2), 0) / (sum(e) FILTER (WHERE s > scales // 2) + 1e-9) AS energy_ratio,
                 -sum((e + 1e-12) / mass * ln((e + 1e-12) / mass)) AS scale_diversity FROM x JOIN m USING (pod, wid) JOIN t USING (pod, wid) GROUP BY pod, wid)
SELECT k.pod, k.wid, {rnd('coalesce(energy, 0) / 1e6')} AS energy, {', '.join(f"{rnd(f'coalesce({c}, 0)')} AS {c}" for c in wavelets.CONTINUOUS[1:])}
FROM (SELECT DISTINCT pod, wid FROM y) k LEFT JOIN whole USING (pod, wid) LEFT JOIN parts USING (pod, wid)"""
)
def wavelet_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the continuous transform of each window's bytes per second."""
    found = wavelets.wavelet_transform(_byte_series(spark, sf_dir), ["pod", "wid"], "sec", "y")
    return rounded(found.withColumn("energy", F.col("energy") / 1e6), *wavelets.CONTINUOUS)


@query(ORACLE["spectral_features_bytes"])
def fft_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral features of each window's bytes per second, from Spark SQL by a table function."""
    tables.register(spark)
    _byte_series(spark, sf_dir).createOrReplaceTempView("netweave_byte_series")
    found = spark.sql("SELECT * FROM fft_features(TABLE(netweave_byte_series) PARTITION BY (pod, wid) ORDER BY (sec), 'pod, wid', 'y')")
    return rounded(rounded(found.withColumn("energy", F.col("energy") / 1e6), "energy", places=7), *spectral.METRICS[1:])


def _metrics_sql(source: str, keys: str) -> str:
    """CTE ``ent`` (keys, signal, and the four metrics) over ``source``, which has ``keys``, seq, ts_us, sec and the amounts."""
    out = [f"{sql.dft(_series_sql(x, source, keys), keys, f'_{source}_{x}')}, m_{source}_{x} AS ({sql.spectral(keys, f'_{source}_{x}')})" for x in spectral.SIGNALS]
    union = " UNION ALL ".join(f"SELECT {keys}, '{x}' AS signal, energy, entropy, dominant_freq, hf_lf FROM m_{source}_{x}" for x in spectral.SIGNALS)
    return ", ".join(out) + f", ent_{source} AS ({union})"


def _benign_windows(flows: DataFrame, size: int = 500) -> DataFrame:
    """The four metrics of each signal in each window of ``size`` benign rows.

    Windows stand for the whole files that a ruleset is otherwise made from, so that no task holds a data set.
    """
    cut = windows.tumbling(flows.where("label = 0"), "pod", "seq", size)
    return spectral.signal_metrics(signal_rows(cut, ["pod", "wid"]), ["pod", "wid"])


_BENIGN = f"{sql.NUMBERED}, bn AS (SELECT *, row_number() OVER (PARTITION BY pod ORDER BY seq) AS brn FROM f WHERE label = 0), w AS (SELECT *, CAST((brn - 1) // 500 AS BIGINT) AS wid, {_SECOND} AS sec FROM bn), {_metrics_sql('w', 'pod, wid')}"
_UNPIVOT = " UNION ALL ".join(f"SELECT signal, '{m}' AS metric, {m}{' / 1e6' if m == 'energy' else ''} AS v FROM ent_w" for m in spectral.METRICS)


@query(f"WITH {_BENIGN}, u AS ({_UNPIVOT}) SELECT signal, metric, count(*) AS n, {rnd('avg(v)', 7)} AS mean, {rnd('stddev_pop(v)', 7)} AS std, {rnd('min(v)', 7)} AS least, {rnd('max(v)', 7)} AS most FROM u GROUP BY signal, metric")
def fft_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral ruleset of the benign rows, with the ends of its values."""
    rules = scoring.metric_rules(_benign_windows(read_flows(spark, sf_dir)), ["signal"], list(spectral.METRICS))
    unit = F.when(F.col("metric") == "energy", 1e6).otherwise(1.0)
    ends = ("mean", "std", "least", "most")
    return rounded(rules.select("signal", "metric", "n", *((F.col(c) / unit).alias(c) for c in ends)), *ends, places=7)


@query(f"WITH {_BENIGN}, u AS ({_UNPIVOT.replace('SELECT signal', 'SELECT pod, wid, signal')}) SELECT pod, wid, signal, metric, {rnd('v', 7)} AS v FROM u")
def fft_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that the spectral ruleset is made from, one row per window, signal and metric."""
    values = scoring.metric_values(_benign_windows(read_flows(spark, sf_dir)), ["pod", "wid", "signal"], list(spectral.METRICS))
    return rounded(values.withColumn("v", F.col("v") / F.when(F.col("metric") == "energy", 1e6).otherwise(1.0)), "v", places=7)


@query(
    f"""WITH {_BENIGN}, {sql.HOPPED.removeprefix(sql.NUMBERED + ",")}, hs AS (SELECT *, {_SECOND} AS sec FROM hop), {_metrics_sql('hs', 'pod, k')},
weights(signal, weight) AS (VALUES ('ts', 0.4), ('bytes', 0.1), ('pkts', 0.25), ('conns', 0.25)),
rules AS (SELECT signal, avg(entropy) AS mean, stddev_pop(entropy) AS std FROM ent_w GROUP BY signal),
z AS (SELECT pod, k, weight, CASE WHEN std < 1e-9 THEN 0 ELSE abs(entropy - mean) / std END AS z FROM ent_hs JOIN rules USING (signal) JOIN weights USING (signal))
SELECT pod, k, {rnd('sum(weight * CASE WHEN z > 3 THEN 1.0 WHEN z > 2 THEN 0.75 WHEN z > 1 THEN 0.5 ELSE 0.0 END)')} AS score FROM z GROUP BY pod, k"""
)
def fft_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hopping windows of all rows by the spectral ruleset of the benign ones."""
    flows = read_flows(spark, sf_dir)
    rules = scoring.metric_rules(_benign_windows(flows), ["signal"], ["entropy"]).select("signal", "mean", "std")
    hopped = windows.hopping(flows, "pod", "seq")
    found = spectral.signal_metrics(signal_rows(hopped, ["pod", "k"]), ["pod", "k"])
    return rounded(scoring.window_scores(found, rules, ["pod", "k"]), "score")


# --- encoders ---------------------------------------------------------------------------

#: The categories of the flow view, for the SQL; the queries fit them.
_STATES = ["CL", "ER", "PU", "SI", "VI"]
_SERVICES = ["click", "purchase", "signup", "unknown", "view"]


def _hot_sql(column: str, of: str, values: list[str]) -> str:
    return ", ".join(f"CAST(coalesce({of}, 'unknown') = '{v}' AS INTEGER) AS {column}_{v}" for v in values)


def _number_sql(**columns: str) -> str:
    return ", ".join(f"CAST(({c}) IS NULL AS INTEGER) AS {name}_missing, {rnd(f'CAST(coalesce({c}, 0) AS DOUBLE)')} AS {name}" for name, c in columns.items())


def _flag_sql(**columns: str) -> str:
    return ", ".join(f"CAST(coalesce({c}, false) AS INTEGER) AS {name}" for name, c in columns.items())


def _typed_log(flows: DataFrame, kind: str) -> DataFrame:
    """The flow view as a typed log: flags are BOOLEAN, lists are arrays; flags of rows without a service are unset."""
    named = F.col("service").isNotNull()
    over = lambda n: F.when(named, F.col("orig_pkts") > n)
    who = ["seq", (F.col("ts_us") / 1e6).cast("decimal(16,6)").alias("ts"), F.col("seq").cast("string").alias("uid"), "orig_h", "orig_p", "resp_h", "resp_p"]
    if kind == "CONN":
        return flows.select(
            *who, "proto", "service", "conn_state", "duration", "orig_bytes", "resp_bytes", over(5).alias("local_orig"), over(30).alias("local_resp"), F.nullif("resp_pkts", F.lit(3)).alias("missed_bytes"),
            "orig_pkts", (F.col("orig_bytes") + 40 * F.col("orig_pkts")).alias("orig_ip_bytes"), "resp_pkts", (F.col("resp_bytes") + 40 * F.col("resp_pkts")).alias("resp_ip_bytes"), F.array("orig_h").alias("tunnel_parents"), F.col("conn_state").alias("history"),
        )
    if kind == "DNS":
        return flows.select(
            *who, "proto", F.col("seq").alias("trans_id"), F.col("duration").alias("rtt"), F.col("resp_h").alias("query"), F.nullif(F.col("resp_p"), F.lit(4)).cast("bigint").alias("qclass"), F.col("service").alias("qclass_name"),
            F.col("resp_bytes").alias("qtype"), F.col("conn_state").alias("qtype_name"), F.col("orig_bytes").alias("rcode"), F.col("service").alias("rcode_name"), *(over(n).alias(c) for c, n in (("AA", 5), ("TC", 10), ("RD", 20), ("RA", 30), ("rejected", 40))),
            F.col("resp_pkts").alias("Z"), F.when(named, F.array("orig_h", F.concat(F.lit("::"), F.col("resp_p").cast("string")), "orig_h")).alias("answers"), F.when(F.col("resp_bytes") > 50, F.array(F.col("resp_bytes").cast("double"), F.col("orig_p").cast("double"))).alias("TTLs"),
        )
    if kind == "SSL":
        return flows.select(*who, F.col("service").alias("version"), F.col("conn_state").alias("cipher"), F.col("proto").alias("curve"), F.col("resp_h").alias("server_name"), over(15).alias("resumed"), F.col("service").alias("next_protocol"), over(25).alias("established"), over(35).alias("sni_matches_cert"))
    return flows.select(*who, F.col("resp_pkts").alias("trans_depth"), F.col("conn_state").alias("method"), F.col("orig_h").alias("host"), F.col("service").alias("version"), F.col("orig_bytes").alias("request_body_len"), F.col("resp_bytes").alias("response_body_len"), F.array("proto").alias("proxied"))


_OVER = "CASE WHEN service IS NOT NULL THEN orig_pkts > {} END"


@query(
    f"""WITH {sql.FLOW} SELECT seq, CAST(coalesce(orig_bytes, 0) = 0 AND coalesce(resp_bytes, 0) = 0 AS INTEGER) AS zero_activity,
{_number_sql(duration='duration', orig_bytes='orig_bytes', resp_bytes='resp_bytes', missed_bytes='nullif(resp_pkts, 3)', orig_pkts='orig_pkts', orig_ip_bytes='orig_bytes + 40 * orig_pkts', resp_pkts='resp_pkts', resp_ip_bytes='resp_bytes + 40 * resp_pkts')},
{_flag_sql(local_orig=_OVER.format(5), local_resp=_OVER.format(30))},
{_hot_sql('proto', 'proto', ['tcp', 'udp'])}, {_hot_sql('service', 'service', _SERVICES)}, {_hot_sql('conn_state', 'conn_state', _STATES)} FROM f"""
)
def encode_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed_log(read_flows(spark, sf_dir), "CONN")
    return rounded(encode.encode_conn(rows, encode.fit_vocabulary(rows, "CONN"), activity=True), *encode.NUMBERS["CONN"])


@query(
    f"""WITH {sql.FLOW}, l AS (SELECT *, CASE WHEN service IS NOT NULL THEN [orig_h, '::' || resp_p, orig_h] ELSE [] END AS a, CASE WHEN resp_bytes > 50 THEN [CAST(resp_bytes AS DOUBLE), CAST(orig_p AS DOUBLE)] ELSE [] END AS t FROM f)
SELECT seq, {_number_sql(rtt='duration', qclass='nullif(resp_p, 4)', qtype='resp_bytes', rcode='orig_bytes', Z='resp_pkts')},
{_flag_sql(AA=_OVER.format(5), TC=_OVER.format(10), RD=_OVER.format(20), RA=_OVER.format(30), rejected=_OVER.format(40))},
CAST(len(a) AS INTEGER) AS answers_count, CAST(len(list_distinct(a)) AS INTEGER) AS answers_unique_count, CAST(len(a) > 0 AS INTEGER) AS answers_has_ipv6,
{rnd('coalesce(list_avg(t), 0)')} AS ttls_mean, {rnd('coalesce(list_stddev_pop(t), 0)')} AS ttls_std, CAST(len(t) AS INTEGER) AS ttls_count, CAST(len(a) <> len(t) AS INTEGER) AS answers_ttls_mismatch,
{_hot_sql('proto', 'proto', ['tcp', 'udp'])}, {_hot_sql('qclass_name', 'service', _SERVICES)}, {_hot_sql('qtype_name', 'conn_state', _STATES)}, {_hot_sql('rcode_name', 'service', _SERVICES)} FROM l"""
)
def encode_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed_log(read_flows(spark, sf_dir), "DNS")
    return rounded(encode.encode_dns(rows, encode.fit_vocabulary(rows, "DNS")), *encode.NUMBERS["DNS"], "ttls_mean", "ttls_std")


@query(
    f"""WITH {sql.FLOW} SELECT seq, {_flag_sql(resumed=_OVER.format(15), established=_OVER.format(25), sni_matches_cert=_OVER.format(35))},
{_hot_sql('version', 'service', _SERVICES)}, {_hot_sql('cipher', 'conn_state', _STATES)}, {_hot_sql('curve', 'proto', ['tcp', 'udp'])} FROM f"""
)
def encode_ssl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed_log(read_flows(spark, sf_dir), "SSL")
    return encode.encode_ssl(rows, encode.fit_vocabulary(rows, "SSL"))


@query(f"WITH {sql.FLOW} SELECT seq, resp_pkts AS trans_depth, orig_bytes AS request_body_len, resp_bytes AS response_body_len, proto AS proxied FROM f")
def encode_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode.encode_http(_typed_log(read_flows(spark, sf_dir), "HTTP"))
    return found.withColumn("proxied", F.array_join("proxied", ","))


_NUMERIC = "duration IS NOT NULL AND orig_bytes IS NOT NULL AND resp_bytes IS NOT NULL"


@query(f"WITH {sql.FLOW} SELECT seq, label FROM f WHERE {_NUMERIC}")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a model of whole transactions takes: none of their numbers is unset."""
    rows = logs.without_unset(logs.without_nulls(read_flows(spark, sf_dir).withColumn("ts", F.col("ts_us")), "CONN", complete=True), "CONN")
    return rows.select("seq", "label")


_DECLARED = ["orig_p", "resp_p", "duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]


@query(
    f"WITH {sql.FLOW}, c AS (SELECT *, nullif(resp_pkts, 3) AS missed_bytes, orig_bytes + 40 * orig_pkts AS orig_ip_bytes, resp_bytes + 40 * resp_pkts AS resp_ip_bytes FROM f) "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS known, {rnd(f'CAST(sum({c}) AS DOUBLE)')} AS total FROM c" for c in _DECLARED)
)
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of every number that a connection log declares (its time stamp left out)."""
    names = logs.numeric_columns("CONN", without=("ts",))
    rows = _typed_log(read_flows(spark, sf_dir), "CONN")
    sums = rows.agg(*(F.count(c).alias(f"{c}_known") for c in names), *(F.sum(c).cast("double").alias(f"{c}_total") for c in names))
    return rounded(sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"{c}_known").alias("known"), F.col(f"{c}_total").alias("total")) for c in names))).alias("r")).select("r.*"), "total")


#: Words of more than three characters stand for answers with a time to live.
_TTL = "list_transform(list_filter(string_split(text, ' '), lambda x: length(x) > 3), lambda x: CAST(length(x) AS DOUBLE))"


@query(
    f"""SELECT doc_id, CAST(len(a) AS BIGINT) AS answers_count, CAST(len(list_distinct(a)) AS BIGINT) AS answers_unique, CAST(len(list_filter(a, lambda x: contains(x, ':'))) > 0 AS INTEGER) AS has_ipv6,
{rnd('coalesce(list_avg(t), 0)')} AS ttl_mean, {rnd('coalesce(list_stddev_pop(t), 0)')} AS ttl_std, CAST(len(t) AS BIGINT) AS ttl_count, CAST(len(a) <> len(t) AS INTEGER) AS answer_ttl_mismatch
FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, ' ') END AS a, CASE WHEN text IS NULL THEN [] ELSE {_TTL} END AS t FROM documents)"""
)
def list_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List columns as a DNS encoder sees them: words as answers, lengths of the longer ones as TTLs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", " "))
    answers = docs.select("doc_id", words.alias("a"), F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.length(w).cast("string")).alias("t"))
    stats = expr.list_stats(F.col("t"))
    found = answers.select(
        "doc_id",
        F.size("a").cast("bigint").alias("answers_count"),
        F.size(F.array_distinct("a")).cast("bigint").alias("answers_unique"),
        F.exists("a", lambda x: F.contains(x, F.lit(":"))).cast("int").alias("has_ipv6"),
        stats["mean"].alias("ttl_mean"),
        stats["std"].alias("ttl_std"),
        stats["count"].cast("bigint").alias("ttl_count"),
        (F.size("a") != F.size("t")).cast("int").alias("answer_ttl_mismatch"),
    )
    return rounded(found, "ttl_mean", "ttl_std")


# --- composition -----------------------------------------------------------------------


def _hash_sql(seed: int) -> str:
    return f"((((seq % 2147483647) * 1103515245 + {12345 + 7919 * seed}) % 2147483647) * 48271 + {seed}) % 2147483647"


def _sample_sql(source: str, n: str, seed: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_hash_sql(seed)}, seq) AS r FROM {source}) WHERE r <= {n})"


_SPLIT = f"{sql.FLOW}, b AS (SELECT * FROM f WHERE label = 0), a AS (SELECT * FROM f WHERE label = 1)"


def _share_sql(source: str, share: float, seed: int) -> str:
    return _sample_sql(source, f"(SELECT floor({share} * count(*)) FROM {source})", seed)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flows = read_flows(spark, sf_dir)
    return flows.where("label = 0"), flows.where("label = 1")


@query(f"WITH {_SPLIT} SELECT 0 AS segment, seq, label FROM {_share_sql('b', 0.5, 1)} UNION ALL SELECT 1, seq, label FROM a")
def mix_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_a(*_split(spark, sf_dir), "seq").select("segment", "seq", "label")


@query(f"WITH {_SPLIT} SELECT 0 AS segment, seq, label FROM a UNION ALL SELECT 1, seq, label FROM {_share_sql('b', 0.5, 1)}")
def mix_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_b(*_split(spark, sf_dir), "seq").select("segment", "seq", "label")


@query(f"WITH {_SPLIT} SELECT {_hash_sql(2)} AS rank_key, seq, label FROM (SELECT * FROM {_share_sql('a', 0.3, 1)} UNION ALL SELECT * FROM {_share_sql('b', 0.7, 1)})")
def mix_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_c(*_split(spark, sf_dir), "seq").select("rank_key", "seq", "label")


@query(f"WITH {_SPLIT}, s AS (SELECT 0 AS segment, * FROM b UNION ALL SELECT 1, * FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY seq) AS rn FROM s) SELECT CAST((rn - 1) // 500 AS BIGINT) AS block, segment, CAST(rn AS BIGINT) AS rn, seq FROM r")
def mix_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_d(*_split(spark, sf_dir), "seq").select("block", "segment", "rn", "seq")


@query(f"WITH {_SPLIT} SELECT 0 AS segment, seq FROM {_sample_sql('b', '300', 10)} UNION ALL SELECT 1, seq FROM {_sample_sql('f', '200', 11)} UNION ALL SELECT 2, seq FROM {_sample_sql('b', '300', 12)}")
def mix_bmb(spark: SparkSession, sf_dir: str) -> DataFrame:
    benign, _ = _split(spark, sf_dir)
    return mix.mix_bmb(benign, read_flows(spark, sf_dir), "seq").select("segment", "seq")


@query("SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return mix.union_by_name(customers, suppliers)


@query(f"WITH {_SPLIT} SELECT avg(label) AS contamination, count(*) AS n FROM f")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_flows(spark, sf_dir).agg(F.avg("label").alias("contamination"), F.count("*").alias("n"))


# --- log lines: fields, tags, quarantine, repair ------------------------------------------

_LINE = "concat_ws(chr(9), CAST(1700000000 + seq AS VARCHAR) || CASE WHEN seq % 97 = 0 THEN '.00' ELSE '.000000' END, 'C' || lpad(CAST(seq AS VARCHAR), CASE WHEN seq % 89 = 0 THEN 9 ELSE 16 END, '0'), orig_h, CAST(orig_p AS VARCHAR), CASE WHEN seq % 83 = 0 THEN '' ELSE resp_h END, proto)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view as log lines of six fields; a few have a short time stamp or uid, or an empty field."""
    seq = F.col("seq")
    ts = F.concat((seq + 1700000000).cast("string"), F.when(seq % 97 == 0, ".00").otherwise(".000000"))
    uid = F.concat(F.lit("C"), F.when(seq % 89 == 0, F.lpad(seq.cast("string"), 9, "0")).otherwise(F.lpad(seq.cast("string"), 16, "0")))
    fields = F.array(ts, uid, F.col("orig_h"), F.col("orig_p").cast("string"), F.when(seq % 83 == 0, "").otherwise(F.col("resp_h")), F.col("proto"))
    return read_flows(spark, sf_dir).select("pod", seq.alias("pos"), logs.logify(fields).alias("value"))


_LINES = f"{sql.FLOW}, l AS (SELECT pod, seq AS pos, {_LINE} AS value FROM f)"


@query(f"WITH {_LINES} SELECT pos, CAST(len(t) AS BIGINT) AS n, t[2] AS uid, t[-1] AS last FROM (SELECT pos, list_filter(string_split(value, chr(9)), lambda x: x <> '') AS t FROM l)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with runs of separators taken as one."""
    parts = _lines(spark, sf_dir).select("pos", logs.tokens(F.col("value"), collapse=True).alias("t"))
    return parts.select("pos", F.size("t").cast("bigint").alias("n"), F.get("t", F.lit(1)).alias("uid"), F.element_at("t", -1).alias("last"))


@query(f"WITH {_LINES} SELECT pos, 'CONN,' || replace(value, chr(9), ',') AS line FROM l")
def csvify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("pos", logs.csvify(logs.tokens(F.col("value")), "CONN").alias("line"))


@query(f"WITH {_LINES} SELECT pos, 'DNS' AS tag, value AS line FROM l")
def logify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged CSV lines back into log lines, whatever the tag's length."""
    tagged = _lines(spark, sf_dir).select("pos", logs.csvify(logs.tokens(F.col("value")), "DNS").alias("line"))
    tag, parts = logs.untag(F.col("line"))
    return tagged.select("pos", tag.alias("tag"), logs.logify(parts).alias("line"))


@query(f"WITH {_LINES} SELECT pos, value FROM (SELECT *, list_filter(string_split(value, chr(9)), lambda x: x <> '') AS t FROM l) WHERE len(t) <> 6 OR length(t[1]) <> 17 OR length(t[2]) < 15")
def corrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(logs.is_corrupt(logs.tokens(F.col("value"), collapse=True), 6)).select("pos", "value")


@query(
    f"""WITH {_LINES}, p AS (SELECT CAST(pod AS VARCHAR) AS file, pos, value, lag(value) OVER (PARTITION BY pod ORDER BY pos) AS prev FROM l)
SELECT file, pos, CASE WHEN pos % 3 = 0 AND pos % 200 <> 0 THEN NULL ELSE value END AS repaired FROM p WHERE pos % 100 = 0 AND prev IS NOT NULL"""
)
def repair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth line cut after 20 characters (some garbled) and found again in the log."""
    lines = _lines(spark, sf_dir).select(F.col("pod").cast("string").alias("file"), "pos", "value")
    cut = windows.lag_rows(lines, "file", "pos", ["value"]).where("pos % 100 = 0 and prev_value is not null")
    garbled = (F.col("pos") % 3 == 0) & (F.col("pos") % 200 != 0)
    fragments = cut.select("file", F.col("pos").alias("at"), F.col("prev_value").alias("prev"), F.when(garbled, "?").otherwise(F.substring("value", 1, 20)).alias("fragment"))
    return logs.repair_lines(fragments, lines).select("file", F.col("at").alias("pos"), "repaired")


@query(f"WITH {sql.FLOW} SELECT a.seq, CAST(b.ts_us - a.ts_us AS BIGINT) AS latency_us FROM f a JOIN f b ON b.seq = a.seq + 7")
def latency_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a row and its output, matched by key (here the row seven later)."""
    seen = read_flows(spark, sf_dir).select("seq", F.col("ts_us").alias("seen"))
    out = read_flows(spark, sf_dir).select((F.col("seq") - 7).alias("seq"), F.col("ts_us").alias("out"))
    return seen.join(out, "seq").select("seq", (F.col("out") - F.col("seen")).alias("latency_us"))


@query(f"WITH {sql.FLOW}, l AS (SELECT a.pod, a.seq, b.ts_us - a.ts_us AS x FROM f a JOIN f b ON b.seq = a.seq + 7) SELECT seq, CAST(count(*) OVER w AS BIGINT) AS n, {rnd('avg(x) OVER w')} AS mean_us, {rnd('stddev_pop(x) OVER w', 1)} AS std_us FROM l WINDOW w AS (PARTITION BY pod ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def running_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and deviation of the latencies up to each row."""
    rows = latency_join(spark, sf_dir).join(read_flows(spark, sf_dir).select("seq", "pod"), "seq")
    found = profile.running_moments(rows, "pod", "seq", "latency_us")
    return found.select("seq", "n", expr.rounded(F.col("mean")).alias("mean_us"), expr.rounded(F.col("std"), 1).alias("std_us"))


# --- reports ------------------------------------------------------------------------------


@query(f"WITH {sql.FLOW}, m AS (SELECT 'port_' || resp_p AS metric, pod, count(*) AS n FROM f GROUP BY 1, 2) SELECT metric, " + ", ".join(f"coalesce(CAST(max(n) FILTER (WHERE pod = {p}) AS VARCHAR), '-1') AS \"{p}\"" for p in range(5)) + " FROM m GROUP BY metric")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per metric (rows of a port) and a column per data set; -1 where a data set lacks it."""
    counts = read_flows(spark, sf_dir).groupBy(F.concat(F.lit("port_"), F.col("resp_p").cast("string")).alias("metric"), F.col("pod").cast("string").alias("dataset")).agg(F.count("*").alias("n"))
    return report.metric_matrix(counts, "metric", "dataset", "n", [str(p) for p in range(5)])


@query(f"WITH {sql.FLOW} SELECT DISTINCT name FROM (SELECT service AS name FROM f UNION ALL SELECT conn_state FROM f) WHERE name IS NOT NULL")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that any of several reports has."""
    flows = read_flows(spark, sf_dir)
    return report.all_names(flows.select(F.col("service").alias("name")), flows.select(F.col("conn_state").alias("name")))


@query(f"WITH {sql.FLOW} SELECT CAST(CASE WHEN duration < 0 THEN 0 WHEN duration >= 40 THEN 21 ELSE floor(duration / 2.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM f WHERE duration IS NOT NULL GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(read_flows(spark, sf_dir).where("duration is not null"), F.col("duration"), 0.0, 40.0, 20)


@query(f"WITH {sql.FLOW} SELECT seq, proto, CAST(orig_pkts >= 50 AS INTEGER) AS is_alert, '{{\"seq\":' || seq || ',\"proto\":\"' || proto || '\"}}' AS json FROM f")
def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.alert_json(read_flows(spark, sf_dir), ["seq", "proto"], F.col("orig_pkts") >= 50)


# --- models ----------------------------------------------------------------------------

_COV = ["orig_p", "orig_pkts", "resp_pkts"]


@query(
    f"WITH {sql.FLOW} SELECT pod, "
    + ", ".join(f"{rnd(f'covar_pop({a}, {b})')} AS cov_{a}_{b}" for i, a in enumerate(_COV) for b in _COV[i:])
    + " FROM f GROUP BY pod"
)
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(_COV) for b in _COV[i:]]
    found = read_flows(spark, sf_dir).groupBy("pod").agg(*(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov_{a}_{b}") for a, b in pairs))
    return rounded(found, *_doubles(found))


from netweave.plans import files as _file_queries  # noqa: E402
from netweave.plans import models as _model_queries  # noqa: E402
from netweave.plans import streams as _stream_queries  # noqa: E402

for _more in (_file_queries, _model_queries, _stream_queries):
    QUERIES |= _more.QUERIES
    ORACLE |= _more.ORACLE
