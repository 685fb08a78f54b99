"""Ruleset scoring of rows and windows, alerts and detection rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.expr import band, guarded_ratio, traffic_class, z_band
from netweave.operators.profile import PROFILE_QUANTILES, rate, spread_quantiles, volume
from netweave.operators.windows import join_on

#: The parts of a row score and of a spectral window score.
ROW_WEIGHTS = {"dur": 0.1, "vol": 0.1, "pkt": 0.1, "bps": 0.35, "pps": 0.35}
WINDOW_WEIGHTS = {"ts": 0.4, "bytes": 0.1, "pkts": 0.25, "conns": 0.25}
ALERT = 0.5
_Q = ("p01", "p05", "p95", "p99")


def build_ruleset(df: DataFrame, keys: list[str], pps_numerator: str = "pkts") -> DataFrame:
    """One row per key: quantiles of duration and of each class of volume and rate, all in one pass over ``df``.

    ``pps_numerator='bytes'`` rates bytes in the packet part as well.  A class
    without data has -1 everywhere, so that a row of an unseen class scores 1.
    """
    profiles = {
        "vol": (volume("orig_bytes", "resp_bytes"), "orig_bytes", "resp_bytes"),
        "pkt": (volume("orig_pkts", "resp_pkts"), "orig_pkts", "resp_pkts"),
        "bps": (rate("orig_bytes", "resp_bytes", "duration"), "orig_bytes", "resp_bytes"),
        "pps": (rate(f"orig_{pps_numerator}", f"resp_{pps_numerator}", "duration"), f"orig_{pps_numerator}", f"resp_{pps_numerator}"),
    }
    value = lambda metric, cls, v: F.struct(F.lit(metric).alias("metric"), cls.alias("cls"), v.cast("double").alias("v"))
    # A value of its own tells that a key has rows.
    every = F.array(value("key", F.lit("all"), F.lit(0)), value("dur", F.lit("all"), F.col("duration")), *(value(m, traffic_class(F.col(o), F.col(r)), v) for m, (v, o, r) in profiles.items()))
    long = df.select(*keys, F.explode(every).alias("x")).select(*keys, "x.*").where("cls in ('all', 'both', 'orig', 'resp')")
    found = spread_quantiles(long, [*keys, "metric", "cls"], "v", PROFILE_QUANTILES)
    place = {p: PROFILE_QUANTILES.index(int(p[1:]) / 100) for p in _Q}
    one = lambda name, c, p: F.max(F.when((F.col("metric") == name) & (F.col("cls") == c), F.get("q", F.lit(place[p]))))
    durations = [one("dur", "all", p).alias(f"dur_{p}") for p in _Q]
    classes = [F.coalesce(one(name, c, p), F.lit(-1.0)).alias(f"{name}_{c}_{p}") for name in profiles for c in ("both", "orig", "resp") for p in _Q]
    return found.groupBy(*keys).agg(*durations, *classes)


def _class_band(name: str, value, cls):
    parts = F.lit(0.0)
    for c in ("both", "orig", "resp"):
        parts = F.when(cls == c, band(value, *(F.col(f"{name}_{c}_{p}") for p in _Q))).otherwise(parts)
    return parts


def rule_scores(rows: DataFrame, ruleset: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Add the five parts of the row score and ``score``.

    ``ruleset`` has one row (or one per key of ``on``): one row per data set,
    so it is broadcast (a handful: without ``on`` every row is scored by each).
    Rows of a key without a ruleset get no score and are left out.  Unknown
    amounts count as 0; rates count only where time has passed.
    """
    n = {c: F.coalesce(c, F.lit(0)) for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration")}
    joined = join_on(rows, F.broadcast(ruleset), on) if on else rows.crossJoin(F.broadcast(ruleset))
    bytes_cls, pkts_cls = traffic_class(n["orig_bytes"], n["resp_bytes"]), traffic_class(n["orig_pkts"], n["resp_pkts"])
    amount = lambda cls, o, r: F.when(cls == "both", guarded_ratio(o, r)).when(cls == "orig", o).otherwise(r)
    timed = lambda name, cls, o, r: F.when(n["duration"] > 0, _class_band(name, (o + r) / n["duration"], cls)).otherwise(0.0)
    parts = {
        "dur": band(n["duration"], *(F.col(f"dur_{p}") for p in _Q)),
        "vol": _class_band("vol", amount(bytes_cls, n["orig_bytes"], n["resp_bytes"]), bytes_cls),
        "pkt": _class_band("pkt", amount(pkts_cls, n["orig_pkts"], n["resp_pkts"]), pkts_cls),
        "bps": timed("bps", bytes_cls, n["orig_bytes"], n["resp_bytes"]),
        "pps": timed("pps", pkts_cls, n["orig_pkts"], n["resp_pkts"]),
    }
    scored = joined.withColumns({f"{k}_part": v for k, v in parts.items()})
    total = sum((F.lit(w) * F.col(f"{k}_part") for k, w in ROW_WEIGHTS.items()), F.lit(0.0))
    extra = [c for c in ruleset.columns if c not in rows.columns and c not in (on or [])]
    return scored.withColumn("score", total).drop(*(c for c in extra if "_p" in c and c.split("_")[0] in parts))


def alerts(scored: DataFrame, score: str = "score", least: float = ALERT) -> DataFrame:
    return scored.where(F.col(score) >= least)


def detection_rates(scored: DataFrame, keys: list[str], score: str = "score", least: float = ALERT) -> DataFrame:
    """Rows, flagged rows and their share per data set (a detection or false-positive rate)."""
    hit = F.col(score) >= least
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("flagged"), F.avg(hit.cast("double")).alias("rate"))


def metric_values(found: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, v): each metric's value of each window of a baseline, as rows."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))
    return found.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def metric_rules(found: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, n, mean, std, least, most): number, mean, population deviation and ends of each metric's values."""
    values = metric_values(found, keys, metrics).groupBy(*keys, "metric")
    return values.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def window_scores(features: DataFrame, ruleset: DataFrame, keys: list[str]) -> DataFrame:
    """Score windows by how far the entropy of each signal is from the ruleset's.

    ``features``: keys, signal, entropy; ``ruleset``: signal, mean, std (four rows).
    """
    banded = features.join(F.broadcast(ruleset), "signal").withColumn("part", z_band(F.col("entropy"), F.col("mean"), F.col("std")))
    weigh = F.lit(0.0)
    for signal, w in WINDOW_WEIGHTS.items():
        weigh = F.when(F.col("signal") == signal, w).otherwise(weigh)
    return banded.groupBy(*keys).agg(F.sum(weigh * F.col("part")).alias("score"))


def known(rows: DataFrame, members: DataFrame, on: list[str], unknown: bool = False) -> DataFrame:
    """Rows whose key is (or is not) a known one."""
    return rows.join(members, on, "left_anti" if unknown else "left_semi")
