"""Statistical profiles of flow logs: frequencies, rates, class-conditional quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.expr import guarded_ratio, safe_rate, traffic_class, variation
from netweave.operators.windows import SPAN_ROWS, join_on, lag_rows, number_rows
from netweave.sources.shared import shared_folder

#: The quantiles of a profile, and of a description.
PROFILE_QUANTILES = (0.01, 0.05, 0.5, 0.95, 0.99)
DESCRIBE_QUANTILES = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def quantiles(c: Column, at: tuple[float, ...], accuracy: int | None = None) -> Column:
    """Exact quantiles with linear interpolation, from all distinct values of a group in one task; with ``accuracy`` a bounded sketch instead."""
    points = F.array(*(F.lit(p) for p in at))
    return F.percentile_approx(c, list(at), accuracy) if accuracy else F.percentile(c, points)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, as SQL engines with fused multiplication interpolate: a value that is the quantile is not beyond it.

    The errors of the product and of the sum are found exactly (Dekker, Knuth) and added last.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
        return high, x - high

    (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
    missed = a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2)
    s = p + c
    c1 = s - p
    fixed = s + (((p - (s - c1)) + (c - c1)) + missed)
    return F.when(F.abs(fixed) < F.lit(math.inf), fixed).otherwise(s)  # beyond some 1e300 the halves overflow


def _ranked(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], parts: int) -> DataFrame:
    """(``_k``: struct of the keys, n, q); keys are compared inside a struct, as null is a key too."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    folder = shared_folder(df.sparkSession, "quantiles")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        """Written once and read by every branch below, so the input is read once."""
        rows.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    counts = stored(df.where(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "counts")
    cuts = counts.groupBy("_k").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
    # The range of a value: how many splitters lie below it (one row of splitters per key).
    below = lambda at, step: F.when((at + step <= F.size("cuts")) & (F.get("cuts", at + step - 1) < F.col("v")), at + step).otherwise(at)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(parts.bit_length()))))  # a binary search
    cut = stored(counts.join(cuts, "_k").withColumn("part", F.aggregate(steps, F.lit(0), below)).drop("cuts"), "cut")
    per_part = cut.groupBy("_k", "part").agg(F.sum("c").alias("own"))
    per_key = Window.partitionBy("_k")
    placed = per_part.select("_k", "part", (F.sum("own").over(per_key.orderBy("part")) - F.col("own")).alias("before"), "own", F.sum("own").over(per_key).alias("n"))
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("rank")) for i, p in enumerate(at))))
    wanted = placed.select("_k", "part", "before", "own", "n", ranks.alias("w")).select("_k", "part", "before", "own", "n", "w.i", "w.rank", F.explode(F.array_distinct(F.array(F.floor("w.rank"), F.ceil("w.rank")))).alias("at"))
    wanted = wanted.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("own"))).drop("own")
    inside = Window.partitionBy("_k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = cut.join(wanted.select("_k", "part").distinct(), ["_k", "part"], "left_semi").withColumn("upto", F.sum("c").over(inside))
    hit = upto.join(wanted, ["_k", "part"]).where((F.col("at") - F.col("before") >= F.col("upto") - F.col("c")) & (F.col("at") - F.col("before") < F.col("upto")))
    ends = hit.groupBy("_k", "i").agg(F.first("n").alias("n"), F.first("rank").alias("rank"), F.min("v").alias("low"), F.max("v").alias("high"))
    part = F.col("rank") - F.floor("rank")
    between = fused(F.col("low"), F.lit(1.0) - part, F.col("high") * part)
    each = ends.withColumn("q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between))
    return each.groupBy("_k").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def spread_quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], parts: int = 256) -> DataFrame:
    """(keys, n, q): exact quantiles without any task that sees all values of a key.

    Rows are counted per key and value first, so a common value is one row.  A
    sketch of the distinct values gives splitters per key; counts between
    splitters say in which ranges the wanted ranks lie, and only the values of
    those ranges get running counts.
    """
    found = _ranked(df, keys, value, at, parts)
    return found.select("_k.*", "n", "q") if keys else found.select("n", "q")


def with_quantiles(stats: DataFrame, df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], name: str = "q") -> DataFrame:
    """Add exact quantiles of ``value`` in ``df`` to ``stats``, one row per key; null where a key has no values."""
    found = _ranked(df, keys, value, at, 256).select("_k", F.col("q").alias(name))
    return stats.withColumn("_k", F.struct(*keys)).join(found, "_k", "left").drop("_k")


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value (or tuple of values)."""
    return df.groupBy(*columns).agg(F.count("*").alias("cnt"))


def relative_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, cnt, share) without nulls; the total comes from the counts, not the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "cnt", (F.col("cnt") / F.col("total")).alias("share"))  # one row


def moments(c: Column, name: str) -> list[Column]:
    """Mean, sample deviation and coefficient of variation."""
    mean, deviation = F.avg(c), F.stddev_samp(c)
    return [mean.alias(f"{name}_mean"), deviation.alias(f"{name}_std"), variation(mean, deviation).alias(f"{name}_cv")]


def interarrival(df: DataFrame, key: str, ts: str, order: str | None = None) -> DataFrame:
    """Time since the row before, per key, by ``ts`` (logs are not in its order); ``order`` tells rows of one time apart.

    The first row of a key has none.
    """
    return lag_rows(df, key, [ts, order] if order else ts, [ts]).withColumn("gap", F.col(ts) - F.col(f"prev_{ts}"))


def running_moments(df: DataFrame, key: str, order: str, value: str, span: int = SPAN_ROWS) -> DataFrame:
    """Add n, mean and std (population) of ``value`` over the rows of a key up to each row; nulls are left out.

    Sums inside spans of rows are added to those of the spans before, so no
    task holds all rows of a key.  They are taken around the overall mean;
    deviations some seven orders of magnitude below it lose their digits.
    """
    x = F.col(value).cast("double")
    numbered = number_rows(df, key, order).withColumn("__block", F.floor((F.col("rn") - 1) / span))
    centre = df.agg(F.avg(x)).first()[0] or 0.0  # sums around the middle keep their digits
    sums = {"__n": F.count(x), "__s": F.sum(x - centre), "__q": F.sum((x - centre) * (x - centre))}
    per_block = numbered.groupBy(key, "__block").agg(*(c.alias(name) for name, c in sums.items()))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select(key, "__block", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}0") for name in sums))
    inside = Window.partitionBy(key, "__block").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = join_on(numbered, before, [key, "__block"])
    both = both.withColumns({name: F.coalesce(c.over(inside), F.lit(0)) + F.col(f"{name}0") for name, c in sums.items()})
    mean = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))
    std = F.when(F.col("__n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__n") - mean * mean)))
    return both.withColumns({"n": F.col("__n"), "mean": mean + centre, "std": std}).drop("rn", "total", "__block", *sums, *(f"{name}0" for name in sums))


def totals(df: DataFrame, orig: str, resp: str, keys: list[str]) -> DataFrame:
    o, r = F.sum(orig), F.sum(resp)
    return df.groupBy(*keys).agg(o.alias("orig_total"), r.alias("resp_total"), guarded_ratio(o, r).alias("ratio"))


def class_profiles(df: DataFrame, values: dict[str, tuple[Column, str, str]], keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Seven statistics per ``metric`` (a name in ``values``: value, orig, resp) and traffic class; -1 where a class has no values.

    Every class gets a row, so a scorer can tell an unseen class.
    """
    metrics = F.explode(F.array(*(F.lit(m) for m in values))).alias("metric")
    classes = F.explode(F.array(F.lit("both"), F.lit("orig"), F.lit("resp"))).alias("cls")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), traffic_class(F.col(o), F.col(r)).alias("cls"), v.cast("double").alias("v")) for m, (v, o, r) in values.items()))
    kept = df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("cls in ('both', 'orig', 'resp') and v is not null")
    by = [*keys, "metric", "cls"]
    columns = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std")]
    if accuracy:
        stats = kept.groupBy(*by).agg(*columns, quantiles(F.col("v"), PROFILE_QUANTILES, accuracy).alias("q"))
    else:
        stats = with_quantiles(kept.groupBy(*by).agg(*columns), kept, by, "v", PROFILE_QUANTILES)
    every = df.select(*keys).distinct().select(*keys, metrics).select(*keys, "metric", classes)
    none = F.lit(-1.0)
    named = [F.coalesce(F.get("q", F.lit(i)), none).alias(f"p{int(100 * p):02d}") for i, p in enumerate(PROFILE_QUANTILES)]
    return join_on(every, stats, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", none).alias("mean"), F.coalesce("std", none).alias("std"), *named)


def class_profile(df: DataFrame, value: Column, orig: str, resp: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Seven statistics of ``value`` per traffic class; -1 where a class has no values."""
    return class_profiles(df, {"": (value, orig, resp)}, keys, accuracy).drop("metric")


def volume(orig: str, resp: str) -> Column:
    """What a class profile of a volume looks at: the ratio for two-sided flows, else the side that sent."""
    o, r = F.col(orig), F.col(resp)
    return F.when((o > 0) & (r > 0), guarded_ratio(o, r)).when((o > 0) & (r == 0), o).when((r > 0) & (o == 0), r)


def rate(orig: str, resp: str, duration: str) -> Column:
    """Amount per second where it is positive."""
    v = safe_rate(F.col(orig) + F.col(resp), F.col(duration))
    return F.when((v > 0) & ~F.isnan(v), v)


def per_second(df: DataFrame, ts_us: str, keys: list[str], **sums: Column) -> DataFrame:
    """Sums per key and second; seconds without rows are left out."""
    second = F.floor(F.col(ts_us) / 1_000_000).cast("long").alias("sec")
    return df.groupBy(*keys, second).agg(*(F.sum(c).alias(name) for name, c in sums.items()), F.count("*").alias("conns"))


def filled_hours(series: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, hour, seconds, sums of ``values``): the filled series by hour, without a row per missing second.

    A row stands for its second and the missing ones before it; a gap makes a
    row for each hour it touches.
    """
    before = lag_rows(series.withColumn("__keys", F.struct(*keys)), "__keys", "sec", ["sec"])
    first = F.coalesce(F.col("prev_sec") + 1, F.col("sec"))
    hour = lambda sec: F.floor(sec / 3600)
    each = before.withColumn("__first", first).withColumn("hour", F.explode(F.sequence(hour(F.col("__first")), hour(F.col("sec")))))
    seconds = F.least(F.col("sec"), F.col("hour") * 3600 + 3599) - F.greatest("__first", F.col("hour") * 3600) + 1
    here = F.col("hour") == hour(F.col("sec"))
    return each.groupBy(*keys, "hour").agg(F.sum(seconds).alias("seconds"), *(F.sum(F.when(here, F.col(v)).otherwise(0)).alias(v) for v in values))


def flag_ratio(df: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Share of rows with the flag among those where it is known."""
    return df.groupBy(*keys).agg(F.count(flag).alias("known"), F.sum(flag.cast("long")).alias("flagged"), F.avg(flag.cast("double")).alias("ratio"))


def describe(df: DataFrame, score: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, population deviation and eleven quantiles of a score."""
    columns = [F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")]
    if accuracy:
        out = df.groupBy(*keys).agg(*columns, quantiles(F.col(score), DESCRIBE_QUANTILES, accuracy).alias("_q"))
    else:
        out = with_quantiles(df.groupBy(*keys).agg(*columns), df, keys, score, DESCRIBE_QUANTILES, "_q")
    return out.select(*keys, "n", "mean", "std", *(F.get("_q", F.lit(i)).alias(f"q{round(100 * p):03d}") for i, p in enumerate(DESCRIBE_QUANTILES)))


def conn_profile(df: DataFrame, key: str = "pod") -> DataFrame:
    """Long (key, section, item, value): what a ruleset of connection logs holds."""
    k = [key]
    parts = [
        with_quantiles(df.groupBy(key).agg(*moments(F.col("duration"), "x")), df, k, "duration", PROFILE_QUANTILES).select(key, F.lit("duration").alias("section"), F.explode(F.map_from_arrays(F.array(*(F.lit(x) for x in ("mean", "std", "cv", "p01", "p05", "p50", "p95", "p99"))), F.concat(F.array("x_mean", "x_std", "x_cv"), "q"))).alias("item", "value")),
        *(totals(df, f"orig_{u}", f"resp_{u}", k).select(key, F.lit(f"{u}_totals").alias("section"), F.lit("ratio").alias("item"), F.col("ratio").alias("value")) for u in ("bytes", "pkts")),
    ]
    for column in ("proto", "service", "conn_state"):
        counts = df.where(F.col(column).isNotNull()).groupBy(key, F.col(column).alias("item")).agg(F.count("*").alias("cnt"))
        all_ = df.where(F.col(column).isNotNull()).groupBy(key).agg(F.count("*").alias("total"))
        parts.append(join_on(counts, all_, [key]).select(key, F.lit(column).alias("section"), "item", (F.col("cnt") / F.col("total")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a profile of each log type looks at (numbers, categories, flags).
PROFILED = {
    "CONN": (("duration",), ("proto", "service", "conn_state"), ()),
    "DNS": (("rtt",), ("query", "qclass_name", "qtype_name", "rcode_name"), ("rejected",)),
    "SSL": ((), ("version", "cipher", "curve", "server_name"), ("established",)),
    "HTTP": (("trans_depth",), ("host", "uri", "user_agent"), ()),
}


def log_profile(df: DataFrame, key: str, numbers: tuple[str, ...] = (), categories: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Long (key, section, item, value): moments of numbers, shares of categories and of flags, nulls left out.

    ``log_profile(rows, "pod", *PROFILED["DNS"])`` profiles DNS logs.  All
    numbers and flags come from one pass; all categories from one more, over
    rows pre-aggregated by value.
    """
    out = []
    single = {(n, stat): made for n in numbers for stat, made in (("mean", F.avg(n)), ("std", F.stddev_samp(n)), ("cv", variation(F.avg(n), F.stddev_samp(n))))}
    single |= {(f, "ratio"): F.avg(F.col(f).cast("double")) for f in flags}
    if single:
        names = list(single)
        made = df.groupBy(key).agg(*(c.alias(f"_{i}") for i, c in enumerate(single.values())))
        items = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(t).alias("item"), F.col(f"_{i}").cast("double").alias("value")) for i, (s, t) in enumerate(names)))
        out.append(made.select(key, F.explode(items).alias("x")).select(key, "x.section", "x.item", "x.value"))
    if categories:
        pairs = F.array(*(F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("item")) for c in categories))
        counts = df.select(key, F.explode(pairs).alias("x")).where("x.item is not null").groupBy(key, "x.section", "x.item").agg(F.count("*").alias("cnt"))
        total = counts.groupBy(key, "section").agg(F.sum("cnt").alias("total"))
        out.append(join_on(counts, total, [key, "section"]).select(key, "section", "item", (F.col("cnt") / F.col("total")).alias("value")))
    found = out[0]
    for p in out[1:]:
        found = found.unionByName(p)
    return found
