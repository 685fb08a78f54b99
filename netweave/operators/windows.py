"""Positional windows that hold up when one key has a large part of all rows.

A plain ``row_number() over (partition by key order by seq)`` puts a key into
one task.  Here the order column is cut into spans of about as many rows each,
by splitters from a quantile sketch, however dense or sparse its values are;
rows are numbered inside (key, span), and the counts of the spans before are
added.  Only span counts, one row per key and span, are ordered per key.

A value, null included, that has more rows than a span is divided further: by
the next order column in the same way, and where all order columns are equal,
so that any numbering is right, by a hash of the row.

Every row stays: null is a key like any other, and rows without an order value
come last in their key.  Rows with equal order values are numbered in no
particular order; give further columns to tell them apart.  An order column is
a number or a time: others are numbered rightly, but in one span.  Columns that
a function adds replace columns of the same name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, about, that one task numbers at a time, the most spans, and the most parts by a further column of one value; they change the work, not the result.
SPAN_ROWS, MOST_SPANS, MOST_PARTS = 1 << 16, 4096, 256

_KEY, _SPAN, _AT, _HASH = "__key", "__span", "__at", "__hash"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null matches null; the keys come from ``left``."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(Column.__and__, (left[k].eqNullSafe(named[f"__right_{k}"]) for k in keys))
    return left.join(named, same, how).drop(*(f"__right_{k}" for k in keys))


def _columns(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _cuts(grid: list[float] | None, n: int, known: int, rows: int, most: int) -> tuple[list[float], dict[int, int]]:
    """Splitters for spans of about ``rows`` rows, and the buckets of one value that are heavier, with their number of spans.

    Bucket i holds values from splitter i - 1 up to, not including, splitter i;
    the one after the last holds what has no value.
    """
    spans = min(most, math.ceil(n / rows))
    found = [grid[min(len(grid), round(i * len(grid) / spans)) - 1] for i in range(1, spans)] if grid and spans > 1 else []
    picked = Counter(c for c in found if math.isfinite(c))
    cuts = sorted({*picked, *(math.nextafter(c, math.inf) for c, times in picked.items() if times > 1)})
    heavy = {cuts.index(c) + 1: times + 1 for c, times in picked.items() if times > 1}
    if n - known > rows:
        heavy[len(cuts) + 1] = math.ceil((n - known) / rows)
    return cuts, heavy


def _grid(x: str, most: int) -> Column:
    """The quantiles among which splitters are picked, from a bounded sketch."""
    return F.expr(f"percentile_approx({x}, array({', '.join(f'{i / most}D' for i in range(1, most))}), {10 * most})")


def _number(c: str, kind: str) -> Column:
    """An order column as a double that sorts alike; null for what is no number and no time."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith(("string", "char", "varchar")):
        return F.col(c).try_cast("double")
    if kind.startswith("timestamp"):
        return F.col(c).cast("timestamp").cast("double")
    simple = kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return F.col(c).cast("double") if simple else F.lit(None).cast("double")


def _open_rows(marked: DataFrame, paths: list[tuple[int, ...]]) -> DataFrame:
    """The rows whose span so far is one of ``paths`` (at most one per span)."""
    table = marked.sparkSession.createDataFrame([(list(p),) for p in paths], "__path array<int>")
    return marked.join(F.broadcast(table), F.col(_SPAN) == F.col("__path"), "left_semi")


def _spanned(df: DataFrame, key: str, order: list[str], rows: int, adds: Sequence[str]) -> DataFrame:
    """``df`` without ``adds``, with inner columns for the key, the order and the span, an array that sorts like the order."""
    spark, hashed = df.sparkSession, [c for c, kind in df.dtypes if not kind.startswith(("map", "variant")) and "map<" not in kind]
    kinds = dict(df.dtypes)
    value = lambda i: F.coalesce(_number(f"{_AT}{i}", kinds[order[i]]), F.lit(math.nan))  # noqa: E731  null, as NaN, gets the last bucket
    # One reading for the count and the splitters.
    n, known, grid = df.select(_number(order[0], kinds[order[0]]).alias("x")).agg(F.count("*"), F.count(F.nanvl("x", F.lit(None))), _grid("x", MOST_SPANS)).first()
    cuts, heavy = _cuts(grid, n, known, rows, MOST_SPANS)
    marked = df.withColumns({_KEY: F.col(key)} | {f"{_AT}{i}": F.col(c) for i, c in enumerate(order)})
    if heavy:
        marked = marked.withColumn(_HASH, F.xxhash64(*(F.col(f"`{c}`") for c in hashed)))
    marked = marked.drop(*adds)
    if not cuts and not heavy:
        return marked.withColumn(_SPAN, F.array(F.lit(0)))
    cut = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol=_AT, outputCol="__bucket", handleInvalid="keep")
    marked = cut.transform(marked.withColumn(_AT, value(0))).withColumn(_SPAN, F.array(F.col("__bucket").cast("int") if cuts else F.when(F.isnan(_AT), 1).otherwise(0))).drop(_AT, "__bucket")
    open_ = {(i,): pieces for i, pieces in heavy.items()}
    for i in range(1, len(order) + 1):
        if not open_:
            break
        last = f"{_AT}{i - 1}"
        grid = [] if i == len(order) else [F.count(F.nanvl("x", F.lit(None))), _grid("x", MOST_PARTS)]
        rest = _open_rows(marked, list(open_)).withColumn("x", value(min(i, len(order) - 1)))
        seen = rest.groupBy(_SPAN).agg(F.count("*").alias("n"), F.count(last).alias("some"), F.min(last).eqNullSafe(F.max(last)).alias("one"), *grid).collect()
        # Different values that are one as doubles are no tie.
        ties = [r for r in seen if r["one"] and r["some"] in (0, r["n"])]
        if i == len(order):
            table = spark.createDataFrame([(r[_SPAN], math.ceil(r["n"] / rows)) for r in ties], "__path array<int>, __parts int")
            part = F.coalesce(F.pmod(F.col(_HASH), F.col("__parts")).cast("int"), F.lit(0))
            open_ = {}
        else:
            found = {tuple(r[_SPAN]): _cuts(r[5], r["n"], r[4], rows, MOST_PARTS) for r in ties}
            table = spark.createDataFrame([(list(p), c) for p, (c, _) in found.items()], "__path array<int>, __cuts array<double>")
            below = F.size(F.filter("__cuts", lambda c: c <= value(i)))  # noqa: B023  used at once
            part = F.when(F.col("__cuts").isNull(), 0).when(F.isnan(value(i)), F.size("__cuts") + 1).otherwise(below)
            open_ = {(*p, b): pieces for p, (_, h) in found.items() for b, pieces in h.items()}
        marked = marked.join(F.broadcast(table), F.col(_SPAN) == F.col("__path"), "left").withColumn(_SPAN, F.concat(_SPAN, F.array(part))).drop("__path", "__cuts", "__parts")
    return marked


def _by(order: list[str]) -> list[Column]:
    return [F.col(f"{_AT}{i}").asc_nulls_last() for i in range(len(order))]


def _inner(order: list[str]) -> list[str]:
    return [_KEY, _SPAN, _HASH, *(f"{_AT}{i}" for i in range(len(order)))]


def number_rows(df: DataFrame, key: str, order: str | Sequence[str], span: int = SPAN_ROWS) -> DataFrame:
    """Add ``rn`` (1.. per key by ``order``) and ``total`` (rows of the key)."""
    order = _columns(order)
    cut = _spanned(df, key, order, span, ["rn", "total"])
    counts = cut.groupBy(_KEY, _SPAN).agg(F.count("*").alias("__n"))
    per_key = Window.partitionBy(_KEY)
    counts = counts.select(_KEY, _SPAN, (F.sum("__n").over(per_key.orderBy(_SPAN)) - F.col("__n")).alias("__before"), F.sum("__n").over(per_key).alias("total"))
    inside = Window.partitionBy(_KEY, _SPAN).orderBy(*_by(order))
    numbered = join_on(cut, counts, [_KEY, _SPAN]).withColumn("rn", F.row_number().over(inside).cast("long") + F.col("__before"))
    return numbered.drop(*_inner(order), "__before")


def lag_rows(df: DataFrame, key: str, order: str | Sequence[str], values: list[str], span: int = SPAN_ROWS) -> DataFrame:
    """Add ``prev_<value>``: the value of the row before, per key by ``order``."""
    order = _columns(order)
    names = [f"prev_{v}" for v in values]
    cut = _spanned(df, key, order, span, names).withColumn("__values", F.struct(*values))
    at = F.struct(*(x for i in range(len(order)) for x in (F.col(f"{_AT}{i}").isNull(), F.col(f"{_AT}{i}"))))
    last = cut.groupBy(_KEY, _SPAN).agg(F.max_by("__values", at).alias("__last"))
    carried = last.select(_KEY, _SPAN, F.lag("__last").over(Window.partitionBy(_KEY).orderBy(_SPAN)).alias("__carried"))
    inside = Window.partitionBy(_KEY, _SPAN).orderBy(*_by(order))
    out = join_on(cut, carried, [_KEY, _SPAN]).withColumn("__prev", F.coalesce(F.lag("__values").over(inside), F.col("__carried")))
    return out.withColumns({name: F.col("__prev").getField(v) for name, v in zip(names, values)}).drop(*_inner(order), "__values", "__carried", "__prev")


def tumbling(df: DataFrame, key: str, order: str | Sequence[str], size: int = 200) -> DataFrame:
    """Add ``wid`` and ``rn``: windows of ``size`` rows in order of arrival, the last one partial."""
    return number_rows(df, key, order).withColumn("wid", F.floor((F.col("rn") - 1) / size).cast("long"))


def full_tumbling(df: DataFrame, key: str, order: str | Sequence[str], size: int = 200) -> DataFrame:
    """Only windows that are complete, as a live scorer sees them."""
    return tumbling(df, key, order, size).where((F.col("wid") + 1) * size <= F.col("total"))


def hopping(df: DataFrame, key: str, order: str | Sequence[str], size: int = 500, hop: int = 250, tail: bool = True) -> DataFrame:
    """A row per row and window ``k`` it is in; window k covers rows 1 + hop k .. size + hop k.

    With ``tail`` the last ``size`` rows make one more window (k = -1) if rows
    remain after the last complete one.
    """
    numbered = number_rows(df, key, order)
    last = F.floor((F.col("total") - size) / hop).cast("long")  # the last complete window; negative if none
    low = F.greatest(F.lit(0), F.ceil((F.col("rn") - size) / hop).cast("long"))
    high = F.least(F.floor((F.col("rn") - 1) / hop).cast("long"), last)
    ks = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    if tail:
        rest = F.when(last < 0, F.col("total") > 0).otherwise(F.col("total") > size + hop * last)
        ks = F.concat(ks, F.when(rest & (F.col("rn") > F.col("total") - size), F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return numbered.withColumn("k", F.explode(ks))


def last_n(df: DataFrame, key: str, order: str | Sequence[str], n: int = 500) -> DataFrame:
    """The last ``n`` rows of each key."""
    return number_rows(df, key, order).where(F.col("rn") > F.col("total") - n)


def elapsed(ts: str, order: str):
    """Time between a window's first and last row."""
    return F.abs(F.max_by(ts, order) - F.min_by(ts, order))


def interleave(df: DataFrame, source: str, order: str | Sequence[str], block: int = 500) -> DataFrame:
    """Add ``block`` and ``rn``: sources alternate in blocks of ``block`` rows when sorted by (block, source, rn)."""
    return number_rows(df, source, order).withColumn("block", F.floor((F.col("rn") - 1) / block).cast("long"))
