"""Reports: metric matrices, histograms, alert records, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.expr import without_remarks


def metric_matrix(long: DataFrame, metric: str, dataset: str, value: str, datasets: list[str], default: str = "-1") -> DataFrame:
    """One row per metric and a column per data set; ``default`` where there is no value."""
    wide = long.groupBy(metric).pivot(dataset, datasets).agg(F.first(value))
    return wide.select(metric, *(F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(default)).alias(d) for d in datasets))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts of equal-width bins; bin 0 is below and bins + 1 from ``high`` on."""
    at = F.when(value < low, 0).when(value >= high, bins + 1).otherwise(F.floor((value - low) / ((high - low) / bins)).cast("int") + 1)
    return df.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def alert_json(df: DataFrame, columns: list[str], is_alert: Column) -> DataFrame:
    """The alert mark and the row as JSON, for a console or an HTTP hook."""
    return df.select(*columns, is_alert.cast("int").alias("is_alert"), F.to_json(F.struct(*columns)).alias("json"))


def parse_report(lines: DataFrame, line: str = "value", order: str = "pos", report: str = "report") -> DataFrame:
    """``key: value`` lines of a text report as (report, section, key, value); remarks in brackets go.

    A line without a colon begins a section.  Reports are small files; each is
    read by one task, files in parallel.
    """
    from pyspark.sql import Window

    at = Window.partitionBy(report).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = without_remarks(F.col(line))
    is_item = F.contains(text, F.lit(":"))
    section = F.last(F.when(~is_item & (text != ""), text), ignorenulls=True).over(at)
    cut = F.split(text, ":", 2)
    return lines.select(report, section.alias("section"), F.trim(F.get(cut, F.lit(0))).alias("key"), F.trim(F.get(cut, F.lit(1))).alias("value"), is_item.alias("item")).where("item").drop("item")


def all_names(*reports: DataFrame, name: str = "name") -> DataFrame:
    """The names that any of the reports has, once each."""
    out = reports[0].select(name)
    for r in reports[1:]:
        out = out.unionByName(r.select(name))
    return out.where(F.col(name).isNotNull()).distinct()
