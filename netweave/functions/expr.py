"""Column expressions of flow analytics.  All stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def null_if_unset(c: Column, unset: str = "-") -> Column:
    """NULL for the log format's "unset" token."""
    return F.nullif(c, F.lit(unset))


def number_or_zero(c: Column) -> Column:
    """A string as a double; what is no number counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def flag(c: Column) -> Column:
    """A BOOLEAN, or 'T' in a text, -> 1; anything else (also unset) -> 0."""
    return F.when(c.cast("string").isin("T", "true"), 1).otherwise(0)


def known(c: Column, default: str = "unknown") -> Column:
    return F.coalesce(c, F.lit(default))


def missing(c: Column) -> Column:
    return c.isNull().cast("int")


def zero_activity(a: Column, b: Column) -> Column:
    return ((F.coalesce(a, F.lit(0)) == 0) & (F.coalesce(b, F.lit(0)) == 0)).cast("int")


def one_hot(c: Column, vocabulary: list[str], prefix: str) -> list[Column]:
    """A 0/1 column per known category; an unknown one is all zeros."""
    return [F.when(c == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in vocabulary]


def traffic_class(orig: Column, resp: Column) -> Column:
    """'both', 'orig', 'resp' or 'none' by which side sent anything; NULL if unknown."""
    return F.when((orig > 0) & (resp > 0), "both").when((orig > 0) & (resp == 0), "orig").when((resp > 0) & (orig == 0), "resp").when((orig == 0) & (resp == 0), "none")


def safe_rate(amount: Column, seconds: Column) -> Column:
    """amount / seconds; NULL where no time has passed or either is unknown."""
    return F.when(seconds > 0, amount / seconds)


def guarded_ratio(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return a / (b + F.lit(epsilon))


def variation(mean: Column, deviation: Column) -> Column:
    """Coefficient of variation; 0 for a mean of 0."""
    return F.when(mean != 0, deviation / mean).otherwise(0.0)


def band(x: Column, p01: Column, p05: Column, p95: Column, p99: Column) -> Column:
    """Outside the 1-99 % range: 1; outside 5-95 %: a half; else 0 (also if unknown)."""
    return F.when(x > p99, 1.0).when(x > p95, 0.5).when(x < p01, 1.0).when(x < p05, 0.5).otherwise(0.0)


def z_band(x: Column, mean: Column, deviation: Column) -> Column:
    """Over 3, 2 or 1 deviations from the mean: 1, 0.75 or 0.5; else 0."""
    z = F.abs(x - mean) / deviation
    return F.when(deviation < EPSILON, 0.0).when(z > 3, 1.0).when(z > 2, 0.75).when(z > 1, 0.5).otherwise(0.0)


def list_items(c: Column, separator: str = ",") -> Column:
    """A vector column's items; an unset vector has none."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, separator))


def list_stats(items: Column) -> dict[str, Column]:
    """Count, mean and population deviation of the numbers in a list, in one pass over it."""

    def add(state: Column, x: Column) -> Column:
        n, off = state["n"] + 1, x - state["mean"]
        mean = state["mean"] + off / n
        return F.struct(n.alias("n"), (state["sum"] + x).alias("sum"), mean.alias("mean"), (state["square"] + off * (x - mean)).alias("square"))

    none = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "square")))
    got = F.aggregate(F.transform(items, number_or_zero), none, add)
    n = F.greatest(got["n"], F.lit(1.0))
    return {"count": F.size(items), "mean": got["sum"] / n, "std": F.sqrt(got["square"] / n)}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


#: Fixed value: the log types that are told by a file's base name.
LOG_TYPES = ("conn", "dns", "http", "ssl", "weird")


def log_type(path: Column) -> Column:
    """'CONN', 'DNS' ... by the base name of a log file, else 'UNKNOWN'."""
    name = F.regexp_extract(base_name(path), rf"^({'|'.join(LOG_TYPES)})\.log$", 1)
    return F.when(name == "", "UNKNOWN").otherwise(F.upper(name))


def without_remarks(c: Column) -> Column:
    """Drop every ``(...)``."""
    return F.trim(F.regexp_replace(c, r"\(.*?\)", ""))


def rounded(c: Column, places: int = 4) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)
