"""Features of count windows: moments, extremes and the entropy of the column profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_entropy(columns: list[str]):
    """Entropy of the windows' mean absolute column values taken as shares."""
    levels = [F.coalesce(F.avg(F.abs(c)), F.lit(0.0)) + F.lit(1e-12) for c in columns]
    total = reduce(lambda a, b: a + b, levels)
    terms = [(v / total) * F.ln(v / total) for v in levels]
    return -reduce(lambda a, b: a + b, terms)


def window_features(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per window: n, mean, population deviation, least, largest per column, entropy.

    One shuffle with partial aggregates; windows of any size stay bounded.
    """
    stats = []
    for c in columns:
        v = F.col(c).cast("double")
        stats += [F.avg(v).alias(f"mean_{c}"), F.stddev_pop(v).alias(f"std_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *stats, profile_entropy(columns).alias("entropy"))
