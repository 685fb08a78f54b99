"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the least id it reaches.

    ``links`` is a stored table.  Each round stores its labels, so a lost
    executor costs one round; a hub's links are pre-aggregated and its join is
    split by adaptive execution.
    """
    both = scratch.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = scratch.store(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        lower = scratch.store(lower, "lower")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("top"))
        after = lower.join(jump, "component").select("id", F.least("component", "top").alias("component"), "was")
        after = scratch.store(after, "labels")
        scratch.free(labels, lower)
        labels = after
        if not labels.where("component <> was").limit(1).count():
            scratch.free(both)
            return labels.select("id", "component")
