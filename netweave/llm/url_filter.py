"""URL filters as a sort-merge range join, with DataFrame functions only.

A host is reversed label by label (``a.example.net`` -> ``net.example.a.``).  A
rule's key is its reversed host, a separator and its path; what the rule fits
under its own host is one interval of the sort order, the keys it is a prefix
of, and intervals of rules are nested or apart.  A page has one key for each
domain around its host that rules name.  Rules and keys of pages are
range-partitioned and swept in order; the last rule at or before a key names,
with the rules it is nested in, the stack of rules that can be active there.  A
partition begins with the last rule of the partitions before it.  Hosts with
many rules or pages spread over partitions, as the path is part of the key, and
equal keys by a salt, which the sweep does not mind.

Defined results: null urls, and urls without ``://``, have empty host and path
and meet no rule; the longest rule wins, of two of one length the one with the
longer host; of rules with the same host and path the smaller verdict counts;
repeated pages each get a row; an empty table gives none, an empty rule table
the default verdict; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave.llm.common import Scratch, ascii_lower, having_ids

#: The rules of the contract, (verdict, host, path).
CONTRACT_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


#: Between the host and the path of a key; sorts before everything else.
GAP = "\u0000"


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Labels in reverse, each closed by a dot; prefixes are parent domains."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=CONTRACT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def domains(key):
    """The keys of a host and of all domains around it."""
    labels = F.split(key, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(domain, key, stack): each rule with the rules it is nested in, the innermost first."""
    whole = F.concat("host", "path")
    at = rules.select(host_key(F.col("host")).alias("domain"), F.length("host").alias("host_size"), F.length(whole).alias("size"), whole.alias("rule"), "path", "verdict")
    at = at.groupBy(F.concat("domain", F.lit(GAP), "path").alias("key"), "domain").agg(F.min(F.struct("verdict", "size", "host_size", "rule")).alias("r"))
    first = F.length("domain") + 1
    around = at.select("domain", "key", F.explode(F.transform(F.sequence(first, F.length("key")), lambda i: F.substring("key", F.lit(1), i))).alias("outer"))
    outer = at.select(F.col("key").alias("outer"), F.struct(F.length("key").alias("deep"), "key", "r").alias("rule"))
    nested = around.join(outer, "outer").groupBy("domain", "key").agg(F.array_sort(F.collect_list("rule")).alias("stack"))
    return nested.select("domain", "key", F.reverse("stack").alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule (null if none), verdict."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = scratch.store(pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("row", F.monotonically_increasing_id()), "seen")
    stacks = scratch.store(rule_stacks(rules), "rules")
    named = scratch.store(stacks.select("domain").distinct(), "domains")
    asked = having_ids(seen.where("host <> ''").select("row", "path", F.explode(domains(host_key(F.col("host")))).alias("domain")), named, "domain")
    asked = asked.select("row", F.concat("domain", F.lit(GAP), "path").alias("key"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("row"), F.lit(1 << 20)).alias("salt"))
    both = asked.unionByName(stacks.select("key", "stack", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt")), allowMissingColumns=True)
    ranged = scratch.store(both.repartitionByRange(parts, "key", "kind", "salt").withColumn("part", F.spark_partition_id()), "ranged")
    # The stack a partition begins with: of the last rule before it.
    last = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = every.join(last, "part", "left").select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "part", "left")  # as many rows as partitions
    inner = F.get(F.filter(F.coalesce("open", "carried"), lambda r: F.col("key").startswith(r["key"])), F.lit(0))
    fit = swept.withColumn("r", inner["r"]).where("r is not null")
    best = fit.groupBy("row").agg(F.max(F.struct("r.size", "r.host_size", "r.rule", "r.verdict")).alias("best"))
    return seen.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
