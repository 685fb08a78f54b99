"""The flow view: the event table read as a connection log.

The test tables hold no connection logs, so every flow operator is shown on
this view, which Spark and other SQL engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

#: The view in DuckDB's SQL, for oracles.
FLOW_SQL = """
SELECT event_id AS seq, epoch_us(ts) AS ts_us, CAST(user_id % 5 AS BIGINT) AS pod,
  CAST(user_id AS VARCHAR) AS orig_h, CAST(event_id % 1000 AS INTEGER) AS orig_p, event_type AS resp_h, CAST(user_id % 10 AS INTEGER) AS resp_p,
  CASE WHEN event_type IN ('click', 'view') THEN 'tcp' ELSE 'udp' END AS proto, nullif(event_type, 'error') AS service, upper(substr(event_type, 1, 2)) AS conn_state,
  CASE WHEN event_type <> 'error' THEN value / 10 END AS duration,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS orig_bytes,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS resp_bytes,
  CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS orig_pkts,
  CASE WHEN event_type = 'click' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 END AS resp_pkts,
  CAST(user_id % 5 = 4 AS INTEGER) AS label
FROM events
"""


def flow_view(events: DataFrame) -> DataFrame:
    """Events as connections: one row per event, columns as in a connection log."""
    kind, value, k = F.col("event_type"), F.col("value"), F.get_json_object("props", "$.k").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("ts_us"),
        (F.col("user_id") % 5).alias("pod"),
        F.col("user_id").cast("string").alias("orig_h"),
        (F.col("event_id") % 1000).cast("int").alias("orig_p"),
        kind.alias("resp_h"),
        (F.col("user_id") % 10).cast("int").alias("resp_p"),
        F.when(kind.isin("click", "view"), "tcp").otherwise("udp").alias("proto"),
        F.nullif(kind, F.lit("error")).alias("service"),
        F.upper(F.substring(kind, 1, 2)).alias("conn_state"),
        F.when(kind != "error", value / 10).alias("duration"),
        F.when(kind == "error", None).when(kind == "view", zero).otherwise(F.floor(value * 10).cast("bigint")).alias("orig_bytes"),
        F.when(kind == "error", None).when(kind == "click", zero).otherwise(k).alias("resp_bytes"),
        F.when(kind == "view", zero).otherwise(F.floor(value).cast("bigint")).alias("orig_pkts"),
        F.when(kind == "click", zero).otherwise(k % 7).alias("resp_pkts"),
        (F.col("user_id") % 5 == 4).cast("int").alias("label"),
    )


def read_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_view(spark.read.parquet(f"{sf_dir}/events.parquet"))
