"""Registered queries that write the flow view as log files and read them again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions import expr
from netweave.operators import encode
from netweave.plans import oracles as sql
from netweave.sources import logs, schemas
from netweave.sources.flowview import read_flows
from netweave.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


#: One line of so many is caught half-written.
_HALF = 97


def _tokens(flows: DataFrame) -> DataFrame:
    """(pod, seq, t): the flow view as the fields of a connection log; ``-`` where a value is unset."""
    whole, part = F.floor(F.col("ts_us") / 1_000_000), F.pmod(F.col("ts_us"), F.lit(1_000_000))
    flag = lambda c: F.when(c, "T").when(~c, "F")
    made = {
        "ts": F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 6, "0")),
        "uid": F.concat(F.lit("C"), F.lpad(F.col("seq").cast("string"), 16, "0")),
        "local_orig": flag(F.when(F.col("service").isNotNull(), F.col("orig_pkts") > 5)),
        "tunnel_parents": F.when(F.col("orig_pkts") % 3 == 0, "(empty)").when(F.col("orig_pkts") % 3 == 1, F.concat_ws(",", "orig_h", "resp_h", "orig_h")),
    }
    names = [schemas.column_name(n) for n, _ in schemas.fields("CONN")]
    values = [made[n] if n in made else F.col(n).cast("string") if n in flows.columns else F.lit(None).cast("string") for n in names]
    return flows.select("pod", "seq", F.array(*(F.coalesce(v, F.lit("-")) for v in values)).alias("t"))


def _write(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Logs of every pod in a folder of its own, with header lines, blank lines and an end; every ``_HALF``-th line is cut short."""
    root = shared_folder(spark, name)
    line = logs.logify(F.col("t"))
    rows = _tokens(read_flows(spark, sf_dir)).select("pod", F.when(F.col("seq") % _HALF == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    fields = "\t".join(["#fields", *(n for n, _ in schemas.fields("CONN"))])
    head = rows.select("pod").distinct().select("pod", F.explode(F.array(*(F.lit(x) for x in ("#separator \\x09", "#path\tconn", fields, "", "#close\t2024")))).alias("value"))
    head.unionByName(rows).write.partitionBy("pod").text(f"{root}/logs")
    return f"{root}/logs"


_CONN = ["ts_us", "seq", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "orig_pkts", "resp_pkts"]
_LOCAL = "CASE WHEN service IS NOT NULL THEN orig_pkts > 5 END AS local_orig"
_TUNNELS = "CAST(CASE orig_pkts % 3 WHEN 0 THEN 0 WHEN 1 THEN len(list_distinct([orig_h, resp_h])) END AS INTEGER) AS tunnels"


@_query(f"WITH {sql.FLOW} SELECT 'pod=' || pod AS source, {', '.join(_CONN)}, {_LOCAL}, {_TUNNELS} FROM f WHERE seq % {_HALF} <> 0")
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files as typed rows: numbers, times, flags and lists; header, blank and half-written lines are no rows."""
    rows, _ = logs.read_log(spark, _write(spark, sf_dir, "read-logs") + "/*", "CONN")
    return rows.select(
        expr.parent_name(F.col("file")).alias("source"),
        (F.col("ts") * 1_000_000).cast("bigint").alias("ts_us"),
        F.substring("uid", 2, 16).cast("bigint").alias("seq"),
        *_CONN[2:],
        "local_orig",
        F.when(F.col("tunnel_parents").isNotNull(), F.size("tunnel_parents")).alias("tunnels"),
    )


@_query(f"WITH {sql.FLOW} SELECT 'pod=' || pod AS source, count(*) AS n FROM f WHERE seq % {_HALF} = 0 GROUP BY pod")
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of log files that are set aside, by source."""
    _, broken = logs.read_log(spark, _write(spark, sf_dir, "quarantine") + "/*", "CONN")
    return broken.groupBy(expr.parent_name(F.col("file")).alias("source")).agg(F.count("*").alias("n"))


@_query(f"WITH {sql.FLOW} SELECT {', '.join(_CONN)}, {_LOCAL}, {_TUNNELS} FROM f WHERE seq % {_HALF} <> 0")
def export_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files exported as quoted CSV with a header, and the export read as typed rows."""
    path = _write(spark, sf_dir, "export-logs")
    lines = logs.read_lines(spark, f"{path}/*").where(F.length("value") > 12)
    logs.write_export(lines, "CONN", f"{path}-csv")
    rows = logs.read_export(spark, f"{path}-csv", "CONN")
    return rows.select(
        (F.col("ts") * 1_000_000).cast("bigint").alias("ts_us"), F.substring("uid", 2, 16).cast("bigint").alias("seq"), *_CONN[2:], "local_orig", F.when(F.col("tunnel_parents").isNotNull(), F.size("tunnel_parents")).alias("tunnels")
    )


@_query(f"WITH {sql.FLOW} SELECT lpad(CAST(seq AS VARCHAR), 16, '0') AS uid, orig_h, resp_h, proto, duration, orig_bytes, resp_bytes, conn_state, {_LOCAL}, orig_pkts, resp_pkts FROM f WHERE seq % {_HALF} <> 0")
def narrow_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow projection of connection logs (columns that the flow view has none of are left out)."""
    rows, _ = logs.read_log(spark, _write(spark, sf_dir, "narrow-logs") + "/*", "CONN")
    found = logs.narrow(rows, "CONN").withColumn("uid", F.substring("uid", 2, 16))
    return found.drop("ts", "local_resp", "orig_ip_bytes", "resp_ip_bytes")


@_query(
    f"""WITH {sql.FLOW}, n AS (SELECT count(*) AS n FROM f WHERE seq % {_HALF} <> 0), h AS (SELECT count(*) AS n FROM f WHERE seq % {_HALF} = 0)
SELECT 0 AS part, 'header' AS kind, CAST(3 AS BIGINT) AS lines UNION ALL SELECT 1, 'whole', n FROM n UNION ALL SELECT 1, 'half', n FROM h WHERE n > 0"""
)
def concat_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several logs as one: the header of one file, then all data lines, no end marks."""
    path = _write(spark, sf_dir, "concat-logs")
    lines = logs.read_lines(spark, f"{path}/*")
    # A folder of part files is one log.
    whole = logs.concat_logs(lines.withColumn("file", expr.parent_name(F.col("file"))))
    kind = F.when(F.col("part") == 0, "header").when(F.length("value") > 12, "whole").otherwise("half")
    return whole.groupBy("part", kind.alias("kind")).agg(F.count("*").alias("lines"))


_NAMES = ("conn", "dns", "http", "ssl", "weird", "files")
_PATH = "'/logs/pod-' || pod || ' (node ' || orig_p || ')/' || CASE seq % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END || '.log'"


@_query(
    f"""WITH {sql.FLOW}, p AS (SELECT seq, {_PATH} AS path, seq % 6 AS k FROM f)
SELECT seq, CASE k {' '.join(f"WHEN {i} THEN '{n.upper()}'" for i, n in enumerate(_NAMES[:5]))} ELSE 'UNKNOWN' END AS log_type, string_split(path, '/')[-1] AS base, string_split(path, '/')[-2] AS parent,
trim(regexp_replace(string_split(path, '/')[-2], '\\(.*?\\)', '', 'g')) AS source FROM p"""
)
def log_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths of log files tell: the log type by the base name, the folder, and the folder without remarks."""
    name = F.get(F.array(*(F.lit(n) for n in _NAMES)), (F.col("seq") % 6).cast("int"))
    path = F.concat(F.lit("/logs/pod-"), F.col("pod").cast("string"), F.lit(" (node "), F.col("orig_p").cast("string"), F.lit(")/"), name, F.lit(".log"))
    paths = read_flows(spark, sf_dir).select("seq", path.alias("file"))
    found = logs.with_log_type(paths)
    return found.select("seq", "log_type", expr.base_name(F.col("file")).alias("base"), F.col("pod").alias("parent"), expr.without_remarks(F.col("pod")).alias("source"))


@_query(
    f"""WITH {sql.FLOW} SELECT seq, CAST(proto = 'udp' AS INTEGER) AS proto_udp, CAST(0 AS INTEGER) AS proto_icmp, CAST(coalesce(service, 'unknown') = 'view' AS INTEGER) AS service_view,
CAST(orig_pkts AS DOUBLE) AS orig_pkts, CAST(0 AS INTEGER) AS orig_pkts_missing FROM f"""
)
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows encoded with the columns, in their order, that a model was trained on; a category never seen here is 0."""
    flows = read_flows(spark, sf_dir).select("seq", "proto", "service", "conn_state", "orig_pkts")
    trained = ["seq", "proto_udp", "proto_icmp", "service_view", "orig_pkts", "orig_pkts_missing"]
    return encode.align(encode.encode_conn(flows, encode.fit_vocabulary(flows, "CONN")), trained)
