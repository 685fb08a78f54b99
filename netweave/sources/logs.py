"""Batch reading and writing of flow logs: lines, tokens, typed tables, quarantine, repair.

Files are read by Spark's text source, split and in parallel; every line knows
its file and an integer ``pos`` that orders the lines of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.functions.expr import base_name, log_type, parent_name
from netweave.operators.windows import lag_rows
from netweave.sources.schemas import NARROW, column_name, fields, schema, typed, width

#: What a sound line has (length of the time stamp, least length of the uid).
TS_CHARS, UID_CHARS = 17, 15
#: Blocks of a file start at least so many bytes apart.
_BLOCK_BITS, _ROW_BITS = 20, 33


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, value): the lines of text files.

    ``pos`` increases with the lines of a file: the number of the MiB in which
    the line's block starts, then the place of the row in its task.
    """
    block = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), _BLOCK_BITS), _ROW_BITS)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), block.bitwiseOR(row).alias("pos"), "value")


def is_data(line: Column) -> Column:
    """Neither a header, nor ``#close``, nor blank."""
    return ~F.startswith(line, F.lit("#")) & (F.trim(line) != "")


def tokens(line: Column, collapse: bool = False, separator: str = "\t") -> Column:
    """The fields of a line; with ``collapse`` runs of separators count as one, as in C."""
    parts = F.split(line, separator)
    return F.filter(parts, lambda x: x != "") if collapse else parts


def is_corrupt(parts: Column, n_fields: Column | int) -> Column:
    """A wrong number of fields, a time stamp of another length or a short uid."""
    wrong = (F.size(parts) != n_fields) | (F.length(F.get(parts, F.lit(0))) != TS_CHARS) | (F.length(F.get(parts, F.lit(1))) < UID_CHARS)
    return F.coalesce(wrong, F.lit(True))


def csvify(parts: Column, kind: Column | str) -> Column:
    """The tagged, unquoted CSV line: ``CONN,a,b,...``."""
    return F.concat_ws(",", F.lit(kind) if isinstance(kind, str) else kind, parts)


def logify(parts: Column) -> Column:
    """Fields back into a log line."""
    return F.concat_ws("\t", parts)


def untag(line: Column) -> tuple[Column, Column]:
    """(tag, fields) of a tagged CSV line, whatever the tag's length."""
    cut = F.split(line, ",", 2)
    return F.get(cut, F.lit(0)), F.split(F.get(cut, F.lit(1)), ",")


def with_log_type(lines: DataFrame) -> DataFrame:
    """Add ``log_type`` by the file's base name and ``pod``, its folder."""
    return lines.withColumns({"log_type": log_type(F.col("file")), "pod": parent_name(F.col("file"))})


def header_fields(lines: DataFrame, most: int = 100) -> list[list[str]]:
    """The distinct ``#fields`` headers among the files (a log type has a few; more than ``most`` is an error)."""
    found = [r[0].split("\t")[1:] for r in lines.where(F.startswith("value", F.lit("#fields"))).select("value").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different headers")
    return sorted(found)


def _as_table(lines: DataFrame, names: list[str], kind: str, extra: list[str]) -> DataFrame:
    """Lines of one header as the typed table of a log type; missing fields are NULL."""
    at = {n: i for i, n in enumerate(names)}
    parts = lines.withColumn("_t", tokens(F.col("value")))
    cols = [(typed(F.get("_t", F.lit(at[n])), k) if n in at else F.lit(None)).cast(schema(kind)[column_name(n)].dataType).alias(column_name(n)) for n, k in fields(kind)]
    return parts.select(*extra, *cols, is_corrupt(F.col("_t"), len(names)).alias("corrupt"), "value")


def parse(lines: DataFrame, kind: str, headers: list[list[str]] | None = None) -> DataFrame:
    """Typed rows of ``kind`` with file, pos, ``corrupt`` and the raw line.

    With several ``headers`` each file is read by its own; fields that a header
    lacks are NULL, and ones the log type does not know are left out.
    """
    data = lines.where(is_data(F.col("value")))
    extra = [c for c in lines.columns if c != "value"]
    if not headers:
        return _as_table(data, [n for n, _ in fields(kind)], kind, extra)
    if len(headers) == 1:
        return _as_table(data, headers[0], kind, extra)
    of_file = lines.where(F.startswith("value", F.lit("#fields"))).groupBy("file").agg(F.min("value").alias("_header"))
    known = data.join(of_file, "file")
    return reduce(DataFrame.unionByName, (_as_table(known.where(F.col("_header") == "\t".join(["#fields", *h])), h, kind, extra) for h in headers))


def read_log(spark: SparkSession, paths: str | list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantined lines) of the logs at ``paths``."""
    lines = read_lines(spark, paths)
    rows = parse(lines, kind, header_fields(lines))
    return rows.where("not corrupt").drop("corrupt", "value"), rows.where("corrupt").select("file", "pos", "value")


def read_export(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """CSV files with a header (an export of ``write_export``) as the typed table; no inference."""
    header = ", ".join(f"`{n}` string" for n, _ in fields(kind))
    raw = spark.read.schema(header).option("header", True).option("enforceSchema", True).option("escape", '"').csv(paths)
    return raw.select(*(typed(F.col(f"`{n}`"), k).alias(column_name(n)) for n, k in fields(kind)))


def write_export(lines: DataFrame, kind: str, path: str) -> None:
    """Log lines as CSV with a header, quoted where needed; values as they are in the log."""
    parts = lines.where(is_data(F.col("value"))).select(tokens(F.col("value")).alias("t"))
    cols = [F.get("t", F.lit(i)).alias(n) for i, (n, _) in enumerate(fields(kind))]
    parts.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


#: The columns without which a row of a log type is left out, for profiles and for models of whole transactions.
REQUIRED = {kind: ("ts", "orig_h", "resp_h") for kind in ("CONN", "DNS", "HTTP", "SSL", "WEIRD")}
COMPLETE = {"CONN": ("orig_bytes", "resp_bytes")}


def without_nulls(rows: DataFrame, kind: str, complete: bool = False) -> DataFrame:
    """Rows that have what every row of the log type needs; with ``complete`` also what only whole transactions have."""
    needed = [*REQUIRED[kind], *(COMPLETE.get(kind, ()) if complete else ())]
    return rows.dropna(subset=[c for c in needed if c in rows.columns])


def numeric_columns(kind: str, without: tuple[str, ...] = ()) -> list[str]:
    """The columns that a log type declares as numbers, in file order."""
    return [f.name for f in schema(kind) if isinstance(f.dataType, T.NumericType) and f.name not in without]


def without_unset(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in which no number is unset."""
    return rows.dropna(subset=[c for c in numeric_columns(kind) if c in rows.columns])


def write_tables(rows: DataFrame, path: str, by: tuple[str, ...] = ("log_type", "pod")) -> None:
    """Typed rows as Parquet, a folder per log type and pod, so that scans of one are pruned."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def narrow(rows: DataFrame, kind: str) -> DataFrame:
    """The narrow projection of a log type."""
    return rows.select(*NARROW[kind].split())


def concat_logs(lines: DataFrame) -> DataFrame:
    """Several logs as one: the header of the first file, the data lines of all, no ``#close``."""
    first = lines.agg(F.min("file").alias("file"))
    head = lines.where(F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("#close"))).join(F.broadcast(first), "file")  # one row
    return head.withColumn("part", F.lit(0)).unionByName(lines.where(is_data(F.col("value"))).withColumn("part", F.lit(1)))


def repair_lines(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace each broken line by the whole one that now follows the same line in the log.

    ``fragments``: file, prev (the line before), fragment; ``lines``: file, pos,
    value.  The whole line must contain the fragment.  NULL where none is found;
    of several the first by pos.
    """
    pairs = lag_rows(lines, "file", "pos", ["value"]).select("file", "pos", F.col("prev_value").alias("prev"), F.col("value").alias("whole"))
    found = fragments.join(pairs, ["file", "prev"], "left").where(F.col("whole").isNull() | F.contains("whole", "fragment"))
    best = found.groupBy("file", "prev", "fragment").agg(F.min_by("whole", "pos").alias("repaired"))
    return fragments.join(best, ["file", "prev", "fragment"], "left")


def source_name(file: Column) -> Column:
    """The folder and base name by which a source is told."""
    return F.concat_ws("/", parent_name(file), base_name(file))
