"""Line dedup with DataFrame functions only.

Normalised lines are exploded and hashed (128 bits, or the line itself is never
moved), the documents of each hash are counted, hashes in ``min_docs`` documents
or more lose their lines everywhere but in the smallest doc_id that holds them,
and each document is reassembled from the positions that stay.

Defined results: null or empty text is one empty line, which is never dropped
(its key is too short); a line repeated inside one document counts once and
stays with the document; rows that repeat a doc_id count as one document; rows
without a doc_id count for nothing and keep every line; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import Scratch, ascii_lower

#: Fixed value: the white space stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    """The key under which two lines count as the same."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per document: ``id_col``, text (what stays), n_lines, n_dropped."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    value = F.coalesce(F.col(text), F.lit(""))
    # Rows that share a doc_id but not the text stay apart by the hash of the text.
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(value, F.length(value)).alias("mark"), F.split(value, "\n").alias("lines"))
    keyed = base.where(F.col("id").isNotNull()).select("id", "mark", F.posexplode(F.transform("lines", line_key)).alias("pos", "key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))
    if min_docs == 2:  # two documents differ in their least and largest id: one small aggregate
        repeated = hashed.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("top")).where("keeper <> top").drop("top")
    else:
        counted = hashed.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
        repeated = counted.where(F.col("n") >= min_docs).drop("n")
    repeated = scratch.store(repeated, "repeated")
    gone = hashed.join(repeated, ["h1", "h2"]).where("id <> keeper")
    gone = scratch.store(gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone")), "gone")
    joined = base.join(gone, ["id", "mark"], "left")
    n = F.size("lines")
    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "gone"), lambda i: F.get(F.col("lines"), i))
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.array_join(stay, "\n").alias("text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
