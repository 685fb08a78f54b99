"""The bounded labelled sample on which the classifiers are trained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import Scratch, held_out

#: Most labelled rows that a classifier is trained on, and most bytes of their texts (documented bounds).
MAX_ROWS, MAX_BYTES = 6000, 256 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", rows: int = MAX_ROWS, most: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts of at most ``most`` bytes together, outside the held-out fold, in a fixed order.

    Rows are chosen by a hash of the id, whole texts as long as they fit.  Null
    labels and ids are left out; of several labels of one id the largest counts,
    of several texts the least, which Spark finds before any text is collected.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    if not chosen:
        return [], []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r[0], r[1]) for r in chosen], usable.schema)
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(ids), "id")  # at most `rows` ids
    least = Scratch(spark, "labelled").store(found.groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y")), "texts")
    sizes, room, kept = {r[0]: r[1] for r in least.select("id", F.octet_length("t")).collect()}, most, []
    for r in chosen:
        if r[0] in sizes and sizes[r[0]] <= room:
            room -= sizes[r[0]]
            kept.append(r[0])
    few = spark.createDataFrame([(i,) for i in kept], usable.select("id").schema)
    best = {r["id"]: (r["t"], r["y"]) for r in least.join(F.broadcast(few), "id").collect()}  # at most `most` bytes
    return [best[i][0] for i in kept], [int(best[i][1] != 0) for i in kept]
