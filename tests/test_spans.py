"""Row numbers where one order value, or none, has most of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.operators import windows


def spans(df, order, rows):
    """Rows of each span."""
    return [r["count"] for r in windows._spanned(df, "k", order, rows, []).groupBy("__span").count().collect()]


@pytest.mark.parametrize("at", ["7", "cast(null as long)", "if(id % 2 = 0, 7, null)", "if(id % 3 = 0, id, 7)", "cast('nan' as double)"])
def test_ties_are_spread(spark, at):
    df = spark.range(0, 400_000, 1, 4).selectExpr("id", f"{at} AS at", "'k' AS k")
    assert max(spans(df, ["at"], 50_000)) <= 130_000 and len(spans(df, ["at"], 50_000)) >= 4
    got = windows.number_rows(df, "k", "at", span=50_000)
    assert got.agg(F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.min("total"), F.max("total")).first()[:] == (400_000, 1, 400_000, 400_000, 400_000)
    at_rn = Window.orderBy("rn")
    back = got.where("at is not null and not isnan(at)").withColumn("before", F.lag("at").over(at_rn)).where("before > at")
    assert back.count() == 0
    assert got.where("at is null").agg(F.min("rn")).first()[0] in (None, 400_000 - df.where("at is null").count() + 1)


def test_further_columns_keep_their_order_in_a_tie(spark):
    df = spark.range(0, 60_000, 1, 3).selectExpr("id", "if(id % 10 < 8, 5, id % 10) AS a", "if(id % 4 = 0, null, if(id % 4 = 1, 3, (id * 7919) % 1000)) AS b", "id % 2 AS k")
    want = {r.id: (r.rn, r.a, r.b) for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last(), "id"))).collect()}
    assert max(spans(df, ["a", "b"], 4_000)) <= 9_000 and len(spans(df, ["a", "b"], 4_000)) >= 12
    got = windows.number_rows(df, "k", ["a", "b", "id"], span=4_000).collect()
    assert {r.id: (r.rn, r.a, r.b) for r in got} == want
    by = {(r.k, r.rn): (r.a, r.b) for r in windows.number_rows(df, "k", ["a", "b"], span=4_000).collect()}
    for r in got:
        assert by[r.k, r.rn] == (r.a, r.b)


def test_previous_rows_across_divided_ties(spark):
    df = spark.range(0, 9_000, 1, 3).selectExpr("id AS v", "if(id % 3 = 0, 1, 2) AS a", "'k' AS k")
    got = windows.lag_rows(df, "k", ["a", "v"], ["v"], span=500).collect()
    want = {r.v: r.p for r in df.withColumn("p", F.lag("v").over(Window.orderBy("a", "v"))).collect()}
    assert {r.v: r.prev_v for r in got} == want


def test_values_that_are_one_as_doubles_are_no_tie(spark):
    df = spark.range(0, 2_000).selectExpr("id", f"{1 << 60} + id % 8 AS at", "'k' AS k")
    got = windows.number_rows(df, "k", "at", span=100).withColumn("before", F.lag("at").over(Window.orderBy("rn")))
    assert got.where("before > at").count() == 0 and got.count() == 2_000


def test_text_orders_are_right(spark):
    df = spark.createDataFrame([(i, f"t{i % 50:03d}") for i in range(900)], "id long, at string").withColumn("k", F.lit(1))
    got = windows.number_rows(df, "k", "at", span=100).withColumn("before", F.lag("at").over(Window.orderBy("rn")))
    assert got.where("before > at").count() == 0


def test_empty_tables(spark):
    df = spark.range(0).selectExpr("id", "id AS at", "'k' AS k")
    assert windows.number_rows(df, "k", ["at", "id"]).count() == 0 and windows.lag_rows(df, "k", "at", ["id"]).count() == 0
