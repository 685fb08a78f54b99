"""Registered queries of models and streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions import expr
from netweave.operators import features, mix, models, windows
from netweave.plans import oracles as sql
from netweave.plans.oracles import rnd
from netweave.sources.flowview import flow_view, read_flows
from netweave.sources.shared import shared_folder
from netweave.streaming import windows as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NUMBERS = ["orig_p", "resp_p", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration"]
_ROW = ["orig_p", "orig_pkts", "resp_pkts"]
#: Fixed values of the ``mahalanobis`` query.
_MEAN = np.array([500.0, 25.0, 3.0])
_INVERSE = np.array([[2e-5, 0.0, 0.0], [0.0, 2e-3, 1e-4], [0.0, 1e-4, 0.25]])


def window_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Window features with the windows' label, and the feature columns."""
    flows = windows.tumbling(read_flows(spark, sf_dir), "pod", "seq")
    found = features.window_features(flows, ["pod", "wid", "label"], NUMBERS)
    return found, [c for c in found.columns if c not in ("pod", "wid", "label", "n")]


def gbt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows scored by 500 boosted trees of depth 8 that learned from the earlier ones."""
    found, columns = window_table(spark, sf_dir)
    early, _ = models.split_in_time(found, ["pod"], "wid")
    return models.predict(models.fit_gbt(early, columns), found, columns).select("pod", "wid", "label", "score", "predicted")


def gbt_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged windows per pod and label: of the windows learned from, of held-out ones, and of held-out rows mixed in blocks."""
    flows = read_flows(spark, sf_dir)
    found, columns = window_table(spark, sf_dir)
    early, late = models.split_in_time(found, ["pod"], "wid")
    model = models.fit_gbt(early, columns)
    _, rows = models.split_in_time(flows, ["pod"], "seq")
    mixed = mix.mix_d(rows.where("label = 0"), rows.where("label = 1"), "seq").withColumn("at", F.col("block") * 2 + F.col("segment")).withColumn("pod", F.lit(-1).cast("long"))
    mixed = windows.tumbling(mixed.withColumn("place", F.col("rn")), "pod", ["at", "place"])
    mixed = features.window_features(mixed.withColumn("label", F.lit(-1)), ["pod", "wid", "label"], NUMBERS)
    return models.evaluate(model, {"learned": early, "held out": late, "mixed": mixed}, columns, ["pod", "label"])


def gbt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows per pod and label, of rows learned from and held-out ones, under 300 boosted trees of depth 10."""
    flows = read_flows(spark, sf_dir)
    early, late = models.split_in_time(flows, ["pod"], "seq")
    model = models.fit_row_gbt(early, NUMBERS)
    return models.evaluate(model, {"learned": early, "held out": late}, NUMBERS, ["pod", "label"])


def rf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored by a random forest (fewer and shallower trees than the default)."""
    flows = read_flows(spark, sf_dir)
    model = models.fit_forest(flows, NUMBERS, numTrees=20, maxDepth=8)
    return models.predict(model, flows, NUMBERS).select("seq", "label", "score", "predicted")


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier scores of rows, and the mark of the share that counts as anomalous."""
    flows = read_flows(spark, sf_dir)
    forest = models.fit_isolation_forest(flows, NUMBERS, "seq")
    scored = models.score_isolation(flows, forest, NUMBERS, ["seq", "label"])
    cut = models.sample_cutoff(forest, 0.02)
    return scored.withColumn("predicted", F.when(F.col("score") > cut, -1).otherwise(1))


def isolation_forest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without and with activity, each scored by a forest of its own."""
    flows = read_flows(spark, sf_dir).withColumn("zero_activity", expr.zero_activity(F.col("orig_bytes"), F.col("resp_bytes")))
    forests = {k: models.fit_isolation_forest(flows.where(F.col("zero_activity") == k), NUMBERS, "seq", trees=50) for k in (0, 1)}
    return models.score_split(flows, forests, NUMBERS, ["seq"])


def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to a given mean under a given inverse covariance."""
    found = models.mahalanobis(read_flows(spark, sf_dir), _ROW, _MEAN, _INVERSE)
    return found.select("seq", expr.rounded(F.col("distance")).alias("distance"))


_D = [f"({c} - {m})" for c, m in zip(_ROW, _MEAN)]
ORACLE["mahalanobis"] = f"WITH {sql.FLOW} SELECT seq, {rnd('sqrt(' + ' + '.join(f'{_D[i]} * {_D[j]} * {_INVERSE[i, j]}' for i in range(3) for j in range(3)) + ')')} AS distance FROM f"


def mahalanobis_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the 99.7 % quantile of the distance, with mean and covariance fitted on label 0."""
    flows = read_flows(spark, sf_dir)
    mean, inverse = models.fit_mahalanobis(flows.where("label = 0"), _ROW)
    cut = float(np.sqrt(models.chi2_quantile(0.997, len(_ROW))))
    scored = models.mahalanobis(flows, _ROW, mean, inverse)
    return scored.select("seq", "label", "distance", (F.col("distance") > cut).cast("int").alias("predicted"))


def stream_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: features of each complete window of 200 rows per pod."""
    root = shared_folder(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    # A pattern, as a stream's plain path has to be a folder.
    stream = flow_view(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))
    sink = lambda df, number: df.write.mode("overwrite").parquet(f"{root}/windows/batch={number}")  # noqa: E731  a batch that runs again replaces its own rows
    run = streaming.score_windows(spark, stream.select("pod", "seq", *NUMBERS), "pod", "seq", NUMBERS, lambda df: df, sink, f"{root}/checkpoint", availableNow=True)
    run.awaitTermination()
    found = spark.read.parquet(f"{root}/windows").drop("batch")
    return found.withColumns({c: expr.rounded(F.col(c)) for c, kind in found.dtypes if kind == "double"})


ORACLE["stream_window_scores"] = f"WITH {sql.NUMBERED} SELECT pod, CAST((rn - 1) // 200 AS BIGINT) AS wid, {sql.window_stats(NUMBERS)} FROM n GROUP BY 1, 2 HAVING count(*) = 200"

for _f in (gbt_windows, gbt_rates, gbt_rows, rf_rows, isolation_forest, isolation_forest_split, mahalanobis, mahalanobis_outliers, stream_window_scores):
    QUERIES[_f.__name__] = _f
