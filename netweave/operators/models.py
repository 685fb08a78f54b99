"""Anomaly models: window and row classifiers, isolation forest, Mahalanobis distance.

Boosted trees are those of ``boosting``, the random forest is a Spark ML pipeline.  The isolation forest, which Spark lacks, is
grown from a bounded uniform sample and scored with Arrow batches; a distance
is a column expression over a fitted mean and inverse covariance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators import boosting
from netweave.operators.profile import spread_quantiles
from netweave.operators.scoring import detection_rates
from netweave.operators.windows import join_on

#: Settings of the row forest.
ROW_FOREST = {"numTrees": 200, "maxDepth": 30}
#: Rows of the sample that an isolation tree is grown on, and of all trees together.
PSI, SAMPLE_ROWS = 256, 20_000
EULER = 0.5772156649015329


def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")


def zeros_for_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})


def fit_gbt(df: DataFrame, columns: list[str], label: str = "label", **settings) -> boosting.Boosted:
    """Boosted trees over windows; ``settings`` replace those of ``boosting.WINDOW``."""
    return boosting.fit(df, columns, label, boosting.WINDOW, **settings)


def fit_row_gbt(df: DataFrame, columns: list[str], label: str = "label", **settings) -> boosting.Boosted:
    """Boosted trees over single rows; ``settings`` replace those of ``boosting.ROW``."""
    return boosting.fit(df, columns, label, boosting.ROW, **settings)


def split_in_time(df: DataFrame, keys: list[str], at: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, held-out rows): of each key the part of its range of ``at`` below ``share``, and the rest."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("__low"), F.max(at).alias("__high"))
    cut = F.col("__low") + F.lit(share) * (F.col("__high") - F.col("__low") + 1)
    marked = join_on(df, ends, keys).withColumn("__early", F.coalesce(F.col(at) < cut, F.lit(False))).drop("__low", "__high")
    return marked.where("__early").drop("__early"), marked.where("not __early").drop("__early")


def evaluate(model: PipelineModel | boosting.Boosted, sets: dict[str, DataFrame], columns: list[str], keys: list[str], least: float = 0.5) -> DataFrame:
    """(set, keys, n, flagged, rate) of each named data set under one model: detection rates where all is an attack, false-positive rates where nothing is."""
    parts = [detection_rates(predict(model, df, columns), keys, "score", least).select(F.lit(name).alias("set"), *keys, "n", "flagged", "rate") for name, df in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def fit_forest(df: DataFrame, columns: list[str], label: str = "label", seed: int = 42, **settings) -> PipelineModel:
    """A random forest (Spark's deepest trees have 30 levels)."""
    trees = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, **(ROW_FOREST | settings))
    return Pipeline(stages=[_assembled(columns), trees]).fit(zeros_for_unknown(df, columns))


def predict(model: PipelineModel | boosting.Boosted, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``score``, the probability of label 1, and ``predicted``."""
    if isinstance(model, boosting.Boosted):
        return boosting.predict(model, df)
    out = model.transform(zeros_for_unknown(df, columns)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score", F.col("prediction").cast("int").alias("predicted"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _isolation_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[int], list[float], list[int], list[float]]:
    """Flat arrays (feature or -1, cut, left child, depth at a leaf); the right child follows the left."""
    feature, cut, left, depth = [], [], [], []
    open_ = [(0, np.arange(len(x)), 0)]
    for out in (feature, cut, left, depth):
        out.append(0)
    while open_:
        node, rows, level = open_.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        spread = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(spread):
            feature[node], depth[node] = -1, level + expected_depth(len(rows))
            continue
        f = int(rng.choice(spread))
        c = float(rng.uniform(low[f], high[f]))
        feature[node], cut[node], left[node] = f, c, len(feature)
        below = x[rows, f] <= c
        for side in (rows[below], rows[~below]):
            open_.append((len(feature), side, level + 1))
            for out in (feature, cut, left, depth):
                out.append(0)
    return feature, cut, left, depth


def grow_isolation_forest(x: np.ndarray, trees: int = 100, psi: int = PSI, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    psi = min(psi, len(x))
    grown = [_isolation_tree(x[rng.choice(len(x), psi, replace=False)], rng, math.ceil(math.log2(max(psi, 2)))) for _ in range(trees)]
    return {"trees": [tuple(np.array(a) for a in t) for t in grown], "psi": psi}


def isolation_scores(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean depth / expected depth): near 1 is an outlier."""
    total = np.zeros(len(x))
    for feature, cut, left, depth in forest["trees"]:
        node = np.zeros(len(x), int)
        inner = feature[node] >= 0
        while inner.any():
            at = node[inner]
            node[inner] = left[at] + (x[inner, feature[at]] > cut[at])
            inner = feature[node] >= 0
        total += depth[node]
    return 2.0 ** (-total / len(forest["trees"]) / max(expected_depth(forest["psi"]), 1e-12))


def fit_isolation_forest(df: DataFrame, columns: list[str], order: str, trees: int = 100, psi: int = PSI, rows: int = SAMPLE_ROWS, seed: int = 42) -> dict:
    """A forest grown on at most ``rows`` rows, chosen by a hash of ``order`` (a documented bound)."""
    picked = zeros_for_unknown(df, columns).orderBy(F.xxhash64(F.lit(seed), F.col(order)), order).limit(rows).select(*columns)
    x = np.array([tuple(r) for r in picked.collect()], float)
    forest = grow_isolation_forest(x, trees, psi, seed)
    return forest | {"sample": np.sort(isolation_scores(forest, x))}


def sample_cutoff(forest: dict, contamination: float) -> float:
    """The score above which a share of ``contamination`` of the rows lies that the forest was fitted on."""
    return float(np.quantile(forest["sample"], 1.0 - contamination))


def score_isolation(df: DataFrame, forest: dict, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` per row; rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # trees over psi rows each: a fixed size
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["score"] = isolation_scores(shared.value, b[[f"_{c}" for c in columns]].to_numpy(float))
            yield out

    numbers = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_{c}") for c in columns]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double"])
    return df.select(*keep, *numbers).mapInPandas(run, schema)


def score_cutoff(scored: DataFrame, contamination: float, score: str = "score") -> float:
    """The score above which a share of ``contamination`` of the rows lies."""
    found = spread_quantiles(scored, [], score, (1.0 - contamination,)).first()
    return found.q[0] if found else None


def score_split(df: DataFrame, forests: dict[int, dict], columns: list[str], keep: list[str], route: str = "zero_activity") -> DataFrame:
    """Rows without and with activity scored by a forest of their own."""
    parts = [score_isolation(df.where(F.col(route) == k), f, columns, [*keep, route]) for k, f in sorted(forests.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, rows) in one pass of partial aggregates."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    got = df.agg(F.count("*"), *(F.avg(c) for c in x), *(F.covar_pop(x[i], x[j]) for i, j in pairs)).first()
    k = len(columns)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, got[1 + k :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return np.array([v or 0.0 for v in got[1 : 1 + k]]), cov, got[0]


def shrink(cov: np.ndarray, amount: float) -> np.ndarray:
    """Towards a multiple of the identity with the same trace."""
    return (1 - amount) * cov + amount * np.trace(cov) / len(cov) * np.eye(len(cov))


def shrinkage(df: DataFrame, columns: list[str], mean: np.ndarray, cov: np.ndarray, n: int) -> float:
    """The Ledoit-Wolf amount, from one more pass: sum of squared norms of the centred rows."""
    square = sum(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m))) ** 2 for c, m in zip(columns, mean)), F.lit(0.0))
    fourth = df.agg(F.sum(square * square)).first()[0] or 0.0
    target = np.trace(cov) / len(cov)
    distance = ((cov - target * np.eye(len(cov))) ** 2).sum()
    spread = (fourth / max(n, 1) - (cov**2).sum()) / max(n, 1)
    return float(min(1.0, max(0.0, spread / distance))) if distance > 0 else 0.0


def mahalanobis(df: DataFrame, columns: list[str], mean: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """Add ``distance``: a column expression, no Python per row."""
    d = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m)) for c, m in zip(columns, mean)]
    square = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            square = square + d[i] * d[j] * F.lit(float(inverse[i, j]))
    return df.withColumn("distance", F.sqrt(F.greatest(square, F.lit(0.0))))


def fit_mahalanobis(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, inverse of the shrunk covariance)."""
    mean, cov, n = covariance(df, columns)
    return mean, np.linalg.pinv(shrink(cov, shrinkage(df, columns, mean, cov, n)))


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function (series; continued fraction beyond a + 1)."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, freedom: int) -> float:
    """The chi-squared quantile, by bisection."""
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_share(freedom / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2
