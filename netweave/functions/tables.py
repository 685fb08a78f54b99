"""Table functions for Spark SQL.

``register(spark)`` makes ``fft_features`` callable::

    SELECT * FROM fft_features(TABLE(series) PARTITION BY (pod, wid) ORDER BY (sec), 'pod, wid', 'y')

The table comes partitioned and ordered by Spark; a partition is one series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from netweave.functions.spectral import METRICS, metrics


class FftFeatures:
    """``keys`` (names with commas), n and the four metrics of the column ``value`` of each partition, in the order given."""

    def __init__(self) -> None:
        self.first, self.values = None, []

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        kept = [table.dataType[c.strip()] for c in keys.value.split(",")]
        return AnalyzeResult(T.StructType([*kept, T.StructField("n", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in METRICS)]))

    def eval(self, table: Row, keys: str, value: str) -> None:
        if self.first is None:
            self.first = tuple(table[c.strip()] for c in keys.split(","))
        self.values.append(table[value])

    def terminate(self) -> Iterator[tuple]:
        if self.first is not None:
            yield (*self.first, len(self.values), *metrics(np.array(self.values, float)).values())


def register(spark: SparkSession) -> None:
    spark.udtf.register("fft_features", udtf(FftFeatures))
