"""Spectral metrics of short series: one Arrow call per group, numpy inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

METRICS = ("energy", "entropy", "dominant_freq", "hf_lf")


def magnitudes(y: np.ndarray) -> np.ndarray:
    """|DFT| for k = 0 .. n // 2; rounding noise counts as 0, so a constant series has no spectrum."""
    return np.round(np.abs(np.fft.rfft(y)), 9)


def metrics(y: np.ndarray) -> dict[str, float]:
    """Energy, entropy, dominant frequency and high/low ratio without the mean; 0 for n < 4."""
    n = len(y)
    if n < 4:
        return dict.fromkeys(METRICS, 0.0)
    m = magnitudes(y)[1:]
    p = m / (m.sum() + 1e-12)
    half = len(m) // 2
    return {
        "energy": float((m * m).sum()),
        "entropy": float(-(p * np.log(p + 1e-12)).sum()),
        "dominant_freq": float((int(np.argmax(m)) + 1) / n),
        "hf_lf": float((m[half:].sum() + 1e-9) / (m[:half].sum() + 1e-9)),
    }


def spectral_metrics(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row per group of ``keys``: n and the four metrics of its ordered series.

    Groups are windows of a bounded number of rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long", *(f"{m} double" for m in METRICS)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = group.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in keys}, "n": len(y), **metrics(y)}])

    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


#: The signals of a window of connections.
SIGNALS = ("ts", "bytes", "pkts", "conns")


def signal(group: pd.DataFrame, name: str) -> np.ndarray:
    """A signal of a window's rows (``at`` microseconds, ``seq``, bytes, pkts): gaps between rows, or sums per second that has rows."""
    if name == "ts":
        return np.diff(group.sort_values(["at", "seq"])["at"].to_numpy(np.int64)) / 1e6
    value = pd.Series(1.0, group.index) if name == "conns" else group[name]
    return value.groupby(group["at"] // 1_000_000).sum().to_numpy(float)


def signal_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group of ``keys`` and signal: n and the four metrics; all signals of a window come from one call.

    ``rows``: keys, at, seq, bytes, pkts.  Groups are windows of a bounded number of rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "signal string", "n long", *(f"{m} double" for m in METRICS)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = {k: group[k].iloc[0] for k in keys}
        series = {name: signal(group, name) for name in SIGNALS}
        return pd.DataFrame([{**first, "signal": name, "n": len(y), **metrics(y)} for name, y in series.items() if len(y)], columns=[*keys, "signal", "n", *METRICS])

    return rows.select(*keys, "at", "seq", "bytes", "pkts").groupBy(*keys).applyInPandas(run, schema)


def spectra(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row per group and frequency index k (0 is the mean): magnitude."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "k long", "magnitude double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = magnitudes(group.sort_values(order)[value].to_numpy(float))
        out = pd.DataFrame({"k": np.arange(len(m)), "magnitude": m})
        for name in reversed(keys):
            out.insert(0, name, group[name].iloc[0])
        return out

    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)
