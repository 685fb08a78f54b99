"""Wavelet features of short series: packets of an orthogonal filter bank, and a continuous transform.

A packet tree splits a series again and again into a low and a high half.  Its
filters have eight taps; a series goes on at both ends as its own mirror image
(half-sample symmetric: ... x1 x0 | x0 x1 ...), so a half of n values has
(n + 7) // 2 and the series can be rebuilt from both.  Bands stand by frequency.

The continuous transform takes the real Morlet wavelet exp(-t^2 / 2) cos(5 t),
up to ``REACH`` on both sides, at every whole scale; at scale s the wavelet is
stretched by s and divided by its root.  Convolutions are products of spectra.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The taps of the orthogonal wavelet with four vanishing moments, low half.
LOW = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)
#: The high half is its mirror with every other sign changed.
HIGH = tuple((-1) ** (j + 1) * x for j, x in enumerate(reversed(LOW)))
LEVELS = 3
#: Scales below this, and how far the continuous wavelet reaches.
MOST_SCALE, REACH = 32, 8
CONTINUOUS = ("energy", "entropy", "max_scale", "energy_ratio", "scale_diversity")
PACKETS = ("entropy", "max_band", "concentration")


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low and the high half of a series of at least one value."""
    n = len(x)
    at = (2 * np.arange((n + len(LOW) - 1) // 2) + 1)[:, None] - np.arange(len(LOW))[None, :]
    at %= 2 * n
    seen = x[np.where(at < n, at, 2 * n - 1 - at)]
    return seen @ np.array(LOW), seen @ np.array(HIGH)


def packets(y: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """The 2 ** levels bands of a series, by frequency."""
    bands = [np.asarray(y, float)]
    for _ in range(levels):
        bands = [half for b in bands for half in halves(b)]
    return [bands[f ^ (f >> 1)] for f in range(len(bands))]  # a high half is turned around, so its own halves change places


def packet_energies(y: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """The energy of each band; none of a series shorter than 2 ** levels."""
    return np.array([float((b * b).sum()) for b in packets(y, levels)]) if len(y) >= 2**levels else np.zeros(2**levels)


def entropy(x: np.ndarray) -> float:
    p = (x + 1e-12) / (x + 1e-12).sum()
    return float(-(p * np.log(p)).sum())


def packet_metrics(energies: np.ndarray) -> dict[str, float]:
    if not energies.any():
        return dict.fromkeys(PACKETS, 0.0)
    return {"entropy": entropy(energies), "max_band": float(energies.argmax()), "concentration": float(energies.max() / (energies.sum() + 1e-9))}


def scales(n: int) -> np.ndarray:
    return np.arange(1, max(2, min(MOST_SCALE, n // 2)))


def continuous(y: np.ndarray) -> np.ndarray:
    """The transform of a series: a row per scale."""
    n = len(y)
    size = 1 << (n + 2 * REACH * MOST_SCALE).bit_length()
    spectrum, out = np.fft.rfft(y, size), []
    for s in scales(n):
        t = np.arange(-REACH * s, REACH * s + 1) / s
        wave = np.exp(-t * t / 2) * np.cos(5 * t) / np.sqrt(s)
        out.append(np.fft.irfft(spectrum * np.fft.rfft(wave, size), size)[REACH * s : REACH * s + n])
    return np.array(out)


def continuous_metrics(y: np.ndarray) -> dict[str, float]:
    """Energy, entropy over times and scales, strongest scale, small to large scales, and entropy over scales; 0 for n < 4."""
    if len(y) < 4:
        return dict.fromkeys(CONTINUOUS, 0.0)
    power = continuous(y) ** 2
    total, by_scale = power.sum(), power.sum(1)
    p, half = power / (total + 1e-12), len(power) // 2
    return {
        "energy": float(total),
        "entropy": float(-(p * np.log(p + 1e-12)).sum()),
        "max_scale": float(by_scale.argmax() + 1),
        "energy_ratio": float(by_scale[:half].sum() / (by_scale[half:].sum() + 1e-9)),
        "scale_diversity": entropy(by_scale),
    }


def _per_series(series: DataFrame, keys: list[str], order: str, value: str, columns: str, run) -> DataFrame:
    """``run`` on the ordered values of each group; groups are windows of a bounded number of rows."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}

    def each(group: pd.DataFrame) -> pd.DataFrame:
        out = run(group.sort_values(order)[value].to_numpy(float))
        for k in reversed(keys):
            out.insert(0, k, [group[k].iloc[0]] * len(out))
        return out

    return series.select(*keys, order, value).groupBy(*keys).applyInPandas(each, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), columns]))


def packet_bands(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, band, energy): a row per group and band of its packets."""
    return _per_series(series, keys, order, value, "band long, energy double", lambda y: pd.DataFrame({"band": np.arange(2**LEVELS), "energy": packet_energies(y)}))


def wavelet_packets(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, entropy, max_band, concentration) of each group's packets."""
    return _per_series(series, keys, order, value, ", ".join(f"{m} double" for m in PACKETS), lambda y: pd.DataFrame([packet_metrics(packet_energies(y))]))


def wavelet_transform(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, energy, entropy, max_scale, energy_ratio, scale_diversity) of each group's continuous transform."""
    return _per_series(series, keys, order, value, ", ".join(f"{m} double" for m in CONTINUOUS), lambda y: pd.DataFrame([continuous_metrics(y)]))
