"""Smoothing of short binned series: polynomial windows and local regression. Each series is one Arrow group of at most some
thousand bins; the data behind the bins never come here."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def polynomial_weights(window: int, degree: int, derivative: int = 0) -> np.ndarray:
    """Weights of the least-squares polynomial's value (or derivative) at the middle of an odd window."""
    half = window // 2
    powers = np.arange(-half, half + 1)[:, None] ** np.arange(degree + 1)
    return np.linalg.pinv(powers)[derivative] * np.prod(np.arange(1, derivative + 1))


def polynomial(series: DataFrame, window: int, degree: int, by: list[str], order: str, value: str) -> DataFrame:
    """Smooth by polynomial windows. Before the first value comes what follows it, as far below it as it differs; after the last what
    precedes it, as far above."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y, half, w = pdf[value].to_numpy(float), window // 2, polynomial_weights(window, degree)
        k = min(half, len(y) - 1)
        head, tail = y[0] - np.abs(y[1 : k + 1][::-1] - y[0]), y[-1] + np.abs(y[-k - 1 : -1][::-1] - y[-1])
        padded = np.pad(np.concatenate([head, y, tail]), half - k, mode="edge")
        return pdf.assign(smooth=np.correlate(padded, w, "valid"))[[*by, order, "smooth"]]

    return series.groupBy(*by).applyInPandas(run, _schema(series, by, order))


def local_regression(series: DataFrame, span: float, by: list[str], order: str, value: str, weight: str | None = None) -> DataFrame:
    """LOESS: at each place a quadratic over the nearest ``span`` of the places, with tricube weights."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[order].to_numpy(float), pdf[value].to_numpy(float)
        own = pdf[weight].to_numpy(float) if weight else np.ones(len(x))
        k, out = min(len(x), max(3, int(np.ceil(span * len(x))))), np.empty(len(x))
        for i, at in enumerate(x):
            d = np.abs(x - at)
            reach = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3 * own
            root = np.sqrt(w)
            powers = (x - at)[:, None] ** np.arange(3)
            out[i] = np.linalg.lstsq(powers * root[:, None], y * root, rcond=None)[0][0]
        return pdf.assign(smooth=out)[[*by, order, "smooth"]]

    return series.groupBy(*by).applyInPandas(run, _schema(series, by, order))


def _schema(series: DataFrame, by: list[str], order: str) -> str:
    return ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in (*by, order)) + ", smooth double"
