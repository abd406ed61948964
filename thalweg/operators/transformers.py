"""Transformers that learn from training rows only, apply to all rows, and can be undone."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .climatology import fourier_design


class Harmonic(NamedTuple):
    """Fitted seasonal cycles: ``coefficients`` has a row a key (keys, coef, sd), and one with null keys for all rows."""

    keys: tuple[str, ...]
    coefficients: DataFrame
    day: str
    value: str
    harmonics: int
    trend: bool

    def _joined(self, df: DataFrame) -> tuple[DataFrame, Column, Column]:
        design = fourier_design(self.day, self.harmonics, self.trend)
        match = [df[k].eqNullSafe(self.coefficients[k]) for k in self.keys]
        rows = df.join(self.coefficients.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], "_coef", "_sd"), [df[k] == F.col(f"_k{i}") for i, k in enumerate(self.keys)], "left") if match else df.crossJoin(self.coefficients)
        fitted = sum((F.col("_coef")[i] * x for i, x in enumerate(design)), F.lit(0.0))
        return rows, fitted, F.col("_sd")

    def transform(self, df: DataFrame, out: str = "anomaly") -> DataFrame:
        """Adds fitted and the scaled anomaly; null where the key had too few training rows."""
        rows, fitted, sd = self._joined(df)
        return rows.withColumn("fitted", fitted).withColumn(out, F.try_divide(F.col(self.value) - F.col("fitted"), F.nullif(sd, F.lit(0.0)))).select(*df.columns, "fitted", out)

    def inverse(self, df: DataFrame, scaled: str = "anomaly", out: str = "restored", lower: float | None = None) -> DataFrame:
        """Adds the values that scaled anomalies stand for, at least ``lower``."""
        rows, fitted, sd = self._joined(df)
        value = F.col(scaled) * sd + fitted
        return rows.withColumn(out, F.greatest(value, F.lit(lower)) if lower is not None else value).select(*df.columns, out)


def fit_harmonic(df: DataFrame, train: Column, keys: list[str] = (), day: str = "d", value: str = "x", harmonics: int = 3, trend: bool = True, least: int | None = None) -> Harmonic:
    """Least squares on a Fourier calendar (and a trend) over the training rows of each key, and the deviation of its residuals.

    The normal equations and the squares of the values are sums, so a key of any number of rows is one row of sums, solved alone. The
    fitted table has one row a key and is joined, not broadcast.
    """
    design = fourier_design(day, harmonics, trend)
    p = len(design)
    needed = least or p + 2
    names = [f"_f{k}" for k in range(p)]
    rows = df.where(train & F.col(value).isNotNull()).withColumns(dict(zip(names, design, strict=True)))
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(names[i]) * F.col(value)).alias(f"b{i}") for i in range(p)]
    totals = rows.groupBy(*keys).agg(*sums, F.sum(F.col(value) * F.col(value)).alias("yy"), F.count("*").alias("rows"))

    @F.pandas_udf("array<double>")
    def solved(table: pd.DataFrame) -> pd.Series:
        out = []
        for r in table.to_dict("records"):
            a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
            b = np.array([r[f"b{i}"] for i in range(p)], float)
            out.append(np.linalg.lstsq(a, b, rcond=None)[0] if r["rows"] >= needed else None)
        return pd.Series(out)

    fit = totals.withColumn("_coef", solved(F.struct(*[c for c in totals.columns if c not in keys])))
    left = F.col("yy") - sum((F.col("_coef")[i] * F.col(f"b{i}") for i in range(p)), F.lit(0.0))
    fit = fit.withColumn("_sd", F.sqrt(F.greatest(left, F.lit(0.0)) / F.col("rows")))
    return Harmonic(tuple(keys), fit.select(*keys, "_coef", "_sd"), day, value, harmonics, trend)


class Seasonal(NamedTuple):
    """Fitted centres and scales of a rain-like target: centres (keys, slot, centre), scales (keys, pooled, scale)."""

    keys: tuple[str, ...]
    slots: DataFrame
    pooled: DataFrame
    day: str
    value: str
    floor: float

    def _joined(self, df: DataFrame) -> tuple[DataFrame, Column, Column]:
        rows = df.withColumn("_slot", F.weekofyear(self.day)).join(self.slots, [*self.keys, "_slot"], "left").join(self.pooled, list(self.keys), "left")
        return rows, F.coalesce("_centre", "_pooled"), F.greatest(F.col("_scale"), F.lit(self.floor))

    def transform(self, df: DataFrame, out: str = "z") -> DataFrame:
        rows, centre, scale = self._joined(df)
        return rows.withColumn(out, (F.col(self.value) - centre) / scale).select(*df.columns, out)

    def inverse(self, df: DataFrame, scaled: str = "z", out: str = "restored", lower: float | None = 0.0) -> DataFrame:
        """Adds the value of a score, not under the physical bound."""
        rows, centre, scale = self._joined(df)
        value = F.col(scaled) * scale + centre
        return rows.withColumn(out, F.greatest(value, F.lit(lower)) if lower is not None else value).select(*df.columns, out)


def fit_seasonal(df: DataFrame, train: Column, keys: list[str], day: str, value: str, floor: float = 0.1) -> Seasonal:
    """Median of each ISO week and the median absolute deviation from it, of training rows; an unseen week takes the pooled median."""
    rows = df.where(train & F.col(value).isNotNull()).withColumn("_slot", F.weekofyear(day))
    slots = rows.groupBy(*keys, "_slot").agg(F.median(value).alias("_centre"))
    spread = rows.join(slots, [*keys, "_slot"]).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("_centre"))) * 1.4826).alias("_scale"))
    pooled = rows.groupBy(*keys).agg(F.median(value).alias("_pooled")).join(spread, list(keys))
    return Seasonal(tuple(keys), slots, pooled, day, value, floor)
