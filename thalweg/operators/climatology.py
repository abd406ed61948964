"""Climatologies, anomalies and standardisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gammainc, ndtri


def _circular(slots: DataFrame, keys: list[str], slot: str, size: int, width: int, values: list[str]) -> DataFrame:
    """Centred mean of ``width`` slots around each, the axis closed to a circle of ``size`` slots."""
    half = width // 2
    near = slots.withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(slot, (F.pmod(F.col(slot) + F.col("_o") - 1, F.lit(size)) + 1).cast("int"))
    return near.groupBy(*keys, slot).agg(*[F.avg(v).alias(v) for v in values])


def doy_climatology(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "x", base: tuple[str, str] | None = None, width: int = 15) -> DataFrame:
    """(keys, doy, clim, sd): mean and sample deviation of each day of the year over the base, smoothed on a circle of 366 days."""
    rows = df.where(F.col(day).between(*[F.lit(b).cast("date") for b in base])) if base else df
    slots = rows.groupBy(*keys, F.dayofyear(day).alias("doy")).agg(F.avg(value).alias("clim"), F.stddev_samp(value).alias("sd"))
    return _circular(slots, list(keys), "doy", 366, width, ["clim", "sd"])


def daily_anomaly(df: DataFrame, clim: DataFrame, keys: list[str] = (), day: str = "d", value: str = "x") -> DataFrame:
    """Adds anomaly, and standardized (null for a deviation of 0)."""
    out = df.withColumn("doy", F.dayofyear(day)).join(F.broadcast(clim) if not keys else clim, [*keys, "doy"], "left")
    anomaly = F.col(value) - F.col("clim")
    return out.withColumn("anomaly", anomaly).withColumn("standardized", F.try_divide(anomaly, F.nullif("sd", F.lit(0.0))))


def monthly_anomaly(monthly: DataFrame, keys: list[str] = (), value: str = "m") -> DataFrame:
    """Adds anomaly against the mean of the month of the year."""
    return monthly.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*keys, F.month("month"))))


def base_zscore(df: DataFrame, base: Column, keys: list[str] = (), value: str = "x", ddof: int = 1) -> DataFrame:
    """Adds z on the base period's mean and deviation."""
    w = Window.partitionBy(*keys)
    kept = F.when(base, F.col(value))
    sd = (F.stddev_samp(kept) if ddof else F.stddev_pop(kept)).over(w)
    return df.withColumn("z", F.try_divide(F.col(value) - F.avg(kept).over(w), F.nullif(sd, F.lit(0.0))))


def source_detrended(df: DataFrame, keys: list[str], base: Column, day: str = "d", value: str = "x", least: int = 3) -> DataFrame:
    """Adds detrended: each source's linear trend over its base rows, removed about the base's centre; unchanged with too few rows."""
    t = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double")
    fit = df.where(base & F.col(value).isNotNull()).groupBy(*keys).agg(F.regr_slope(F.col(value), t).alias("slope"), F.avg(t).alias("centre"), F.count("*").alias("rows"))
    out = df.join(fit, keys, "left")
    return out.withColumn("detrended", F.when(F.col("rows") >= least, F.col(value) - F.col("slope") * (t - F.col("centre"))).otherwise(F.col(value))).drop("rows", "centre")


def iso_week_robust(weekly: DataFrame, keys: list[str] = (), week_end: str = "week_end", value: str = "v", least_years: int = 3, floor: float = 0.1) -> DataFrame:
    """Adds centre (median of the ISO week), scale (largest of seasonal and pooled MAD and pooled mean deviation), z, and the scale's source.

    Week 53 takes the rows of weeks 52, 53 and 1; with too few years the centre is the pooled median.
    """
    rows = weekly.withColumn("week", F.weekofyear(week_end))
    spread = rows.withColumn("_w", F.explode(F.when(F.col("week").isin(52, 1), F.array("week", F.lit(53))).otherwise(F.array("week"))))
    # the slot of week 53 also holds its neighbours, every other slot its own rows
    centres = spread.groupBy(*keys, F.col("_w").alias("week")).agg(F.median(value).alias("slot"), F.count(value).alias("n"))
    pooled = rows.groupBy(*keys).agg(F.median(value).alias("pooled"))
    joined = rows.join(centres, [*keys, "week"], "left")
    joined = joined.join(pooled, keys, "left") if keys else joined.crossJoin(F.broadcast(pooled))
    joined = joined.withColumn("centre", F.when(F.col("n") >= least_years, F.col("slot")).otherwise(F.col("pooled"))).withColumn("dev", F.abs(F.col(value) - F.col("centre")))
    seasonal = joined.groupBy(*keys, "week").agg((F.median("dev") * 1.4826).alias("mad_season"))
    total = joined.groupBy(*keys).agg((F.median("dev") * 1.4826).alias("mad_pool"), (F.avg("dev") * math.sqrt(math.pi / 2)).alias("l1_pool"))
    joined = joined.join(seasonal, [*keys, "week"], "left")
    joined = joined.join(total, keys, "left") if keys else joined.crossJoin(F.broadcast(total))
    scales = ["mad_season", "mad_pool", "l1_pool"]
    kept = [F.when(F.col(s) >= floor, F.col(s)) for s in scales]
    best = F.greatest(*kept)
    source = F.coalesce(*[F.when(k == best, F.lit(s)) for k, s in zip(kept, scales, strict=True)])
    return joined.select(*weekly.columns, "week", "centre", best.alias("scale"), source.alias("scale_source"), ((F.col(value) - F.col("centre")) / best).alias("z"))


def iso_week_anomaly(weekly: DataFrame, keys: list[str] = (), week_end: str = "week_end", value: str = "v", base: tuple[str, str] | None = None, width: int = 5) -> DataFrame:
    """Adds anomaly against the mean of the ISO week over the base, smoothed over ``width`` weeks on a circle of 53."""
    rows = weekly.withColumn("_week", F.weekofyear(week_end))
    kept = rows.where(F.col(week_end).between(*[F.lit(b).cast("date") for b in base])) if base else rows
    slots = kept.groupBy(*keys, "_week").agg(F.avg(value).alias("_clim"))
    joined = rows.join(_circular(slots, list(keys), "_week", 53, width, ["_clim"]), [*keys, "_week"], "left")
    return joined.withColumn("anomaly", F.col(value) - F.col("_clim")).drop("_week", "_clim")


def fourier_design(day: str | Column, harmonics: int = 3, trend: bool = False) -> list[Column]:
    """1, sin k theta, cos k theta, with theta of the day of the year; and with ``trend`` years since 2000."""
    theta = (F.dayofyear(day) - 1) * (2 * math.pi / 365.2425)
    out = [F.lit(1.0)]
    for k in range(1, harmonics + 1):
        out += [F.sin(theta * k), F.cos(theta * k)]
    if trend:
        out.append(F.datediff(day, F.lit("2000-01-01").cast("date")) / 365.2425)
    return out


def harmonic_anomaly(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "x", harmonics: int = 3, trend: bool = False, base: Column | None = None) -> DataFrame:
    """Adds fitted and anomaly of least squares on a Fourier calendar, fitted on the base.

    The normal equations are sums, so any number of rows meets as one row of them per key; each is solved alone.
    """
    design = fourier_design(day, harmonics, trend)
    p = len(design)
    names = [f"_f{k}" for k in range(p)]
    rows = df.withColumns(dict(zip(names, design, strict=True)))
    fit = rows.where((base if base is not None else F.lit(True)) & F.col(value).isNotNull())
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(F.col(names[i]) * F.col(value)).alias(f"b{i}") for i in range(p)]
    kept = fit.groupBy(*keys).agg(*sums, F.count("*").alias("rows"))

    @F.pandas_udf("array<double>")
    def solved(table: pd.DataFrame) -> pd.Series:
        out = []
        for r in table.itertuples(index=False):
            a = np.array([[getattr(r, f"a{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)], float)
            b = np.array([getattr(r, f"b{i}") for i in range(p)], float)
            out.append(np.linalg.lstsq(a, b, rcond=None)[0] if r.rows >= p + 2 else np.full(p, np.nan))
        return pd.Series(out)

    coefficients = kept.select(*keys, solved(F.struct(*[c for c in kept.columns if c not in keys])).alias("_c"))
    joined = rows.join(coefficients, list(keys), "left") if keys else rows.crossJoin(F.broadcast(coefficients))
    fitted = sum((F.col("_c")[k] * F.col(names[k]) for k in range(1, p)), F.col("_c")[0] * F.col(names[0]))
    return joined.withColumn("fitted", fitted).withColumn("anomaly", F.col(value) - F.col("fitted")).drop(*names, "_c")


def spi(weekly: DataFrame, keys: list[str] = (), week_end: str = "week_end", value: str = "v", weeks: int = 4) -> DataFrame:
    """Adds accumulated and spi: the standard score of k-week sums by a moment-fitted gamma distribution of each ISO week."""
    w = Window.partitionBy(*keys).orderBy(week_end).rowsBetween(1 - weeks, 0)
    rows = weekly.withColumn("accumulated", F.when(F.count(value).over(w) == weeks, F.sum(value).over(w))).withColumn("week", F.weekofyear(week_end))
    wet = F.when(F.col("accumulated") > 0, F.col("accumulated"))
    fit = rows.groupBy(*keys, "week").agg(F.avg(wet).alias("mean"), F.var_samp(wet).alias("var"), F.avg(F.when(F.col("accumulated") == 0, 1.0).when(F.col("accumulated").isNotNull(), 0.0)).alias("q"))
    joined = rows.join(fit, [*keys, "week"], "left")

    @F.pandas_udf("double")
    def score(x: pd.Series, mean: pd.Series, var: pd.Series, q: pd.Series) -> pd.Series:
        x, mean, var, q = (s.to_numpy(float) for s in (x, mean, var, q))
        with np.errstate(all="ignore"):
            shape, scale = mean**2 / var, var / mean
            p = np.where(x == 0, q / 2, q + (1 - q) * gammainc(shape, x / scale))
        ok = np.isfinite(x) & ((x == 0) | (var > 0))
        return pd.Series(np.where(ok, ndtri(np.clip(p, 1e-6, 1 - 1e-6)), np.nan)).replace({np.nan: None})

    return joined.withColumn("spi", score("accumulated", "mean", "var", "q")).drop("mean", "var", "q")
