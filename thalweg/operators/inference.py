"""More inference: partial correlation, paired tests, tails, regression within events, resampling, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_two_sided
from ..functions.text import hash32
from .stats import pearson


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, control: str) -> DataFrame:
    """(keys, n, r): correlation of what a linear fit on the control leaves of both."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    c = ok.groupBy(*keys).agg(F.count("*").alias("n"), pearson(x, y).alias("a"), pearson(x, control).alias("b"), pearson(y, control).alias("c"))
    r = F.try_divide(F.col("a") - F.col("b") * F.col("c"), F.nullif(F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c"))), F.lit(0.0)))
    return c.select(*keys, "n", r.alias("r"))


def wilcoxon(df: DataFrame, keys: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """(keys, n, w_plus, w_minus, z): signed ranks of differences, zeros left out; null z under ``least`` differences."""
    rows = df.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d") != 0).withColumn("_m", F.round(F.abs("_d"), 9))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy("_m")) + (F.count("*").over(Window.partitionBy(*keys, "_m")) - 1) / 2.0
    out = rows.withColumn("_r", rank).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n")
    return out.withColumn("z", F.when(n >= least, (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0)))


def power_tail(df: DataFrame, keys: list[str], value: str, xmin: float) -> DataFrame:
    """(keys, n, alpha): maximum-likelihood exponent of the values of ``xmin`` or more."""
    rows = df.where(F.col(value) >= xmin)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (1 + F.try_divide(F.count("*").cast("double"), F.nullif(F.sum(F.log(F.col(value) / xmin)), F.lit(0.0)))).alias("alpha"))


def event_regression(df: DataFrame, event: str, x: str, y: str, order: str, lags: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, n_events, slope, se, t): least squares with Bartlett-weighted errors that never reach over an event's end."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x) - F.avg(x).over(w))
    rows = rows.withColumn("_b", F.regr_slope(y, x).over(w)).withColumn("_g", F.col("_x") * (F.col(y) - F.avg(y).over(w) - F.col("_b") * F.col("_x")))
    inside = Window.partitionBy(*keys, event).orderBy(order)
    meat = F.col("_g") * F.col("_g")
    for k in range(1, lags + 1):
        meat = meat + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col("_g") * F.lag("_g", k).over(inside), F.lit(0.0))
    rows = rows.withColumn("_m", meat)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(event).alias("n_events"), F.first("_b").alias("slope"), (F.sqrt(F.greatest(F.lit(0.0), F.sum("_m"))) / F.sum(F.col("_x") * F.col("_x"))).alias("se"))
    return out.withColumn("t", F.try_divide("slope", F.nullif("se", F.lit(0.0))))


def drawn_units(units: DataFrame, keys: list[str], unit: str, draws: int, seed: int = 42) -> DataFrame:
    """(keys, unit, draw, times): how often each unit of a key is taken in each draw with replacement. A key has few units (years, events)."""
    by = Window.partitionBy(*keys)
    known = units.select(*keys, unit).withColumn("_i", (F.row_number().over(by.orderBy(unit)) - 1).cast("long")).withColumn("_n", F.count("*").over(by))
    slots = known.select(*keys, "_n", F.col("_i").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.withColumn("_i", F.floor(hash32(F.lit(seed), F.col("draw"), F.col("_slot")) * F.col("_n") / 4294967296).cast("long"))
    return picks.groupBy(*keys, "draw", "_i").agg(F.count("*").alias("times")).join(known.select(*keys, "_i", unit), [*keys, "_i"]).drop("_i")


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, unit: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """(keys, n_units, mean, low, high): percentile interval of the mean over units drawn with replacement.

    A draw takes as many units of a key as it has; hashes say which, so it is the same each time.
    """
    each = df.groupBy(*keys, unit).agg(F.avg(value).alias("_v"))
    taken = drawn_units(each, keys, unit, draws, seed)
    means = taken.join(each, [*keys, unit]).groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("_v") * F.col("times")), F.sum("times").cast("double")).alias("_m"))
    spread = means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    centre = each.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("_v").alias("mean"))
    return centre.join(spread, keys) if keys else centre.crossJoin(spread)


def confirmatory_gate(df: DataFrame, q: str, p_field: str, same_sign: str, n_events: str, alpha: float = 0.05) -> Column:
    """Verdict of the first test in order that fails: multiplicity, field, stability; else confirmed."""
    return (
        F.when(F.col(q).isNull() | (F.col(q) > alpha), "not_significant")
        .when(F.col(p_field).isNull() | (F.col(p_field) > alpha), "field_not_significant")
        .when((F.col(n_events) < 5) | (F.col(same_sign) < 0.8), "unstable")
        .otherwise("confirmed")
    )


def field_significance(signal: DataFrame, field: DataFrame, cell: str, order: str, x: str, y: str, lags: tuple[int, ...], margin: int = 26, alpha: float = 0.05, least: int = 30, step_days: int = 7) -> DataFrame:
    """(lag, cells, fraction, n_shifts, p_lag, p_field): whether more of the field is correlated with a signal than by chance.

    ``fraction`` is the share of cells (with ``least`` pairs) whose correlation at a lag, in steps, has p <= ``alpha``. The
    null rolls the whole field by every common offset from the longest lag plus ``margin`` to as much before the axis' end,
    p = (1 + number of offsets with as large a share) / (1 + number of offsets); ``p_field`` takes each offset's largest
    share of all lags. Both are null for an axis of under three times that margin. Seasons should have been taken away before.
    """
    far = max(lags) + margin
    axis = field.agg(F.min(order).alias("_first"), (F.datediff(F.max(order), F.min(order)) / step_days + 1).cast("int").alias("_n"))
    step = (F.datediff(order, "_first") / step_days).cast("int")
    pairs = lambda v: F.sort_array(F.collect_list(F.when(F.col(v).isNotNull(), F.struct(step.alias("i"), F.col(v).cast("double").alias("v")))))
    one = signal.crossJoin(F.broadcast(axis)).agg(pairs(x).alias("_x"))
    each = field.crossJoin(F.broadcast(axis)).groupBy(cell, "_n").agg(pairs(y).alias("_y")).crossJoin(F.broadcast(one))
    each = each.select("_n", *[F.col(f"{c}.{k}").alias(f"{c}{k}") for c in ("_x", "_y") for k in "iv"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[int, int], list[int]] = {}
            for n, xi, xv, yi, yv in pdf.itertuples(index=False):
                v = np.full(n, np.nan)
                v[yi] = yv
                v -= np.mean(yv) if len(yv) else 0
                offsets = np.r_[0, np.arange(far, n - far + 1)] if n >= 3 * far else np.zeros(1, np.int64)
                rolled = v[(np.arange(n) - offsets[:, None]) % n]
                has = np.isfinite(rolled)
                b = np.where(has, rolled, 0)
                for lag in lags:
                    a, on = np.zeros(n), np.zeros(n)
                    ok = (xi + lag >= 0) & (xi + lag < n)
                    a[xi[ok] + lag], on[xi[ok] + lag] = xv[ok] - np.mean(xv), 1
                    m, sx, sxx, sy, syy, sxy = has @ on, has @ a, has @ (a * a), b @ on, (b * b) @ on, b @ a
                    with np.errstate(all="ignore"):
                        r = np.clip((m * sxy - sx * sy) / np.sqrt((m * sxx - sx * sx) * (m * syy - sy * sy)), -1, 1)
                        p = t_two_sided(np.abs(r * np.sqrt((m - 2) / np.maximum(1 - r * r, 1e-15))), np.maximum(m - 2, 1e-9))
                    valid = np.isfinite(r) & (m >= max(least, 3))
                    for s, c, h in zip(offsets.tolist(), valid.tolist(), (valid & (p <= alpha)).tolist(), strict=True):
                        got = found.setdefault((s, lag), [0, 0])
                        got[0] += c
                        got[1] += h
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["shift", "lag", "cells", "hits"])

    share = each.mapInPandas(run, "shift int, lag int, cells long, hits long").groupBy("shift", "lag").agg(F.sum("cells").alias("cells"), F.try_divide(F.sum("hits"), F.sum("cells")).alias("fraction"))
    null = share.where("shift <> 0").select("lag", F.col("fraction").alias("_f"), F.max("fraction").over(Window.partitionBy("shift")).alias("_top"))
    p = lambda c: F.when(F.col("fraction").isNotNull() & (F.count(c) > 0), (1 + F.count_if(F.col(c) >= F.col("fraction"))) / (1 + F.count(c)))
    return share.where("shift = 0").join(null, "lag", "left").groupBy("lag", "cells", "fraction").agg(F.count("_f").alias("n_shifts"), p("_f").alias("p_lag"), p("_top").alias("p_field"))


def rolled_events(df: DataFrame, event: str, order: str, value: str, shift: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds rolled: the values of each event (of a key) rolled round by ``shift`` places."""
    w = Window.partitionBy(*keys, event)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    other = rows.select(*keys, event, F.pmod(F.col("_i") + shift, F.col("_n")).alias("_i"), F.col(value).alias("rolled"))
    return rows.join(other, [*keys, event, "_i"]).drop("_i", "_n")


def picked_peaks(df: DataFrame, keys: list[str], day: str, value: str, least: float, apart_days: int, most: int) -> DataFrame:
    """(keys, rank, day, value): the highest values in turn, none within ``apart_days`` of a higher one that was taken. One short series a key."""
    kinds = {c: k for c, k in df.dtypes}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "rank int", f"{day} date", f"{value} double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf[value] >= least].sort_values([value, day], ascending=[False, True])
        out: list[tuple] = []
        for d, v in zip(pd.to_datetime(rows[day]), rows[value], strict=True):
            if len(out) == most:
                break
            if all(abs((d - o[0]).days) > apart_days for o in out):
                out.append((d, float(v)))
        return pd.DataFrame([(*key, i + 1, d.date(), v) for i, (d, v) in enumerate(out)], columns=[*keys, "rank", day, value])

    return df.select(*keys, day, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(run, schema)
