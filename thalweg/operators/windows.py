"""Window operators over time axes. A global axis of days or months is a dimension; fields are always partitioned by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def centred_mean(value: str, width: int, least: int, keys: list[str], order: str) -> Column:
    """Mean of the ``width`` rows around each row; null under ``least`` values."""
    w = _by(keys, order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def trailing_sum(value: str, width: int, keys: list[str], order: str) -> Column:
    """Sum of the last ``width`` rows; null unless all have values."""
    w = _by(keys, order).rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(w) == width, F.sum(value).over(w))


def history_features(df: DataFrame, value: str, widths: tuple[int, ...], keys: list[str], order: str) -> DataFrame:
    """Adds mean_w (of what there is) and delta_w (against w rows before) for each width."""
    w = _by(keys, order)
    return df.withColumns({f"mean_{n}": F.avg(value).over(w.rowsBetween(1 - n, 0)) for n in widths} | {f"delta_{n}": F.col(value) - F.lag(value, n).over(w) for n in widths})


def lagged(df: DataFrame, value: str, lags: tuple[int, ...], keys: list[str], order: str, suffix: str = "") -> DataFrame:
    """Adds value_lagL, the value L rows before."""
    w = _by(keys, order)
    return df.withColumns({f"{value}_lag{n}{suffix}": F.lag(value, n).over(w) for n in lags})


def led(df: DataFrame, value: str, leads: tuple[int, ...], keys: list[str], order: str) -> DataFrame:
    """Adds value_leadH, the value H rows after; null beyond the end."""
    w = _by(keys, order)
    return df.withColumns({f"{value}_lead{n}": F.lead(value, n).over(w) for n in leads})


def islands(df: DataFrame, state: str, keys: list[str], order: str, position: Column | None = None) -> DataFrame:
    """Adds run, equal for neighbours of one state; with ``position`` (a step number) a missing step breaks a run."""
    w = _by(keys, order)
    step = position if position is not None else F.row_number().over(w)
    out = df.withColumn("_p", step)
    return out.withColumn("run", F.col("_p") - F.row_number().over(Window.partitionBy(*keys, state).orderBy(order))).drop("_p")


def run_duration(df: DataFrame, state: str, keys: list[str], order: str) -> DataFrame:
    """Adds run and duration, the place of a row in its run."""
    return islands(df, state, keys, order).withColumn("duration", F.row_number().over(Window.partitionBy(*keys, state, "run").orderBy(order)))


def coverage(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """(keys, n, valid_share, first_valid, last_valid, longest_gap)."""
    marked = islands(df.withColumn("_ok", F.col(value).isNotNull()), "_ok", keys, order)
    gaps = marked.groupBy(*keys, "_ok", "run").agg(F.count("*").alias("size"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.sum(F.col("_ok").cast("int")).alias("valid"))
    return gaps.groupBy(*keys).agg(
        F.sum("size").alias("n"), (F.sum("valid") / F.sum("size")).alias("valid_share"), F.min(F.when(F.col("_ok"), F.col("lo"))).alias("first_valid"),
        F.max(F.when(F.col("_ok"), F.col("hi"))).alias("last_valid"), F.coalesce(F.max(F.when(~F.col("_ok"), F.col("size"))), F.lit(0)).cast("long").alias("longest_gap"),
    )


def tendency(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Adds the change per elapsed day; the first row, which has none, is left out."""
    w = _by(keys, order)
    days = F.datediff(order, F.lag(order).over(w))
    return df.withColumn("tendency", (F.col(value) - F.lag(value).over(w)) / days).where(F.col("tendency").isNotNull())


def seams(df: DataFrame, code: str, value: str, keys: list[str], order: str, width: int = 26, limit: float = 2.0) -> DataFrame:
    """Rows at which the source changes, with the means before and after and whether they differ by over ``limit`` pooled deviations."""
    w = _by(keys, order)
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    out = df.select(
        *keys, order, code, F.lag(code).over(w).alias("before_code"), F.avg(value).over(before).alias("before"), F.avg(value).over(after).alias("after"),
        F.sqrt((F.var_samp(value).over(before) + F.var_samp(value).over(after)) / 2).alias("sd"),
    )
    z = F.try_divide(F.col("after") - F.col("before"), F.col("sd"))
    return out.where(F.col("before_code") != F.col(code)).withColumn("z", z).withColumn("is_seam", F.abs(z) > limit)
