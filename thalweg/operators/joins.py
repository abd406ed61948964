"""Joins on time: lags, as-of, nearest, intervals, forward horizons; and guards on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_join(x: DataFrame, y: DataFrame, lags: tuple[int, ...], time: str = "d", x_value: str = "x", y_value: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """(lag, time, target_time, x, y): x at t with y at t + lag days, for each lag; both must have a value."""
    if any(n < 0 for n in lags):
        raise ValueError("a lag is never negative")
    # the lags multiply x by a constant; one equi-join serves all
    spread = x.where(F.col(x_value).isNotNull()).select(*keys, time, x_value, F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("target_time", F.date_add(time, F.col("lag")))
    return spread.join(y.where(F.col(y_value).isNotNull()).select(*keys, F.col(time).alias("target_time"), y_value), [*keys, "target_time"])


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds value: that of the latest right row at or before a left row's time. One sort of both sides, no range join."""
    l = left.withColumn("_t", F.col(left_time).cast("timestamp_ntz")).withColumn("_s", F.lit(1))
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).cast("timestamp_ntz").alias("_t"), F.struct(F.col(value).alias("v")).alias("_v")).withColumn("_s", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)["v"]).where("_s = 1")
    return out.select(*left.columns, value)


def released(monthly: DataFrame, month: str, delay_days: int) -> DataFrame:
    """Adds release: the day after the month's end by which its value is public."""
    return monthly.withColumn("release", F.date_add(F.last_day(month), delay_days))


def nearest(left: DataFrame, right: DataFrame, on: tuple[str, ...], left_at: str, right_at: str, value: str, within: float) -> DataFrame:
    """Adds value and distance of the right row nearest in one coordinate, at most ``within`` away; the lower coordinate of two equally near.

    Both sides are cut into cells of width ``within``, so only neighbouring cells meet. Left rows find their match by keys and coordinate:
    a number given to a row would not be the same each time that the rows are read or computed.
    """
    cell = F.floor(F.col(left_at) / within)
    near = left.select(*on, left_at, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    r = right.select(*on, F.col(right_at).alias("_at"), F.col(value).alias("_v")).withColumn("_cell", F.floor(F.col("_at") / within))
    gap = F.abs(F.col("_at") - F.col(left_at))
    best = near.join(r, [*on, "_cell"]).where(gap <= within).groupBy(*on, left_at).agg(F.min(F.struct(gap.alias("distance"), F.col("_at"), F.col("_v"))).alias("_b"))
    return left.join(best, [*on, left_at], "left").select(*left.columns, F.col("_b._v").alias(value), F.col("_b.distance").alias("distance"))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, priority: Column) -> DataFrame:
    """Points with the interval that holds them, of several that of highest priority. Intervals are a table of events, broadcast if Spark finds it small."""
    hit = points.join(intervals, (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)), "left")
    w = Window.partitionBy(*points.columns).orderBy(priority.desc_nulls_last())
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def forward_max(df: DataFrame, horizon: int, keys: list[str] = (), day: str = "d", value: str = "x") -> DataFrame:
    """Adds forward_max and forward_time: the largest value from t to t + horizon days, the earliest of equal ones."""
    number = F.datediff(day, F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(0, horizon)
    best = F.max(F.struct(F.col(value).alias("v"), (-number).alias("n"))).over(w)
    return df.withColumn("_b", best).withColumn("forward_max", F.col("_b.v")).withColumn("forward_time", F.date_add(F.lit("1970-01-01").cast("date"), -F.col("_b.n"))).drop("_b")


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str, names: tuple[str, str] = ("with", "without")) -> DataFrame:
    """Rows of two runs by key with their difference; a key that is only on one side, or twice, raises when the row is read."""
    l = a.groupBy(*keys).agg(F.first(value).alias(f"{value}_{names[0]}"), F.count("*").alias("_n"))
    r = b.groupBy(*keys).agg(F.first(value).alias(f"{value}_{names[1]}"), F.count("*").alias("_m"))
    both = l.join(r, keys, "full")
    bad = F.col("_n").isNull() | F.col("_m").isNull() | (F.col("_n") > 1) | (F.col("_m") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unpaired key "), F.concat_ws(",", *keys))).cast("double")).otherwise(F.col(f"{value}_{names[0]}") - F.col(f"{value}_{names[1]}"))
    return both.withColumn("difference", checked).drop("_n", "_m")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises if a key is twice on the right."""
    one = right.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return left.join(one, keys, "left").where(F.coalesce(F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key on the right")).cast("boolean")), F.lit(True))).drop("_n")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that are only in a ("missing") or only in b ("extra")."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("extra")))


def coalesced(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """All keys of both, each value from the first side that has one."""
    s = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return first.join(s, keys, "full").select(*keys, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)
