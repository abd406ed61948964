"""Calendar operators: Sunday-ending weeks, months, completeness, densified axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_end(d: str | Column) -> Column:
    """The Sunday that ends a day's week (Monday to Sunday)."""
    return F.next_day(F.date_sub(d, 1), "SU")


def weekly_mean(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "v", days: int = 7) -> DataFrame:
    """(keys, week_end, value): mean of a week; null unless ``days`` days have a value."""
    return df.groupBy(*keys, week_end(day).alias("week_end")).agg(F.when(F.count(value) >= days, F.avg(value)).alias(value))


def weekly_sum(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "v", least: int = 7) -> DataFrame:
    """(keys, week_end, total, valid_days, expected_days, is_partial): sum of complete weeks; edges of the axis are kept, null and marked."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    weeks = df.groupBy(*keys, week_end(day).alias("week_end")).agg(F.sum(value).alias("s"), F.count(value).alias("valid_days")).crossJoin(F.broadcast(bounds))
    first = F.greatest(F.date_sub("week_end", 6), "lo")
    expected = F.datediff(F.least("week_end", "hi"), first) + 1
    full = (F.col("valid_days") >= least) & (expected == 7)
    return weeks.select(*keys, "week_end", F.when(full, F.col("s")).alias("total"), "valid_days", expected.alias("expected_days"), (expected < 7).alias("is_partial"))


def weekly_mode(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "v") -> DataFrame:
    """(keys, week_end, mode): most frequent value of a week, the smallest of equal ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, week_end(day).alias("week_end"), value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "week_end").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("mode"))).alias("m")).select(*keys, "week_end", "m.mode")


def monthly_mean(df: DataFrame, keys: list[str] = (), day: str = "d", value: str = "x") -> DataFrame:
    """(keys, month, mean, valid_days, is_complete)."""
    out = df.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("valid_days"))
    return out.withColumn("is_complete", F.col("valid_days") >= F.dayofmonth(F.last_day("month")))


def daily(df: DataFrame, ts: str, means: list[str] = (), sums: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Sub-daily rows to days: instantaneous columns as means, accumulated ones as sums."""
    return df.groupBy(*keys, F.to_date(ts).alias("d")).agg(*[F.avg(c).alias(f"{c}_mean") for c in means], *[F.sum(c).alias(f"{c}_sum") for c in sums], F.count("*").alias("n"))


def axis(df: DataFrame, day: str, step: str = "1 day", name: str = "d") -> DataFrame:
    """Every step between the first and the last day."""
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(name))


def densified(df: DataFrame, day: str = "d", step: str = "1 day") -> DataFrame:
    """The rows on a regular axis, null where there was none."""
    return axis(df, day, step, day).join(df, day, "left")


def missing_steps(df: DataFrame, day: str = "d", step: str = "1 day") -> DataFrame:
    """Steps of the regular axis that have no row."""
    return axis(df, day, step, day).join(df.select(day), day, "left_anti")


def anchored_bins(df: DataFrame, origin: str, width: int = 7, day: str = "d", value: str = "x") -> DataFrame:
    """(bin_start, mean, n): bins of ``width`` days from an arbitrary origin."""
    start = F.date_add(F.lit(origin).cast("date"), (F.floor(F.datediff(day, F.lit(origin).cast("date")) / width) * width).cast("int"))
    return df.groupBy(start.alias("bin_start")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def lunar_phase(day: Column, anchor: str = "2000-01-06", synodic: float = 29.530588853) -> Column:
    """Name of the moon's phase: quartiles of the cycle, centred on the new moon."""
    cycle = F.pmod(F.datediff(day, F.lit(anchor).cast("date")) / synodic, F.lit(1.0))
    quarter = F.floor(F.pmod(cycle + 0.125, F.lit(1.0)) * 4)
    return F.when(quarter == 0, "new").when(quarter == 1, "first_quarter").when(quarter == 2, "full").otherwise("last_quarter")


def season(day: str | Column) -> Column:
    month = F.month(day)
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def month_distance(a: Column, b: Column) -> Column:
    """Whole calendar months from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
