"""Threshold-run events, their peaks and life-cycles, and daily extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import week_end
from .windows import islands


def threshold_events(series: DataFrame, value: str = "oni", month: str = "month", threshold: float = 0.5, least: int = 5) -> DataFrame:
    """(event_id, event_type, onset, peak_time, end, months, peak_value): runs of ``least`` consecutive months at or beyond the threshold.

    A missing month breaks a run. The peak is the first of equal maxima. The axis of months is one short series.
    """
    sign = F.when(F.col(value) >= threshold, 1).when(F.col(value) <= -threshold, -1).otherwise(0)
    number = F.year(month) * 12 + F.month(month)
    rows = islands(series.where(F.col(value).isNotNull()).withColumn("sign", sign), "sign", [], month, number).where("sign <> 0")
    best = F.max_by(F.struct(F.col(month).alias("t"), F.col(value).alias("v")), F.struct(F.abs(value), -number))
    runs = rows.groupBy("sign", "run").agg(F.min(month).alias("onset"), F.max(month).alias("end"), F.count("*").alias("months"), best.alias("p")).where(F.col("months") >= least)
    kind = F.when(F.col("sign") > 0, "warm").otherwise("cold")
    years = F.when(F.year("onset") == F.year("end"), F.year("onset").cast("string")).otherwise(F.concat_ws("_", F.year("onset"), F.year("end")))
    return runs.select(F.concat_ws("_", kind, years).alias("event_id"), kind.alias("event_type"), "onset", F.col("p.t").alias("peak_time"), "end", "months", F.col("p.v").alias("peak_value"))


def within_years(rows: DataFrame, at: str, events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Pairs of rows and events whose span touches the row's year: an equi-join, on which conditions of time follow."""
    spans = events.withColumn("_year", F.explode(F.sequence(F.year(start), F.year(end))))
    return rows.withColumn("_year", F.year(at)).join(spans, "_year").drop("_year")


def peak_band(events: DataFrame, series: DataFrame, fraction: float, value: str = "oni", month: str = "month") -> DataFrame:
    """(event_id, peak_band_start, peak_band_end): the months around the peak without a gap at ``fraction`` of it or more."""
    rows = within_years(series, month, events, F.col("onset"), F.col("end")).where((F.col(month) >= F.col("onset")) & (F.col(month) <= F.col("end")))
    rows = rows.where(F.abs(value) >= F.abs("peak_value") * fraction)
    rows = islands(rows.withColumn("one", F.lit(1)), "one", ["event_id"], month, F.year(month) * 12 + F.month(month))
    bands = rows.groupBy("event_id", "run").agg(F.min(month).alias("peak_band_start"), F.last_day(F.max(month)).alias("peak_band_end"), F.max((F.col(month) == F.col("peak_time")).cast("int")).alias("has_peak"))
    return bands.where("has_peak = 1").select("event_id", "peak_band_start", "peak_band_end")


def lifecycle(weeks: DataFrame, events: DataFrame, bands: DataFrame, week: str = "week_end", genesis_weeks: int = 26) -> DataFrame:
    """(week, event_type, phase, event_id, weeks_from_peak): growth, peak and decay inside an event, genesis before it where nothing else is.

    Where events overlap, the one of later onset holds the week; of genesis windows, that of the nearest onset. Events that share an
    identifier (two of a type with the same years) share their bands too, of which the later holds.
    """
    e = events.join(bands, "event_id").withColumn("close", F.last_day("end"))
    inside = (F.col(week) >= F.col("onset")) & (F.col(week) <= F.col("close"))
    before = (F.col(week) < F.col("onset")) & (F.col(week) >= F.date_sub("onset", 7 * genesis_weeks))
    phase = F.when(before, "genesis").when(F.col(week) < F.col("peak_band_start"), "growth").when(F.col(week) <= F.col("peak_band_end"), "peak").otherwise("decay")
    rank = F.struct(inside.cast("int").alias("active"), F.when(inside, F.datediff("onset", F.lit("1970-01-01"))).otherwise(-F.datediff("onset", F.lit("1970-01-01"))).alias("order"), "peak_band_start")
    hit = within_years(weeks.select(week), week, e, F.date_sub("onset", 7 * genesis_weeks), F.col("close")).where(inside | before).groupBy(week)
    held = hit.agg(F.max_by(F.struct("event_type", phase.alias("phase"), "event_id", F.floor(F.datediff(week, "peak_time") / 7).alias("weeks_from_peak")), rank).alias("h"))
    out = weeks.select(week).distinct().join(held, week, "left")
    return out.select(week, F.coalesce("h.event_type", F.lit("neutral")).alias("event_type"), F.coalesce("h.phase", F.lit("neutral")).alias("phase"), F.col("h.event_id").alias("event_id"), F.col("h.weeks_from_peak").alias("weeks_from_peak"))


def state_label(event_type: str = "event_type", phase: str = "phase") -> Column:
    """One of nine states: neutral, or type and phase."""
    return F.when(F.col(event_type) == "neutral", "neutral").otherwise(F.concat_ws("_", event_type, phase))


def gap_tolerant_runs(series: DataFrame, value: str, month: str, threshold: float, least: int) -> DataFrame:
    """(run_no, start, end, months, top): runs over rows as they stand, so that a missing month does not break one."""
    rows = islands(series.where(F.col(value).isNotNull()).withColumn("on", F.col(value) >= threshold), "on", [], month).where("on")
    runs = rows.groupBy("run").agg(F.min(month).alias("start"), F.max(month).alias("end"), F.count("*").alias("months"), F.max(value).alias("top")).where(F.col("months") >= least)
    return runs.withColumn("run_no", F.row_number().over(Window.orderBy("start"))).drop("run")


def percentile_runs(df: DataFrame, keys: list[str], share: float, least: int, day: str = "d", value: str = "v") -> DataFrame:
    """(keys, onset, peak_time, end, days, top, mean, cumulative, centroid): runs of ``least`` days over the cell's percentile.

    Values are the excess over the threshold; the centroid is the intensity-weighted mean day.
    """
    limits = df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("limit"))
    rows = df.join(limits, keys).withColumn("excess", F.col(value) - F.col("limit")).withColumn("on", F.col("excess") > 0)
    number = F.datediff(day, F.lit("1970-01-01"))
    rows = islands(rows, "on", keys, day, number).where("on").withColumn("n", number)
    runs = rows.groupBy(*keys, "run").agg(
        F.min(day).alias("onset"), F.min_by(F.col(day), F.struct(-F.col("excess"), F.col("n"))).alias("peak_time"), F.max(day).alias("end"), F.count("*").alias("days"),
        F.max("excess").alias("top"), F.avg("excess").alias("mean"), F.sum("excess").alias("cumulative"), (F.sum(F.col("n") * F.col("excess")) / F.sum("excess")).alias("centroid"),
    )
    return runs.where(F.col("days") >= least).drop("run")


def dry_wet(df: DataFrame, keys: list[str], low: float = 0.1, high: float = 0.9, value: str = "v") -> DataFrame:
    """Adds is_dry and is_wet by the cell's percentiles, ends included."""
    limits = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("dry_limit"), F.percentile(value, F.lit(high)).alias("wet_limit"))
    out = df.join(limits, keys)
    return out.withColumn("is_dry", F.col(value) <= F.col("dry_limit")).withColumn("is_wet", F.col(value) >= F.col("wet_limit"))


def weekly_extremes(df: DataFrame, keys: list[str], day: str = "d", value: str = "v", wet: float = 1.0, share: float = 0.95, least_wet: int = 100) -> DataFrame:
    """(keys, week_end, rx1, rx5, r95, cdd, cwd): largest day, largest five-day sum inside the week, rain over the wet-day percentile,
    longest dry and wet runs inside the week. A missing day ends a run; the percentile needs ``least_wet`` wet days."""
    rows = df.withColumn("week_end", week_end(day)).withColumn("is_wet", F.col(value) >= wet)
    number = F.datediff(day, F.lit("1970-01-01"))
    limit = df.where(F.col(value) >= wet).groupBy(*keys).agg(F.when(F.count("*") >= least_wet, F.percentile(value, F.lit(share))).alias("limit"))
    span = Window.partitionBy(*keys, "week_end").orderBy(number).rangeBetween(-4, 0)
    rows = rows.join(limit, keys, "left").withColumn("five", F.when(F.count(value).over(span) == 5, F.sum(value).over(span)))
    rows = islands(rows, "is_wet", [*keys, "week_end"], day, number)
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "week_end", "is_wet", "run")))
    return rows.groupBy(*keys, "week_end").agg(
        F.max(value).alias("rx1"), F.max("five").alias("rx5"), F.when(F.max("limit").isNotNull(), F.sum(F.when(F.col(value) > F.col("limit"), F.col(value)).otherwise(0.0))).alias("r95"),
        F.coalesce(F.max(F.when(~F.col("is_wet"), F.col("size"))), F.lit(0)).cast("long").alias("cdd"), F.coalesce(F.max(F.when(F.col("is_wet"), F.col("size"))), F.lit(0)).cast("long").alias("cwd"),
    )


def group_id(phase_table: DataFrame, week: str = "week_end") -> DataFrame:
    """Adds group_id: the event, or neutral_<year>Q<n>."""
    return phase_table.withColumn("group_id", F.coalesce("event_id", F.concat(F.lit("neutral_"), F.year(week).cast("string"), F.lit("Q"), F.quarter(week).cast("string"))))


def event_targets(events: DataFrame) -> DataFrame:
    """(event_id, peak_size, weeks_to_peak, weeks_to_end, intensity_rank)."""
    return events.select("event_id", F.abs("peak_value").alias("peak_size"), (F.datediff("peak_time", "onset") / 7.0).alias("weeks_to_peak"), (F.datediff("end", "onset") / 7.0).alias("weeks_to_end"), F.dense_rank().over(Window.orderBy(F.abs("peak_value").desc())).cast("long").alias("intensity_rank"))
