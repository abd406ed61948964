"""Operators on profiles: (profile_id, depth_m, t) rows, one profile a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RHO, CP = 1025.0, 3990.0


def _w(depth: str):
    return Window.partitionBy("profile_id").orderBy(depth)


def crossing_depth(df: DataFrame, level: float = 20.0, depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, depth): first depth at which the value falls through ``level``, interpolated; the middle of two equal values; null without a crossing."""
    w = _w(depth)
    nxt, low = F.lead(value).over(w), F.lead(depth).over(w)
    hit = (F.col(value) >= level) & (nxt <= level)
    at = F.when(F.col(value) == nxt, (F.col(depth) + low) / 2).otherwise(F.col(depth) + (F.col(value) - level) / F.nullif(F.col(value) - nxt, F.lit(0.0)) * (low - F.col(depth)))
    rows = df.where(F.col(value).isNotNull()).select("profile_id", depth, F.when(hit, at).alias("at"))
    return rows.groupBy("profile_id").agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col(depth))).alias("depth"))


def gradients(df: DataFrame, depth: str = "depth_m", value: str = "t") -> DataFrame:
    """Adds gradient, of second order on uneven levels, one-sided at the ends."""
    w = _w(depth)
    h1, h2 = F.col(depth) - F.lag(depth).over(w), F.lead(depth).over(w) - F.col(depth)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    inner = (h1 * h1 * c + (h2 * h2 - h1 * h1) * b - h2 * h2 * a) / (h1 * h2 * (h1 + h2))
    return df.where(F.col(value).isNotNull()).withColumn("gradient", F.coalesce(inner, (c - b) / h2, (b - a) / h1))


def max_gradient_depth(df: DataFrame, least: int = 3, depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, depth, gradient): where the gradient is steepest, the upper of equal ones; profiles of ``least`` levels."""
    rows = gradients(df, depth, value)
    best = F.max_by(F.struct(F.col(depth).alias("depth"), "gradient"), F.struct(F.round(F.abs("gradient"), 9), -F.col(depth)))
    return rows.groupBy("profile_id").agg(F.count("*").alias("n"), best.alias("b")).where(F.col("n") >= least).select("profile_id", "b.depth", "b.gradient")


def mixed_layer_depth(df: DataFrame, delta: float = 0.5, depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, depth): of the levels that differ from the top by ``delta`` or more, the one that differs least (not the first)."""
    top = df.where(F.col(value).isNotNull()).groupBy("profile_id").agg(F.min_by(value, depth).alias("top"))
    gap = F.abs(F.col(value) - F.col("top"))
    rows = df.join(top, "profile_id").where(gap >= delta)
    return rows.groupBy("profile_id").agg(F.min_by(depth, F.struct(gap, depth)).alias("depth"))


def trapezoid(df: DataFrame, scale: float = RHO * CP, depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, total, mean): integral over depth by trapezoids, and the layer mean."""
    w = _w(depth)
    dz = F.lead(depth).over(w) - F.col(depth)
    rows = df.where(F.col(value).isNotNull()).withColumn("dz", dz).withColumn("part", (F.col(value) + F.lead(value).over(w)) / 2 * dz)
    return rows.groupBy("profile_id").agg((F.sum("part") * scale).alias("total"), F.try_divide(F.sum("part"), F.sum("dz")).alias("mean"))


def layer_content(df: DataFrame, top: float, bottom: float, scale: float = RHO * CP, depth: str = "depth_m", value: str = "t", strict: bool = False) -> DataFrame:
    """(profile_id, content): each level stands for the layer to the midpoints of its neighbours, cut to [top, bottom].

    The first level reaches to the surface and the last as far below itself as its upper midpoint is above. A layer that the levels do
    not cover gives null, or with ``strict`` raises.
    """
    w = _w(depth)
    above, below = F.lag(depth).over(w), F.lead(depth).over(w)
    upper = F.when(above.isNull(), F.lit(0.0)).otherwise((F.col(depth) + above) / 2)
    lower = F.when(below.isNull(), F.when(above.isNull(), F.col(depth)).otherwise(F.col(depth) + (F.col(depth) - above) / 2)).otherwise((F.col(depth) + below) / 2)
    rows = df.where(F.col(value).isNotNull()).select("profile_id", value, upper.alias("u"), lower.alias("l"))
    dz = F.greatest(F.lit(0.0), F.least("l", F.lit(bottom)) - F.greatest("u", F.lit(top)))
    sums = rows.groupBy("profile_id").agg(F.sum(F.col(value) * dz).alias("s"), F.sum(dz).alias("covered"))
    full = F.abs(F.col("covered") - (bottom - top)) < 1e-6
    otherwise = F.raise_error(F.lit("cannot integrate exactly: the layer is not covered")).cast("double") if strict else F.lit(None).cast("double")
    return sums.select("profile_id", F.when(full, F.col("s") * scale).otherwise(otherwise).alias("content"))


def at_levels(df: DataFrame, levels: list[float], depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, level, value): linear between levels, null outside a profile's range."""
    w = _w(depth)
    spans = df.where(F.col(value).isNotNull()).select("profile_id", F.col(depth).alias("z0"), F.col(value).alias("v0"), F.lead(depth).over(w).alias("z1"), F.lead(value).over(w).alias("v1"))
    wanted = F.explode(F.array(*map(F.lit, levels))).alias("level")
    rows = spans.select("*", wanted)
    hit = F.when((F.col("level") == F.col("z0")), F.col("v0")).when((F.col("level") > F.col("z0")) & (F.col("level") < F.col("z1")), F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("level") - F.col("z0")) / (F.col("z1") - F.col("z0")))
    return rows.groupBy("profile_id", "level").agg(F.max(hit).alias(value))


def tilt(df: DataFrame, keys: list[str], west: tuple[float, float], east: tuple[float, float], lon: str = "lon", value: str = "v") -> DataFrame:
    """(keys, tilt, slope): eastern less western mean, and the linear slope over longitude."""
    w, e = F.avg(F.when(F.col(lon).between(*west), F.col(value))), F.avg(F.when(F.col(lon).between(*east), F.col(value)))
    return df.groupBy(*keys).agg((e - w).alias("tilt"), F.regr_slope(value, lon).alias("slope"))


def stress_curl(df: DataFrame, tau_x: str, tau_y: str, keys: list[str], radius: float = 6_371_000.0) -> DataFrame:
    """Adds curl: d tau_y / dx - d tau_x / dy over neighbouring cells in metres; null at edges and at the poles."""
    x = Window.partitionBy(*keys, "lat").orderBy("lon")
    y = Window.partitionBy(*keys, "lon").orderBy("lat")

    def slope(c: str, at: str, w, metres: Column) -> Column:
        return F.try_divide(F.lead(c).over(w) - F.lag(c).over(w), F.radians(F.lead(at).over(w) - F.lag(at).over(w)) * metres)

    cos = F.cos(F.radians("lat"))
    dx = F.when(cos > 1e-6, slope(tau_y, "lon", x, cos * radius))
    return df.withColumn("curl", dx - slope(tau_x, "lat", y, F.lit(radius)))
