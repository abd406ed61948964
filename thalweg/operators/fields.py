"""Operators on longitude-time fields and cells: matrices, band passes, phase speed, regridding, overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import EARTH_RADIUS_M
from .stats import pearson


def lon_time(df: DataFrame, band: tuple[float, float], time: str, value: str = "v") -> DataFrame:
    """(time, lon, value): mean over a latitude band, less each longitude's mean."""
    rows = df.where(F.col("lat").between(*band)).groupBy(time, "lon").agg(F.avg(value).alias(value))
    return rows.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy("lon")))


def band_pass(df: DataFrame, time: str, half_width: float, value: str = "v") -> DataFrame:
    """Adds passed: the value less the zonal mean of its time, then the mean within ``half_width`` degrees."""
    rows = df.withColumn("_a", F.col(value) - F.avg(value).over(Window.partitionBy(time)))
    # ranges are whole numbers: thousandths of a degree
    near = Window.partitionBy(time).orderBy((F.col("lon") * 1000).cast("long")).rangeBetween(-round(half_width * 1000), round(half_width * 1000))
    return rows.withColumn("passed", F.avg("_a").over(near)).drop("_a")


def lag_by_longitude(df: DataFrame, reference: float, lags: tuple[int, ...], time: str, value: str = "v", step_days: int = 7) -> DataFrame:
    """(lon, lag, r): the lag in steps at which each longitude follows the reference best, the shortest of equal ones."""
    ref = df.where(F.abs(F.col("lon") - reference) < 1e-9).select(F.col(time).alias("_t"), F.col(value).alias("_x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    ref = ref.withColumn(time, F.date_add("_t", F.col("lag") * step_days))
    r = df.join(ref, time).groupBy("lon", "lag").agg(pearson("_x", value).alias("r"))
    return r.where("r is not null").groupBy("lon").agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.col("lag"))).alias("b")).select("lon", "b.lag", "b.r")


def phase_speed(lags: DataFrame, reference: float, step_days: int = 7) -> DataFrame:
    """(n, speed, r2): metres a second by least squares of the distance from the reference on the lag."""
    x = F.col("lag") * (86400.0 * step_days)
    y = (F.col("lon") - reference) * (3.141592653589793 / 180 * EARTH_RADIUS_M)
    return lags.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("speed"), F.regr_r2(y, x).alias("r2"))


def arg_max_cell(df: DataFrame, time: str, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, time, lon, value): the largest value, the first of equal ones by time and then longitude."""
    best = F.min_by(F.struct(F.col(time), F.col("lon"), F.col(value)), F.struct(-F.col(value), F.datediff(time, F.lit("1970-01-01")), F.col("lon")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def bilinear(df: DataFrame, targets: list[tuple[float, float]], keys: tuple[str, ...], row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """(keys, y, x, value) at target nodes in units of cells, from the four cells around; null where one has no value."""
    cells = F.explode(F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for y, x in targets])).alias("q")
    rows = df.select(*keys, row, col, value, cells).select(*keys, row, col, value, "q.y", "q.x")
    wy, wx = 1 - F.abs(F.col(row) - F.col("y")), 1 - F.abs(F.col(col) - F.col("x"))
    rows = rows.where((wy > 0) & (wx > 0))
    got = rows.groupBy(*keys, "y", "x").agg(F.sum(F.col(value) * wy * wx).alias("s"), F.sum(F.when(F.col(value).isNotNull(), wy * wx)).alias("w"))
    return got.select(*keys, "y", "x", F.when(F.abs(F.col("w") - 1) < 1e-9, F.col("s")).alias(value))


def rectangle_membership(cells: DataFrame, units: DataFrame, size: float) -> DataFrame:
    """(pixel_id, unit, fraction): share of each cell of ``size`` degrees in rectangles (unit, south, north, west, east), by area on the sphere."""
    half = size / 2
    # units meet cells in bands of the cells' height, then by their sides
    band = lambda lat: F.floor(lat / size).cast("long")
    spread = units.withColumn("_band", F.explode(F.sequence(band(F.col("south") - half), band(F.col("north") + half))))
    pairs = cells.withColumn("_band", band(F.col("lat"))).join(spread, "_band").drop("_band")
    pairs = pairs.where((F.col("lat") + half > F.col("south")) & (F.col("lat") - half < F.col("north")) & (F.col("lon") + half > F.col("west")) & (F.col("lon") - half < F.col("east")))
    low, high = F.greatest(F.col("lat") - half, "south"), F.least(F.col("lat") + half, "north")
    dx = F.least(F.col("lon") + half, "east") - F.greatest(F.col("lon") - half, "west")
    part = (F.sin(F.radians(high)) - F.sin(F.radians(low))) * dx
    whole = (F.sin(F.radians(F.col("lat") + half)) - F.sin(F.radians(F.col("lat") - half))) * size
    return pairs.select("pixel_id", "unit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole)).alias("fraction"))


def nearest_level(df: DataFrame, levels: list[float], depth: str = "depth_m", value: str = "t") -> DataFrame:
    """(profile_id, level, depth, value): the level nearest to each wanted one, the upper of two equally near."""
    rows = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    best = F.min_by(F.struct(F.col(depth).alias("depth"), F.col(value)), F.struct(F.abs(F.col(depth) - F.col("level")), F.col(depth)))
    return rows.groupBy("profile_id", "level").agg(best.alias("b")).select("profile_id", "level", "b.*")
