"""Operators on fields: longitudes, boxes, area weights, blocks, cell identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def longitude(lon: str | Column, convention: str = "0_360") -> Column:
    """A longitude in [0, 360) or [-180, 180)."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    if convention == "0_360":
        return F.pmod(lon, F.lit(360.0))
    if convention == "-180_180":
        return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    raise ValueError(f"unknown longitude convention {convention!r}")


def circular_between(lon: str | Column, west: float, east: float) -> Column:
    """Whether a longitude in [0, 360) is in a range that may wrap; ends included."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    west, east = west % 360, east % 360
    return lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)


def box(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Cells in a latitude and longitude box, ends included."""
    return df.where(F.col("lat").between(min(south, north), max(south, north)) & circular_between(longitude("lon"), west, east))


def weighted_mean(value: str = "v", weight: Column | None = None) -> Column:
    """Mean over non-null values, by the cosine of latitude unless a weight is given."""
    weight = F.cos(F.radians("lat")) if weight is None else weight
    kept = F.when(F.col(value).isNotNull(), weight)
    return F.try_divide(F.sum(F.col(value) * kept), F.sum(kept))


def box_index(df: DataFrame, south: float, north: float, west: float, east: float, day: str = "d", value: str = "v") -> DataFrame:
    """(d, index): area-weighted mean of a box each day."""
    return box(df, south, north, west, east).groupBy(day).agg(weighted_mean(value).alias("index"))


def dipole_index(df: DataFrame, west_box: tuple, east_box: tuple, day: str = "d", value: str = "v") -> DataFrame:
    """(d, west, east, dipole): difference of two box means, days on which both have values."""
    a = box(df, *west_box).groupBy(day).agg(F.avg(value).alias("west"))
    b = box(df, *east_box).groupBy(day).agg(F.avg(value).alias("east"))
    return a.join(b, day).withColumn("dipole", F.col("west") - F.col("east"))


def unit_mean(df: DataFrame, membership: DataFrame, least: float = 0.8, value: str = "v", keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """(keys, unit, mean, coverage) of units from (pixel_id, unit, weight); null where too little of the weight has values."""
    total = membership.groupBy("unit").agg(F.sum("weight").alias("whole"))
    rows = df.join(membership, "pixel_id").where(F.col(value).isNotNull())
    sums = rows.groupBy(*keys, "unit").agg(F.sum(F.col(value) * F.col("weight")).alias("s"), F.sum("weight").alias("w")).join(F.broadcast(total), "unit")
    coverage = F.col("w") / F.col("whole")
    return sums.select(*keys, "unit", F.when(coverage >= least, F.col("s") / F.col("w")).alias("mean"), coverage.alias("coverage"))


def coarsen(df: DataFrame, factor: int, row: str = "row", col: str = "col", value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of factor x factor blocks; null unless every cell of the block has a value."""
    blocks = df.groupBy(*keys, F.floor(F.col(row) / factor).alias(row), F.floor(F.col(col) / factor).alias(col))
    return blocks.agg(F.when(F.count(value) == factor * factor, F.avg(value)).alias(value))


def pixel_id(row: Column, col: Column, n_cols: int) -> Column:
    """Row-major number of a cell."""
    return row * n_cols + col


def grid_hash(df: DataFrame, columns: tuple[str, ...] = ("pixel_id", "lat", "lon")) -> DataFrame:
    """(fingerprint): SHA-256 over the cells in order, at fixed precision. A grid is a small dimension table."""
    head, rest = columns[0], columns[1:]
    text = F.concat_ws(",", F.col(head).cast("string"), *[F.format_string("%.8f", F.col(c).cast("double")) for c in rest])
    rows = df.select(head, text.alias("cell")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.col(head), F.col("cell"))))
    return rows.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["cell"]), ";"), 256).alias("fingerprint"))


def regularity(df: DataFrame, coord: str, tolerance: float = 1e-7) -> DataFrame:
    """(n, step, is_regular): whether distinct coordinates have one constant step."""
    from pyspark.sql import Window

    # a coordinate axis is a dimension of a grid, not a fact table: one task orders it
    gaps = df.select(coord).distinct().withColumn("gap", F.col(coord) - F.lag(coord).over(Window.orderBy(coord)))
    return gaps.agg(F.count(coord).alias("n"), F.min("gap").alias("step"), (F.max("gap") - F.min("gap") <= tolerance).alias("is_regular"))


def wind_stress(u: Column, v: Column, rho: float = 1.22, drag: float = 1.3e-3) -> tuple[Column, Column]:
    """Wind speed and zonal stress."""
    speed = F.hypot(u, v)
    return speed, speed * u * (rho * drag)


def area_m2(lat: Column, dlat: float, dlon: float) -> Column:
    """Area of a cell of dlat x dlon degrees."""
    return F.cos(F.radians(lat)) * (EARTH_RADIUS_M**2) * F.radians(F.lit(dlat)) * F.radians(F.lit(dlon))
