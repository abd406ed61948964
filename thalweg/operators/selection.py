"""Choosing columns, conditions and rows by contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_contract(df: DataFrame, expected: list[str]) -> list[str]:
    """The expected columns in their order; a column that is missing or no number raises."""
    kinds = dict(df.dtypes)
    bad = [c for c in expected if not (kinds.get(c, "") in NUMERIC or kinds.get(c, "").startswith("decimal"))]
    if bad:
        raise ValueError(f"not numeric columns of the table: {bad}")
    return list(expected)


def without_aliases(columns: list[str], target: str, tokens: tuple[str, ...]) -> list[str]:
    """The columns that neither are the target, nor start with it, nor hold one of its tokens as a part of their name."""
    return [c for c in columns if c != target and not c.startswith(f"{target}_") and not set(c.lower().split("_")) & set(tokens)]


def column_group(name: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """First group with a token among the parts of a name; else other."""
    parts = F.split(F.lower(name), "_")
    whens = [(F.arrays_overlap(parts, F.array(*map(F.lit, tokens))), g) for g, tokens in groups.items()]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(whens), F.lit("other"))


def parse_condition(text: str) -> tuple[str, str]:
    """(event type, phase) of ``all``, ``neutral``, ``type`` or ``type:phase``; ``*`` stands for any."""
    kind, _, phase = text.strip().lower().partition(":")
    if not kind or (phase and kind in ("all", "neutral")):
        raise ValueError(f"not a condition: {text!r}")
    return ("*" if kind == "all" else kind), phase or "*"


def condition_mask(condition: str, event_type: str = "event_type", phase: str = "phase") -> Column:
    """Whether a row of the phase table meets a condition."""
    kind, part = parse_condition(condition)
    out = F.lit(True)
    if kind != "*":
        out = out & (F.lower(event_type) == kind)
    if part != "*":
        out = out & (F.lower(phase) == part)
    return out


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str, other: str) -> DataFrame:
    """Both fields' values by key; a point that only one of them has raises when its row is read."""
    both = a.select(*keys, F.col(value), F.lit(True).alias("_a")).join(b.select(*keys, F.col(other), F.lit(True).alias("_b")), keys, "full")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    return both.withColumn(value, F.when(lone, F.raise_error(F.concat(F.lit("grids differ at "), F.concat_ws(",", *keys))).cast("double")).otherwise(F.col(value))).drop("_a", "_b")


def concatenated(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of the pieces; a key that two rows have raises when it is read, and is never averaged."""
    rows = reduce(DataFrame.unionByName, parts)
    n = F.count("*").over(Window.partitionBy(*keys))
    first = next(c for c, k in rows.dtypes if c not in keys and k == "double")
    return rows.withColumn("_n", n).withColumn(first, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("twice: "), F.concat_ws(",", *keys))).cast("double")).otherwise(F.col(first))).drop("_n")


def hashed_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of the lowest hash of their identifier: the same rows each time, however they are dealt."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))).orderBy("_h").limit(size).drop("_h")


def in_polygon(points: DataFrame, edges: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(point columns, unit) of points inside polygons, by the parity of the edges that a ray to the east crosses.

    ``edges`` is (unit, x1, y1, x2, y2). Points and edges meet in bands of one degree of y: an edge is sent to the bands that it
    spans, a point to its own.
    """
    band = F.floor(F.col(y)).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.withColumn("_band", F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))))
    hit = points.withColumn("_band", band).join(spread, "_band")
    crosses = (low <= F.col(y)) & (F.col(y) < high) & (F.col(x) < F.col("x1") + (F.col(y) - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))))
    return hit.groupBy(*keys, "unit").agg(F.count_if(crosses).alias("_c")).where("_c % 2 = 1").select(*keys, "unit")
