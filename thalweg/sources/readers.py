"""Readers: by suffix, ledgers with their malformed lines, ragged profiles, availability, synthetic series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import hash32

FORMATS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json", "txt": "text"}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table by its suffix; CSV has a header, and types only from a schema."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {path!r}")
    reader = spark.read.format(FORMATS[suffix])
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if suffix == "csv" else reader).load(path)


def read_ledger(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries, issues) of a file of one JSON object a line; issues are (line, reason). The file is never changed."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in required]))
    reason = F.when(F.col("e._corrupt").isNotNull(), "malformed").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    marked = parsed.withColumn("reason", reason)
    entries = marked.where("reason is null").select(*[F.col(f"e.{f.name}").alias(f.name) for f in schema.fields])
    return entries, marked.where("reason is not null").select(F.col("value").alias("line"), "reason")


def ragged(counts: DataFrame, values: DataFrame, order: str = "position") -> DataFrame:
    """Values of contiguous ragged arrays by cast: rows of (cast_id, size) in order, and of (position, ...) from 0."""
    from pyspark.sql import Window

    w = Window.orderBy("cast_id").rowsBetween(Window.unboundedPreceding, 0)  # one row a cast: a small table
    spans = counts.withColumn("stop", F.sum("size").over(w)).withColumn("start", F.col("stop") - F.col("size"))
    return values.join(F.broadcast(spans), (F.col(order) >= F.col("start")) & (F.col(order) < F.col("stop"))).withColumn("level", F.col(order) - F.col("start")).drop("start", "stop", "size")


def available(df: DataFrame, source: str, day: str, delays: dict[str, int], today: str) -> DataFrame:
    """Rows that their source had published by ``today``; an unknown source has no delay."""
    delay = F.coalesce(F.create_map(*[F.lit(x) for kv in delays.items() for x in kv])[F.col(source)], F.lit(0))
    return df.where(F.col(day) <= F.date_sub(F.lit(today).cast("date"), delay))


def synthetic_weekly(spark: SparkSession, weeks: int, variables: int, start: str = "1981-01-04") -> DataFrame:
    """A made-up weekly matrix, the same each time: v0 .. vn with yearly cycles, marked as made up."""
    rows = spark.range(weeks).select(F.date_add(F.lit(start).cast("date"), (F.col("id") * 7).cast("int")).alias("week_end"), F.col("id").alias("k"))
    noise = lambda i: (hash32(F.col("k"), F.lit(i)) % 2001 - 1000) / 1000.0
    return rows.select("week_end", F.lit(True).alias("is_synthetic"), *[(F.sin(F.col("k") * (2 * 3.141592653589793 / 52.1775) + i) + noise(i)).alias(f"v{i}") for i in range(variables)])


def require_not_coarser(df: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """The rows, if their usual step is a day or less: coarser input is refused rather than filled up."""
    from pyspark.sql import Window

    step = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.lag(F.unix_timestamp(F.col(ts).cast("timestamp"))).over(Window.orderBy(ts))
    usual = df.select(ts).distinct().select(step.alias("s")).agg(F.percentile_approx("s", 0.5)).first()[0]
    if usual is not None and usual > hours * 3600:
        raise ValueError(f"the usual step of {usual} s is coarser than {hours} hours")
    return df
