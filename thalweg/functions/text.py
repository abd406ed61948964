"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slug(text: str | Column) -> Column:
    """Lower case without accents, other signs as single underscores."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def percentile_label(p: Column) -> Column:
    """90 -> p90, 97.5 -> p97p5."""
    text = F.regexp_replace(F.format_string("%.6f", p.cast("double")), r"\.?0+$", "")
    return F.concat(F.lit("p"), F.replace(text, F.lit("."), F.lit("p")))


def longitude_label(lon: Column) -> Column:
    """190 -> 170W, 120 -> 120E."""
    east = F.pmod(lon, F.lit(360.0))
    return F.when(east > 180, F.concat(F.round(360 - east).cast("int").cast("string"), F.lit("W"))).otherwise(F.concat(F.round(east).cast("int").cast("string"), F.lit("E")))


def hash32(*parts: Column | str) -> Column:
    """A number under 2**32 from texts, the same on every engine: the first eight digits of their MD5, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def truth(text: Column) -> Column:
    """true, 1, yes, y in any case."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def tolerant_date(number: Column) -> Column:
    """YYYYMMDD as a date; null for what is none."""
    return F.try_to_date(F.when(number > 0, number.cast("string")), "yyyyMMdd")


def stable_seed(*parts: Column) -> Column:
    """First four bytes of the SHA-256 of the parts joined by bars, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def intensity(value: Column, bounds: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), names: tuple[str, ...] = ("weak", "moderate", "strong", "very_strong")) -> Column:
    """Class of a magnitude, lower ends included; neutral below the first and for null."""
    size = F.abs(value)
    out = F.lit("neutral")
    for b, n in zip(bounds, names, strict=True):
        out = F.when(size >= b, n).otherwise(out)
    return out


