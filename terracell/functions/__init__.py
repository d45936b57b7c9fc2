"""Column functions: null-safe arithmetic, text, hashes and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def tidy(c: Column, digits: int) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def round_as_sql(c: Column, digits: int) -> Column:
    """A finite number rounded in double arithmetic, halves away from zero, as the SQL does; ``round`` rounds the decimal form, so 0.5055 goes up there and down here."""
    scale = 10.0**digits
    scaled = F.abs(c) * scale
    whole = F.floor(scaled).cast("double")
    return F.when(c < 0, -1.0).otherwise(1.0) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / scale


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < INF)


def valid(c: Column, nodata: float | None = None) -> Column:
    """The value, or null where it is not finite or is the no-data value (NaN no-data included in that)."""
    ok = finite(c) if nodata is None or nodata != nodata else finite(c) & (c != nodata)
    return F.when(ok, c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|."""
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def same_text(c: Column, text: str) -> Column:
    """Equality without regard to case and surrounding white space."""
    return F.lower(trimmed(c)) == text.strip().lower()


def padded_id(prefix: str, c: Column, width: int = 6) -> Column:
    """prefix and the number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"{prefix}%0{width}d", c.cast("long"))


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the 1-degree tile with this south-west corner, such as S31W052."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.concat(ns, F.format_string("%02d", F.abs(lat).cast("int")), ew, F.format_string("%03d", F.abs(lon).cast("int")))


def agreeing(*aliases: Column) -> tuple[Column, Column]:
    """The value of the aliases that are not null, null if they disagree; and whether they do."""
    known = F.array_distinct(F.filter(F.array(*aliases), lambda x: x.isNotNull()))
    return F.when(F.size(known) == 1, known[0]), F.size(known) > 1


def circular_degrees(sine: Column, cosine: Column) -> Column:
    """Direction of a vector in [0, 360); values within 1e-10 of 360 are 0."""
    d = F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0))
    return F.when(F.abs(d - 360) <= 1e-10, 0.0).otherwise(d)


def rank_key(seed: int, c: Column) -> Column:
    """A reproducible random order: the md5 of seed and id, then the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
