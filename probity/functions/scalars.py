"""Column expressions over scalars and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(column: Column | str) -> Column:
    """A nullable flag, null as false."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(False))


def rate(column: Column | str) -> Column:
    """Share of rows for which a nullable flag holds."""
    return F.avg(flag(column).cast("double"))


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    """prefix-000001; numbers longer than width keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def utc_text(ts: Column) -> Column:
    """A timestamp as text in UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def confidence(high: Column, medium: Column | None = None) -> Column:
    """high where the condition holds, else medium; where another is given, low unless that holds."""
    return F.when(high, "high").when(F.lit(True) if medium is None else medium, "medium").otherwise("low")


def status_tier(status: Column) -> Column:
    """Display tier of a status, whatever its case; unknown and null are pending."""
    s = F.upper(status)
    return (
        F.when(s.isin("SECURE", "F"), "secure")
        .when(s.isin("REVIEW", "O"), "review")
        .when(s.isin("QUARANTINE", "P"), "quarantine")
        .otherwise("pending")
    )


def file_size(n: Column) -> Column:
    """Bytes as text in units of 1024 with one decimal."""
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power)))
    whole = F.concat(n.cast("string"), F.lit(" B"))
    return F.when(n < 1024, whole).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))
