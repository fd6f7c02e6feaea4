"""Numbers as text, and bounds that hold for what is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import finite

ABSENT = "—"


def number(x: Column | str, places: int = 2) -> Column:
    """x with fixed places; a dash for null, NaN and infinities."""
    return F.when(finite(x).isNull(), ABSENT).otherwise(F.format_string(f"%.{places}f", finite(x)))


def percent(x: Column | str, places: int = 2) -> Column:
    """100 x with fixed places and a percent sign; a dash for null, NaN and infinities."""
    x = 100 * finite(x)
    return F.when(x.isNull(), ABSENT).otherwise(F.format_string(f"%.{places}f%%", x))


def bounded(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; low for null, NaN and infinities."""
    return F.coalesce(F.least(F.greatest(finite(x), F.lit(low)), F.lit(high)), F.lit(low))
