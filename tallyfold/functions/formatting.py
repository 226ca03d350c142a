"""Numbers as text for tables: fixed places, thousands, a dash for nothing, small p-values as a bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def fixed(x: Column, places: int = 2) -> Column:
    return F.coalesce(F.format_number(x, places), F.lit(DASH))


def p_value(p: Column, places: int = 3) -> Column:
    least = 10.0**-places
    return F.when(p.isNull(), DASH).when(p < least, f"<{least:.{places}f}").otherwise(F.format_number(p, places))
