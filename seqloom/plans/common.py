from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
