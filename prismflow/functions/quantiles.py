"""What counts as a missing value; quantiles are in operators/ranks.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(value: Column | str) -> Column:
    """Null or NaN."""
    column = F.col(value) if isinstance(value, str) else value
    return column.isNull() | F.isnan(column)
