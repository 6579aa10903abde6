"""Element-wise intensity transforms as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def stable_asinh(x: Column) -> Column:
    """asinh that is odd and keeps small and large values exact, which the built-in does not."""
    a = F.abs(x)
    near = F.log1p(a + a * a / (1 + F.sqrt(a * a + 1)))
    return F.signum(x) * F.when(a > 1e150, F.log(a) + math.log(2)).otherwise(near)


def intensity(x: Column, kind: str, scale: float) -> Column:
    if kind == "sqrt":
        return signed_sqrt(x)
    if kind == "log1p":
        return F.log1p(x / F.lit(scale))
    if kind == "asinh":
        return stable_asinh(x / F.lit(scale))
    return x
