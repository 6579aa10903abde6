"""Names of wavelengths and features, and natural order of text."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

META = ("Time", "Step", "Sequence")


def new_name() -> str:
    """A column name that no table has."""
    return f"prismflow_{uuid.uuid4().hex}"


def wavelength_name(value: float) -> str:
    return f"{value:.1f}nm"


def wavelength_of(name: str) -> float:
    """The wavelength that a column stands for; its name must be the one that the value has."""
    try:
        value = float(name.removesuffix("nm"))
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or wavelength_name(value) != name:
        raise ValueError(f"not a wavelength column: {name}")
    return value


def feature_name(wavelength: float, step: float, sequence: float, step_time: float) -> str:
    """Python's rounding of the exact value, which SQL formatting does not share."""
    return f"{wavelength_name(wavelength)}_{int(step)}_{int(sequence)}_{step_time:.2f}"


_FEATURE = re.compile(r"(-?[0-9.]+nm)_(-?\d+)_(-?\d+)_(-?[0-9.]+)")


def feature_of(name: str) -> tuple[float, int, int, float]:
    """Coordinates (wavelength, Step, Sequence, StepTime) of a feature's name."""
    m = _FEATURE.fullmatch(name)
    if not m:
        raise ValueError(f"not a feature column: {name}")
    return wavelength_of(m[1]), int(m[2]), int(m[3]), float(m[4])


def natural_key(text: Column | str) -> Column:
    """Sort key in which runs of digits, however long, compare as numbers (run-2 before run-10)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    # of two numbers without leading zeros the longer one is greater; lengths have ten digits at most
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    number = lambda p: F.concat(F.lpad(F.length(bare(p)).cast("string"), 10, "0"), bare(p))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p))
