"""Validated settings. Every mistake is a ValueError before any file is read.

Fixed values, which callers rely on: the names and defaults of settings, the names of choices, and the names of
the columns of the two limit blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from numbers import Integral, Real

TRANSFORMS = ("none", "sqrt", "log1p", "asinh")
SCALINGS = ("none", "z-score", "minmax", "robust", "pareto")
IMPUTATIONS = ("drop", "median", "kmeans")
OUTLIERS = (None, "winsorize", "drop")
STEM_CHECKS = ("skip", "warn", "error")


def _number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


def two_bounds(value, name: str, ordered: bool = False) -> tuple[float, float] | None:
    """Two finite bounds from a tuple or list, or None."""
    if value is None:
        return None
    if not isinstance(value, (tuple, list)) or len(value) != 2:
        raise ValueError(f"{name} must be a pair of numbers")
    low, high = (_number(v, name) for v in value)
    if ordered and low > high:
        raise ValueError(f"{name} must not fall")
    return low, high


def positive(value, name: str, optional: bool = True) -> float | None:
    """A finite number above zero."""
    if value is None and optional:
        return None
    number = _number(value, name)
    if number <= 0:
        raise ValueError(f"{name} must be above 0")
    return number


def count(value, name: str) -> int:
    """An integer of at least one."""
    if isinstance(value, bool) or not isinstance(value, Integral) or value < 1:
        raise ValueError(f"{name} must be an integer of at least 1")
    return int(value)


def one_of(value, name: str, choices: Sequence):
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(map(str, choices))}")
    return value


def share(value, name: str) -> float:
    """A number from 0 to 1."""
    number = _number(value, name)
    if not 0 <= number <= 1:
        raise ValueError(f"{name} must lie in [0, 1]")
    return number


def significance(value) -> float:
    number = _number(value, "alpha")
    if not 0 < number < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return number


@dataclass(frozen=True)
class PreprocessConfig:
    """What happens to spectra between scan and flatten."""

    target_steps: tuple | None = None
    edge_trim: tuple[float, float] | None = None
    wavelength_range: tuple[float, float] | None = None
    t_smoothing_window: float | None = None
    w_smoothing_window: float | None = None
    t_normalization_range: tuple[float, float] | None = None
    w_normalization_range: tuple[float, float] | None = None
    intensity_transform: str = "none"
    intensity_transform_scale: float = 1.0
    t_downsampling_stride: int = 1
    w_downsampling_stride: int = 1
    max_null_ratio: float = 0.1
    stem_uniqueness: str = "skip"
    validate_metadata_uniqueness: bool = False
    validate_metadata_alignment: bool = False
    materialize_once: bool = True
    workers: int = 1

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.target_steps is not None:
            if isinstance(self.target_steps, (str, bytes)):
                raise ValueError("target_steps must be a collection of steps")
            put("target_steps", tuple(self.target_steps))
        put("edge_trim", two_bounds(self.edge_trim, "edge_trim"))
        for name in ("wavelength_range", "t_normalization_range", "w_normalization_range"):
            put(name, two_bounds(getattr(self, name), name, ordered=True))
        for name in ("t_smoothing_window", "w_smoothing_window"):
            put(name, positive(getattr(self, name), name))
        one_of(self.intensity_transform, "intensity_transform", TRANSFORMS)
        put("intensity_transform_scale", positive(self.intensity_transform_scale, "intensity_transform_scale", optional=False))
        for name in ("t_downsampling_stride", "w_downsampling_stride", "workers"):
            put(name, count(getattr(self, name), name))
        put("max_null_ratio", share(self.max_null_ratio, "max_null_ratio"))
        one_of(self.stem_uniqueness, "stem_uniqueness", STEM_CHECKS)


def _names(*names: str) -> None:
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("output columns must have different names that are not empty")


@dataclass(frozen=True)
class MahalanobisConfig:
    """Columns and limits of the Hotelling T2 block."""

    cumulative_explained_variance: float | int | None = 0.9
    alpha: float = 0.01
    distance_column: str = "mahalanobis_sq"
    ucl_column: str = "mahalanobis_ucl"
    exceeds_ucl_column: str = "mahalanobis_exceeds_ucl"

    def __post_init__(self) -> None:
        significance(self.alpha)
        _names(self.distance_column, self.ucl_column, self.exceeds_ucl_column)

    @property
    def columns(self) -> tuple[str, str, str]:
        return self.distance_column, self.ucl_column, self.exceeds_ucl_column


@dataclass(frozen=True)
class SpeConfig:
    """Columns and limits of the Q (squared prediction error) block."""

    cumulative_explained_variance: float | int | None = 0.9
    alpha: float = 0.01
    spe_column: str = "spe"
    ucl_column: str = "spe_ucl"
    exceeds_ucl_column: str = "spe_exceeds_ucl"

    def __post_init__(self) -> None:
        significance(self.alpha)
        _names(self.spe_column, self.ucl_column, self.exceeds_ucl_column)

    @property
    def columns(self) -> tuple[str, str, str]:
        return self.spe_column, self.ucl_column, self.exceeds_ucl_column
