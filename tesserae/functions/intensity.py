"""Intensity transforms, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, wrap(low)), wrap(high))


def unit_scale(x: Column, largest: Column) -> Column:
    """Floats to [0, 1]: by 1, 255, 65535 or their largest value, whichever holds them first."""
    scale = F.when(largest <= 1, 1.0).when(largest <= 255, 255.0).when(largest <= 65535, 65535.0).otherwise(largest)
    return clip(x / scale)


def optical_density(x: Column) -> Column:
    """Negative natural logarithm of an intensity in [0, 1]."""
    return -F.ln(clip(x, 0.5 / 65535, 1.0))


def linear(values: list[Column], weights: list[float]) -> Column:
    """Weighted sum, not below zero."""
    total = F.lit(0.0)
    for x, w in zip(values, weights, strict=True):
        total = total + x * w
    return F.greatest(total, F.lit(0.0))


#: Optical densities of hematoxylin and of eosin in red, green and blue.
STAINS = ((0.650, 0.704, 0.286), (0.072, 0.990, 0.105))


def stain_weights() -> tuple[list[float], list[float]]:
    """Weights of the three densities that give each stain's concentration: the pseudo-inverse of ``STAINS``."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    h, e = STAINS
    hh, he, ee = dot(h, h), dot(h, e), dot(e, e)
    det = hh * ee - he * he
    return [(ee * x - he * y) / det for x, y in zip(h, e, strict=True)], [(hh * y - he * x) / det for x, y in zip(h, e, strict=True)]


def saturation(red: Column, green: Column, blue: Column) -> Column:
    top = F.greatest(red, green, blue)
    return (top - F.least(red, green, blue)) / F.greatest(top, F.lit(1e-6))


def gray(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def upper_tail(x: Column, low: Column, high: Column) -> Column:
    """How far x stands between two quantiles; zero where they coincide."""
    return F.when(high > low, clip((x - low) / F.when(high > low, high - low))).otherwise(0.0)


def lower_signal(x: Column, p25: Column, p75: Column) -> Column:
    """How far x stands below its first quartile."""
    return clip((p25 - x) / F.greatest(0.75 * p25, p75 - p25, F.lit(0.025)))


def normal_score(x: Column, threshold: Column | float) -> Column:
    """A score whose threshold comes to one half."""
    return clip(0.5 * x / threshold)


def fuse(a: Column, b: Column, wa: float = 0.5, wb: float = 0.5) -> Column:
    """Weighted mean; the other side alone where one is null."""
    return F.coalesce((wa * a + wb * b) / (wa + wb), a, b)
