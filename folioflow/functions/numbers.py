"""Arithmetic with stated edge cases. Division by zero gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959964


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def clamp(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; null and NaN become ``low``."""
    x = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(float(low))).otherwise(c.cast("double"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def clamp_text(c: Column, low: float, high: float) -> Column:
    """A number text into [low, high]; no number becomes ``low``."""
    return clamp(c.try_cast("double"), low, high)


def sigmoid(c: Column) -> Column:
    """The logistic function, the exponent bounded at 700."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), c))))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounded with halves toward plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of a share, within [0, 1]; null for n = 0."""
    p = successes / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(n > 0, clip((centre - spread) / scale)), F.when(n > 0, clip((centre + spread) / scale))


def min_max(c: Column, low: Column, high: Column, epsilon: float = 0.0) -> Column:
    """(c - low) / (high - low), 0 where there is no spread; with ``epsilon`` a spread below it counts as none and it is added to the spread."""
    spread = high - low
    flat = spread < epsilon if epsilon else spread == 0
    return F.when(flat, F.lit(0.0)).otherwise((c - low) / F.when(flat, F.lit(1.0)).otherwise(spread + epsilon))


def bucket(c: Column, width: float, buckets: int) -> Column:
    """Half-open buckets of equal width from 0, the last open-ended."""
    return F.least(F.floor(F.abs(c) / width), F.lit(buckets - 1)).cast("int")


def gap_class(c: Column) -> Column:
    return F.when(c == 1, "adjacent").when(c == 2, "moderate").otherwise("wide")


def noise_scale(confidence: Column) -> Column:
    """The noise of a rating by its confidence in [0, 1]."""
    return 0.2 * (1 - confidence) + 0.05
