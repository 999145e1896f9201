"""Expressions over vector columns (ARRAY<FLOAT> or ARRAY<DOUBLE>); arithmetic is in doubles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null where the lengths differ or an element is null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if either vector has length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column | str, zero: str = "keep") -> Column:
    """The vector at length 1. zero: 'keep' leaves a zero vector as it is, 'null' makes it null, 'eps' divides by at least 1e-12."""
    v, size = doubles(v), norm(v)
    if zero == "eps":
        return F.transform(v, lambda x: x / F.greatest(size, F.lit(1e-12)))
    unit = F.transform(v, lambda x: F.try_divide(x, size))
    return F.when(size > 0, unit).otherwise(v if zero == "keep" else F.lit(None))


def normalize_if_large(v: Column | str, limit: float = 10.0) -> Column:
    """Normalised only where an element exceeds limit in size."""
    return F.when(F.array_max(F.transform(doubles(v), F.abs)) > limit, normalize(v)).otherwise(doubles(v))


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded as DuckDB does it: half away from zero, and what is rounded to zero keeps its sign (F.round makes -0.0 a 0.0)."""
    scaled = x * F.lit(10.0**digits)
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    near = F.when(size < 2.0**52, (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) * F.signum(scaled)).otherwise(scaled)
    return F.when(F.abs(scaled) < float("inf"), near / F.lit(10.0**digits)).otherwise(x)


def average(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def clip(x: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_finite(v: Column | str) -> Column:
    """Whether all elements are finite numbers."""
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def upsample(v: Column | str, size: int, wide: int) -> Column:
    """A vector of `size` elements stretched to `wide`: every element repeated, then the head of the result for what is left."""
    many, rest = divmod(wide, size)
    long = F.flatten(F.transform(doubles(v), lambda x: F.array_repeat(x, many)))
    return F.concat(long, F.slice(long, 1, rest)) if rest else long


def downsample(v: Column | str, size: int, narrow: int) -> Column:
    """A vector of `size` elements as the mean of its consecutive chunks of `narrow`; size must be a multiple of narrow."""
    if size % narrow:
        raise ValueError(f"{size} is no multiple of {narrow}")
    v, parts = doubles(v), size // narrow
    return F.transform(F.sequence(F.lit(1), F.lit(narrow)), lambda j: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.element_at(v, k * narrow + j)), F.lit(0.0), lambda s, x: s + x) / parts)


def pooled(v: Column | str, size: int, narrow: int) -> Column:
    """A vector of `size` elements as `narrow` means of neighbours that cover it, overlapping where narrow does not divide size."""
    spans = [(j * size // narrow, -(-(j + 1) * size // narrow)) for j in range(narrow)]
    return F.array(*[mean(F.slice(doubles(v), a + 1, b - a)) for a, b in spans])


def total(v: Column | str) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def mean(v: Column | str) -> Column:
    return F.try_divide(total(v), F.size(v))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once a row however often use looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def std(v: Column | str, sample: bool = False) -> Column:
    """Population standard deviation of the elements; sample: with n - 1."""
    squares = lambda m: F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.sqrt(F.try_divide(bound(mean(v), squares), F.size(v) - (1 if sample else 0)))


def histogram(v: Column | str, bins: int = 10) -> Column:
    """Counts of the elements in equal bins between the least and the greatest; the greatest falls into the last bin."""
    v = doubles(v)
    span = F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    place = lambda x, s: F.least(F.coalesce(F.floor(F.try_divide((x - s["low"]) * bins, s["high"] - s["low"])), F.lit(0)), F.lit(bins - 1))
    places = bound(span, lambda s: F.transform(v, lambda x: place(x, s)))
    return bound(places, lambda own: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(own, lambda p: p == b))))


def entropy(v: Column | str, bins: int = 10) -> Column:
    """Entropy in bits of the histogram of the elements."""
    n = F.size(v)
    return F.aggregate(histogram(v, bins), F.lit(0.0), lambda s, c: s + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))


def zeros_for_null(v: Column | str, size: int) -> Column:
    return F.coalesce(doubles(v), F.array_repeat(F.lit(0.0), size))


def half(v: Column | str, part: int, size: int) -> Column:
    """The first (0) or second (1) half of a vector of `size` elements."""
    return F.slice(doubles(v), part * (size // 2) + 1, size // 2)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
