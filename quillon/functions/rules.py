"""Rules over numbers: safe ratios, categories and words of an embedding's statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


def ratio(x: Column, y: Column, empty: float | None = 0.0) -> Column:
    """x / y; empty where y is zero or null."""
    out = F.try_divide(x.cast("double"), y.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def ratio_eps(x: Column, y: Column, eps: float = 1e-6) -> Column:
    return x / F.greatest(y, F.lit(eps))


def category(v: Column | str, with_entropy: bool = True) -> Column:
    """The category of an embedding by its mean, sample deviation and entropy."""
    m, s = V.mean(v), V.std(v, sample=True)
    plain = F.when(s > 0.3, F.when(m > 0.1, "nature").otherwise("urban")).otherwise(F.when(m > 0, "person").otherwise("object"))
    return F.when(V.entropy(v) > 2.5, "abstract").otherwise(plain) if with_entropy else plain


def feature_word(x: Column, words: list[str]) -> Column:
    """The word for a size: the integer part of x, at most 3."""
    return F.element_at(F.array(*map(F.lit, words)), F.least(F.greatest(x, F.lit(0.0)), F.lit(3.0)).cast("int") + 1)
