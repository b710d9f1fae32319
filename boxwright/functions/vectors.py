"""Vectors (arrays of floats) as column expressions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def normalised(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def unit(cos: Column) -> Column:
    return (cos + 1) / 2


def bit_counts(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """n11, n10, n01, n00 of two arrays of booleans."""
    both = F.zip_with(a, b, lambda x, y: x.cast("int") * 2 + y.cast("int"))
    count = lambda k: F.size(F.filter(both, lambda z: z == k)).cast("double")
    return count(3), count(2), count(1), count(0)


def distances(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """Boolean distances; an empty denominator gives 0."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    differ, n = n10 + n01, n11 + n10 + n01 + n00
    return {
        "hamming": over(differ, n),
        "jaccard": over(differ, n11 + differ),
        "matching": over(differ, n),
        "rogerstanimoto": over(2 * differ, n11 + n00 + 2 * differ),
        "sokalmichener": over(2 * differ, n11 + n00 + 2 * differ),
        "yule": over(n10 * n01, n11 * n00 + n10 * n01),
    }


def similarities(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """Similarities of two sets of bits; an empty denominator gives 0."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    a, b, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    return {
        "allbit": over(n11 + n00, n),
        "asymmetric": over(n11, F.least(a, b)),
        "braunblanquet": over(n11, F.greatest(a, b)),
        "cosine": over(n11, F.sqrt(a * b)),
        "dice": over(2 * n11, a + b),
        "kulczynski": over(n11 * (a + b), 2 * a * b),
        "onbit": over(n11, n11 + n10 + n01),
        "rogotgoldberg": over(n11, a + b) + over(n00, 2 * n - a - b),
        "russel": over(n11, n),
        "sokal": over(n11, 2 * a + 2 * b - 3 * n11),
        "tanimoto": over(n11, a + b - n11),
    }


def canberra(a: Column, b: Column) -> Column:
    """Mean over the dimensions."""
    terms = F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y).cast("double") / (F.abs(x) + F.abs(y)).cast("double")).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
