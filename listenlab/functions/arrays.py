"""Vector functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """AR7."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """AR4."""
    return F.element_at(F.transform(F.array(norm(a) + 1e-9), lambda n: F.transform(a, lambda x: x / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def project_out(a: Column, d: Column) -> Column:
    """AX8: a without its part along the unit vector d."""
    return F.element_at(F.transform(F.array(dot(a, d)), lambda p: F.zip_with(a, d, lambda x, y: x - p * y)), 1)


def pooled(frames: Column, n: int) -> Column:
    """AR3: mean, maximum and root mean square over time of frames of n numbers, one behind the other."""
    at = lambda i: F.transform(frames, lambda f: f[i])
    count = F.size(frames)
    total = lambda v, sq: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x if sq else x))
    i = F.sequence(F.lit(0), F.lit(n - 1))
    return F.concat(
        F.transform(i, lambda k: total(F.transform(frames, lambda f: F.get(f, k)), False) / count),
        F.transform(i, lambda k: F.array_max(F.transform(frames, lambda f: F.get(f, k)))),
        F.transform(i, lambda k: F.sqrt(total(F.transform(frames, lambda f: F.get(f, k)), True) / count)),
    )


def bands(a: Column, b: Column, n: int, width: int) -> Column:
    """AR8: cosine of each of n equally wide bands of two stacks."""
    return F.array(*[cosine(F.slice(a, i * width + 1, width), F.slice(b, i * width + 1, width)) for i in range(n)])
