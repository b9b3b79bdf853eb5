"""Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector gives null."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    shares = lambda e: let(_sum(e), lambda s: F.transform(e, lambda x: x / s))
    return let(a, lambda v: let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), shares)))


def top(a: Column, k: int) -> Column:
    """The k largest as structs (minus, place), ties to the first."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("minus"), i.alias("place"))))
    return F.slice(ranked, 1, k)


def masked_match(x: Column, mask: Column, pattern: Column) -> Column:
    """1 - sum(mask * |x - pattern|) / (sum(mask) + 1e-8)."""
    gap = F.zip_with(x, pattern, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return 1 - dot(mask, gap) / (_sum(F.transform(mask, lambda m: m.cast("double"))) + 1e-8)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine_transform(grid: Column, side: int, low: int) -> Column:
    """The low x low first coefficients, row by row, of the two-dimensional cosine transform
    (kind II, not scaled) of side x side numbers, row by row."""
    waves = F.array(*[F.array(*[F.lit(math.cos(math.pi * (2 * i + 1) * k / (2 * side))) for i in range(side)]) for k in range(low)])
    rows = F.transform(F.sequence(F.lit(1), F.lit(side * side), F.lit(side)), lambda at: F.slice(grid, at, F.lit(side)))
    across = F.transform(rows, lambda row: F.transform(waves, lambda wave: dot(row, wave)))
    column = lambda half, j: F.transform(half, lambda row: F.get(row, j))
    both = lambda half: F.transform(waves, lambda wave: F.transform(F.sequence(F.lit(0), F.lit(low - 1)), lambda j: dot(wave, column(half, j))))
    return F.flatten(let(across, both))


def perceptual_hash(grid: Column, side: int = 8, low: int = 6) -> Column:
    """A bit for each of the low frequencies, the first one highest: whether its coefficient
    is above the median of all. Grids that look alike differ in few bits. Null if the
    grid isn't side x side numbers."""
    n = low * low
    middle = lambda c: let(F.array_sort(c), lambda s: (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2)
    bits = lambda c: let(middle(c), lambda m: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > m).cast("long")))
    return F.when(F.size(grid) == side * side, let(cosine_transform(grid, side, low), bits))
