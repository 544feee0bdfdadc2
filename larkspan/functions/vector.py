"""Vectors as ARRAY columns: norms, products and Hadamard transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def inverse_norm(x: Column) -> Column:
    """1 / max(norm, 1e-12); take it as a column of its own before `scaled`, else it is computed per element."""
    return 1 / F.greatest(F.sqrt(squared_norm(x)), F.lit(TINY))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def padded(x: Column, width: int) -> Column:
    """The vector followed by zeros up to `width`."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), width)), 1, width)


def fast_hadamard(x: Column, width: int) -> Column:
    """The normalised Walsh-Hadamard transform in width log width steps; `width` must be a power of two.

    Each pass adds and subtracts coordinates that are `half` apart, for halves 1, 2, 4 and so on.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("the width must be a power of two")
    halves = F.array(*[F.lit(1 << i) for i in range(width.bit_length() - 1)]).cast("array<int>")

    def butterfly(done, half):
        other = lambda i: F.element_at(done, i.bitwiseXOR(half) + 1)
        return F.transform(done, lambda v, i: F.when(i.bitwiseAND(half) == 0, v + other(i)).otherwise(other(i) - v))

    return F.aggregate(halves, x, butterfly, lambda done: F.transform(done, lambda v: v / float(width) ** 0.5))


def hadamard(x: Column, width: int) -> Column:
    """The normalised Walsh-Hadamard transform, see `fast_hadamard`."""
    return fast_hadamard(x, width)


def augmented(x: Column) -> Column:
    """A vector of at most unit length with the coordinate that makes it one of exactly unit length."""
    return F.concat(x, F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - squared_norm(x)))))
