"""Column builders for vectors in ARRAY<DOUBLE> columns; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    return let(F.struct(a.alias("v"), norm(a).alias("n")), lambda s: F.when(s.n > 0, F.transform(s.v, lambda x: x / s.n)).otherwise(s.v))


def project(v: Column, matrix: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """(v - mean)' matrix: one dot product per column of the matrix."""
    matrix = np.asarray(matrix, float)
    offset = np.zeros(matrix.shape[1]) if mean is None else np.asarray(mean) @ matrix
    return let(v, lambda x: F.array(*[dot(x, vector(c)) - float(o) for c, o in zip(matrix.T, offset, strict=True)]))


def argmin(values: Sequence[Column]) -> Column:
    """Index of the least value; the lowest index wins ties."""
    a = F.array(*values)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def majority(labels: Column) -> Column:
    """The most frequent element of an array, the smallest of equals."""
    distinct = F.array_sort(F.array_distinct(labels))
    counts = F.transform(distinct, lambda d: F.size(F.filter(labels, lambda x: x == d)))
    return F.element_at(distinct, F.array_position(counts, F.array_max(counts)).cast("int"))
