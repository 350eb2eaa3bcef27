"""Column functions and aggregates on arrays of doubles. All stay in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def angular(cos: Column) -> Column:
    """1 - acos(cos) / pi, the cosine clipped to [-1, 1] first."""
    return 1 - F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))) / F.lit(3.141592653589793)


def angular_similarity(a: Column, b: Column) -> Column:
    return angular(cosine(a, b))


def mean_vector(a: Column) -> Column:
    """Aggregate: the component-wise mean, partial sums before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)
