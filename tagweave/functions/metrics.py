"""Ranking metrics over a truth array and a predicted array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(truth: Column, predicted: Column, k: int) -> Column:
    return F.size(F.array_intersect(truth, F.slice(predicted, 1, k)))


def recall(truth: Column, predicted: Column, k: int) -> Column:
    """Distinct hits over the length of truth, repeats included; 1 for an empty truth."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(hits(truth, predicted, k) / F.greatest(F.size(truth), F.lit(1)))


def precision(truth: Column, predicted: Column, k: int) -> Column:
    """Hits over the length of the cut prediction; 1 for an empty truth, null for an empty prediction."""
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.try_divide(hits(truth, predicted, k).cast("double"), F.least(F.size(predicted), F.lit(k)).cast("double")))


def f1(truth: Column, predicted: Column, k: int) -> Column:
    r, p = recall(truth, predicted, k), precision(truth, predicted, k)
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0)))


def _relevant(truth: Column, predicted: Column, k: int) -> Column:
    return F.transform(F.slice(predicted, 1, k), lambda x: F.array_contains(truth, x).cast("int"))


def average_precision(truth: Column, predicted: Column, k: int) -> Column:
    """Sum of precision at each hit over min(truth, k)."""
    rel = _relevant(truth, predicted, k)
    at = F.transform(rel, lambda x, i: x * F.aggregate(F.slice(rel, F.lit(1), i + 1), F.lit(0), lambda a, y: a + y) / (i + 1))
    return F.when(F.size(truth) == 0, 1.0).otherwise(F.aggregate(at, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.least(F.size(truth), F.lit(k)), F.lit(1)))


def ndcg(truth: Column, predicted: Column, k: int) -> Column:
    """Binary gain over log2(place + 1), against the best order of min(truth, k) hits."""
    gain = F.transform(_relevant(truth, predicted, k), lambda x, i: x / F.log2(i + 2))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(truth), F.lit(k)), F.lit(1))), lambda i: 1 / F.log2(i + 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(truth) == 0, 1.0).otherwise(total(gain) / total(ideal))
