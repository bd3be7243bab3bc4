"""Expressions of the logistic model, and of the numbering of feature pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sigmoid(z: Column) -> Column:
    """log of 1 / (1 + exp(-z)), also for large |z|."""
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def sigmoid(z: Column) -> Column:
    return F.exp(log_sigmoid(z))


def class_log_prob(z: Column, label: Column) -> Column:
    return F.when(label, log_sigmoid(z)).otherwise(log_sigmoid(-z))


def pair_dim(n: Column | int) -> Column:
    """Coefficients of n features with all pairs, the bias included."""
    n = n if isinstance(n, Column) else F.lit(n)
    return (n * (n + 1) / 2 + 1).cast("bigint")


def pair_position(a: Column, b: Column, n: Column | int) -> Column:
    """The place of feature (a, b), a <= b: singles 1..n, then pairs row by row."""
    n = n if isinstance(n, Column) else F.lit(n)
    before = n * (n - 1) / 2 - (n - a) * (n - a - 1) / 2
    return F.when(a == b, a + 1).otherwise(n + before + b - a).cast("bigint")


def position_pair(i: Column, n: int) -> tuple[Column, Column]:
    """The pair at place i (from 1): the inverse of pair_position."""
    k = i - 1 - n  # from 0 among the pairs
    whole = n * (n - 1) // 2
    rest = F.lit(whole - 1) - k
    a = F.lit(n - 2) - F.floor((F.sqrt(8.0 * rest + 1) - 1) / 2)
    b = k - (whole - (n - a) * (n - a - 1) / 2) + a + 1
    single = i <= n
    return F.when(single, i - 1).otherwise(a).cast("bigint"), F.when(single, i - 1).otherwise(b).cast("bigint")
