"""Models over wide tables of numbers: scores are projections, sums over samples one aggregation.

A table of scores has a column for each base feature. Where its columns are known, as
they always are for tables of scores, nothing needs to be made long: no value is
shuffled, and a sample's products arise in its own row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logistic import log_sigmoid, sigmoid
from ..spec import Model, Pair
from .dataset import require_columns
from .linear import biases

#: Features whose sums are taken in one aggregation; more take several.
GROUP = 64


def value(columns: list[str], feature: Pair) -> Column:
    """A feature's value in a row: a column, or the product of two; null counts as zero."""
    one = lambda i: F.coalesce(F.col(f"`{columns[i]}`").cast("double"), F.lit(0.0))
    a, b = feature
    return one(a) if a == b else one(a) * one(b)


def pairs(columns: list[str]) -> list[Pair]:
    n = len(columns)
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def singles(columns: list[str]) -> list[Pair]:
    return [(a, a) for a in range(len(columns))]


def member_score(model: Model, columns: list[str], member: int = 0) -> Column:
    """The linear score of a row, transform and bias included."""
    z = F.lit(dict(biases(model))[member])
    for f, t in model.members[member].theta.items():
        if t != 0:
            z = z + value(columns, f) * F.lit(float(t * model.transform.get(f, (0.0, 1.0))[1]))
    return z


def scores(table: DataFrame, model: Model, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns keep with member and z, a row for each row of table and member."""
    require_columns(range(len(columns)), model)
    each = F.array(*(F.struct(F.lit(m).alias("member"), member_score(model, columns, m).alias("z")) for m in range(len(model.members))))
    return table.select(*keep, F.inline(each))


def predict(table: DataFrame, model: Model, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns keep with prediction: the members' log-probabilities of label true, summarised in the row."""
    require_columns(range(len(columns)), model)
    each = F.array(*(log_sigmoid(member_score(model, columns, m)) for m in range(len(model.members))))
    return table.select(*keep, summary(each, model.summary, len(model.members)).alias("prediction"))


def summary(each: Column, how: str, n: int) -> Column:
    """summarise for an array of n values."""
    if how == "mean":
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / n
    if how == "product":
        return F.aggregate(each, F.lit(1.0), lambda a, x: a * x)
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(each)
    if how == "":
        return each[0] if n == 1 else F.lit(float("nan"))
    raise ValueError(f"unknown summary: {how}")


def _sums(table: DataFrame, features: list[Pair], aggregates) -> DataFrame:
    """(a, b, ...): aggregates(feature) names some aggregates, whose values become columns; a job passes over the table once."""
    if not features:
        raise ValueError("no features")
    found = []
    for lo in range(0, len(features), GROUP):
        own = features[lo : lo + GROUP]
        named = [aggregates(f) for f in own]
        one = table.agg(*(c.alias(f"_{i}_{n}") for i, x in enumerate(named) for n, c in x.items()))
        rows = [
            F.struct(F.lit(f[0]).cast("bigint").alias("a"), F.lit(f[1]).cast("bigint").alias("b"), *(F.col(f"_{i}_{n}").alias(n) for n in x))
            for i, (f, x) in enumerate(zip(own, named, strict=True))
        ]
        found.append(one.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, found)


def residual(z: Column, label: Column, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    """The derivative of a sample's loss by its score, not yet divided by the number of samples."""
    w = F.when(label, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    return (sigmoid(z) - label.cast("double")) * w


def gradient(
    table: DataFrame, model: Model, columns: list[str], features: list[Pair], member: int = 0, weights: tuple[float, float] = (1.0, 1.0), label: str = "label", score: str | None = None
) -> DataFrame:
    """(a, b, gradient) of the mean loss by each of the features, the model's transform applied where it has one.

    score: a column that holds the scores already.
    """
    z = member_score(model, columns, member) if score is None else F.col(score)
    r = table.withColumn("_r", residual(z, F.col(label), weights))

    def one(f: Pair) -> dict[str, Column]:
        offset, scale = model.transform.get(f, (0.0, 1.0))
        return {"gradient": F.sum(F.col("_r") * (value(columns, f) - F.lit(float(offset))) * F.lit(float(scale))) / F.count("*")}

    return _sums(r, features, one)


def statistics(table: DataFrame, columns: list[str], features: list[Pair]) -> DataFrame:
    """(a, b, nonzero, mean, sd, max_abs, total) of features over all rows, as stats.statistics gives them."""

    def one(f: Pair) -> dict[str, Column]:
        v = value(columns, f)
        return {
            "nonzero": F.count_if(v != 0), "mean": F.avg(v), "sd": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "max_abs": F.max(F.abs(v)), "total": F.sum(v),
        }

    return _sums(table, features, one)


def transformed(table: DataFrame, columns: list[str], features: list[Pair], transform: dict[Pair, tuple[float, float]], keep: list[str]) -> DataFrame:
    """(keep, a, b, value, shift) of the features that aren't zero: scaled values, and the shift that a zero becomes."""
    rows = []
    for f in features:
        offset, scale = transform.get(f, (0.0, 1.0))
        rows.append(F.struct(
            F.lit(f[0]).cast("bigint").alias("a"), F.lit(f[1]).cast("bigint").alias("b"), value(columns, f).alias("raw"),
            (value(columns, f) * F.lit(float(scale))).alias("value"), F.lit(float(-offset * scale)).alias("shift"),
        ))
    return table.select(*keep, F.inline(F.array(*rows))).where("raw <> 0").drop("raw")

