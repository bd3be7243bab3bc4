"""Column statistics over all samples, implicit zeros included, and the transforms made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, stored

#: Features up to whose number a transform goes to all executors.
FEW = 500_000


def statistics(values: DataFrame, n: int) -> DataFrame:
    """(a, b, nonzero, mean, sd, max_abs, total) of values(sample_id, a, b, value) over n samples.

    One aggregation over what is stored; the n - stored zeros enter by number. sd has
    n - 1 below it; squared distances are those to the stored values' own mean, moved to
    the mean of all.
    """
    found = values.groupBy("a", "b").agg(
        F.count_if(F.col("value") != 0).alias("nonzero"), F.count("*").alias("stored"), F.sum("value").alias("total"),
        F.max(F.abs("value")).alias("max_abs"), F.avg("value").alias("own"), F.var_pop("value").alias("spread"),
    ).withColumn("mean", F.col("total") / n)
    ss = F.col("stored") * (F.col("spread") + (F.col("own") - F.col("mean")) ** 2) + (F.lit(n) - F.col("stored")) * F.col("mean") ** 2
    return found.select("a", "b", "nonzero", "mean", F.sqrt(ss / max(n - 1, 1)).alias("sd"), "max_abs", "total")


def single_values(features: DataFrame) -> DataFrame:
    """features as values(sample_id, a, b, value) with a = b."""
    return features.select("sample_id", F.col("feature_id").alias("a"), F.col("feature_id").alias("b"), "value")


def fit_transform(values: DataFrame, n: int, kind: str) -> DataFrame:
    """(a, b, offset, scale): value becomes (value - offset) * scale.

    standardizer: mean and 1 / sd, scale 1 for a constant column; variance-scaler: the
    same without offset; max-abs-scaler: 1 / max |value|; mean-scaler: n / sum. Where the
    last two would divide by zero the scale is infinite.
    """
    return transform_of(statistics(values, n), n, kind)


def transform_of(s: DataFrame, n: int, kind: str) -> DataFrame:
    """fit_transform out of statistics."""
    inverse = lambda x: F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(float("inf")))
    one = F.when(F.col("sd") == 0, F.lit(1.0)).otherwise(inverse(F.col("sd")))
    zero = F.lit(0.0)
    offset, scale = {
        "standardizer": (F.col("mean"), one),
        "variance-scaler": (zero, one),
        "max-abs-scaler": (zero, inverse(F.col("max_abs"))),
        "mean-scaler": (zero, inverse(F.col("total") / n)),
        "none": (zero, F.lit(1.0)),
    }[kind]
    return s.select("a", "b", offset.alias("offset"), scale.alias("scale"))


def apply_transform(values: DataFrame, transform: DataFrame) -> DataFrame:
    """values with the scale applied, and the shift -offset * scale of each feature apart.

    A transformed value is value + shift; a zero becomes the shift alone, so the table
    stays sparse and the shift is added where sums are taken. (sample_id, a, b, value, shift)
    """
    t = stored(transform.select("a", "b", "scale", (-F.col("offset") * F.col("scale")).alias("shift")), "transform")
    t = F.broadcast(t) if small(t, FEW) else t
    return values.join(t, ["a", "b"]).select("sample_id", "a", "b", (F.col("value") * F.col("scale")).alias("value"), "shift")


def select_transform(transform: DataFrame, features: DataFrame) -> DataFrame:
    """The entries of the features (a, b)."""
    return transform.join(features.select("a", "b"), ["a", "b"], "left_semi")


def merge_transforms(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The union of two transforms; features in both must agree within the tolerance."""
    l, r = (t.select("a", "b", F.struct("offset", "scale").alias(n)) for t, n in ((left, "l"), (right, "r")))
    both = l.join(r, ["a", "b"], "full_outer")
    far = (F.abs(F.col("l.offset") - F.col("r.offset")) > tolerance) | (F.abs(F.col("l.scale") - F.col("r.scale")) > tolerance)
    got = F.when(far, F.raise_error(F.lit("the transforms differ"))).otherwise(F.coalesce("l", "r"))
    return both.select("a", "b", got.alias("t")).select("a", "b", "t.offset", "t.scale")


def same_transforms(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: same, whether the features that both have agree within the tolerance."""
    both = left.alias("l").join(right.alias("r"), ["a", "b"])
    near = (F.abs(F.col("l.offset") - F.col("r.offset")) <= tolerance) & (F.abs(F.col("l.scale") - F.col("r.scale")) <= tolerance)
    return both.agg(F.coalesce(F.bool_and(near), F.lit(True)).alias("same"))
