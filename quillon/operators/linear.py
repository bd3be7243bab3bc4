"""Evaluation of logistic models: scores, log-probabilities, gradient and loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logistic import class_log_prob, log_sigmoid, sigmoid
from ..spec import Model
from .dataset import require_columns
from .kmers import feature_values

#: Coefficients up to which a model goes to all executors.
FEW = 200_000


def coefficients(spark: SparkSession, model: Model) -> DataFrame:
    """coef(member, a, b, theta, scale) of the non-zero coefficients."""
    rows = [
        (m, a, b, float(t), float(model.transform.get((a, b), (0.0, 1.0))[1]))
        for m, member in enumerate(model.members)
        for (a, b), t in sorted(member.theta.items())
        if t != 0
    ]
    return spark.createDataFrame(rows, "member int, a bigint, b bigint, theta double, scale double")


def biases(model: Model) -> list[tuple[int, float]]:
    """Each member's bias with the transform's offsets taken in: what a sample of zeros scores."""
    out = []
    for m, member in enumerate(model.members):
        shift = 0.0
        for f, t in member.theta.items():
            offset, scale = model.transform.get(f, (0.0, 1.0))
            if t != 0 and offset != 0:
                shift -= offset * scale * t
        out.append((m, float(member.bias + shift)))
    return out


def linear_scores(samples: DataFrame, features: DataFrame, model: Model, columns: int | None = None) -> DataFrame:
    """samples with member and z, a row for each of both; products are formed on the way.

    columns: how many columns the features are made of; a model that needs others is refused.

    One shuffle by sample; samples without a feature of the model keep the bias. With
    offsets nothing is made dense: they are part of the bias.
    """
    if columns is not None:
        require_columns(range(columns), model)
    coef = coefficients(samples.sparkSession, model)
    small = sum(len(m.theta) for m in model.members) <= FEW
    defs = coef.select("a", "b").distinct()
    values = feature_values(features, F.broadcast(defs) if small else defs)
    terms = values.join(F.broadcast(coef) if small else coef, ["a", "b"])
    sums = terms.groupBy("sample_id", "member").agg(F.sum(F.col("value") * F.col("scale") * F.col("theta")).alias("_s"))
    each = F.array(*(F.struct(F.lit(m).alias("member"), F.lit(b).alias("_b")) for m, b in biases(model)))
    rows = samples.withColumn("_m", F.explode(each)).select(*samples.columns, "_m.member", "_m._b")
    scored = rows.join(sums, ["sample_id", "member"], "left")
    return scored.withColumn("z", F.col("_b") + F.coalesce("_s", F.lit(0.0))).select(*samples.columns, "member", "z")


def predict(samples: DataFrame, features: DataFrame, model: Model) -> DataFrame:
    """samples with prediction, the log-probability of label true, summarised over members."""
    from .ensemble import summarise

    scored = linear_scores(samples, features, model).withColumn("prediction", log_sigmoid(F.col("z")))
    if len(model.members) == 1:
        return scored.drop("member", "z")
    return scored.groupBy(*samples.columns).agg(summarise("prediction", model.summary).alias("prediction"))


def _weight(w0: float, w1: float):
    return F.when(F.col("label"), F.lit(float(w1))).otherwise(F.lit(float(w0)))


def loss(scored: DataFrame, n: int | None = None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(member, loss): the mean weighted negative log-likelihood of scored(label, member, z).

    It is divided by n (None: the samples that are scored), whatever the weights add up to.
    """
    nll = -class_log_prob(F.col("z"), F.col("label")) * _weight(*weights)
    return scored.groupBy("member").agg((F.sum(nll) / (F.count("*") if n is None else F.lit(n))).alias("loss"))


def penalty(model: Model, lambda_: float | None) -> list[float]:
    """lambda times the absolute sum of each member's coefficients, biases left out; None is no penalty."""
    return [(lambda_ or 0.0) * sum(abs(t) for t in m.theta.values()) for m in model.members]


def residuals(scored: DataFrame, n: int, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(sample_id, r): the derivative of the loss by each sample's score."""
    y = F.col("label").cast("double")
    return scored.select("sample_id", ((sigmoid(F.col("z")) - y) * _weight(*weights) / n).alias("r"))


def gradient(values: DataFrame, residuals: DataFrame) -> DataFrame:
    """(a, b, gradient) of the loss by each feature of values(sample_id, a, b, value[, shift]).

    Where a transform has offsets, shift times the sum of all residuals makes up for the zeros.
    """
    terms = values.join(residuals, "sample_id")
    if "shift" not in values.columns:
        return terms.groupBy("a", "b").agg(F.sum(F.col("r") * F.col("value")).alias("gradient"))
    total = residuals.agg(F.sum("r")).first()[0] or 0.0
    return terms.groupBy("a", "b").agg((F.sum(F.col("r") * F.col("value")) + F.first("shift") * F.lit(total)).alias("gradient"))


def penalised(gradient: DataFrame, model: Model, lambda_: float, member: int = 0) -> DataFrame:
    """gradient with lambda * sign(theta) added where theta isn't zero."""
    spark = gradient.sparkSession
    signs = [(a, b, lambda_ if t > 0 else -lambda_) for (a, b), t in model.members[member].theta.items() if t != 0]
    side = spark.createDataFrame(signs, "a bigint, b bigint, _p double")
    return gradient.join(F.broadcast(side) if len(signs) <= FEW else side, ["a", "b"], "left").select("a", "b", (F.col("gradient") + F.coalesce("_p", F.lit(0.0))).alias("gradient"))
