"""Stateless scoring of a stream of rows of numbers by a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.logistic import log_sigmoid
from ..operators.tables import member_score
from ..spec import Model


def score_stream(rows: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """rows, a stream or not, with prediction: the log-probability of label true of the first member."""
    return rows.withColumn("prediction", log_sigmoid(member_score(model, columns)))
