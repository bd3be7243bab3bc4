"""Feature selection by the size of gradients, and the penalty that goes with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..spec import Pair


@dataclass
class Selection:
    """Features to fit (in order), the penalty, and whether fitting may change anything."""

    features: list[Pair]
    lambda_: float
    changed: bool


def top_gradients(gradients: DataFrame, k: int) -> DataFrame:
    """The k features of the largest absolute gradients; ties by feature."""
    return gradients.orderBy(F.desc(F.abs("gradient")), F.col("a") != F.col("b"), "a", "b").limit(k)


def lambda_for(gradients: list[float], n: int) -> float:
    """Half way between the n-th largest absolute gradient and the largest one below it.

    gradients: absolute values, n of the largest and all below that may matter. With
    fewer than n there is no penalty.
    """
    ranked = sorted((abs(g) for g in gradients), reverse=True)
    if n > len(ranked) or n <= 0:
        return 0.0
    v = ranked[n - 1]
    return (v + next((g for g in ranked if g < v), 0.0)) / 2


def select_auto(gradients: DataFrame, active: list[Pair], n: int, before: float | None, epsilon: float = 0.0) -> Selection:
    """Active features and the best others, up to n in all, with the penalty for n features.

    Only the largest gradients come to the driver: twice n, and the largest below them,
    which is all that the choice and the penalty depend on. Another fit is due if a
    feature is new, if more than n are active, or, with epsilon > 0, if the penalty moved
    by that much.
    """
    wanted = max(2 * n, 1)
    gradients = gradients.persist(StorageLevel.MEMORY_AND_DISK)
    best = [((r.a, r.b), r.gradient) for r in top_gradients(gradients, wanted + 1).collect()]
    below = abs(best.pop()[1]) if len(best) > wanted else None
    if below is not None and below == abs(best[-1][1]):  # tied with the last of the best: the next smaller one counts
        below = gradients.where(F.abs("gradient") < F.lit(below)).agg(F.max(F.abs("gradient"))).first()[0]
    gradients.unpersist()
    return choose(best, below, active, n, before, epsilon)


def choose(best: list[tuple[Pair, float]], below: float | None, active: list[Pair], n: int, before: float | None, epsilon: float = 0.0) -> Selection:
    """select_auto's choice out of the 2 * n largest gradients, largest first, and the size of the next smaller one."""
    lambda_ = lambda_for([g for _, g in best] + ([below] if below is not None else []), n)
    chosen, taken = list(active), set(active)
    for nonzero in (True, False):
        for f, g in best:
            if len(chosen) >= n:
                break
            if f not in taken and (g != 0) == nonzero:
                chosen.append(f)
                taken.add(f)
    new = len(chosen) > len(active)
    moved = epsilon > 0 and before is not None and abs(lambda_ - before) >= epsilon
    return Selection(chosen, lambda_, new or len(active) > n or moved)


def select_fixed(gradients: DataFrame, active: list[Pair], lambda_: float, most: int = 0) -> Selection:
    """Active features and those whose absolute gradient reaches lambda, in feature order, up to `most`."""
    taken = set(active)
    over = gradients.where(F.abs("gradient") >= F.lit(lambda_)).orderBy(F.col("a") != F.col("b"), "a", "b")
    if most:
        over = over.limit(most + len(active))
    chosen = list(active)
    for r in over.toLocalIterator():
        if (r.a, r.b) in taken:
            continue
        chosen.append((r.a, r.b))
        if most and len(chosen) >= most:
            break
    return Selection(chosen, lambda_, len(chosen) > len(active))


def base_features(features: list[Pair]) -> tuple[list[int], list[Pair]]:
    """The base features that a selection needs, and the selection by their new numbers."""
    base = sorted({i for f in features for i in f})
    number = {i: k for k, i in enumerate(base)}
    return base, [(number[a], number[b]) for a, b in features]


def reduced(values: DataFrame, samples: DataFrame, features: list[Pair]) -> DataFrame:
    """samples with a column f0, f1, ... for each selected feature: the small dense design."""
    spark = samples.sparkSession
    own = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(features)], "i int, a bigint, b bigint"))
    hits = values.join(own, ["a", "b"])
    wide = hits.groupBy("sample_id").agg(*(F.sum(F.when(F.col("i") == i, F.col("value"))).alias(f"f{i}") for i in range(len(features))))
    return samples.join(wide, "sample_id", "left").fillna(0.0, [f"f{i}" for i in range(len(features))])
