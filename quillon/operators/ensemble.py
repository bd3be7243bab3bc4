"""Model algebra on coefficient tables coef(member, a, b, theta)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import RANKED
from ..spec import Member, Model


def summarise(column: str, summary: str) -> Column:
    """An aggregate of the members' log-probabilities or losses; '' is for a single member."""
    c = F.col(column)
    if summary == "mean":
        return F.avg(c)
    if summary == "min":
        return F.min(c)
    if summary == "max":
        return F.max(c)
    if summary == "product":
        return F.aggregate(F.collect_list(c), F.lit(1.0), lambda a, x: a * x)
    if summary == "":
        return F.when(F.count(c) == 1, F.first(c)).otherwise(F.lit(float("nan")))
    raise ValueError(f"unknown summary: {summary}")


def union_members(tables: list[DataFrame]) -> DataFrame:
    """coef tables of several models as one, members numbered on; zeros are dropped."""
    shifted, at = [], 0
    for t in tables:
        shifted.append(t.withColumn("member", F.col("member") + F.lit(at)))
        at += t.select("member").distinct().count()
    return reduce(DataFrame.unionByName, shifted).where("theta <> 0")


def wide_members(coef: DataFrame, members: int) -> DataFrame:
    """(a, b, theta_0, theta_1, ...): the full outer join of all members on the feature, 0 where absent."""
    one = lambda m: F.coalesce(F.sum(F.when(F.col("member") == m, F.col("theta"))), F.lit(0.0)).alias(f"theta_{m}")
    return coef.groupBy("a", "b").agg(*(one(m) for m in range(members)))


def combine(coef: DataFrame, members: int, how: str) -> DataFrame:
    """(a, b, theta) of one model out of all members; an absent coefficient counts as 0.

    mean; or min and max by absolute value, the sign kept, the first member winning ties.
    """
    if how == "mean":
        return coef.groupBy("a", "b").agg((F.sum("theta") / members).alias("theta"))
    theta = F.array(*(f"theta_{m}" for m in range(members)))
    ranked = F.transform(theta, lambda x, i: F.struct(F.abs(x).alias("size"), (i if how == "min" else -i).alias("at"), x.alias("theta")))
    best = F.array_min(ranked) if how == "min" else F.array_max(ranked)
    return wide_members(coef, members).select("a", "b", best["theta"].alias("theta"))


def aligned(models: list[Model]) -> list[Model]:
    """The models over one numbering of base features, by name.

    K-mer classes of all models are numbered in the alphabet's order; columns of score
    tables keep their places, which must have one name. Models of different spaces, or
    whose transforms differ in a feature that both use, don't go together.
    """
    first = models[0]
    for m in models[1:]:
        if (m.spec is None) != (first.spec is None) or m.cooccurrence != first.cooccurrence or m.spec and not m.spec.same_space(first.spec):
            raise ValueError("the models have different kinds of features")
    if first.spec is None:
        names: dict[int, str] = {}
        for m in models:
            for i, name in m.names.items():
                if names.setdefault(i, name) != name:
                    raise ValueError(f"column {i + 1} is named {names[i]} and {name}")
        moved = [Model(m.members, names, None, m.transform, m.summary, m.cooccurrence) for m in models]
    else:
        every = sorted({n for m in models for n in m.names.values()}, key=class_order)
        number = {n: i for i, n in enumerate(every)}
        moved = [_renumbered(m, {i: number[n] for i, n in m.names.items()}, dict(enumerate(every))) for m in models]
    for k, m in enumerate(moved):
        for other in moved[:k]:
            _same_transform(m, other)
    return moved


def class_order(name: str) -> tuple[int, list[int]]:
    """Sorts names of k-mer classes as dictionaries do: by length, then in the alphabet's order."""
    word = name.split("|")[0]
    return len(word), [RANKED.index(c) for c in word]


def _renumbered(m: Model, to: dict[int, int], names: dict[int, str]) -> Model:
    move = lambda f: tuple(sorted((to[f[0]], to[f[1]])))
    members = [Member(x.bias, {move(f): t for f, t in x.theta.items()}) for x in m.members]
    return Model(members, names, m.spec, {move(f): t for f, t in m.transform.items()}, m.summary, m.cooccurrence)


def _same_transform(m: Model, other: Model, tolerance: float = 1e-12) -> None:
    if bool(m.transform) != bool(other.transform) and m.features() and other.features():
        raise ValueError("only one of the models has a transform")
    for f in m.transform.keys() & other.transform.keys():
        if any(abs(x - y) > tolerance for x, y in zip(m.transform[f], other.transform[f], strict=True)):
            raise ValueError("the models have different transforms")


def joined(models: list[Model]) -> Model:
    """One ensemble of all members, over the union of the features that have coefficients.

    Summaries must agree; one without a summary takes that of the others.
    """
    known = {m.summary for m in models if m.summary}
    if len(known) > 1:
        raise ValueError("the models have different summaries")
    moved = aligned(models)
    members = [Member(x.bias, {f: t for f, t in x.theta.items() if t != 0}) for m in moved for x in m.members]
    used = {f for x in members for f in x.theta}
    base = {i for f in used for i in f}
    transform = {f: t for m in moved for f, t in m.transform.items() if f in used}
    names = {i: n for i, n in moved[0].names.items() if i in base}
    return Model(members, names, moved[0].spec, transform, next(iter(known), ""), moved[0].cooccurrence)


def combine_models(models: list[Model], how: str) -> Model:
    """The members of all models combined, biases too; a coefficient that a member lacks counts as 0.

    A single member stays as it is.
    """
    whole = joined(models)
    if len(whole.members) == 1:
        return whole
    if how == "mean":
        pick = lambda xs: sum(xs) / len(xs)
    elif how in ("min", "max"):
        pick = (lambda xs: min(xs, key=abs)) if how == "min" else (lambda xs: max(xs, key=abs))
    else:
        raise ValueError(f"unknown summary: {how}")
    theta = {f: pick([m.theta.get(f, 0.0) for m in whole.members]) for f in whole.features()}
    return Model([Member(pick([m.bias for m in whole.members]), theta)], whole.names, whole.spec, whole.transform, "", whole.cooccurrence)


def stability(coef: DataFrame) -> DataFrame:
    """(a, b, stability, mean): in how many members a coefficient isn't zero, and its mean size there (NaN: in none)."""
    n = F.count_if(F.col("theta") != 0)
    return coef.groupBy("a", "b").agg(
        n.alias("stability"), F.coalesce(F.try_divide(F.sum(F.abs("theta")), n), F.lit(float("nan"))).alias("mean")
    )
