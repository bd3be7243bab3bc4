"""Ensembles, cross-validation and whole runs of learning."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logistic import class_log_prob, log_sigmoid
from ..operators.dataset import folds, limit_samples, placed
from ..operators.ensemble import summarise
from ..operators.linear import biases, linear_scores, penalty
from ..session import stored
from ..sources import model_io, writers
from ..spec import KmerSpec, Member, Model, Options
from .fit import SUMMARIES, Estimate, Fits, evaluate


@dataclass
class Result:
    """A model for one number of features with the estimates of its members."""

    n: int
    model: Model
    estimates: list[Estimate]


@dataclass
class FoldResult:
    """A fold's result with predictions(sample_id, label, prediction) of its test samples, and losses."""

    fold: int
    result: Result
    predictions: DataFrame
    train_loss: float
    test_loss: float


def _preselected(samples: DataFrame, features: DataFrame, options: Options, uses: list[Column], scaled_by: list[Column] | None, of: list[int]) -> DataFrame | None:
    """With co-preselection, candidates(a, b, fit): pairs of the features that fits without pairs choose.

    uses: the samples of each such fit; of: for each fit that is to come, which of them it follows.
    """
    if not (options.cooccurrence and options.co_preselection):
        return None
    first = replace(options, cooccurrence=False, lambda_=None, lambda_auto=(options.co_preselection,), penalty_free=False)
    fits = Fits(samples, features, first, uses, scaled_by)
    chosen = [sorted(a for a, _ in e[0].member.theta) for e in fits.estimates()]
    fits.close()
    pairs = [(a, b, k) for k, j in enumerate(of) for i, a in enumerate(chosen[j]) for b in chosen[j][i:]]
    return samples.sparkSession.createDataFrame(pairs, "a bigint, b bigint, fit int")


def _results(every: list[list[Estimate]], names: dict[int, str], options: Options, spec: KmerSpec | None) -> list[Result]:
    """A result for each number of features out of the members' estimates."""
    out = []
    for i, n in enumerate(options.lambda_auto if options.lambda_ is None else (options.max_features,)):
        own = [e[i] for e in every]
        transform = {f: t for e in own for f, t in e.transform.items()}
        used = sorted({x for e in own for f in e.member.theta for x in f})
        known = {x: names.get(x, str(x)) for x in used}
        out.append(Result(n, Model([e.member for e in own], known, spec, transform, options.ensemble_summary, options.cooccurrence), own))
    return out


def fit_ensemble(
    samples: DataFrame, features: DataFrame, names: dict[int, str], options: Options, spec: KmerSpec | None = None, validation: DataFrame | None = None
) -> list[Result]:
    """A model for each number of features; member k is fitted on the samples whose group isn't k.

    All members share one transform, made of all samples, and are fitted side by side. With
    validation samples only the result of the least loss on them is returned.
    """
    size = options.ensemble_size
    grouped = folds(samples, size, 0.0, options.seed) if size > 1 else samples.withColumn("fold", F.lit(-1))
    candidates = _preselected(grouped, features, options, [F.lit(True)], None, [0] * max(size, 1))
    fits = Fits(grouped, features, options, [F.col("fold") != k for k in range(max(size, 1))], None, candidates)
    every = fits.estimates()
    fits.close()
    out = _results(every, names, options, spec)
    if validation is not None and len(out) > 1:
        return [min(out, key=lambda r: evaluate(validation, features, r.model, None, options.balance))]
    return out


def cross_validate(samples: DataFrame, features: DataFrame, names: dict[int, str], options: Options, spec: KmerSpec | None = None) -> list[FoldResult]:
    """All folds' results; none for a single fold. Losses carry the penalty of a fixed lambda only.

    The folds, and their ensembles' members, are fitted side by side and scored by one
    pass, so the number of jobs doesn't grow with them. A fold's transform is made of all
    samples but those that validate it.
    """
    k, size = options.k_fold, max(options.ensemble_size, 1)
    if k <= 1:
        return []
    marked = folds(placed(samples, "place", options.seed), k, options.validation_size, options.seed, "place").persist()
    held = options.validation_size > 0
    before = marked.where("is_validation").count() if held else 0  # they come first
    fold, place = F.col("fold"), F.col("place")
    validates = [F.col("is_validation") & (fold != f) for f in range(k)]
    train = [~F.col("is_validation") & (fold != f) for f in range(k)]
    # the place among a fold's training samples: those of the fold itself, and those that validate, are left out
    rank = [place - before - (F.floor((place - 1 - f) / k) - F.floor(F.lit(float(before - 1 - f)) / k)) for f in range(k)]
    uses = [train[f] & (F.pmod(rank[f], F.lit(size)) != e if size > 1 else F.lit(True)) for f in range(k) for e in range(size)]
    scaled_by = [~v for v in validates] if held else None
    candidates = _preselected(marked, features, options, train, scaled_by, [f for f in range(k) for _ in range(size)])
    fits = Fits(marked, features, options, uses, [s for s in scaled_by for _ in range(size)] if held else None, candidates)
    every = fits.estimates()
    fits.close()
    done = [_results(every[f * size : (f + 1) * size], names, options, spec) for f in range(k)]
    many = len(done[0])
    # the members of all folds' models, their transforms made part of the coefficients, are scored by one pass
    whole = Model([_plain(r.model, m) for rs in done for r in rs for m in range(size)], {}, None, {}, "", options.cooccurrence)
    own = F.floor(F.col("member") / (many * size))
    scored = linear_scores(marked.select("sample_id", "label", "fold", "is_validation"), features, whole)
    part = F.when(fold == own, "test").when(F.col("is_validation"), "validation").otherwise("train")
    scored = stored(scored.withColumn("part", part), "scored")
    nll = -class_log_prob(F.col("z"), F.col("label"))
    sums = scored.groupBy("member", "part").agg(
        F.count_if("label").alias("n1"), F.count_if(~F.col("label")).alias("n0"), F.sum(F.when(F.col("label"), nll)).alias("s1"), F.sum(F.when(~F.col("label"), nll)).alias("s0")
    )
    losses = {(r.member, r.part): _mean_loss(r.n1, r.n0, r.s1 or 0.0, r.s0 or 0.0, options.balance) for r in sums.collect()}
    out = []
    for f, rs in enumerate(done):
        first = [(f * many + i) * size for i in range(many)]
        one = lambda i, p, l=None, rs=rs, first=first: float(
            SUMMARIES[rs[i].model.summary]([losses.get((first[i] + m, p), float("nan")) + x for m, x in enumerate(penalty(rs[i].model, l))])
        )
        chosen = [min(range(many), key=lambda i: one(i, "validation"))] if held and many > 1 else range(many)
        for i in chosen:
            tests = scored.where((F.col("part") == "test") & F.col("member").between(first[i], first[i] + size - 1))
            shown = tests.withColumn("prediction", log_sigmoid(F.col("z"))).groupBy("sample_id", "label").agg(summarise("prediction", rs[i].model.summary if size > 1 else "").alias("prediction"))
            out.append(FoldResult(f, rs[i], shown, one(i, "train", options.lambda_), one(i, "test", options.lambda_)))
    marked.unpersist()
    return out


def _plain(model: Model, k: int) -> Member:
    """A member with the transform in its coefficients and bias."""
    own = model.component(k)
    return Member(biases(own)[0][1], {f: t * model.transform.get(f, (0.0, 1.0))[1] for f, t in own.members[0].theta.items()})


def _mean_loss(n1: int, n0: int, s1: float, s0: float, balance: bool) -> float:
    n = n1 + n0
    return (s1 * n / (2 * n1) if n1 else 0.0) / n + (s0 * n / (2 * n0) if n0 else 0.0) / n if balance else (s1 + s0) / n


def learn(
    samples: DataFrame, features: DataFrame, names: dict[int, str], options: Options, spec: KmerSpec | None = None, output: str | None = None
) -> list[Result] | list[FoldResult]:
    """A run of learning: samples limited, then a fit on all of them, or one for each fold.

    output: the base name of the files that a run leaves behind (see save_run).
    """
    limited = limit_samples(samples, options.max_samples)
    if options.k_fold > 1:
        done = cross_validate(limited, features, names, options, spec)
    else:
        done = fit_ensemble(limited, features, names, options, spec)
    if output is not None:
        save_run(samples.sparkSession, done, options, output)
    return done


TRACE = "duration double, iteration int, change double, nonzero int, lambda double, loss double"


def save_run(spark: SparkSession, done: list[Result] | list[FoldResult], options: Options, output: str) -> list[str]:
    """Models, traces, paths and the tables of cross-validation, under the names that writers.output_name gives.

    Traces and paths hold all numbers of features of one fold. Returns what was written.
    """
    many = len(options.lambda_auto) > 1 and options.lambda_ is None
    written: list[str] = []

    def put(write, path: str) -> None:
        write(path)
        written.append(path)

    folds_ = sorted({r.fold for r in done if isinstance(r, FoldResult)}) or [None]
    for fold in folds_:
        own = [r.result if isinstance(r, FoldResult) else r for r in done if fold is None or r.fold == fold]
        for r in own:
            put(lambda p, r=r: model_io.save(r.model, p, spark), writers.output_name(output, r.n, fold, len(own) > 1) + ".json")
        last = own[-1].estimates
        trace = [x for e in last for x in e.trace]
        put(lambda p, x=trace: writers.write_trace(spark.createDataFrame(x, TRACE), p), writers.output_name(output, fold=fold) + ".trace")
        steps = [(k, i, *x) for k, e in enumerate(last) for i, x in enumerate(e.path)]
        steps_ = "estimator int, step int, lambda double, norm double, theta array<double>"
        put(lambda p, x=steps: writers.write_path(spark.createDataFrame(x, steps_), p), writers.output_name(output, fold=fold) + ".path")
    for n in sorted({r.result.n for r in done if isinstance(r, FoldResult)}):
        own = [r for r in done if r.result.n == n]
        shown = reduce(DataFrame.unionByName, [r.predictions.select("prediction", "label") for r in own])
        losses = spark.createDataFrame([(r.train_loss, r.test_loss) for r in own], "train double, test double")
        put(lambda p, a=shown, b=losses: writers.write_cv(a, b, p), writers.output_name(output, n, many=many))
    return written
