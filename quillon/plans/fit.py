"""L1-regularised logistic regression along a path of numbers of features, for many fits at once.

The driver holds coefficients and selected features. Fits that differ in the samples they
use (folds, members of ensembles) go side by side: the gradients of all features are one
job for all of them, and so is each iteration of their solver.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType, _parse_datatype_string
from pyspark.storagelevel import StorageLevel

from ..operators import gram
from ..operators.dataset import class_weights
from ..operators.kmers import FEW, feature_table, feature_values
from ..operators.linear import linear_scores, loss, penalty
from ..operators.select import Selection, choose
from ..operators.stats import single_values, statistics, transform_of
from ..session import ship, small
from ..spec import Member, Model, Options, Pair
from .solver import Design, Hook, Problem, dense, minimise

#: Epochs of a fit that names no bound of its own: features that the solver drops and the
#: gradient proposes again would alternate for ever. A fit that ends so isn't settled.
MOST_EPOCHS = 30

log = logging.getLogger(__name__)
#: A sample's features by their ids, and by their places in a choice.
OWN, ITEMS = "array<struct<i:bigint,v:double>>", "array<struct<i:int,v:double>>"


@dataclass
class Estimate:
    """A fitted member with what led to it.

    trace: a row for each iteration of the solver (seconds, iterations so far, relative change,
    nonzero coefficients and the bias, penalty, objective). settled: False where a bound
    of epochs ended the fit.
    """

    member: Member
    transform: dict[Pair, tuple[float, float]] = field(default_factory=dict)
    lambda_: float = 0.0
    trace: list[tuple[float, int, float, int, float, float]] = field(default_factory=list)
    path: list[tuple[float, float, list[float]]] = field(default_factory=list)
    settled: bool = True


def in_order(features) -> list[Pair]:
    """Singles first, then pairs."""
    return sorted(features, key=lambda f: (f[0] != f[1], f))


@dataclass
class State:
    """One of the fits: where it stands."""

    member: Member = field(default_factory=lambda: Member(0.0))
    lambda_: float | None = None
    settled: bool = True
    trace: list = field(default_factory=list)
    path: list = field(default_factory=list)

    def active(self) -> list[Pair]:
        return in_order(f for f, t in self.member.theta.items() if t != 0)


class Fits:
    """Fits on parts of samples(sample_id, label, ...) and features; each starts warm from its last solution."""

    def __init__(
        self, samples: DataFrame, features: DataFrame, options: Options, uses: list[Column] | None = None, scaled_by: list[Column] | None = None,
        candidates: DataFrame | None = None, transform: DataFrame | None = None, hook: Hook | None = None, warm: bool = True,
    ):
        """uses: for each fit, which samples it is on; one on all without. scaled_by: for each
        of as many transforms as fits, or for one of all fits, the samples that it is made of;
        all without. candidates(a, b[, fit]): the features that may be chosen; None is all, with
        all pairs if options.cooccurrence. transform: one fitted before."""
        self.options, self.hook, self.warm = options, hook, warm
        uses, scaled_by = uses or [F.lit(True)], scaled_by or [F.lit(True)]
        marked = samples.select("sample_id", "label", F.array(*uses).alias("uses"), F.array(*scaled_by).alias("scaled")).persist(StorageLevel.MEMORY_AND_DISK)
        many, scales = len(uses), len(scaled_by)
        counted = [F.count_if(F.col("uses")[k] & c) for k in range(many) for c in (F.lit(True), F.col("label"))]
        row = marked.agg(*counted, *(F.count_if(F.col("scaled")[t]) for t in range(scales)), F.count("*")).first()
        self.n = [row[2 * k] for k in range(many)]
        self.labelled = [row[2 * k + 1] for k in range(many)]
        if not all(self.n):
            raise ValueError("no samples to fit on")
        self.weights = [self._class_weights(n, n1) for n, n1 in zip(self.n, self.labelled, strict=True)]
        weight = [
            F.when(F.col("uses")[k], F.when(F.col("label"), F.lit(w[1] / n)).otherwise(F.lit(w[0] / n))).otherwise(F.lit(0.0))
            for k, (n, w) in enumerate(zip(self.n, self.weights, strict=True))
        ]
        self.samples = marked.select("sample_id", "label", F.array(*weight).alias("w"))
        # a row is a sample with all of its features: choices, residuals and gradients shuffle no value
        own = features.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("feature_id").cast("bigint").alias("i"), F.col("value").cast("double").alias("v"))).alias("own"))
        self.packed = self.samples.join(own, "sample_id", "left").withColumn("own", F.coalesce("own", F.array().cast(OWN))).persist(StorageLevel.MEMORY_AND_DISK)
        self.features = self.packed.select("sample_id", F.inline("own")).withColumnsRenamed({"i": "feature_id", "v": "value"})
        self.candidates, self.pairs = candidates, options.cooccurrence and candidates is None
        self.values = single_values(self.features)
        if candidates is not None:  # products arise for the candidates only
            wanted = candidates.select("a", "b").distinct()
            self.values = feature_values(self.features, F.broadcast(wanted) if small(wanted, FEW) else wanted)
        self.kept = [marked, self.packed]
        self.transform, self._scales = None, {}
        if transform is not None:
            self.transform = transform.select("a", "b", F.array("offset").alias("offset"), F.array("scale").alias("scale"))
        elif options.transform != "none":
            self.transform = self._fit_transform(marked, [row[2 * many + t] for t in range(scales)], row[-1])
        if self.transform is not None:
            self.transform = self.transform.persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(self.transform)
        self.scale_of = [k if scales == many else 0 for k in range(many)] if transform is None else [0] * many
        self.states = [State() for _ in range(many)]
        self.started = time.monotonic()

    def _class_weights(self, n: int, n1: int) -> tuple[float, float]:
        if not self.options.balance:
            return 1.0, 1.0
        return (n / (2 * (n - n1)) if n > n1 else 1.0), (n / (2 * n1) if n1 else 1.0)

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    def _fit_transform(self, marked: DataFrame, n: list[int], every: int) -> DataFrame:
        """(a, b, offset array, scale array): an entry for each set of samples that transforms are made of."""
        found = []
        for t, many in enumerate(n):
            own = lambda df, t=t, many=many: df if many == every else df.join(marked.where(F.col("scaled")[t]).select("sample_id"), "sample_id", "left_semi")
            s = statistics(own(self.values), many)
            if self.pairs:
                s = s.unionByName(gram.pair_statistics(own(self.features), many))
            found.append(transform_of(s, many, self.options.transform).withColumn("t", F.lit(t)))
        if len(found) == 1:
            return found[0].select("a", "b", F.array("offset").alias("offset"), F.array("scale").alias("scale"))
        # a feature that a set of samples lacks is a constant there
        one = lambda c, t, absent: F.coalesce(F.max(F.when(F.col("t") == t, F.col(c))), F.lit(absent))
        arrays = [F.array(*(one(c, t, absent) for t in range(len(n)))).alias(c) for c, absent in (("offset", 0.0), ("scale", 1.0))]
        return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(*arrays)

    def scales(self, features: list[Pair], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The features' offsets and scales in fit k."""
        missing = [f for f in features if f not in self._scales]
        if missing and self.transform is not None:
            side = feature_table(self.samples.sparkSession, missing)
            for r in self.transform.join(F.broadcast(side.select("a", "b")), ["a", "b"]).collect():
                self._scales[r.a, r.b] = (r.offset, r.scale)
        t = self.scale_of[k]
        own = [(o[t], s[t]) for o, s in (self._scales.get(f, ([0.0] * (t + 1), [1.0] * (t + 1))) for f in features)]
        return np.array([o for o, _ in own], float), np.array([s for _, s in own], float)

    def _picked(self, features: list[Pair], keep: list[str]) -> DataFrame:
        """The columns keep of packed with items, for features that are no products: within each sample's row."""
        ids = np.array([a for a, _ in features], np.int64)
        order = np.argsort(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column("own")
                ends, flat = own.offsets.to_numpy(), own.flatten()
                i, v = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = np.minimum(np.searchsorted(ids, i, sorter=order), max(len(ids) - 1, 0))
                place = order[at] if len(ids) else at
                hit = (ids[place] == i) & (v != 0) if len(ids) else np.zeros(len(i), bool)
                offsets = np.concatenate([[0], np.cumsum(hit)])[ends - ends[0]].astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(place[hit].astype(np.int32)), pa.array(v[hit])], names=["i", "v"])
                yield pa.record_batch([*(b.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), items)], names=[*keep, "items"])

        ship(self.samples.sparkSession)
        used = self.packed.select(*dict.fromkeys([*keep, "own"]))
        fields = [used.schema[c] for c in keep]
        return used.mapInArrow(run, StructType([*fields, StructField("items", _parse_datatype_string(ITEMS))]))

    def _rows(self, features: list[Pair]) -> DataFrame:
        """(sample_id, label, w, items): the samples with their values of the features, by the features' places."""
        if all(a == b for a, b in features):
            return self._picked(features, ["sample_id", "label", "w"])
        items = F.lit(None).cast(ITEMS)
        spark = self.samples.sparkSession
        defs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(features)], "i int, a bigint, b bigint")
        hits = feature_values(self.features, F.broadcast(defs.select("a", "b"))).join(F.broadcast(defs), ["a", "b"])
        own = hits.groupBy("sample_id").agg(F.collect_list(F.struct("i", F.col("value").alias("v"))).alias("items"))
        return self.samples.join(own, "sample_id", "left").withColumn("items", F.coalesce("items", F.array().cast(ITEMS)))

    def _scored(self) -> tuple[list[Pair], Callable[[pa.RecordBatch], np.ndarray]]:
        """The active features, and what gives a batch's residuals by fit out of columns label, w and items."""
        active = in_order({f for s in self.states for f in s.active()})
        place = {f: i + 1 for i, f in enumerate(active)}
        raw = np.zeros((len(active) + 1, len(self.states)))
        for k, s in enumerate(self.states):
            own = s.active()
            p = Problem([place[f] - 1 for f in own], 0.0, np.zeros(0), *self.scales(own, k))
            raw[[0, *(place[f] for f in own)], k] = p.raw() @ np.array([s.member.bias, *(s.member.theta[f] for f in own)])

        def of(b: pa.RecordBatch) -> np.ndarray:
            y = b.column("label").to_numpy(zero_copy_only=False).astype(float)[:, None]
            w = b.column("w").flatten().to_numpy().reshape(b.num_rows, -1)
            z = dense(b.column("items"), len(raw) - 1) @ raw[1:] + raw[0]
            return (np.exp(np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z)))) - y) * w

        return active, of

    def residuals(self) -> DataFrame:
        """(sample_id, w array<double>): for each fit the derivative of its loss by the sample's score, at its coefficients."""
        active, of = self._scored()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                r = of(b)
                lists = pa.ListArray.from_arrays(np.arange(0, r.size + 1, r.shape[1], dtype=np.int32), pa.array(r.ravel()))
                yield pa.record_batch([b.column("sample_id"), lists], names=["sample_id", "w"])

        ship(self.samples.sparkSession)
        rows = self._rows(active)
        return rows.mapInArrow(run, StructType([rows.schema["sample_id"], StructField("w", ArrayType(DoubleType()))]))

    def _sums_by_feature(self) -> DataFrame | None:
        """(a, g array<double>): for each fit the sum of residuals times a feature's values, and of residuals alone where a is null; None if products are active."""
        active, of = self._scored()
        if any(a != b for a, b in active):
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                r, own = of(b), b.column("own")
                flat = own.flatten()
                ids, at = np.unique(flat.field(0).to_numpy(zero_copy_only=False), return_inverse=True)
                row = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
                v = flat.field(1).to_numpy(zero_copy_only=False)
                g = np.column_stack([np.concatenate([np.bincount(at, v * r[row, k], len(ids)), [r[:, k].sum()]]) for k in range(r.shape[1])])
                lists = pa.ListArray.from_arrays(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32), pa.array(g.ravel()))
                yield pa.record_batch([pa.array([*ids.tolist(), None], pa.int64()), lists], names=["a", "g"])

        ship(self.samples.sparkSession)
        parts = self._picked(active, ["label", "w", "own"]).mapInArrow(run, "a bigint, g array<double>")
        return parts.groupBy("a").agg(F.array(*(F.sum(F.col("g")[k]) for k in range(len(self.states)))).alias("g"))

    def every_gradient(self) -> DataFrame:
        """(a, b, g array<double>) of each fit's unpenalised loss by every feature that may be chosen, at its coefficients."""
        many = range(len(self.states))
        sums = self._sums_by_feature() if self.candidates is None and not self.pairs else None
        r = (self.residuals() if sums is None else sums).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(r)
        if sums is not None:
            found = r.where("a is not null").select("a", F.col("a").alias("b"), "g")
            return found if self.transform is None else self._moved(found, r.where("a is null").first().g)
        found = self.values.join(r, "sample_id").groupBy("a", "b").agg(F.array(*(F.sum(F.col("value") * F.col("w")[k]) for k in many)).alias("g"))
        if self.pairs:
            found = found.unionByName(gram.pair_sums(self.features, r).select("a", "b", F.col("sums").alias("g")))
        if self.transform is None:
            return found
        return self._moved(found, r.agg(*(F.sum(F.col("w")[k]) for k in many)).first())

    def _moved(self, found: DataFrame, total: Sequence[float]) -> DataFrame:
        """Sums (a, b, g) by the features' transforms, given the sums of residuals."""
        many = range(len(self.states))
        one = lambda k: F.col("scale")[self.scale_of[k]] * (F.col("g")[k] - F.col("offset")[self.scale_of[k]] * F.lit(float(total[k])))
        return found.join(self.transform, ["a", "b"]).select("a", "b", F.array(*(one(k) for k in many)).alias("g"))

    def _each(self, gradients: DataFrame, open_: list[int]) -> DataFrame:
        """(fit, a, b, gradient) of the fits that are open, each one's candidates only."""
        rows = gradients.select("a", "b", F.posexplode("g").alias("fit", "gradient")).where(F.col("fit").isin(open_))
        if self.candidates is not None and "fit" in self.candidates.columns:
            rows = rows.join(F.broadcast(self.candidates) if small(self.candidates, FEW) else self.candidates, ["fit", "a", "b"], "left_semi")
        return rows

    def _best(self, gradients: DataFrame, open_: list[int], n: int) -> dict[int, tuple[list[tuple[Pair, float]], float | None]]:
        """Of each open fit the 2 * n largest gradients, and the size of the next smaller one: one job, and one more if there are ties."""
        rows, wanted = self._each(gradients, open_), max(2 * n, 1)
        size = F.abs("gradient")
        order = Window.partitionBy("fit").orderBy(F.desc(size), F.col("a") != F.col("b"), "a", "b")
        top: dict[int, list] = {k: [] for k in open_}
        for r in rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= wanted + 1).orderBy("fit", "at").collect():
            top[r.fit].append(((r.a, r.b), r.gradient))
        below: dict[int, float | None] = {k: abs(x.pop()[1]) if len(x) > wanted else None for k, x in top.items()}
        tied = {k: b for k, b in below.items() if b is not None and b == abs(top[k][-1][1])}
        if tied:  # with the last of the best: the next smaller one counts
            rules = [F.max(F.when((F.col("fit") == k) & (size < F.lit(b)), size)).alias(str(k)) for k, b in tied.items()]
            below |= {int(k): x for k, x in rows.agg(*rules).first().asDict().items()}
        return {k: (top[k], below[k]) for k in open_}

    def _over(self, gradients: DataFrame, open_: list[int], lambda_: float, most: int) -> dict[int, list[Pair]]:
        """Of each open fit the features whose gradient reaches lambda, in feature order; with a bound no more than it and the active ones."""
        rows = self._each(gradients, open_).where(F.abs("gradient") >= F.lit(lambda_))
        if most:
            order = Window.partitionBy("fit").orderBy(F.col("a") != F.col("b"), "a", "b")
            held = max(len(self.states[k].active()) for k in open_)
            rows = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most + held)
        out: dict[int, list[Pair]] = {k: [] for k in open_}
        for r in rows.select("fit", "a", "b").collect():
            out[r.fit].append((r.a, r.b))
        return {k: in_order(x) for k, x in out.items()}

    def _solve(self, chosen: dict[int, list[Pair]], lambdas: dict[int, float]) -> dict[int, list]:
        """Fit the chosen features of some fits at once; their new members, and the iterations of each."""
        union = in_order({f for x in chosen.values() for f in x})
        place = {f: i for i, f in enumerate(union)}
        problems, steps = {}, {}
        for k, features in chosen.items():
            theta, (w0, w1) = self.states[k].member.theta if self.warm else {}, self.weights[k]
            if not features:
                n1, n0 = self.labelled[k], self.n[k] - self.labelled[k]
                self.states[k].member, steps[k] = Member(float(np.log(max(n1 * w1, 1e-12) / max(n0 * w0, 1e-12)))), []
                continue
            start = np.array([self.states[k].member.bias if self.warm else 0.0, *(theta.get(f, 0.0) for f in features)])
            problems[k] = Problem([place[f] for f in features], lambdas[k], start, *self.scales(features, k), k)
        if problems:
            design, o, own = Design(self._rows(union), len(union)), self.options, list(problems)
            hook = (lambda j, run: self.hook(own[j], run)) if self.hook else None
            for k, run in zip(own, minimise(design, list(problems.values()), o.solver, o.epsilon, o.epsilon_loss, o.max_iterations, hook), strict=True):
                self.states[k].member = Member(float(run.theta[0]), {f: float(t) for f, t in zip(chosen[k], run.theta[1:], strict=True)})
                steps[k] = run.steps[1:]
            design.close()
        return steps

    def _fit(self, chosen: dict[int, Selection]) -> None:
        began = time.monotonic() - self.started
        steps = self._solve({k: c.features for k, c in chosen.items()}, {k: c.lambda_ for k, c in chosen.items()})
        for k, c in chosen.items():
            s = self.states[k]
            s.trace += [(began + x.seconds, len(s.trace) + i, x.change, x.nonzero, x.lambda_, x.value) for i, x in enumerate(steps[k])]
            theta = [s.member.bias, *(s.member.theta[f] for f in in_order(s.member.theta))]
            s.path.append((c.lambda_, sum(map(abs, theta[1:])), theta))
            log.info("fit %d: %d features of %d tried, lambda %e, %d iterations", k, s.member.nonzero(), len(c.features), c.lambda_, len(steps[k]))

    def _epochs(self, select) -> None:
        """Let every fit choose and fit again until its choice changes nothing. select(gradients, open fits) gives their Selections."""
        open_ = list(range(len(self.states)))
        for k in open_:
            self.states[k].settled = False
        for epoch in range(self.options.max_epochs or MOST_EPOCHS):
            gradients = self.every_gradient().persist(StorageLevel.MEMORY_AND_DISK)
            due = select(gradients, open_)
            gradients.unpersist()
            self.kept.pop().unpersist()
            for k in open_:
                self.states[k].settled = bool(epoch) and not due[k].changed
            open_ = [k for k in open_ if not self.states[k].settled]
            if not open_:
                break
            self._fit({k: due[k] for k in open_})
            for k in open_:
                self.states[k].lambda_ = due[k].lambda_
            if self.options.lambda_ is not None and self.options.max_features:
                full = [k for k in open_ if len(due[k].features) >= self.options.max_features]
                for k in full:
                    self.states[k].settled = True
                open_ = [k for k in open_ if k not in full]
            if not open_:
                break

    def fit_auto(self, n: int) -> list[Estimate]:
        """Choose features and penalty for n non-zero coefficients, fit, and again until nothing changes.

        n = 0 stands for all candidates.
        """
        for s in self.states:
            s.lambda_ = None

        def chosen(gradients: DataFrame, open_: list[int]) -> dict[int, Selection]:
            many = n if n > 0 else gradients.count()
            best = self._best(gradients, open_, many)
            return {k: choose(*best[k], self.states[k].active(), many, self.states[k].lambda_, self.options.epsilon_lambda) for k in open_}

        self._epochs(chosen)
        return self._done()

    def fit_fixed(self, lambda_: float) -> list[Estimate]:
        """Add what violates |gradient| < lambda and fit, until nothing does."""
        most = self.options.max_features

        def chosen(gradients: DataFrame, open_: list[int]) -> dict[int, Selection]:
            out = {}
            for k, over in self._over(gradients, open_, lambda_, most).items():
                active = self.states[k].active()
                fresh = [f for f in over if f not in set(active)]
                features = active + (fresh[: max(most - len(active), 1)] if most else fresh)
                out[k] = Selection(features, lambda_, len(features) > len(active))
            return out

        self._epochs(chosen)
        for s in self.states:
            s.lambda_ = lambda_
        return self._done()

    def _done(self) -> list[Estimate]:
        kept = [s.member for s in self.states]
        if self.options.penalty_free:
            due = {k: s.active() for k, s in enumerate(self.states) if s.active()}
            self._solve(due, dict.fromkeys(due, 0.0))
        out = []
        for k, s in enumerate(self.states):
            member = Member(s.member.bias, {f: s.member.theta[f] for f in s.active()})
            transform = {}
            if self.transform is not None:
                transform = {f: (float(o), float(x)) for f, o, x in zip(member.theta, *self.scales(list(member.theta), k), strict=True)}
            if not s.settled:
                log.warning("a fit ended at its bound of epochs, not settled")
            out.append(Estimate(member, transform, s.lambda_ or 0.0, list(s.trace), list(s.path), s.settled))
            s.member = kept[k]  # the next number of features starts from the penalised solution
        return out

    def estimates(self) -> list[list[Estimate]]:
        """For each fit one estimate for a fixed penalty, else one for each number of features, ascending."""
        if self.options.lambda_ is not None:
            found = [self.fit_fixed(self.options.lambda_)]
        else:
            found = [self.fit_auto(n) for n in self.options.lambda_auto]
        return [list(x) for x in zip(*found, strict=True)]


class Estimator(Fits):
    """A single fit on all samples."""

    @property
    def member(self) -> Member:
        return self.states[0].member

    @property
    def trace(self) -> list:
        return self.states[0].trace

    @property
    def path(self) -> list:
        return self.states[0].path

    def restore(self, member: Member) -> None:
        """Go on from a fitted member: its coefficients that aren't zero are active, and the next fit starts from them."""
        self.states[0].member = Member(member.bias, {f: t for f, t in member.theta.items() if t != 0})

    def gradients(self) -> DataFrame:
        """(a, b, gradient) of the unpenalised loss by every candidate, at the current coefficients."""
        return self.every_gradient().select("a", "b", F.col("g")[0].alias("gradient"))

    def estimate(self) -> list[Estimate]:
        return self.estimates()[0]


SUMMARIES = {"mean": np.mean, "min": np.min, "max": np.max, "product": np.prod, "": lambda v: v[0] if len(v) == 1 else float("nan")}


def evaluate(samples: DataFrame, features: DataFrame, model: Model, lambda_: float | None = None, balance: bool = False) -> float:
    """The loss of a model on labelled samples, members summarised."""
    scored = linear_scores(samples, features, model)
    n = samples.count()
    w = class_weights(samples).first() if balance else None
    rows = {r["member"]: r["loss"] for r in loss(scored, n, (w.w0, w.w1) if w else (1.0, 1.0)).collect()}
    values = [rows.get(m, float("nan")) + p for m, p in enumerate(penalty(model, lambda_))]
    return float(SUMMARIES[model.summary](values))
