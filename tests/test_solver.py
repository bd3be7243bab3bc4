"""Own solvers against another one and against optimality, fits side by side against fits one by one, sums over pairs against products."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillon.operators import dataset, gram, kmers, linear, stats
from quillon.plans.fit import Estimator, Fits
from quillon.plans.learn import cross_validate
from quillon.plans.solver import Design, Problem, minimise
from quillon.spec import Member, Model, Options

COLUMNS = 6


def table(spark, n=240, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        label = r.random() < 0.4
        x = [r.gauss(0.7 * label, 1), r.gauss(5, 2) - label, r.gauss(0, 3), r.random() * (i % 3 > 0), float(r.randint(0, 4)), r.gauss(0, 1)]
        rows.append((i, label, x))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = table(spark)
    df = spark.createDataFrame([(i, y, *x) for i, y, x in rows], "sample_id bigint, label boolean, " + ", ".join(f"c{i} double" for i in range(COLUMNS))).cache()
    return rows, df.select("sample_id", "label"), dataset.score_features(df, [f"c{i}" for i in range(COLUMNS)]).cache()


@pytest.fixture(scope="module")
def design(spark, data):
    rows, _, _ = data
    n = len(rows)
    w = [[1 / n, (i % 3 > 0) / 160.0] for i in range(n)]
    items = [[(j, v) for j, v in enumerate(x) if v] for _, _, x in rows]
    df = spark.createDataFrame([(y, a, b) for (_, y, _), a, b in zip(rows, w, items, strict=True)], "label boolean, w array<double>, items array<struct<i:int,v:double>>")
    return Design(df.repartition(3), COLUMNS)


def problem(rows, columns, lambda_, weight=0, start=None):
    x = np.array([[r[2][c] for c in columns] for r in rows])
    return Problem(list(columns), lambda_, np.zeros(len(columns) + 1) if start is None else start, x.mean(axis=0), 1 / x.std(axis=0, ddof=1), weight)


@pytest.mark.parametrize("method", ["coordinate", "proximal"])
def test_optimum_is_that_of_another_solver(spark, data, design, method):
    rows, _, _ = data
    problems = [problem(rows, range(COLUMNS), 0.02), problem(rows, [0, 1, 4], 0.05, 1), problem(rows, [2], 10.0), problem(rows, [0, 3], 0.0)]
    runs = minimise(design, problems, method)
    for p, run in zip(problems, runs, strict=True):
        own = [(float(y), Vectors.dense([(x[c] - o) * s for c, o, s in zip(p.columns, p.offset, p.scale, strict=True)])) for i, y, x in rows if p.weight == 0 or i % 3 > 0]
        other = LogisticRegression(regParam=p.lambda_, elasticNetParam=1.0, standardization=False, maxIter=2000, tol=1e-13).fit(spark.createDataFrame(own, ["label", "features"]))
        assert run.theta == pytest.approx(np.array([other.intercept, *other.coefficients]), abs=1e-6)
        assert run.done and all(a.value >= b.value - 1e-12 for a, b in zip(run.steps, run.steps[1:], strict=False))


def test_one_job_an_iteration_for_all_problems(data, design):
    rows, _, _ = data
    before = design.jobs
    runs = minimise(design, [problem(rows, range(COLUMNS), x) for x in (0.1, 0.03, 0.01, 0.001)])
    assert design.jobs - before <= max(len(r.steps) for r in runs) + 3


def test_steps_shrink_on_a_rise_and_hooks_see_every_iteration(data, design):
    rows, _, _ = data
    seen = []

    def hook(k, run):
        if len(run.steps) == 2:
            run.step *= 1000  # far too long: the next objective rises
        seen.append((k, run.step, run.value))
        return len(run.steps) > 300

    p = problem(rows, range(COLUMNS), 0.02)
    run = minimise(design, [p], "proximal", hook=hook)[0]
    assert run.theta == pytest.approx(minimise(design, [p])[0].theta, abs=1e-6)
    assert len(seen) == len(run.steps) and min(s for _, s, _ in seen[2:]) < seen[1][1]
    stopped = minimise(design, [p], "proximal", hook=lambda k, r: len(r.steps) == 4)[0]
    assert len(stopped.steps) == 4 and minimise(design, [p], "proximal", most=5)[0].done


@pytest.mark.parametrize("solver", ["coordinate", "proximal"])
def test_a_path_starts_warm(data, solver):
    _, samples, features = data
    options = Options(lambda_auto=(1, 2, 3), transform="standardizer", solver=solver)
    took = {}
    for warm in (True, False):
        est = Estimator(samples, features, options, warm=warm)
        done = est.estimate()
        assert [e.member.nonzero() for e in done] == [1, 2, 3] and all(e.settled for e in done)
        assert all(change is not None and nonzero >= 1 for _, _, change, nonzero, _, _ in est.trace)
        took[warm] = (len(est.trace), [e.member.theta for e in done])
        est.close()
    assert took[True][0] < took[False][0] or solver == "coordinate" and took[True][0] <= took[False][0]  # a Newton path is short either way
    for a, b in zip(took[True][1], took[False][1], strict=True):
        assert a == pytest.approx(b, abs=1e-6)


def jobs(spark, f):
    """How many Spark jobs a call takes."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_jobs_of_cross_validation_do_not_grow_with_folds(spark, data):
    _, samples, features = data
    run = lambda k: cross_validate(samples, features, {}, Options(lambda_auto=(2,), k_fold=k, seed=-1, transform="standardizer", max_epochs=3))
    few, a = jobs(spark, lambda: run(2))
    many, b = jobs(spark, lambda: run(6))
    assert len(few) == 2 and len(many) == 6
    assert b <= a * 1.5  # epochs and iterations of the slowest fold, not their sum


def test_folds_and_members_equal_fits_one_by_one(data):
    _, samples, features = data
    options = Options(lambda_auto=(1, 3), k_fold=2, ensemble_size=2, validation_size=0.3, seed=-1, transform="standardizer", balance=True)
    done = cross_validate(samples, features, {}, options)
    assert [r.fold for r in done] == [0, 1]
    marked = dataset.folds(samples, 2, 0.3, -1)
    for r in done[1:]:
        train, validation, test = dataset.split(marked, r.fold)
        assert train.count() + validation.count() + test.count() == 240 and r.predictions.count() == test.count()
        # transforms are of training and test samples; put them into the plain fit
        shared = Fits(train.unionByName(test).select("sample_id", "label"), features, Options(transform="standardizer"))
        grouped = dataset.folds(train.select("sample_id", "label"), 2, 0.0, -1)
        plain = shared.transform.select("a", "b", F.col("offset")[0].alias("offset"), F.col("scale")[0].alias("scale"))
        for m, member in enumerate(r.result.model.members):
            est = Estimator(grouped.where(F.col("fold") != m), features, Options(lambda_auto=(1, 3), balance=True), transform=plain)
            found = {len(e.member.theta): e.member for e in est.estimate()}[len(member.theta)]
            assert member.theta == pytest.approx(found.theta, abs=1e-7) and member.bias == pytest.approx(found.bias, abs=1e-7)
            est.close()
        shared.close()
        scored = linear.predict(test.select("sample_id", "label"), features, r.result.model)
        assert {x.sample_id: x.prediction for x in scored.collect()} == pytest.approx({x.sample_id: x.prediction for x in r.predictions.collect()})


def sparse(spark, n=70, p=25, seed=2):
    r = random.Random(seed)
    rows = [(i, f, r.choice([1.0, 2.0, -3.0, 0.5])) for i in range(n) for f in range(p) if r.random() < 0.3]
    rows += [(n, f, 1.0) for f in range(p)] + [(n + 1, 3, 4.0)]
    return spark.createDataFrame(rows, "sample_id bigint, feature_id bigint, value double").repartition(3).cache(), n + 3


@pytest.mark.parametrize(("side", "held"), [(256, 1 << 27), (4, 1 << 27), (4, 600)])
def test_sums_over_pairs_equal_products(spark, monkeypatch, side, held):
    monkeypatch.setattr(gram, "SIDE", side)
    monkeypatch.setattr(gram, "HELD", held)
    monkeypatch.setattr(gram, "DENSE", 1 << 12)
    features, n = sparse(spark)
    r = spark.range(n).select(F.col("id").alias("sample_id"), (F.sin("id") / 7).alias("r"))
    near = lambda df, c: {(x.a, x.b): x[c] for x in df.collect()}
    products = kmers.pair_values(features).cache()
    assert near(gram.pair_gradient(features, r), "gradient") == pytest.approx(near(linear.gradient(products, r), "gradient"), abs=1e-12)
    mine, theirs = gram.pair_statistics(features, n).collect(), {(x.a, x.b): x for x in stats.statistics(products, n).collect()}
    assert len(mine) == len(theirs)
    for x in mine:
        assert tuple(x) == pytest.approx(tuple(theirs[x.a, x.b]), abs=1e-9)
    plan = gram.pair_gradient(features, r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # with the residuals, not with itself
    assert gram.pair_statistics(features.where("false"), n).count() == 0


def test_fits_with_all_pairs_equal_fits_with_named_pairs(spark):
    features, n = sparse(spark, p=6)
    samples = spark.range(n).select(F.col("id").alias("sample_id"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("label"))
    every = kmers.feature_table(spark, [(a, b) for a in range(6) for b in range(a, 6)])
    found = []
    for candidates in (None, every.select("a", "b")):
        est = Estimator(samples, features, Options(lambda_auto=(2,), transform="variance-scaler", cooccurrence=True), candidates=candidates)
        found.append(est.estimate()[0])
        est.close()
    a, b = found
    assert a.member.theta == pytest.approx(b.member.theta, abs=1e-7) and a.transform.keys() == b.transform.keys()
    assert all(a.transform[f] == pytest.approx(b.transform[f]) for f in a.transform)


def test_a_fit_needs_samples(spark):
    features, _ = sparse(spark)
    with pytest.raises(ValueError, match="no samples"):
        Estimator(spark.createDataFrame([], "sample_id bigint, label boolean"), features, Options())
    with pytest.raises(ValueError, match="solver"):
        Options(solver="magic")
    assert Model([Member(0.0)], {}).features() == []
