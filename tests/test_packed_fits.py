"""Fits keep a sample's features in one row: choices and gradients join nothing by sample."""

import pytest

from quillon.plans.fit import Estimator
from quillon.spec import Options


@pytest.fixture
def est(spark):
    samples = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "sample_id bigint, label boolean")
    features = spark.createDataFrame([(i, f, float(i * (f + 1) % 7)) for i in range(29) for f in range(3)], "sample_id bigint, feature_id bigint, value double")
    found = Estimator(samples, features, Options(lambda_auto=(1,)))
    yield found
    found.close()


def above_cache(df):
    return df._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def test_choices(est):
    rows = est._rows([(2, 2), (0, 0)])
    assert "Exchange" not in above_cache(rows) and "Join" not in above_cache(rows)
    for r in rows.collect():
        want = {} if r.sample_id == 29 else {0: r.sample_id * 3 % 7, 1: r.sample_id % 7}
        assert {x.i: x.v for x in r["items"]} == {i: v for i, v in want.items() if v}


def test_gradients(est):
    found = est.gradients()
    assert "Join" not in above_cache(found)
    want = {f: sum(i * (f + 1) % 7 * (0.5 - (i % 3 == 0)) for i in range(29)) / 30 for f in range(3)}
    got = {r.a: r.gradient for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want)
