"""Expansion of many columns, deep results, and rules that turn columns away."""

import math
import random

import pytest

from quillon.operators import expand


def test_hundreds_of_columns(spark):
    r = random.Random(1)
    names = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple([i, f"s{i}", *(r.uniform(0.5, 2.0) for _ in names)]) for i in range(60)], "id int, s string, " + ", ".join(f"{c} double" for c in names))
    got = expand.expand(df.repartition(3), names, expand.parse_operations("square,sqrt,mul"), max_depth=2, max_features=2000)
    assert len(got.columns) == 2002 and got.columns[:102] == df.columns
    new = got.columns[102:]
    assert new[0] == "(c0^2)" and new[100] == "sqrt(c0)" and new[200] == "(c0*c1)" and len(set(new)) == 1900
    for x in got.where("id < 5").collect():
        row = x.asDict()
        assert row["s"] == f"s{row['id']}"
        for c in new[::37]:
            assert row[c] == pytest.approx(eval(c.replace("^", "**"), {"sqrt": math.sqrt} | row))


def test_results_that_may_not_stay(spark):
    df = spark.createDataFrame([(1.0, 0.0, -1.0, 1000.0, None, 1.0), (2.0, 3.0, -4.0, 2.0, 5.0, 1.0)], "a double, zero double, neg double, big double, gap double, one double")
    names = df.columns
    got = expand.expand(df, names, expand.parse_operations("abs,exp,log,sqrt,div"), max_depth=1).columns[6:]
    assert "abs(a)" not in got and "abs(neg)" in got  # nothing is moved by it
    assert "exp(big)" not in got and "exp(-big)" in got and "log(zero)" not in got and "log(-neg)" in got and "sqrt(zero)" in got
    assert not any("gap" in c for c in got) and "sqrt(one)" not in got
    assert "(a/zero)" not in got and "(zero/a)" in got
    assert "exp(a)" not in expand.expand(df, names, expand.parse_operations("exp"), max_depth=1, most=5.0).columns
    assert expand.expand(df, names, expand.parse_operations("square"), max_depth=1, least=500.0).columns[6:] == ["(big^2)"]
    assert expand.expand(df.where("false"), names).columns == names


def test_last_operations_that_reject(spark):
    df = spark.createDataFrame([(0.5,), (0.7,)], "a double")
    got = expand.expand(df, ["a"], expand.parse_operations("exp,log,square"), max_depth=3, max_features=40).columns
    assert "exp(a)" in got and not any(c.startswith(("exp(exp", "exp(log", "log(exp", "exp(-exp")) for c in got) and "exp((exp(a)^2))" in got


def test_sums_feed_the_next_final_operation_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 5.0, 1.0)], "a double, b double, c double")
    got = expand.expand(df, ["a", "b", "c"], expand.parse_operations("add,mul,square"), max_depth=1).columns[3:]
    assert "((a+b)*(a+c))" in got and "(a+b)" not in got and "((a+b)^2)" not in got and "(a^2)" in got


def test_many_candidates_are_decided_in_turns(spark, monkeypatch):
    df = spark.createDataFrame([tuple(float(i + j) for j in range(8)) for i in range(4)], ", ".join(f"c{j} double" for j in range(8)))
    whole = expand.expand(df, df.columns, max_features=60, max_depth=1).columns
    monkeypatch.setattr(expand, "TOGETHER", 5)
    assert expand.expand(df, df.columns, max_features=60, max_depth=1).columns == whole
