"""Queries on whole runs: what fits, folds, expansions and exports leave in files, made by the library's own results and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit_queries import _NEWTON, _ONE_EACH, _PARTS3, _L, _one_column
from .operators import dataset, expand, kmers, select, stats, tables
from .plans.fit import Estimator
from .plans.learn import learn
from .queries import (  # noqa: I001
    COLUMNS, MODEL, _EXP, _LONG, _LP, _SCORES, _STATS, _Z, _counts_sql, _folder, _gradients3, _G3, _rounded, _score_data, _scores, _seq_sql, _sequences, _spec, query,
)
from .sources import model_io, readers, writers
from .spec import Member, Model, Options

# The files of a run


@query(
    f"""{_NEWTON} select source, round(l, 5) as "lambda", round(abs(t), 5) as norm, round(b, 5) as bias, round(t, 5) as theta
    from best, p, (select unnest(['path', 'model']) as source)"""
)
def files_of_a_run(spark, d):
    """A run's path and model files: both end at the optimum."""
    samples, features = _score_data(spark, d)
    base = _folder(spark)
    done = learn(samples, features, MODEL.names, Options(transform="standardizer", lambda_auto=(1,)), output=base)
    fields = F.split("value", "\t")
    step = readers.read_lines(spark, base + ".path").where("n > 0").select("n", *(fields[i].cast("double").alias(c) for i, c in ((1, "lambda"), (2, "norm"))), F.split(fields[3], ",").cast("array<double>").alias("theta"))
    last = step.agg(*(F.max_by(c, "n").alias(c) for c in ("lambda", "norm", "theta")))
    path = last.select(F.lit("path").alias("source"), "lambda", "norm", F.col("theta")[0].alias("bias"), F.col("theta")[1].alias("theta"))
    model = model_io.load(base + ".json", spark)
    (theta,) = model.members[0].theta.values()
    held = spark.createDataFrame([("model", done[0].estimates[0].lambda_, abs(theta), model.members[0].bias, theta)], path.schema)
    return _rounded(path.unionByName(held), 5, "lambda", "norm", "bias", "theta")


@query(
    f"""{_PARTS3}, z as (select part, held, y, b + t * x as z, {_L} * abs(t) as l from best join x using (part))
    select 'prediction' as kind, y as label, count(*) as n, round(avg({_LP}), 5) as train, null::double as test from z where held group by y
    union all select 'loss', null, 1, round(avg(ln(1 + exp(z)) - y * z) filter (not held) + any_value(l), 5), round(avg(ln(1 + exp(z)) - y * z) filter (held) + any_value(l), 5) from z group by part"""
)
def files_of_folds(spark, d):
    """The two tables of a cross-validation: the mean prediction of each label, and the losses of each fold."""
    samples, features = _one_column(spark, d)
    base = _folder(spark)
    learn(samples, features, MODEL.names, Options(k_fold=3, **_ONE_EACH), output=base)
    fields = F.split("value", "\t")
    rows = lambda end: readers.read_lines(spark, base + end).where("n > 0").select(fields[0].cast("double").alias("one"), fields[1].alias("other"))
    shown = rows(".table").groupBy(F.col("other").cast("int").alias("label")).agg(F.count("*").alias("n"), F.avg("one").alias("train"))
    shown = shown.select(F.lit("prediction").alias("kind"), "label", "n", "train", F.lit(None).cast("double").alias("test"))
    losses = rows("_loss.table").select(F.lit("loss").alias("kind"), F.lit(None).cast("int").alias("label"), F.lit(1).cast("bigint").alias("n"), F.col("one").alias("train"), F.col("other").cast("double").alias("test"))
    return _rounded(shown.unionByName(losses), 5, "train", "test")


@query(f"{_PARTS3} select round(b, 6) as bias, round(t, 6) as theta from best where part = 0")
def fit_restored(spark, d):
    """A fit that takes up where one of a hundred times the penalty ended, on two of three folds."""
    samples, features = _one_column(spark, d)
    fitted = stats.fit_transform(stats.single_values(features), samples.count(), "standardizer")
    rest = dataset.folds(samples, 3).where("fold <> 0")

    def ended(lambda_: float, start: Member | None) -> Member:
        est = Estimator(rest, features, Options(lambda_=lambda_), transform=fitted)
        if start:
            est.restore(start)
        found = est.estimate()[0].member
        est.close()
        return found

    found = ended(_L, ended(100 * _L, None))
    return _rounded(spark.createDataFrame([(found.bias, found.theta.get((0, 0), 0.0))], "bias double, theta double"), 6, "bias", "theta")


# Selection beside what is active


@query(
    f"""with {_G3}, n as (select count(*) as n from g), r as (select f, g, row_number() over (order by abs(g) desc, f) as place from g),
    act as (select f from r where place in (2, (select n from n))),
    v as (select abs(g) as v from r where place = 6), free as (select f, row_number() over (order by place) as spot from r where f not in (select f from act))
    select cast(f as bigint) as a, cast(f as bigint) as b, round((v + (select max(abs(g)) from g where abs(g) < v)) / 2, 6) as "lambda"
    from (select f from act union all select f from free where spot <= 4), v"""
)
def selection_beside_active(spark, d):
    """Six features of which the second best and the least one are active: both stay, and the best four others come."""
    gradients = _gradients3(spark, d)
    order = [F.desc(F.abs("gradient")), F.col("a")]
    second = gradients.orderBy(*order).limit(2).collect()[-1]
    least = gradients.orderBy(F.abs("gradient"), F.desc("a")).first()
    found = select.select_auto(gradients, [(r.a, r.b) for r in (second, least)], 6, None)
    return _rounded(spark.createDataFrame([(a, b, found.lambda_) for a, b in found.features], "a bigint, b bigint, lambda double"), 6, "lambda")


@query(
    f"""with {_SCORES}, {_LONG}, g as (select p.f as a, q.f as b, sum((0.5 - label::int) * p.v * (case when p.f = q.f then 1 else q.v end)) / (select count(*) from scores) as g
        from long p join long q using (sample_id, label) where p.f <= q.f group by all)
    select cast(row_number() over (order by a <> b, a, b) as integer) as place, cast(a as bigint) as a, cast(b as bigint) as b from g where abs(g) >= 0.02"""
)
def selection_of_pairs(spark, d):
    """Features of a large gradient, products among them, in feature order: singles, then pairs."""
    zero = Model([Member(0.0)], MODEL.names)
    gradients = tables.gradient(_scores(spark, d), zero, COLUMNS, tables.singles(COLUMNS) + tables.pairs(COLUMNS))
    chosen = select.select_fixed(gradients, [], 0.02).features
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(chosen)], "place int, a bigint, b bigint")


@query(f"with {_Z} select sample_id, cast(member as integer) as member, round({_LP}, 6) as prediction from z")
def component_predictions(spark, d):
    """Each member of an ensemble as a model of its own."""
    rows = _scores(spark, d)
    one = lambda m: tables.predict(rows, MODEL.component(m), COLUMNS, ["sample_id"]).withColumn("member", F.lit(m))
    return _rounded(one(0).unionByName(one(1)), 6, "prediction")


# Transforms and exports


@query(
    f"""with {_STATS.removeprefix('with ')}, h as (select sample_id % 2 as half, f, avg(v) as m, stddev_samp(v) as sd from long group by all),
    far as (select max(greatest(abs(p.m - q.m), abs(1 / p.sd - 1 / q.sd))) as far from h p join h q using (f) where p.half = 0 and q.half = 1)
    select e as tolerance, far <= e as same from far, (select unnest([1e-12::double, 0.1::double, 1.0::double, 10.0::double, 1e3::double, 1e6::double]) as e)"""
)
def transforms_of_halves(spark, d):
    """Whether the standardizers of two halves of the samples agree, by tolerance."""
    rows = _scores(spark, d)
    half = lambda k: stats.transform_of(tables.statistics(rows.where(F.col("sample_id") % 2 == k), COLUMNS, tables.singles(COLUMNS)), 1, "standardizer")
    even, odd = (half(k).persist() for k in (0, 1))
    told = [(e, stats.same_transforms(even, odd, e).first().same) for e in (1e-12, 0.1, 1.0, 10.0, 1e3, 1e6)]
    even.unpersist(), odd.unpersist()
    return spark.createDataFrame(told, "tolerance double, same boolean")


_D2 = f"{_seq_sql()}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts))"


@query(
    f"""with {_D2}, x as (select sample_id, f, coalesce(n, 0) as v from seqs join dict on true left join counts using (sample_id, kmer)),
    s as (select f, avg(v) as m, stddev_samp(v) as sd from x group by f), rows as (select sample_id, list(cast(printf('%.6e', (v - m) / sd) as double) order by f) as row from x join s using (f) group by sample_id)
    select cast(sample_id % 2 as integer) as src, count(*) as n, place, round(sum(row[place] * (1 + sample_id % 7)), 6) + 0.0 as total
    from rows, (select cast(unnest(range(1, 11)) as integer) as place) group by 1, 3"""
)
def transformed_export(spark, d):
    """Two tables of standardized counts over one dictionary and one transform, read back: sums of each column, weighted by the sample."""
    seqs = _sequences(spark, d)
    samples, features, known = kmers.compiled([seqs.where(F.col("sample_id") % 2 == k) for k in (0, 1)], _spec(2))
    fitted = stats.fit_transform(stats.single_values(features), samples.count(), "standardizer")
    lines = writers.matrix_lines(features, samples, known, integers=False, transform=fitted)
    row = F.split("line", ",").cast("array<double>")
    rows = lines.select("src", F.col("sample_id.sample_id").alias("sample_id"), F.posexplode(row).alias("place", "v"))
    found = rows.groupBy("src", (F.col("place") + 1).alias("place")).agg(F.count("*").alias("n"), F.sum(F.col("v") * (1 + F.col("sample_id") % 7)).alias("total"))
    return found.select("src", "n", "place", (F.round("total", 6) + F.lit(0.0)).alias("total"))


# Expansion


@query(
    f"""with {_SCORES}, x as (select cast(case when label then 0 else 1 end as integer) as src, quantity as q, discount as d, tax as t from scores)
    select src, round(q * d, 4) as x0, round(q * t, 4) as x1, round(d * t, 4) as x2, round(q * q, 4) as x3, round(d * d, 4) as x4, round(t * t, 4) as x5, count(*) as n from x group by all"""
)
def expanded_tables(spark, d):
    """Two tables expanded by one decision on their columns, written apart and read back, both."""
    both = dataset.joined_sources([_scores(spark, d).where(F.col("label") == v).select(*_EXP) for v in (True, False)])
    found = expand.expand(both, _EXP, expand.parse_operations("mul,square"), max_depth=1)
    new = [c for c in found.columns if c not in ("src", *_EXP)]
    base = _folder(spark)
    writers.write_expanded(found, new, base, 2)
    read = dataset.joined_sources([readers.read_scores(spark, f"{base}_{i}.table", header=True) for i in (0, 1)])
    names = [f"x{i}" for i in range(len(new))]
    return read.select("src", *(F.round(F.col("values")[i], 4).alias(c) for i, c in enumerate(names))).groupBy("src", *names).agg(F.count("*").alias("n"))


_DEEP = [
    "exp(t)", "exp(-q)", "exp(-t)", "ln(q)", "sqrt(q)", "sqrt(t)", "exp(sqrt(t))", "exp(-sqrt(q))", "exp(-sqrt(t))", "ln(sqrt(q))",
    "sqrt(exp(t))", "sqrt(exp(-q))", "sqrt(exp(-t))", "sqrt(ln(q))", "sqrt(sqrt(q))", "sqrt(sqrt(t))",
]


@query(f"with {_SCORES}, x as (select sample_id, quantity as q, tax as t from scores) select sample_id, {', '.join(f'round({c}, 6) as x{i}' for i, c in enumerate(_DEEP))} from x")
def expand_rejecting(spark, d):
    """Exponentials and logarithms aren't applied to each other's results; roots are, and what is undefined or too large somewhere goes."""
    rows = _scores(spark, d).select("sample_id", F.col("quantity").alias("q"), F.col("tax").alias("t"))
    found = expand.expand(rows, ["q", "t"], expand.parse_operations("exp,log,sqrt"), max_depth=2, most=200.0)
    new = [c for c in found.columns if c not in rows.columns]
    return found.select("sample_id", *(F.round(F.col(f"`{c}`"), 6).alias(f"x{i}") for i, c in enumerate(new)))
