"""Queries that write files with the library's writers into the shared folder and read them back, and those on models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import dataset, ensemble, kmers, linear, report, select, stats, tables
from .plans.fit import Estimator
from .queries import (  # noqa: I001
    _COEF, _EXP, _I3, _LABELLED, _LP, _NLL, _SCORES, _STATS, _Z, _folder, _item_model, _labelled, _members, _rounded, _score_data, _scores, _sequences, _seq_sql, _counts_sql, _spec,
    _table, COLUMNS, MODEL, both_ways, query,
)
from .sources import model_io, readers, writers
from .spec import Member, Model, Options


def _lines(spark, path: str) -> DataFrame:
    """Distinct lines of a text folder, their ends stripped, with their numbers."""
    return spark.read.text(path).groupBy(F.trim("value").alias("line")).agg(F.count("*").alias("n"))


def _counted(sql: str) -> str:
    return f"select line, count(*) as n from ({sql}) group by line"


_E = "printf('%.6e', {})"


# Sources


@query("select 'chr' || (event_id % 7) as seqname, event_id as start, event_id + 5 as stop, round(value, 3) as x, cast(user_id as double) as y from events")
def range_table_round_trip(spark, d):
    path = _folder(spark)
    e = _table(spark, d, "events")
    row = F.format_string("chr%d %d %d %.3f,%d", F.col("event_id") % 7, F.col("event_id"), F.col("event_id") + 5, F.round("value", 3), F.col("user_id"))
    body = e.select(F.lit(1).alias("k"), row.alias("value"))
    body.unionByName(spark.createDataFrame([(0, "seqnames from to counts")], "k int, value string")).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    found = readers.read_ranges(spark, path)
    return found.select("seqname", "start", "stop", F.round(F.col("values")[0], 3).alias("x"), F.col("values")[1].alias("y"))


@query("select 'chr' || (event_id % 7) as seqname, event_id as start, event_id + user_id as stop from events")
def bed_round_trip(spark, d):
    path = _folder(spark)
    row = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("event_id") % 7), "event_id", F.col("event_id") + F.col("user_id"), "event_type")
    head = spark.createDataFrame([("track name=events",), ("# note",), ("",)], "value string")
    _table(spark, d, "events").select(row.alias("value")).unionByName(head).write.text(path)
    return readers.read_bed(spark, path)


@query(
    f"""with {_SCORES}, t as (select label, round(quantity, 4) as quantity, round(discount, 4) as discount, round(tax, 4) as tax from scores)
    select cast(case when label then 0 else 1 end as integer) as src, quantity, discount, tax, count(*) as n from t group by all"""
)
def score_tables_import(spark, d):
    """Two tables of scores read and joined, told apart by src."""
    parts = []
    for label in (True, False):
        path = _folder(spark)
        _scores(spark, d).where(F.col("label") == label).select(F.concat_ws(",", *(F.col(c).cast("string") for c in _EXP)).alias("value")).write.text(path)
        parts.append(readers.read_scores(spark, path, columns=_EXP))
    rows = dataset.joined_sources(parts)
    v = [F.round(F.col("values")[i], 4).alias(c) for i, c in enumerate(_EXP)]
    return rows.select("src", *v).groupBy("src", *_EXP).agg(F.count("*").alias("n"))


_D2 = f"{_seq_sql()}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts))"


@query(
    f"""with {_D2} select cast(sample_id % 2 as integer) as src, sample_id, string_agg(cast(coalesce(n, 0) as varchar), ',' order by f) as line
    from seqs join dict on true left join counts using (sample_id, kmer) group by sample_id"""
)
def multi_file_export(spark, d):
    """Two tables of sequences over one dictionary, and their rows by table."""
    seqs = _sequences(spark, d)
    samples, features, known = kmers.compiled([seqs.where(F.col("sample_id") % 2 == k) for k in (0, 1)], _spec(2))
    return writers.matrix_lines(features, samples, known).select("src", "sample_id.sample_id", "line")


# Sinks


def _predicted(spark, d) -> DataFrame:
    return _rounded(tables.predict(_scores(spark, d), MODEL, COLUMNS, ["sample_id", "label"]), 4, "prediction")


_P = f"with {_Z}, p as (select sample_id, label, round(avg({_LP}), 4) as p from z group by all)"


@query(f"{_P} " + _counted(f"select {_E.format('p')} as line from p union all select 'prediction'"))
def prediction_lines(spark, d):
    path = _folder(spark)
    writers.write_predictions(_predicted(spark, d), path)
    return _lines(spark, path)


@query(f"{_P} " + _counted(f"select {_E.format('p')} || chr(9) || label::int as line from p union all select 'prediction' || chr(9) || 'labels'"))
def cv_table_lines(spark, d):
    path = _folder(spark)
    losses = spark.createDataFrame([(0.5, 0.25)], "train double, test double")
    writers.write_cv(_predicted(spark, d), losses, path)
    return _lines(spark, f"{path}.table")


@query(f"with {_Z} select printf('%.6e', round(avg({_NLL}), 6)) as line, 1 as n from z where member = 0")
def loss_line(spark, d):
    path = _folder(spark)
    found = linear.loss(tables.scores(_scores(spark, d), MODEL.component(0), COLUMNS, ["label"])).first()
    writers.write_loss(round(found.loss, 6), path, spark)
    return _lines(spark, path).withColumn("n", F.col("n").cast("int"))


_CUTS = f"""with {_SCORES}, p as (select cast(sample_id // 10 as bigint) as sample_id, sample_id % 10 as start, round(tax - discount, 4) as p from scores)"""


@query(f"{_CUTS} select sample_id, string_agg({_E.format('p')}, ' ' order by start, p) as line from p group by sample_id")
def window_prediction_lines(spark, d):
    rows = _scores(spark, d).select(F.expr("sample_id div 10").alias("sample_id"), (F.col("sample_id") % 10).alias("start"), (F.round(F.col("tax") - F.col("discount"), 4) + F.lit(0.0)).alias("prediction"))
    return writers.window_lines(rows)


@query(
    f"""with {_COEF}, rows as (select member, string_agg({_E.format('theta')}, ',' order by a) as t, round(sum(abs(theta)), 6) as norm from coef group by member)
    """
    + _counted("select member || chr(9) || printf('%.6e', 0.5) || chr(9) || printf('%.6e', norm) || chr(9) || t as line from rows union all select 'estimator' || chr(9) || 'lambda' || chr(9) || 'norm' || chr(9) || 'theta'")
)
def path_lines(spark, d):
    path = _folder(spark)
    row = F.sort_array(F.collect_list(F.struct("a", "theta")))
    steps = _members(spark, d).groupBy(F.col("member").alias("estimator")).agg(F.lit(0).alias("step"), F.lit(0.5).alias("lambda"), F.round(F.sum(F.abs("theta")), 6).alias("norm"), row.alias("r"))
    writers.write_path(steps.withColumn("theta", F.transform("r", lambda x: x["theta"])), path)
    return _lines(spark, path)


@query(
    f"with {_COEF}, rows as (select member, sum(abs(theta)) as s, count_if(theta <> 0) as k from coef group by member) "
    + _counted(
        "select printf('%15s', printf('%.6fs', 0.5)) || printf(' %9d', member) || printf(' %12s', printf('%.6e', round(s, 4))) || printf(' %8d', k) || printf(' %12s', printf('%.6e', 0.25))"
        " || printf(' %12s', 'nan') as line from rows union all select 'duration iteration       change  nonzero       lambda         loss'"
    ).replace("select line,", "select trim(line) as line,", 1).replace("group by line", "group by trim(line)")
)
def trace_lines(spark, d):
    path = _folder(spark)
    rows = _members(spark, d).groupBy(F.col("member").alias("iteration")).agg(
        F.lit(0.5).alias("duration"), F.round(F.sum(F.abs("theta")), 4).alias("change"), F.count_if(F.col("theta") != 0).alias("nonzero"), F.lit(0.25).alias("lambda"), F.lit(None).cast("double").alias("loss")
    )
    writers.write_trace(rows, path)
    return _lines(spark, path)


@query(
    f"""with {_COEF}, s as (select a, count_if(theta <> 0) as k, coalesce(sum(abs(theta)) / nullif(count_if(theta <> 0), 0), 'nan'::double) as m from coef group by a) """
    + _counted("select k || chr(9) || printf('%.6e', round(m, 5)) as line from s union all select 'stability' || chr(9) || 'mean'")
)
def stability_lines(spark, d):
    path = _folder(spark)
    writers.write_stability(_rounded(ensemble.stability(_members(spark, d)), 5, "mean"), path)
    return _lines(spark, path)


@query(
    f"""with {_I3}, x as (select sample_id, f, n as v, f % 3 as w from counts join dict using (kmer)), q as (select sample_id, coalesce(sum(w * v * v), 0) + 0.5 as q from items left join x using (sample_id) group by 1),
    dots as (select p.sample_id as s1, r.sample_id as s2, sum(p.w * p.v * r.v) as d from x p join x r on p.f = r.f group by 1, 2),
    s as (select a.sample_id as s1, b.sample_id as s2, round((coalesce(d, 0) + 0.5) / sqrt(a.q) / sqrt(b.q), 3) as s from q a join q b on true left join dots on s1 = a.sample_id and s2 = b.sample_id)
    """
    + _counted("select trim(string_agg(printf('%8.4f', s), ' ' order by s2)) as line from s group by s1")
)
def similarity_lines(spark, d):
    path = _folder(spark)
    items, features, known, _ = _item_model(spark, d)
    theta = known.select("feature_id", (F.col("feature_id") % 3).cast("double").alias("theta"))
    writers.write_similarity(_rounded(report.similarity(items, features, theta, 0.5), 3, "similarity"), path)
    return _lines(spark, path)


@query(f"with {_SCORES} " + _counted(f"select {_E.format('round(quantity, 4)')} || ',' || {_E.format('round(tax, 4)')} as line from scores where label union all select 'quantity,tax'"))
def expanded_table_lines(spark, d):
    path = _folder(spark)
    rows = _scores(spark, d).select((~F.col("label")).cast("int").alias("src"), F.round("quantity", 4).alias("quantity"), F.round("tax", 4).alias("tax"))
    writers.write_expanded(rows, ["quantity", "tax"], path, 2)
    return _lines(spark, f"{path}_0.table")


# Models and transforms


def _kept(spark, d, keep) -> list[Model]:
    """A model for each line number, with the coefficients of `keep(member, feature)` only."""
    by: dict[int, dict] = {}
    for r in _members(spark, d).orderBy("member", "a").collect():
        if keep(r.member, r.a):
            by.setdefault(r.member, {})[r.a, r.a] = r.theta
    return [Model([Member(float(m), t)], {a: COLUMNS[a] for a, _ in t}) for m, t in sorted(by.items())]


def _coefficient_rows(spark, model: Model) -> DataFrame:
    """A row for each coefficient that the model holds, zeros too."""
    rows = [(m, model.names[a], float(t)) for m, x in enumerate(model.members) for (a, _), t in x.theta.items()]
    rows += [(m, "bias", float(x.bias)) for m, x in enumerate(model.members)]
    return spark.createDataFrame(rows, "member int, feature string, theta double")


_PARTLY = f"""{_COEF}, names(a, feature) as (values (0, 'quantity'), (1, 'price'), (2, 'discount'), (3, 'tax')),
    partly as (select member, feature, theta from coef join names using (a) where ((member + a) % 2 = 0 or a >= 2) and theta <> 0)"""


def _held_by(m: int, a: int) -> bool:
    """Quantity and price are held by every other member, discount and tax by all."""
    return (m + a) % 2 == 0 or a >= 2


@query(f"with {_PARTLY} select member, feature, theta from partly union all select distinct member, 'bias', cast(member as double) from coef")
def ensemble_joined(spark, d):
    """One ensemble of models over different features."""
    return _coefficient_rows(spark, ensemble.joined(_kept(spark, d, _held_by)))


def _combined(how: str, of_theta: str, of_bias: str) -> None:
    def run(spark, d):
        return _rounded(_coefficient_rows(spark, ensemble.combine_models(_kept(spark, d, _held_by), how)), 6, "theta")

    run.__name__ = f"combine_models_{how}"
    query(
        f"""with {_PARTLY}, m as (select distinct member from coef), f as (select distinct feature from partly),
        filled as (select member, feature, coalesce(theta, 0) as theta from m join f on true left join partly using (member, feature))
        select 0 as member, feature, round({of_theta}, 6) as theta from filled group by feature union all select 0, 'bias', round({of_bias}, 6) from m"""
    )(run)


_combined("mean", "avg(theta)", "avg(member)")
_combined("max", "first(theta order by abs(theta) desc, member)", "first(member order by abs(member) desc)")
_combined("min", "first(theta order by abs(theta), member)", "first(member order by abs(member))")


@query(f"with {_COEF} select member, cast(count_if(theta <> 0) as bigint) as nonzero from coef group by member")
def nonzero_coefficients(spark, d):
    whole = ensemble.joined(_kept(spark, d, lambda m, a: True))
    return spark.createDataFrame([(m, x.nonzero()) for m, x in enumerate(whole.members)], "member int, nonzero bigint")


@query(f"with {_PARTLY} select member, feature, theta from partly union all select distinct member, 'bias', cast(member as double) from coef")
def score_model_file(spark, d):
    """A model of scores written as JSON and read again."""
    path = _folder(spark)
    model_io.save(ensemble.joined(_kept(spark, d, _held_by)), path, spark)
    return _coefficient_rows(spark, model_io.load(path, spark)).where("theta <> 0 or feature = 'bias'")


@query(
    f"""with {_I3}, t as (select kmer || '|' || reverse(translate(kmer, 'acgt', 'tgca')) as feature, round((df - 30) / 10, 3) as theta, f from dict)
    select 0 as member, feature, theta from t where theta <> 0 union all select 0, 'bias', 0.5"""
)
def kmer_model_file(spark, d):
    path = _folder(spark)
    _, _, known, theta = _item_model(spark, d)
    rows = known.join(theta, "feature_id").where("theta <> 0").select("feature_id", "name", "theta").collect()
    model = Model([Member(0.5, {(r.feature_id, r.feature_id): r.theta for r in rows})], {r.feature_id: r.name for r in rows}, _spec(3))
    model_io.save(model, path, spark, "other reader's kind")
    return _coefficient_rows(spark, model_io.load(path, spark))


def _transform(spark, d, kind: str) -> DataFrame:
    return stats.transform_of(tables.statistics(_scores(spark, d), COLUMNS, tables.singles(COLUMNS)), 1, kind)


@query(f"{_STATS} select cast(f as bigint) as a, cast(f as bigint) as b, round(m, 6) as \"offset\", round(1 / sd, 9) as scale from s where f in (1, 3)")
def transform_select(spark, d):
    wanted = spark.createDataFrame([(1, 1), (3, 3), (0, 1)], "a bigint, b bigint")
    return _rounded(_rounded(stats.select_transform(_transform(spark, d, "standardizer"), wanted), 6, "offset"), 9, "scale")


@query(f"{_STATS} select cast(f as bigint) as a, cast(f as bigint) as b, round(m, 6) as \"offset\", round(1 / sd, 9) as scale from s")
def transform_merge(spark, d):
    whole = _transform(spark, d, "standardizer")
    return _rounded(_rounded(stats.merge_transforms(whole.where("a < 3"), whole.where("a > 0")), 6, "offset"), 9, "scale")


@query("select true as with_itself, false as with_another, true as with_none")
def transform_compare(spark, d):
    one, other = _transform(spark, d, "standardizer"), _transform(spark, d, "max-abs-scaler")
    same = lambda a, b, n: stats.same_transforms(a, b).withColumnRenamed("same", n)
    return same(one, one, "with_itself").join(same(one, other, "with_another")).join(same(one, other.where("a < 0"), "with_none"))


@query(f"with {_SCORES} select sample_id, label, round(price, 6) as f0, round(tax, 6) as f1, round(quantity * tax, 6) as f2 from scores")
def reduced_design(spark, d):
    """Selected features, one of them a product, as the columns of a small design."""
    samples, long = _score_data(spark, d)
    features = [(1, 1), (3, 3), (0, 3)]
    base, _ = select.base_features(features)
    own = long.where(F.col("feature_id").isin(*base))
    values = kmers.feature_values(own, F.broadcast(kmers.feature_table(spark, features).select("a", "b")))
    return _rounded(select.reduced(values, samples, features), 6, "f0", "f1", "f2")


@query(
    f"""with {_LABELLED}, p as (select *, row_number() over (order by sample_id) - 1 as i, count(*) over () as n from labelled)
    select sample_id, label, case when i % 5 = 1 then 'test' when (i - i % 5) < 0.25 * n and i + 5 < n then 'validation' else 'train' end as part from p"""
)
def cv_split(spark, d):
    parts = zip(("train", "validation", "test"), dataset.split(dataset.folds(_labelled(spark, d), 5, 0.25), 1), strict=True)
    return reduce(DataFrame.unionByName, [df.select("sample_id", "label", F.lit(name).alias("part")) for name, df in parts])


# Fits: what every solution must satisfy


def _violations(est: Estimator, lambda_: float) -> list[tuple[int, int, bool]]:
    """Whether each feature keeps the optimality conditions: |gradient| is lambda where it is active, at most that elsewhere."""
    theta = est.member.theta
    slack = 2e-3 * max(lambda_, 1e-4)
    out = []
    for r in est.gradients().collect():
        t = theta.get((r.a, r.b), 0.0)
        far = abs(r.gradient + (lambda_ if t > 0 else -lambda_)) if t else max(abs(r.gradient) - lambda_, 0.0)
        out.append((r.a, r.b, far <= slack))
    return sorted(out)


@query("select cast(f as bigint) as a, cast(f as bigint) as b, true as optimal from (select unnest([0, 1, 2, 3]) as f)")
def fit_optimality(spark, d):
    samples, features = _score_data(spark, d)
    est = Estimator(samples, features, Options(transform="standardizer", lambda_=0.001))
    est.estimate()
    found = _violations(est, 0.001)
    est.close()
    return spark.createDataFrame(found, "a bigint, b bigint, optimal boolean")


@query("select n as wanted, n as active, true as settled from (select unnest([1, 2, 3]) as n)")
def path_counts(spark, d):
    """A fit for n features has n of them."""
    samples, features = _score_data(spark, d)
    est = Estimator(samples, features, Options(transform="standardizer", lambda_auto=(1, 2, 3)))
    done = est.estimate()
    est.close()
    return spark.createDataFrame([(n, e.member.nonzero(), e.settled) for n, e in zip((1, 2, 3), done, strict=True)], "wanted int, active int, settled boolean")
