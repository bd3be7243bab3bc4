"""Queries over the given tables, each with the same in SQL where SQL can express it.

Sequences are the whole texts of documents with their letters projected on acgt; score
samples are order lines with four numbers. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import nucleotides as nt
from .functions.logistic import log_sigmoid, pair_dim, pair_position, position_pair
from .operators import dataset, ensemble, expand, kmers, linear, report, select, stats, tables, windows
from .plans.fit import Estimator
from .plans.learn import cross_validate, fit_ensemble
from .session import shared_dir, stored
from .spec import KmerSpec, Member, Model, Options

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Sequences

_AZ, _BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def _sequences(spark, d, table="documents", key="doc_id") -> DataFrame:
    return _table(spark, d, table).select(F.col(key).alias("sample_id"), nt.from_text(F.col("text")).alias("sequence"))


def _seq_sql(table: str = "documents", key: str = "doc_id", name: str = "seqs") -> str:
    return f"{name} as (select {key} as sample_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_AZ}', '{_BASES}') as s from {table})"


def _words_sql(k: int, seqs: str = "seqs", name: str = "words") -> str:
    return (
        f"{name} as (select sample_id, substring(s, i, {k}) as w from (select sample_id, s, unnest(range(1, length(s) - {k} + 2)) as i"
        f" from {seqs} where length(s) >= {k}))"
    )


def _rc(w: str) -> str:
    return f"reverse(translate({w}, 'acgtn', 'tgcan'))"


def _canon(w: str) -> str:
    return f"least({w}, {_rc(w)})"


def _counts_sql(k: int, seqs: str = "seqs", suffix: str = "") -> str:
    """CTEs ending in counts(sample_id, kmer, n) of length k, reverse complements merged."""
    return f"{_words_sql(k, seqs, 'words' + suffix)}, counts{suffix} as (select sample_id, {_canon('w')} as kmer, count(*) as n from words{suffix} group by all)"


def _spec(m: int, n: int | None = None, **more) -> KmerSpec:
    return KmerSpec(m, n or m, **({"revcomp": True} | more))


@query(f"with {_seq_sql()}, {_counts_sql(4)} select sample_id, 4 as k, kmer, n from counts")
def kmer_counts(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), _spec(4))


@query(f"with {_seq_sql()}, {_counts_sql(4)} select sample_id, 4 as k, kmer from counts")
def kmer_presence(spark, d):
    return kmers.kmer_presence(_sequences(spark, d), _spec(4, binarize=True))


_RANGE = " union all ".join(f"select sample_id, {k} as k, kmer, n from counts{k}" for k in (2, 3, 4))


@query(f"with {_seq_sql()}, {', '.join(_counts_sql(k, suffix=str(k)) for k in (2, 3, 4))} {_RANGE}")
def kmer_range_counts(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), _spec(2, 4))


@query(
    f"""with {_seq_sql()}, {_words_sql(4)}, plain as (select sample_id, w, count(*) as n from words group by all),
    wide as (select sample_id, n, unnest([w, w[1] || 'n' || w[3] || w[4], w[1] || w[2] || 'n' || w[4], w[1] || 'nn' || w[4]]) as p from plain)
    select sample_id, 4 as k, case when translate(p, 'n', 'z') <= translate({_rc('p')}, 'n', 'z') then p else {_rc('p')} end as kmer,
    cast(sum(n) as bigint) as n from wide group by all"""
)
def kmer_gapped_counts(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), _spec(4, alphabet="gapped-nucleotide"))


_CODES = ", ".join(f"('{c}', '{b}')" for c, bases in nt.AMBIGUOUS.items() for b in bases)


@query(
    f"""with {_seq_sql()}, {_words_sql(3)}, codes(c, b) as (values {_CODES}, ('a', 'a'), ('c', 'c'), ('g', 'g'), ('t', 't')),
    plain as (select sample_id, w, count(*) as n from words group by all)
    select sample_id, 3 as k, w[1] || c || w[3] as kmer, cast(sum(n) as bigint) as n from plain join codes on b = w[2] group by all"""
)
def kmer_iupac_counts(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), KmerSpec(3, 3, alphabet="iupac-nucleotide", max_ambiguous=1))


@query(
    f"""with {_seq_sql()}, {_words_sql(3)} select sample_id, 3 as k,
    least(w, reverse(w), translate(w, 'acgt', 'tgca'), {_rc('w')}) as kmer, count(*) as n from words group by all"""
)
def kmer_orbit_counts(spark, d):
    return kmers.kmer_counts(_sequences(spark, d), KmerSpec(3, 3, reverse=True, complement=True))


_DICT = f"""dict as (select row_number() over (order by length(kmer), kmer) - 1 as feature_id, cast(length(kmer) as integer) as k, kmer,
    kmer || '|' || {_rc('kmer')} as name from (select kmer from counts2 union select kmer from counts3))"""


@query(f"with {_seq_sql()}, {_counts_sql(2, suffix='2')}, {_counts_sql(3, suffix='3')}, {_DICT} select * from dict")
def kmer_dictionary(spark, d):
    spec = _spec(2, 3)
    return kmers.dictionary(kmers.kmer_counts(_sequences(spark, d), spec), spec)


@query(f"with {_seq_sql()}, {_words_sql(6)} select count(distinct {_canon('w')}) as n_features from words")
def count_features(spark, d):
    return kmers.count_features(kmers.kmer_counts(_sequences(spark, d), _spec(6)))


@query(
    f"""with {_seq_sql()}, {_counts_sql(5)}, {_seq_sql('benchmark', 'item_id', 'items')}, {_counts_sql(5, 'items', '_i')},
    dict as (select kmer, row_number() over (order by kmer) - 1 as feature_id from (select distinct kmer from counts_i))
    select sample_id, 5 as k, kmer, n, feature_id from counts join dict using (kmer)"""
)
def fixed_dictionary_counts(spark, d):
    spec = _spec(5)
    fixed = kmers.dictionary(kmers.kmer_counts(_sequences(spark, d, "benchmark", "item_id"), spec), spec)
    return kmers.fixed_dictionary(kmers.kmer_counts(_sequences(spark, d), spec), fixed)


_F2 = f"{_seq_sql()}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)), x as (select sample_id, f, cast(n as double) as v from counts join dict using (kmer))"


def _features2(spark, d) -> tuple[DataFrame, DataFrame]:
    spec = _spec(2)
    return kmers.kmer_features(_sequences(spark, d), spec)


@query(f"with {_F2} select p.sample_id, p.f as a, q.f as b, p.v * q.v as value from x p join x q on p.sample_id = q.sample_id and p.f < q.f")
def cooccurrence_products(spark, d):
    return kmers.pair_values(_features2(spark, d)[0])


@query(
    f"""with {_F2}, n as (select count(*) as n from dict), pairs as (select p.f as a, q.f as b, n from dict p join dict q on p.f <= q.f, n)
    select a, b, cast(n * (n + 1) / 2 + 1 as bigint) as dim, cast(case when a = b then a + 1 else n + n * (n - 1) / 2 - (n - a) * (n - a - 1) / 2 + b - a end as bigint) as position,
    a as back_a, b as back_b from pairs"""
)
def feature_positions(spark, d):
    known = _features2(spark, d)[1]
    n = known.count()
    at = kmers.all_features(known, True).withColumns({"dim": pair_dim(n), "position": pair_position(F.col("a"), F.col("b"), n)})
    a, b = position_pair(F.col("position"), n)
    return at.withColumns({"back_a": a, "back_b": b})


# Samples and labels

_LABELLED = "labelled as (select doc_id as sample_id, quality = 1 as label from labels where quality in (0, 1))"


def _labelled(spark, d) -> DataFrame:
    return _table(spark, d, "labels").where("quality in (0, 1)").select(F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("label"))


@query(
    """select doc_id as sample_id, length(text) as size, quality = 1 as label, cast(case when quality = 1 then 0 else 1 end as integer) as src
    from documents join labels using (doc_id) where quality in (0, 1)"""
)
def training_union(spark, d):
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id")
    part = lambda q: docs.where(F.col("quality") == q).select(F.col("doc_id").alias("sample_id"), F.length("text").cast("bigint").alias("size"))
    return dataset.training_data(part(1), part(0))


_LIMIT = 100


@query(
    f"""with {_LABELLED}, n as (select count_if(label) as n1, count_if(not label) as n0 from labelled),
    ranked as (select sample_id, label, row_number() over (partition by label order by sample_id) as r from labelled)
    select sample_id, label from ranked, n where n1 + n0 <= {_LIMIT} or r <= case when label then floor(n1 / (n1 + n0) * {_LIMIT}) else {_LIMIT} - floor(n1 / (n1 + n0) * {_LIMIT}) end"""
)
def limit_samples(spark, d):
    return dataset.limit_samples(_labelled(spark, d), _LIMIT)


@query(f"with {_LABELLED} select count(*) as n, round(count(*) / (2 * count_if(not label)), 9) as w0, round(count(*) / (2 * count_if(label)), 9) as w1 from labelled")
def class_weights(spark, d):
    return dataset.class_weights(_labelled(spark, d)).select("n", F.round("w0", 9).alias("w0"), F.round("w1", 9).alias("w1"))


_PLACES = f"with {_LABELLED}, p as (select *, row_number() over (order by sample_id) - 1 as i, count(*) over () as n from labelled)"


@query(f"{_PLACES} select sample_id, label, cast(i % 5 as integer) as fold, false as is_validation from p")
def cv_folds(spark, d):
    return dataset.folds(_labelled(spark, d), 5)


@query(f"{_PLACES} select sample_id, label, cast(i % 5 as integer) as fold, (i - i % 5) < 0.25 * n and i + 5 < n as is_validation from p")
def cv_validation_flags(spark, d):
    return dataset.folds(_labelled(spark, d), 5, 0.25)


# Scores of order lines

COLUMNS = ["quantity", "price", "discount", "tax"]
_SCORES = """scores as (select l_orderkey * 10 + l_linenumber as sample_id, max(l_returnflag) = 'R' as label, sum(l_quantity) as quantity,
    sum(l_extendedprice) as price, max(l_discount) as discount, max(l_tax) as tax from lineitem group by 1)"""
_LONG = """long as (select sample_id, label, unnest([0, 1, 2, 3]) as f, unnest([quantity, price, discount, tax]) as v from scores)"""


def _scores(spark, d) -> DataFrame:
    rows = _table(spark, d, "lineitem")
    return rows.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id")).agg(
        (F.max("l_returnflag") == "R").alias("label"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
        F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"),
    )


def _score_data(spark, d) -> tuple[DataFrame, DataFrame]:
    table = _scores(spark, d)
    return table.select("sample_id", "label"), dataset.score_features(table, COLUMNS)


@query(f"with {_SCORES}, {_LONG} select sample_id, cast(f as bigint) as feature_id, round(v, 6) as value from long where v <> 0")
def score_features(spark, d):
    return _score_data(spark, d)[1].withColumn("value", F.round("value", 6))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


_STATS = f"""with {_SCORES}, {_LONG}, s as (select f, avg(v) as m, stddev_samp(v) as sd, max(abs(v)) as mx, sum(v) as t, count(*) as n, count_if(v <> 0) as nz from long group by f)"""


def both_ways(sql: str) -> Callable[[Query], Query]:
    """Registers f(spark, d, wide) twice: over the wide table of scores, and, as <name>_sparse, over long features."""

    def register(f) -> Query:
        for name, wide in ((f.__name__, True), (f"{f.__name__}_sparse", False)):

            def run(spark, d, wide=wide):
                return f(spark, d, wide)

            run.__name__ = name
            query(sql)(run)
        return f

    return register


def _statistics(spark, d, wide: bool, features: list | None = None) -> DataFrame:
    if wide:
        return tables.statistics(_scores(spark, d), COLUMNS, features or tables.singles(COLUMNS))
    samples, long = _score_data(spark, d)
    return stats.statistics(kmers.pair_values(long) if features else stats.single_values(long), samples.count())


def _fitted(spark, d, wide: bool, kind: str) -> DataFrame:
    table = _scores(spark, d)
    if wide:
        return stats.transform_of(_statistics(spark, d, True), table.count() if kind == "mean-scaler" else 1, kind)
    samples, long = _score_data(spark, d)
    return stats.fit_transform(stats.single_values(long), samples.count(), kind)


@both_ways(f"{_STATS} select cast(f as bigint) as a, cast(f as bigint) as b, cast(nz as bigint) as nonzero, round(m, 6) as mean, round(sd, 6) as sd, round(mx, 6) as max_abs from s")
def column_statistics(spark, d, wide):
    return _rounded(_statistics(spark, d, wide).select("a", "b", "nonzero", "mean", "sd", "max_abs"), 6, "mean", "sd", "max_abs")


def _transform_query(kind: str, offset: str, scale: str) -> None:
    def run(spark, d, wide):
        return _rounded(_rounded(_fitted(spark, d, wide, kind), 6, "offset"), 9, "scale")

    run.__name__ = "stats_" + kind.replace("-", "_")
    both_ways(f"{_STATS} select cast(f as bigint) as a, cast(f as bigint) as b, round({offset}, 6) as \"offset\", round({scale}, 9) as scale from s")(run)


_transform_query("standardizer", "m", "1 / sd")
_transform_query("variance-scaler", "0.0", "1 / sd")
_transform_query("max-abs-scaler", "0.0", "1 / mx")
_transform_query("mean-scaler", "0.0", "n / t")


def _held(transform: DataFrame) -> dict:
    """A transform of a score table's few columns."""
    return {(r.a, r.b): (r.offset, r.scale) for r in transform.collect()}


@both_ways(f"{_STATS} select sample_id, cast(f as bigint) as a, cast(f as bigint) as b, round(v / sd, 6) as value, round(-m / sd, 6) as shift from long join s using (f) where v <> 0")
def transform_apply(spark, d, wide):
    fitted = _fitted(spark, d, wide, "standardizer")
    if wide:
        found = tables.transformed(_scores(spark, d), COLUMNS, tables.singles(COLUMNS), _held(fitted), ["sample_id"])
    else:
        found = stats.apply_transform(stats.single_values(_score_data(spark, d)[1]), fitted)
    return _rounded(found, 6, "value", "shift")


_PAIRS = "pairs as (select p.f as a, q.f as b, p.v * q.v as v from long p join long q on p.sample_id = q.sample_id and p.f < q.f)"


@both_ways(
    f"""with {_SCORES}, {_LONG}, {_PAIRS}
    select cast(a as bigint) as a, cast(b as bigint) as b, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd, round(max(abs(v)), 4) as max_abs from pairs group by 1, 2"""
)
def pair_statistics(spark, d, wide):
    found = _statistics(spark, d, wide, tables.pairs(COLUMNS))
    return _rounded(found.select("a", "b", "mean", "sd", "max_abs"), 4, "mean", "sd", "max_abs")


# Evaluation of a model with known coefficients

MODEL = Model(
    [Member(0.1, {(0, 0): 0.01, (1, 1): -0.00001, (2, 2): 2.0, (3, 3): -1.5, (0, 2): 0.05}), Member(-0.2, {(0, 0): -0.02, (3, 3): 1.0})],
    dict(enumerate(COLUMNS)),
    cooccurrence=True,
)
#: The same with offsets and scales for some features.
MOVED = Model(MODEL.members, MODEL.names, None, {(0, 0): (25.0, 0.5), (3, 3): (0.04, 2.0), (0, 2): (1.0, 3.0)}, "mean", True)
_Z = f"""{_SCORES}, z as (select sample_id, label, 0 as member, 0.1::double + quantity * 0.01::double + price * (-0.00001)::double + discount * 2 + tax * (-1.5)::double + quantity * discount * 0.05::double as z from scores
    union all select sample_id, label, 1 as member, -0.2::double + quantity * (-0.02)::double + tax from scores)"""
_LP = "(least(z, 0) - ln(1 + exp(-abs(z))))"
_NLL = f"-(case when label then {_LP} else {_LP} - z end)"


def _scored(spark, d, wide: bool, model: Model = MODEL) -> DataFrame:
    if wide:
        return tables.scores(_scores(spark, d), model, COLUMNS, ["sample_id", "label"])
    return linear.linear_scores(*_score_data(spark, d), model, len(COLUMNS))


@both_ways(f"with {_Z} select sample_id, label, cast(member as integer) as member, round(z, 7) as z from z")
def linear_score(spark, d, wide):
    return _rounded(_scored(spark, d, wide), 7, "z")


@both_ways(
    f"""with {_SCORES} select sample_id, label, 0 as member, round(0.1::double + (quantity - 25) * 0.005::double + price * (-0.00001)::double + discount * 2 - (tax - 0.04::double) * 3
        + (quantity * discount - 1) * 0.15::double, 7) as z from scores
    union all select sample_id, label, 1, round(-0.2::double - (quantity - 25) * 0.01::double + (tax - 0.04::double) * 2, 7) from scores"""
)
def linear_score_transformed(spark, d, wide):
    return _rounded(_scored(spark, d, wide, MOVED), 7, "z")


@both_ways(f"with {_Z} select sample_id, label, round(avg({_LP}), 6) as prediction from z group by all")
def ensemble_predict(spark, d, wide):
    if wide:
        found = tables.predict(_scores(spark, d), MODEL, COLUMNS, ["sample_id", "label"])
    else:
        found = linear.predict(*_score_data(spark, d), MODEL)
    return _rounded(found, 6, "prediction")


@both_ways(f"with {_Z} select cast(member as integer) as member, round(avg({_NLL}), 9) as loss from z group by 1")
def logistic_loss(spark, d, wide):
    return _rounded(linear.loss(_scored(spark, d, wide)), 9, "loss")


_W = "w as (select count(*) / (2 * count_if(not label)) as w0, count(*) / (2 * count_if(label)) as w1 from scores)"


@both_ways(f"with {_Z}, {_W} select cast(member as integer) as member, round(avg({_NLL} * case when label then w1 else w0 end), 9) as loss from z, w group by 1")
def balanced_loss(spark, d, wide):
    w = dataset.class_weights(_scores(spark, d)).first()
    return _rounded(linear.loss(_scored(spark, d, wide), w.n, (w.w0, w.w1)), 9, "loss")


_R = f"{_Z}, r as (select sample_id, (exp({_LP}) - label::int) / count(*) over () as r from z where member = 0)"


def _residuals(spark, d) -> tuple[DataFrame, DataFrame]:
    samples, features = _score_data(spark, d)
    scored = linear.linear_scores(samples, features, MODEL.component(0))
    return linear.residuals(scored, samples.count()), features


def _gradient(spark, d, wide: bool, features: list | None = None) -> DataFrame:
    if wide:
        return tables.gradient(_scores(spark, d), MODEL, COLUMNS, features or tables.singles(COLUMNS))
    r, long = _residuals(spark, d)
    return linear.gradient(kmers.pair_values(long) if features else stats.single_values(long), r)


@both_ways(f"with {_R}, {_LONG} select cast(f as bigint) as a, cast(f as bigint) as b, round(sum(r * v), 6) as gradient from r join long using (sample_id) group by f")
def gradient(spark, d, wide):
    return _rounded(_gradient(spark, d, wide), 6, "gradient")


@both_ways(
    f"""with {_R}, {_LONG} select cast(p.f as bigint) as a, cast(q.f as bigint) as b, round(sum(r * p.v * q.v), 4) as gradient
    from r join long p using (sample_id) join long q using (sample_id) where p.f < q.f group by p.f, q.f"""
)
def gradient_cooccurrence(spark, d, wide):
    return _rounded(_gradient(spark, d, wide, tables.pairs(COLUMNS)), 4, "gradient")


@both_ways(
    f"""with {_R}, {_LONG}, s as (select f, avg(v) as m, stddev_samp(v) as sd from long group by f)
    select cast(f as bigint) as a, cast(f as bigint) as b, round(sum(r * (v - m) / sd), 6) as gradient from r join long using (sample_id) join s using (f) group by f"""
)
def gradient_standardized(spark, d, wide):
    fitted = _fitted(spark, d, wide, "standardizer")
    if wide:
        # the scores are those of MODEL as it is; only the gradient's features are scaled
        rows = _scores(spark, d).withColumn("_z", tables.member_score(MODEL, COLUMNS))
        return _rounded(tables.gradient(rows, Model(MODEL.members, MODEL.names, None, _held(fitted)), COLUMNS, tables.singles(COLUMNS), score="_z"), 6, "gradient")
    r, features = _residuals(spark, d)
    return _rounded(linear.gradient(stats.apply_transform(stats.single_values(features), fitted), r), 6, "gradient")


@both_ways(
    f"""with {_R}, {_LONG}, t(f, p) as (values (0, 0.01), (1, -0.01), (2, 0.01), (3, -0.01))
    select cast(f as bigint) as a, cast(f as bigint) as b, round(sum(r * v) + any_value(p), 6) as gradient from r join long using (sample_id) join t using (f) group by f"""
)
def gradient_penalised(spark, d, wide):
    return _rounded(linear.penalised(_gradient(spark, d, wide), MODEL, 0.01), 6, "gradient")


# Selection at zero coefficients, where g_j = avg((0.5 - y) x_j), on k-mers of labelled documents

_G3 = f"""{_LABELLED}, {_seq_sql()}, {_counts_sql(3)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)),
    g as (select f, sum((0.5 - label::int) * n) / (select count(*) from labelled) as g from counts join dict using (kmer) join labelled using (sample_id) group by f)"""


def _gradients3(spark, d) -> DataFrame:
    samples = _labelled(spark, d)
    features, _ = kmers.kmer_features(_sequences(spark, d), _spec(3), samples)
    zero = Model([Member(0.0)], {})
    return linear.gradient(stats.single_values(features), linear.residuals(linear.linear_scores(samples, features, zero), samples.count()))


@query(f"with {_G3} select cast(f as bigint) as a, cast(f as bigint) as b, round(g, 6) as gradient from g order by abs(g) desc, f limit 10")
def gradient_topk(spark, d):
    return _rounded(select.top_gradients(_gradients3(spark, d), 10), 6, "gradient")


@query(
    f"""with {_G3}, ranked as (select abs(g) as g, row_number() over (order by abs(g) desc) as r from g), v as (select g as v from ranked where r = 5)
    select round((v + coalesce((select max(g) from ranked where g < v), 0)) / 2, 6) as "lambda", cast(5 as bigint) as n_selected from v"""
)
def lambda_auto_zero(spark, d):
    chosen = select.select_auto(_gradients3(spark, d), [], 5, None)
    return spark.createDataFrame([(round(chosen.lambda_, 6), len(chosen.features))], "lambda double, n_selected bigint")


@query(f"with {_G3} select cast(f as bigint) as a, cast(f as bigint) as b from g where abs(g) >= 20")
def select_fixed(spark, d):
    chosen = select.select_fixed(_gradients3(spark, d), [], 20.0)
    return spark.createDataFrame(chosen.features, "a bigint, b bigint")


# Fits: no SQL; tests hold them against optimality conditions

_SCALED = Options(transform="standardizer")


def _fit_rows(spark, results) -> DataFrame:
    rows = [(r.n, m, a, b, float(t)) for r in results for m, x in enumerate(r.model.members) for (a, b), t in [((-1, -1), x.bias), *sorted(x.theta.items())]]
    return spark.createDataFrame(rows, "n bigint, member int, a bigint, b bigint, theta double")


@query()
def fit_l1(spark, d):
    samples, features = _score_data(spark, d)
    return _fit_rows(spark, fit_ensemble(samples, features, MODEL.names, Options(transform="standardizer", lambda_=0.001)))


@query()
def leapfrog_path(spark, d):
    samples, features = _score_data(spark, d)
    est = Estimator(samples, features, Options(transform="standardizer", lambda_auto=(1, 2, 3)))
    est.estimate()
    est.close()
    return spark.createDataFrame([(i, float(x), float(norm), [float(t) for t in theta]) for i, (x, norm, theta) in enumerate(est.path)], "step bigint, lambda double, norm double, theta array<double>")


@query()
def penalty_free_fit(spark, d):
    samples, features = _score_data(spark, d)
    return _fit_rows(spark, fit_ensemble(samples, features, MODEL.names, Options(transform="standardizer", lambda_auto=(2,), penalty_free=True)))


@query()
def ensemble_fit(spark, d):
    samples, features = _score_data(spark, d)
    return _fit_rows(spark, fit_ensemble(samples, features, MODEL.names, Options(transform="variance-scaler", lambda_auto=(2,), ensemble_size=3, seed=-1)))


@query()
def cross_validation(spark, d):
    samples, features = _score_data(spark, d)
    done = cross_validate(samples, features, MODEL.names, Options(transform="variance-scaler", lambda_auto=(2,), k_fold=3, seed=-1))
    return spark.createDataFrame([(r.fold, r.train_loss, r.test_loss) for r in done], "fold int, train double, test double")


# Ensembles of coefficients: each line number's gradient at zero is a member

_COEF = f"""{_SCORES}, {_LONG}, coef as (select cast(sample_id % 10 - 1 as integer) as member, cast(f as bigint) as a, cast(f as bigint) as b,
    round(avg((0.5 - label::int) * v), 3) as theta from long group by all)"""


def _members(spark, d) -> DataFrame:
    table = _scores(spark, d)
    values = F.array(*(F.col(c) for c in COLUMNS))
    long = table.select("sample_id", "label", F.posexplode(values).alias("f", "v"))
    rows = long.groupBy((F.col("sample_id") % 10 - 1).cast("int").alias("member"), F.col("f").cast("bigint").alias("a")).agg(
        F.round(F.avg((0.5 - F.col("label").cast("double")) * F.col("v")), 3).alias("theta")
    )
    return rows.select("member", "a", F.col("a").alias("b"), "theta")


_MEMBERS = 7


@query(f"with {_COEF} select a, b, {', '.join(f'coalesce(sum(theta) filter (member = {m}), 0) as theta_{m}' for m in range(_MEMBERS))} from coef where theta <> 0 group by a, b")
def ensemble_union(spark, d):
    coef = _members(spark, d)
    parts = [coef.where("member < 3"), coef.where("member >= 3").withColumn("member", F.col("member") - 3)]
    return ensemble.wide_members(ensemble.union_members(parts), _MEMBERS)


@query(f"with {_COEF} select a, b, round(sum(theta) / {_MEMBERS}, 6) as theta from coef group by a, b")
def combine_mean(spark, d):
    return _rounded(ensemble.combine(_members(spark, d), _MEMBERS, "mean"), 6, "theta")


@query(f"with {_COEF} select a, b, first(theta order by abs(theta), member) as theta from coef group by a, b")
def combine_min(spark, d):
    return ensemble.combine(_members(spark, d), _MEMBERS, "min")


@query(f"with {_COEF} select a, b, first(theta order by abs(theta) desc, member) as theta from coef group by a, b")
def combine_max(spark, d):
    return ensemble.combine(_members(spark, d), _MEMBERS, "max")


@query(f"with {_COEF} select a, b, cast(count_if(theta <> 0) as bigint) as stability, round(coalesce(sum(abs(theta)) / nullif(count_if(theta <> 0), 0), 'nan'::double), 6) as mean from coef group by a, b")
def stability(spark, d):
    return _rounded(ensemble.stability(_members(spark, d)), 6, "mean")


@both_ways(f"with {_Z}, p as (select sample_id, {_LP} as p from z) select sample_id, round(avg(p), 6) as mean, round(min(p), 6) as min, round(max(p), 6) as max, round(min(p) * max(p), 6) as product from p group by 1")
def summarise(spark, d, wide):
    how = ("mean", "min", "max", "product")
    if wide:
        each = F.array(*(log_sigmoid(tables.member_score(MODEL, COLUMNS, m)) for m in range(2)))
        return _rounded(_scores(spark, d).select("sample_id", *(tables.summary(each, h, 2).alias(h) for h in how)), 6, *how)
    scored = _scored(spark, d, False).withColumn("p", log_sigmoid(F.col("z")))
    return _rounded(scored.groupBy("sample_id").agg(*(ensemble.summarise("p", h).alias(h) for h in how)), 6, *how)


# Reports

_NAMES = "names(f, name) as (values (0, 'quantity'), (1, 'price'), (2, 'discount'), (3, 'tax'))"


def _names(spark) -> DataFrame:
    return spark.createDataFrame(list(MODEL.names.items()), "feature_id bigint, name string")


@query(f"with {_COEF}, {_NAMES} select member, cast(row_number() over (partition by member order by abs(theta) desc, a) as integer) as place, name as feature, theta from coef join names on a = f where theta <> 0")
def coefficients_ranked(spark, d):
    return report.ranked_coefficients(_members(spark, d), _names(spark))


@query(
    f"""with {_COEF}, {_NAMES}, r as (select member, row_number() over (partition by member order by abs(theta) desc, a) as place, name, theta from coef join names on a = f where theta <> 0)
    select member, cast(place as integer) as place, printf('%6d', place) || ' ' || printf('%14.6e', theta) || ' ' || lpad(name, cast(max(length(name)) over (partition by member) as integer), ' ') || ' ' as line from r"""
)
def coefficient_listing(spark, d):
    return report.listing(report.ranked_coefficients(_members(spark, d), _names(spark)))


@query(
    f"""with {_COEF}, {_NAMES}, s as (select f as a, 1 / max(abs(v)) as scale from long group by f)
    select member, cast(row_number() over (partition by member order by abs(theta / scale) desc, a) as integer) as place, name as feature, round(theta / scale, 6) as theta
    from coef join names on a = f join s using (a) where theta <> 0"""
)
def coefficients_rescaled(spark, d):
    samples, features = _score_data(spark, d)
    scale = stats.fit_transform(stats.single_values(features), samples.count(), "max-abs-scaler")
    return _rounded(report.ranked_coefficients(_members(spark, d).join(scale.drop("offset"), ["a", "b"]), _names(spark), True), 6, "theta")


@query(
    f"""with {_LABELLED}, {_seq_sql()}, {_counts_sql(4)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)),
    n as (select count_if(label) as n1, count_if(not label) as n0 from labelled)
    select f as a, f as b, round(count_if(label) / any_value(n1), 9) as foreground, round(count_if(not label) / any_value(n0), 9) as background
    from counts join dict using (kmer) join labelled using (sample_id), n group by f"""
)
def abundance(spark, d):
    features, _ = kmers.kmer_features(_sequences(spark, d), _spec(4), _labelled(spark, d))
    return _rounded(report.abundance(stats.single_values(features), _labelled(spark, d)), 9, "foreground", "background")


_I3 = f"{_seq_sql('benchmark', 'item_id', 'items')}, {_counts_sql(3, 'items')}, dict as (select kmer, row_number() over (order by kmer) - 1 as f, count(*) as df from counts group by kmer)"
_THETA = "round((df - 30) / 10, 3)"


def _item_model(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, their features, the dictionary, and a coefficient for each class out of its item frequency."""
    spec = _spec(3)
    items = _sequences(spark, d, "benchmark", "item_id")
    features, known = kmers.kmer_features(items, spec)
    theta = features.groupBy("feature_id").agg(F.round((F.count("*") - 30) / 10, 3).alias("theta"))
    return items, features, known, theta


@query(
    f"""with {_I3}, x as (select sample_id, f, n as v, greatest({_THETA}, 0) as w from counts join dict using (kmer)),
    q as (select sample_id, coalesce(sum(w * v * v), 0) + 0.5 as q from items left join x using (sample_id) group by 1),
    dots as (select p.sample_id as s1, r.sample_id as s2, sum(p.w * p.v * r.v) as d from x p join x r on p.f = r.f and p.sample_id <= r.sample_id where p.w > 0 group by 1, 2)
    select a.sample_id as s1, b.sample_id as s2, round((coalesce(d, 0) + 0.5) / sqrt(a.q) / sqrt(b.q), 6) as similarity
    from q a join q b on a.sample_id <= b.sample_id left join dots on s1 = a.sample_id and s2 = b.sample_id"""
)
def similarity(spark, d):
    items, features, _, theta = _item_model(spark, d)
    return _rounded(report.similarity(items, features, theta, 0.5), 6, "similarity")


@query(
    f"""with {_seq_sql('benchmark', 'item_id', 'items')}, {_counts_sql(2, 'items', '2')}, {_counts_sql(3, 'items', '3')},
    c as (select * from counts2 union all select * from counts3),
    dict as (select kmer, row_number() over (order by length(kmer), kmer) - 1 as f, round((count(*) - 30) / 10, 3) as theta from c group by kmer),
    words as (select distinct f, theta, unnest([kmer, {_rc('kmer')}]) as w from dict where theta <> 0),
    pairs as (select distinct p.f as feature_id, q.f as other, q.theta from words p join words q on p.f <> q.f and (contains(p.w, q.w) or contains(q.w, p.w)))
    select feature_id, other, theta, cast(row_number() over (partition by feature_id order by abs(theta) desc, other) as integer) as place from pairs"""
)
def related_kmers(spark, d):
    features, known = kmers.kmer_features(_sequences(spark, d, "benchmark", "item_id"), _spec(2, 3))
    theta = features.groupBy("feature_id").agg(F.round((F.count("*") - 30) / 10, 3).alias("theta"))
    coef = theta.select(F.col("feature_id").alias("a"), F.col("feature_id").alias("b"), "theta")
    return report.related(known, coef)


# Windows

_WINDOW, _STEP = 40, 10
_CUT = f"cut as (select sample_id, cast(i as integer) as start, substring(s, i + 1, {_WINDOW}) as s from (select sample_id, s, unnest(range(0, length(s) - {_WINDOW}, {_STEP})) as i from seqs))"
_PARTS = "parts as (select sample_id, start, substring(s, j, 2) as w from (select sample_id, start, s, unnest(range(1, {0})) as j from cut))"


def _window_model(spark, d, binarize: bool = False) -> tuple[DataFrame, DataFrame, Model]:
    """Documents, their dictionary of pairs of letters, and a model with a coefficient for all but one of them."""
    spec = _spec(2, binarize=binarize)
    seqs = _sequences(spark, d)
    known = stored(kmers.dictionary(kmers.kmer_counts(seqs, spec), spec), "dictionary")
    theta = {(i, i): (i - 4) / 50 for i in range(known.count()) if i != 4}
    return seqs, known, Model([Member(0.25, theta)], {}, spec, {(1, 1): (0.5, 2.0)})


_SCALED_SUM = "sum(case when f = 1 then 2 * (f - 4) / 50 else (f - 4) / 50 end) + 0.5 * 2 * 3 / 50"


_SCALED_Z = f"""with {_seq_sql()}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)),
    {_CUT}, {_PARTS.format(_WINDOW)},
    z as (select sample_id, start, 0.25 + {_SCALED_SUM} as z from parts join dict on kmer = {_canon('w')} group by 1, 2)"""


@query(f"{_SCALED_Z} select sample_id, start, cast(0 as integer) as member, round(z, 6) as z, round({_LP}, 6) as prediction from z")
def window_scores(spark, d):
    seqs, known, model = _window_model(spark, d)
    return _rounded(windows.window_scores(seqs, known, model, _WINDOW, _STEP), 6, "z", "prediction")


@query(
    f"""with {_seq_sql()}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)),
    {_CUT}, {_PARTS.format(_WINDOW)}, once as (select distinct sample_id, start, f from parts join dict on kmer = {_canon('w')}),
    z as (select sample_id, start, 0.25 + {_SCALED_SUM} as z from once group by 1, 2)
    select sample_id, start, cast(0 as integer) as member, round(z, 6) as z, round({_LP}, 6) as prediction from z"""
)
def window_scores_of_presence(spark, d):
    seqs, known, model = _window_model(spark, d, True)
    return _rounded(windows.window_scores(seqs, known, model, _WINDOW, _STEP), 6, "z", "prediction")


_REGIONS = """regions as (select event_id as region_id, user_id as seqname, cast(event_id * 7919 % greatest(length(s), 1) as integer) as start, length(s) as n, s,
    event_id from events join seqs on user_id = sample_id), placed as (select *, cast(least(n, start + event_id % 97) as integer) as stop from regions)"""


def _regions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Regions anywhere in whole texts, and those texts as a genome."""
    genome = _sequences(spark, d).select(F.col("sample_id").alias("seqname"), "sequence")
    n = F.length("sequence")
    start = (F.col("event_id") * 7919 % F.greatest(n, F.lit(1))).cast("int")
    rows = _table(spark, d, "events").join(genome.where("sequence is not null"), F.col("user_id") == F.col("seqname"))
    return rows.select(F.col("event_id").alias("region_id"), "seqname", start.alias("start"), F.least(n, start + F.col("event_id") % 97).cast("int").alias("stop")), genome


@query(f"with {_seq_sql()}, {_REGIONS} select region_id, seqname, start, stop, substring(s, start + 1, stop - start) as sequence from placed where s is not null")
def genomic_slice(spark, d):
    regions, genome = _regions(spark, d)
    return windows.genomic_slices(regions, genome).select("region_id", "seqname", "start", "stop", "sequence")


_GENOMIC = f"""with {_seq_sql()}, {_REGIONS}, {_counts_sql(2)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)),
    cut as (select sample_id, cast(i as integer) as start, substring(s, i + 1, 20) as s from (select region_id as sample_id, substring(s, start + 1, stop - start) as s,
        unnest(range(0, stop - start - 20, 10)) as i from placed where s is not null)), {_PARTS.format(20)},
    z as (select sample_id, start, 0.25 + {_SCALED_SUM} as z from parts join dict on kmer = {_canon('w')} group by 1, 2),
    scored as (select sample_id as region_id, start, 2 * {_LP} as prediction from z)"""


def _genomic_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    regions, genome = _regions(spark, d)
    _, known, model = _window_model(spark, d)
    return windows.genomic_scores(regions, genome, [(model, known), (model, known)], 20, 10), regions


@query(f"{_GENOMIC} select region_id, start, round(prediction, 6) as prediction from scored")
def genomic_window_scores(spark, d):
    return _rounded(_genomic_scores(spark, d)[0], 6, "prediction")


@query(
    f"""{_GENOMIC} select region_id, -1 as place, 'fixedStep chrom=' || seqname || ' start=' || (start + 10) || ' step=10 span=10' as line from placed where s is not null
    union all select region_id, start as place, printf('%.9f', exp(prediction)) as line from scored"""
)
def wiggle_lines(spark, d):
    from .sources.writers import wiggle_lines as lines

    return lines(*_genomic_scores(spark, d), 20, 10, digits=9)


@query(
    """with p as (select user_id as sample_id, row_number() over (partition by user_id order by event_id) as position, value as score from events)
    select sample_id, position as start, round(sum(score) over (partition by sample_id order by position range between current row and 4 following), 6) as total from p"""
)
def window_sums(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    positions = _table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.row_number().over(order).cast("bigint").alias("position"), F.col("value").alias("score"))
    return _rounded(windows.window_sums(positions, 5), 6, "total")


# Expansion

_EXP = [c for c in COLUMNS if c != "price"]


def _expanded(spark, d, **rules) -> DataFrame:
    found = expand.expand(_scores(spark, d).select("sample_id", *_EXP), _EXP, **rules)
    new = [c for c in found.columns if c not in ("sample_id", *_EXP)]
    columns = {c: f"x{i}" for i, c in enumerate(new)}
    return _rounded(found.select("sample_id", *(F.col(f"`{c}`").alias(x) for c, x in columns.items())), 6, *columns.values())


@query(f"with {_SCORES} select sample_id, round(exp(-quantity), 6) as x0, round(exp(-discount), 6) as x1, round(exp(-tax), 6) as x2, round(discount * discount, 6) as x3, round(tax * tax, 6) as x4, round(sqrt(quantity), 6) as x5, round(sqrt(discount), 6) as x6, round(sqrt(tax), 6) as x7 from scores")
def expand_unary(spark, d):
    ops = [o for o in expand.parse_operations("abs,exp,square,sqrt") if o.name not in ("exp",)]
    return _expanded(spark, d, operations=ops, max_depth=1, most=100.0)


@query(f"with {_SCORES} select sample_id, round(quantity * discount, 6) as x0, round(quantity * tax, 6) as x1, round(quantity * (quantity + discount), 6) as x2, round(quantity * (quantity + tax), 6) as x3, round(quantity * (discount + tax), 6) as x4, round(discount * tax, 6) as x5 from scores")
def expand_binary(spark, d):
    return _expanded(spark, d, operations=expand.parse_operations("add,mul"), max_depth=1, max_features=9)


@query(f"with {_SCORES} select sample_id, round(quantity ^ 2, 6) as x0, round(discount ^ 2, 6) as x1, round(tax ^ 2, 6) as x2, round(sqrt(quantity), 6) as x3, round(sqrt(discount), 6) as x4, round(sqrt(tax), 6) as x5, round(quantity ^ 4, 6) as x6, round(discount ^ 4, 6) as x7, round(tax ^ 4, 6) as x8, round(quantity, 6) as x9, round(discount, 6) as x10, round(tax, 6) as x11 from scores")
def expand_depth2(spark, d):
    return _expanded(spark, d, operations=expand.parse_operations("square,sqrt"), max_depth=2, max_features=15)


@query(f"with {_SCORES}, s as (select sample_id, quantity as q, discount as d, tax as t from scores) select sample_id, round(q / (q - d), 6) as x0, round(q / (q - t), 6) as x1, round(q / (d - q), 6) as x2, round(q / (t - q), 6) as x3, round(d / (q - d), 6) as x4, round(d / (q - t), 6) as x5 from s")
def expand_quotients(spark, d):
    """Differences feed quotients; a quotient with a zero below it anywhere goes."""
    return _expanded(spark, d, operations=expand.parse_operations("sub,div"), max_depth=1, max_features=9)


# Sources and sinks: written by Spark into the shared folder, and read again


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"


@query("select 'doc' || doc_id as seqname, regexp_replace(lower(text), '[^a-z]', '', 'g') as sequence from documents where regexp_replace(lower(text), '[^a-z]', '', 'g') <> ''")
def fasta_round_trip(spark, d):
    from .sources.readers import read_fasta

    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    broken = F.regexp_replace(letters, "(.{60})", "$1\n")
    rows = _table(spark, d, "documents").where(letters != "").select(F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"), broken).alias("value"))
    path = _folder(spark)
    rows.write.text(path)
    return read_fasta(spark, path)


@query(f"with {_SCORES} select round(quantity, 4) as quantity, round(discount, 4) as discount, round(tax, 4) as tax, count(*) as n from scores group by all")
def score_table_round_trip(spark, d):
    from .sources.readers import read_scores

    path = _folder(spark)
    line = F.concat_ws(" ,", *(F.col(c).cast("string") for c in _EXP))
    _scores(spark, d).select(F.concat(line, F.lit(",")).alias("value")).write.text(path)
    v = [F.round(F.col("values")[i], 4).alias(c) for i, c in enumerate(_EXP)]
    return read_scores(spark, path, columns=_EXP).select(*v).groupBy(*_EXP).agg(F.count("*").alias("n"))


_D3 = f"{_seq_sql()}, {_counts_sql(3)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts))"


@query(
    f"""with {_D3} select 0 as src, sample_id, string_agg(cast(coalesce(n, 0) as varchar), ',' order by f) as line
    from seqs join dict on true left join counts using (sample_id, kmer) group by sample_id"""
)
def matrix_export(spark, d):
    from .sources.writers import matrix_lines

    seqs = _sequences(spark, d)
    features, known = kmers.kmer_features(seqs, _spec(3))
    return matrix_lines(features, seqs.select("sample_id"), known)


from . import file_queries, fit_queries, run_queries  # noqa: E402, F401 - register their own
