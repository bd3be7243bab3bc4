"""Queries on fits with their optimum in SQL, sums over pairs of words, records in parts, patterns, and files that keep an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import gram, kmers, linear, report, windows
from .plans.fit import Estimator
from .plans.learn import TRACE, cross_validate, fit_ensemble
from .queries import (  # noqa: I001
    MODEL, _GENOMIC, _LABELLED, _LONG, _LP, _SCALED_Z, _SCORES, _STEP, _WINDOW, _counts_sql, _fit_rows, _folder, _genomic_scores, _labelled, _rc, _rounded, _score_data, _seq_sql, _sequences,
    _spec, _window_model, _words_sql, query,
)
from .session import stored
from .sources import readers, writers
from .spec import KmerSpec, Member, Model, Options

# Fits for one feature: the choice, the penalty half way between the two largest gradients, and the optimum by Newton's method

_NEWTON = f"""with recursive {_SCORES}, {_LONG}, s as (select f, avg(v) as m, stddev_samp(v) as sd from long group by f),
    g as (select f, avg((0.5 - label::int) * (v - m) / sd) as g from long join s using (f) group by f),
    r as (select f, g, abs(g) as size, row_number() over (order by abs(g) desc) as place from g),
    p as (select max(f) filter (place = 1) as f, -sign(max(g) filter (place = 1)) as way, (max(size) + max(size) filter (place = 2)) / 2 as l from r),
    x as (select label::int as y, (v - m) / sd as x from long join s using (f) join p using (f)),
    it(i, b, t) as (select 0, 0.0::double, 0.0::double union all
        select i + 1, b - (htt * gb - hbt * gt) / (hbb * htt - hbt * hbt), t - (hbb * gt - hbt * gb) / (hbb * htt - hbt * hbt) from (
            select i, b, t, avg(q - y) as gb, avg((q - y) * x) + any_value(l * way) as gt, avg(q * (1 - q)) as hbb, avg(q * (1 - q) * x) as hbt, avg(q * (1 - q) * x * x) as htt
            from (select i, b, t, y, x, l, way, 1 / (1 + exp(-(b + t * x))) as q from it, x, p where i < 12) group by i, b, t)),
    best as (select b, t from it where i = 12)"""


def _one_feature(spark, d, solver: str) -> tuple[Estimator, object]:
    samples, features = _score_data(spark, d)
    est = Estimator(samples, features, Options(transform="standardizer", lambda_auto=(1,), solver=solver))
    return est, est.estimate()[0]


def _fitted(solver: str) -> None:
    def run(spark, d):
        est, found = _one_feature(spark, d, solver)
        est.close()
        ((a, _), theta), = found.member.theta.items()
        return _rounded(spark.createDataFrame([(a, found.lambda_, found.member.bias, theta)], "a bigint, lambda double, bias double, theta double"), 6, "lambda", "bias", "theta")

    run.__name__ = f"fit_one_feature_{solver}"
    query(f"{_NEWTON} select cast(f as bigint) as a, round(l, 6) as \"lambda\", round(b, 6) as bias, round(t, 6) as theta from best, p")(run)


_fitted("coordinate")
_fitted("proximal")


@query(f"{_NEWTON} select true as whole, true as falling, 2 as nonzero, round(any_value(l), 5) as \"lambda\", round(avg(ln(1 + exp(b + t * x)) - y * (b + t * x)) + any_value(l * abs(t)), 5) as loss from best, p, x")
def trace_of_fit(spark, d):
    """The file of a fit's trace: every iteration has its change and number of coefficients, the first loss is the largest, and the last one is at the optimum."""
    est, found = _one_feature(spark, d, "proximal")
    est.close()
    path = _folder(spark)
    writers.write_trace(spark.createDataFrame(found.trace, TRACE), path)
    part = F.split(F.trim("value"), r"\s+")
    rows = readers.read_lines(spark, path).where("n > 0").select(*(part[i].alias(c) for i, c in enumerate(("duration", "iteration", "change", "nonzero", "lambda", "loss"))))
    rows = rows.select(F.col("iteration").cast("int").alias("i"), F.col("change").cast("double").alias("change"), F.col("nonzero").cast("int").alias("nonzero"), *(F.col(c).cast("double").alias(c) for c in ("lambda", "loss")))
    last = lambda c: F.max_by(c, "i")
    found = rows.agg(
        F.bool_and((F.col("change") >= 0) & (F.col("nonzero") >= 1)).alias("whole"), (F.min_by("loss", "i") == F.max("loss")).alias("falling"),
        last("nonzero").alias("nonzero"), last("lambda").alias("lambda"), last("loss").alias("loss"),
    )
    return _rounded(found, 5, "lambda", "loss")


# Pairs of words

_F4 = f"{_seq_sql()}, {_counts_sql(4)}, dict as (select kmer, row_number() over (order by kmer) - 1 as f from (select distinct kmer from counts)), x as (select sample_id, f, cast(n as double) as v from counts join dict using (kmer))"


@query(
    f"""with {_LABELLED}, {_F4}, r as (select sample_id, (0.5 - label::int) / count(*) over () as r from labelled)
    select p.f as a, q.f as b, round(sum(r * p.v * q.v), 6) as gradient from r join x p using (sample_id) join x q using (sample_id) where p.f < q.f group by 1, 2 having sum(r * p.v * q.v) <> 0"""
)
def pair_gradient(spark, d):
    """The gradient at zero coefficients by all products of the counts of words of four letters."""
    samples = _labelled(spark, d)
    features, _ = kmers.kmer_features(_sequences(spark, d), _spec(4), samples)
    r = linear.residuals(linear.linear_scores(samples, features, Model([Member(0.0)], {})), samples.count())
    return _rounded(gram.pair_gradient(features, r), 6, "gradient")


@query(
    f"""with {_F4}, n as (select count(*) as n from seqs), p as (select p.f as a, q.f as b, p.v * q.v as v from x p join x q on p.sample_id = q.sample_id and p.f < q.f),
    m as (select a, b, count(*) as nonzero, sum(v) as t, sum(v * v) as s, max(v) as mx from p group by 1, 2)
    select a, b, nonzero, round(t / n, 4) as mean, round(sqrt((s - n * (t / n) * (t / n)) / (n - 1)), 3) as sd, mx as max_abs from m, n"""
)
def pair_statistics_of_words(spark, d):
    seqs = _sequences(spark, d)
    features, _ = kmers.kmer_features(seqs, _spec(4))
    found = gram.pair_statistics(features, seqs.count()).drop("total")
    return _rounded(_rounded(found, 4, "mean"), 3, "sd")


# Records in parts


@query(f"with {_seq_sql()}, {_counts_sql(4)} select 'doc' || sample_id as sample_id, 4 as k, kmer, n from counts")
def kmer_counts_of_parts(spark, d):
    """Records written as FASTA, read in parts of 10,000 letters, and counted without being joined."""
    path = _folder(spark)
    broken = F.regexp_replace("sequence", "(.{60})", "$1\n")
    rows = _sequences(spark, d).where("sequence <> ''")
    rows.select(F.concat(F.lit(">doc"), F.col("sample_id").cast("string"), F.lit(" of documents\n"), broken).alias("value")).write.text(path)
    parts = readers.read_fasta_parts(spark, path, 10_000)
    return kmers.kmer_counts(parts.withColumnRenamed("seqname", "sample_id"), _spec(4))


# Related patterns

_WIDE = f"""{_seq_sql()}, {_words_sql(3, name='words3')}, {_words_sql(4, name='words4')},
    wide as (select sample_id, unnest([w, w[1] || 'n' || w[3]]) as p from (select distinct * from words3)
        union all select sample_id, unnest([w, w[1] || 'n' || w[3] || w[4], w[1] || w[2] || 'n' || w[4], w[1] || 'nn' || w[4]]) as p from (select distinct * from words4)),
    held as (select distinct sample_id, case when translate(p, 'n', 'z') <= translate({_rc('p')}, 'n', 'z') then p else {_rc('p')} end as kmer from wide),
    dict as (select kmer, row_number() over (order by length(kmer), translate(kmer, 'n', 'z')) - 1 as f, round((count(*) - 300) / 100, 3) as theta from held group by kmer)"""


@query(
    f"""with {_WIDE}, words as (select distinct f, theta, unnest([kmer, {_rc('kmer')}]) as w from dict where theta <> 0),
    pairs as (select distinct p.f as feature_id, q.f as other, q.theta from words p join words q on p.f <> q.f and (regexp_matches(p.w, replace(q.w, 'n', '.')) or regexp_matches(q.w, replace(p.w, 'n', '.'))))
    select feature_id, other, theta, cast(row_number() over (partition by feature_id order by abs(theta) desc, other) as integer) as place from pairs"""
)
def related_patterns(spark, d):
    spec = KmerSpec(3, 4, revcomp=True, alphabet="gapped-nucleotide")
    counts = kmers.kmer_counts(_sequences(spark, d), spec)
    held = stored(counts.groupBy("k", "kmer").agg(F.count("*").alias("samples")), "held")
    known = stored(kmers.dictionary(held, spec), "dictionary")
    theta = known.join(held, ["k", "kmer"]).withColumn("theta", F.round((F.col("samples") - 300) / 100, 3))
    return report.related(known, theta.select(F.col("feature_id").alias("a"), F.col("feature_id").alias("b"), "theta"))


# Files in order


@query(
    f"""{_GENOMIC}, lines as (select region_id, -1 as place, 'fixedStep chrom=' || seqname || ' start=' || (start + 10) || ' step=10 span=10' as line from placed where s is not null
    union all select region_id, start as place, printf('%.9f', exp(prediction)) as line from scored)
    select row_number() over (order by region_id, place) - 1 as n, line as value from lines"""
)
def wiggle_file(spark, d):
    path = _folder(spark)
    scores, regions = _genomic_scores(spark, d)
    writers.write_wiggle(scores, regions, path, 20, 10, digits=9)
    return readers.read_lines(spark, path)


@query(f"{_SCALED_Z}, lines as (select sample_id, string_agg(printf('%.6e', round({_LP}, 5)), ' ' order by start) as value from z group by 1) select row_number() over (order by sample_id) - 1 as n, value from lines")
def window_file(spark, d):
    path = _folder(spark)
    seqs, known, model = _window_model(spark, d)
    scores = windows.window_scores(seqs, known, model, _WINDOW, _STEP)
    writers.write_windows(_rounded(scores, 5, "prediction"), path)
    return readers.read_lines(spark, path)


# Folds and members, each left out of one of three fits on the first column with a small penalty

_L = 0.00001
_PARTS3 = f"""with recursive {_SCORES}, {_LONG}, s as (select avg(quantity) as m, stddev_samp(quantity) as sd from scores),
    placed as (select sample_id, label::int as y, (quantity - m) / sd as x, (row_number() over (order by sample_id) - 1) % 3 as fold from scores, s),
    x as (select part, fold = part as held, y, x from placed join (select unnest([0, 1, 2]) as part) on true),
    it(i, part, b, t) as (select 0, part, 0.0::double, 0.0::double from (select unnest([0, 1, 2]) as part) union all
        select i + 1, part, b - (htt * gb - hbt * gt) / (hbb * htt - hbt * hbt), t - (hbb * gt - hbt * gb) / (hbb * htt - hbt * hbt) from (
            select *, slope + {_L} * (case when t = 0 then -sign(slope) else sign(t) end) as gt from (
                select i, part, b, t, avg(q - y) as gb, avg((q - y) * x) as slope, avg(q * (1 - q)) as hbb, avg(q * (1 - q) * x) as hbt, avg(q * (1 - q) * x * x) as htt
                from (select i, part, b, t, y, x, 1 / (1 + exp(-(b + t * x))) as q from it join x using (part) where i < 14 and not held) group by i, part, b, t))),
    best as (select part, b, t from it where i = 14)"""
_ONE_EACH = {"transform": "standardizer", "lambda_": _L, "seed": -1}


def _one_column(spark, d) -> tuple[DataFrame, DataFrame]:
    samples, features = _score_data(spark, d)
    return samples, features.where("feature_id = 0")


@query(
    f"""{_PARTS3}, nll as (select part, held, ln(1 + exp(b + t * x)) - y * (b + t * x) as nll, {_L} * abs(t) as l from best join x using (part))
    select cast(part as integer) as fold, round(avg(nll) filter (not held) + any_value(l), 6) as train, round(avg(nll) filter (held) + any_value(l), 6) as test from nll group by part"""
)
def cross_validation_of_one_feature(spark, d):
    samples, features = _one_column(spark, d)
    done = cross_validate(samples, features, MODEL.names, Options(k_fold=3, **_ONE_EACH))
    return _rounded(spark.createDataFrame([(r.fold, r.train_loss, r.test_loss) for r in done], "fold int, train double, test double"), 6, "train", "test")


@query(
    f"""{_PARTS3} select cast(part as integer) as member, cast(-1 as bigint) as a, round(b, 6) as theta from best
    union all select cast(part as integer), cast(0 as bigint), round(t, 6) from best"""
)
def ensemble_of_one_feature(spark, d):
    samples, features = _one_column(spark, d)
    found = fit_ensemble(samples, features, MODEL.names, Options(ensemble_size=3, **_ONE_EACH))
    return _rounded(_fit_rows(spark, found).select("member", "a", "theta"), 6, "theta")


@query(
    f"""{_PARTS3} select sample_id, label, round(-ln(1 + exp(-(b + t * x))), 6) as prediction
    from placed join best on fold = part join scores using (sample_id)"""
)
def predictions_of_folds(spark, d):
    """Each sample's prediction by the fit that left it out."""
    samples, features = _one_column(spark, d)
    done = cross_validate(samples, features, MODEL.names, Options(k_fold=3, **_ONE_EACH))
    return _rounded(reduce(DataFrame.unionByName, [r.predictions for r in done]), 6, "prediction")
