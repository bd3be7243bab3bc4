"""Fits on the small score tables, model algebra, and files."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions.nucleotides import class_name
from quillon.operators import dataset, ensemble, expand, kmers, linear, report
from quillon.plans.fit import Estimator, evaluate
from quillon.plans.learn import cross_validate, fit_ensemble
from quillon.sources import model_io, readers, writers
from quillon.spec import KmerSpec, Member, Model, Options
from quillon.streaming.score import score_stream

# Eight rows of either label, seven columns.
FG = """0.4,1.4,10.5,0.21,5.1,0.22,4.21|0.2,1.2,33.5,0.23,1.6,0.11,5.23|0.3,1.3,20.3,0.26,4.4,0.13,4.25|0.4,1.2,36.5,0.29,10.1,0.11,2.21
0.2,1.2,65.1,0.22,50.1,0.31,4.23|0.1,1.3,70.2,0.21,0.2,0.21,2.21|0.3,1.2,43.5,0.22,0.1,0.22,4.22|0.2,1.4,10.3,0.23,0.4,0.31,2.32"""
BG = """0.2,22.4,30.5,0.53,13.3,0.11,14.21|0.4,11.5,13.1,0.54,3.6,0.42,45.23|0.5,15.4,24.2,0.44,1.6,0.31,24.25|0.2,21.3,26.5,0.20,0.3,0.14,21.21
0.4,11.1,10.3,0.20,10.4,0.61,14.23|0.2,31.4,50.2,0.11,65.3,0.18,12.21|1.1,11.2,32.5,0.13,2.1,0.32,14.22|1.3,13.4,70.3,0.45,6.4,0.99,12.32"""
THETA = (0.842178566751775, -0.05466291047449, -0.03026279836545)


def table(text):
    return [[float(x) for x in r.split(",")] for r in text.replace("\n", "|").split("|")]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, i < 8, *r) for i, r in enumerate(table(FG) + table(BG))]
    df = spark.createDataFrame(rows, "sample_id bigint, label boolean, " + ", ".join(f"c{i} double" for i in range(7))).cache()
    return df.select("sample_id", "label"), dataset.score_features(df, [f"c{i}" for i in range(7)]), df


def test_loss_at_known_coefficients(scores):
    samples, features, _ = scores
    model = Model([Member(THETA[0], {(1, 1): THETA[1], (6, 6): THETA[2]})], {1: "2", 6: "7"})
    assert evaluate(samples, features, model, 4.647556) == pytest.approx(0.813659729805629, abs=1e-9)


def test_two_features_are_chosen_with_the_known_penalty(scores):
    samples, features, _ = scores
    est = Estimator(samples, features, Options(lambda_auto=(2,)))
    found = est.estimate()[0]
    assert found.lambda_ == pytest.approx(2.496875)
    assert set(found.member.theta) == {(1, 1), (6, 6)}
    assert found.member.theta[1, 1] == pytest.approx(THETA[1], rel=1e-2)
    # optimality: active gradients equal the penalty, the others are below it
    for r in est.gradients().collect():
        if (r.a, r.b) in found.member.theta:
            assert abs(r.gradient) == pytest.approx(found.lambda_, rel=1e-3)
        else:
            assert abs(r.gradient) <= found.lambda_ * 1.001
    est.close()


def test_fixed_penalty_leaves_no_violation(scores):
    samples, features, _ = scores
    est = Estimator(samples, features, Options(lambda_=0.05, transform="standardizer"))
    found = est.estimate()[0]
    assert found.member.theta and all(abs(r.gradient) <= 0.05 * 1.01 for r in est.gradients().collect())
    assert all(t[5] <= math.log(2) + 1e-9 for t in est.trace)
    est.close()


def test_ensemble_and_cross_validation(scores):
    samples, features, _ = scores
    results = fit_ensemble(samples, features, {i: str(i + 1) for i in range(7)}, Options(lambda_auto=(1,), ensemble_size=2, seed=-1))
    assert len(results[0].model.members) == 2
    folds = cross_validate(samples, features, {}, Options(lambda_auto=(1,), k_fold=2, seed=-1))
    assert sum(f.predictions.count() for f in folds) == 16 and all(f.test_loss > 0 for f in folds)


def test_pair_model_predictions(spark):
    """Log-probabilities of a bias and two coefficients on presence features."""
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id bigint")
    features = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)], "sample_id bigint, feature_id bigint, value double")
    model = Model([Member(-0.100097, {(0, 1): 0.099957, (0, 0): 0.0})], {0: "a", 1: "b"}, cooccurrence=True)
    got = {r.sample_id: r.prediction for r in linear.predict(samples, features, model).collect()}
    assert got[0] == pytest.approx(-math.log1p(math.exp(0.100097 - 0.099957)))
    assert got[1] == got[2] == pytest.approx(-0.74444761, abs=1e-5)


def test_model_file(spark, tmp_path):
    spec = KmerSpec(2, 3, revcomp=True, alphabet="gapped nucleotide alphabet")
    model = Model([Member(0.5, {(0, 0): 1.0, (0, 2): -2.0}), Member(0.1, {(2, 2): 3.0})], {0: "aa|tt", 2: "ac|gt"}, spec, {(0, 0): (1.0, 2.0)}, "max", True)
    back = model_io.from_json(model_io.to_json(model))
    assert [m.bias for m in back.members] == [0.5, 0.1] and back.summary == "max" and back.spec.alphabet == "gapped-nucleotide"
    assert back.members[0].theta[(0, 1)] == -2.0
    model_io.save(model, str(tmp_path / "m"), spark)
    assert model_io.load(str(tmp_path / "m"), spark).members[1].theta[(1, 1)] == 3.0


def test_combined_members():
    models = [Model([Member(1.0, {(0, 0): -3.0})], {0: "a"}), Model([Member(-2.0, {(0, 0): 1.0})], {0: "a"})]
    assert ensemble.combine_models(models, "max").members[0].theta == {(0, 0): -3.0}
    assert ensemble.combine_models(models, "min").members[0].bias == 1.0
    assert ensemble.combine_models(models, "mean").members[0].theta == {(0, 0): -1.0}


def test_class_names(spark):
    df = spark.createDataFrame([("gntanc",)], "w string")
    spec = KmerSpec(6, 6, revcomp=True, alphabet="gapped-nucleotide")
    assert df.select(class_name(F.col("w"), spec)).first()[0] == "gntanc|gntanc"


def test_palindromes_count_once(spark):
    seqs = spark.createDataFrame([(0, "GATCnGATC"), (1, "ga"), (2, None)], "sample_id bigint, sequence string")
    got = {(r.sample_id, r.kmer): r.n for r in kmers.kmer_counts(seqs, KmerSpec(4, 4, revcomp=True)).collect()}
    assert got == {(0, "gatc"): 2}


def test_expansion_of_a_positive_table(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in table(FG) + table(BG)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = expand.expand(df, ["a", "b", "c", "d"], max_features=20).columns
    assert got == (
        "a,b,c,d,exp(a),exp(b),exp(c),exp(d),exp(-a),exp(-b),exp(-c),exp(-d),log(a),log(b),log(c),log(d),(a^2),(b^2),(c^2),(d^2)".split(",")
    )


def test_expansion_ends_where_nothing_is_added(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert expand.expand(df, ["a", "b"], expand.parse_operations("add")).columns == ["a", "b"]
    with pytest.raises(ValueError, match="unknown"):
        expand.parse_operations("cube")


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nac\n>y\n\nGG\n>x\nTT\n")
    assert {(r.seqname, r.sequence) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("x", "TT"), ("y", "GG")}
    (tmp_path / "s.table").write_text("a,b\n1, 2\n\n3,,4\n")
    assert readers.score_names(spark, str(tmp_path / "s.table")) == ["a", "b"]
    got = [r[0] for r in readers.read_scores(spark, str(tmp_path / "s.table"), header=True, columns=["a", "b"]).collect()]
    assert sorted(got) == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "h.table").write_text("1,2\n1,2\n3,4\n1,2\n")
    assert sorted(r[0] for r in readers.read_scores(spark, str(tmp_path / "h.table"), header=True).collect()) == [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "bad.table").write_text("1,2\n3,x\n")
    with pytest.raises(Exception, match="not a row of scores"):
        readers.read_scores(spark, str(tmp_path / "bad.table")).collect()
    (tmp_path / "r.bed").write_text("track x\nchr1\t5\t9\textra\n")
    assert [tuple(r) for r in readers.read_bed(spark, str(tmp_path / "r.bed")).collect()] == [("chr1", 5, 9)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, -0.5), (0, -0.25)], "sample_id bigint, prediction double")
    writers.write_predictions(df, str(tmp_path / "p"))
    lines = [r.value.strip() for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert sorted(lines) == ["-2.500000e-01", "-5.000000e-01", "prediction"]
    assert writers.output_name("m", 2, 0, True) == "m_cv1_2" and writers.output_name("m", 2) == "m"


def test_similarity_of_equal_samples(spark):
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id bigint")
    features = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0), (2, 1, 1.0)], "sample_id bigint, feature_id bigint, value double")
    theta = spark.createDataFrame([(0, 1.0), (1, -1.0)], "feature_id bigint, theta double")
    got = {(r.s1, r.s2): r.similarity for r in report.similarity(samples, features, theta, -1.0).collect()}
    assert got[0, 1] == pytest.approx(1.0) and got[0, 2] == 0.0 and len(got) == 6


def test_a_stream_is_scored(spark, scores, tmp_path):
    _, _, df = scores
    df.write.parquet(str(tmp_path / "in"))
    model = Model([Member(THETA[0], {(1, 1): THETA[1], (6, 6): THETA[2], (0, 1): 0.5})], {})
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    columns = [f"c{i}" for i in range(7)]
    q = score_stream(stream, model, columns).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.sample_id: r.prediction for r in linear.predict(*scores[:2], model).collect()}
    got = {r.sample_id: r.prediction for r in spark.table("scored").collect()}
    assert got == pytest.approx(want)


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(lambda_=1.0, lambda_auto=(2,))
    with pytest.raises(ValueError):
        KmerSpec(3, 2)
    assert KmerSpec(4, 6, alphabet="gapped-nucleotide", max_ambiguous=(1, 2, 9)).ambiguous_at(6) == 4
