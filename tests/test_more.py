"""Transforms, co-preselection, genomic scores, and the remaining readers and writers."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import dataset, kmers, report, select, stats, windows
from quillon.plans.fit import Estimator
from quillon.plans.learn import fit_ensemble
from quillon.sources import readers, writers
from quillon.spec import KmerSpec, Member, Model, Options


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


T = "a bigint, b bigint, offset double, scale double"


def test_transforms_merge_where_they_agree(spark):
    one = frame(spark, [(0, 0, 1.0, 2.0), (1, 1, 0.0, 3.0)], T)
    two = frame(spark, [(1, 1, 0.0, 3.0), (0, 1, 0.5, 1.0)], T)
    assert stats.merge_transforms(one, two).count() == 3 and stats.same_transforms(one, two).first().same
    far = frame(spark, [(1, 1, 0.0, 3.1)], T)
    assert not stats.same_transforms(one, far).first().same
    with pytest.raises(Exception, match="differ"):
        stats.merge_transforms(one, far).collect()
    assert stats.select_transform(one, far).count() == 1


def test_transforms_of_odd_columns(spark):
    """A constant column has scale 1; one of zeros has no entry, as it has no value."""
    values = frame(spark, [(0, 0, 0, 5.0), (1, 0, 0, 5.0), (0, 1, 1, 1.0), (1, 1, 1, -1.0)], "sample_id bigint, a bigint, b bigint, value double")
    got = {r.a: r for r in stats.fit_transform(values, 2, "standardizer").collect()}
    assert (got[0].offset, got[0].scale) == (5.0, 1.0) and got[1].scale == pytest.approx(1 / math.sqrt(2))
    assert {r.a: r.scale for r in stats.fit_transform(values, 2, "mean-scaler").collect()}[1] == math.inf


def xor(spark):
    """Only the product of the first two features tells the labels apart."""
    rows = [(i, i % 2 == 0) for i in range(16)]
    features = []
    for i, label in rows:
        on = (1.0, 1.0) if label else ((1.0, 0.0) if i % 4 == 1 else (0.0, 1.0))
        features += [(i, f, v) for f, v in enumerate((*on, float(i % 3))) if v]
    return frame(spark, rows, "sample_id bigint, label boolean"), frame(spark, features, "sample_id bigint, feature_id bigint, value double")


def test_a_pair_is_found(spark):
    samples, features = xor(spark)
    est = Estimator(samples, features, Options(lambda_auto=(1,), cooccurrence=True))
    assert set(est.estimate()[0].member.theta) == {(0, 1)}
    est.close()


def test_co_preselection(spark):
    samples, features = xor(spark)
    found = fit_ensemble(samples, features, {0: "x", 1: "y", 2: "z"}, Options(lambda_auto=(1,), cooccurrence=True, co_preselection=2))
    assert len(found[0].model.members[0].theta) == 1


def test_selection_rules():
    assert select.lambda_for([3.0, -1.0, 2.0], 2) == 1.5 and select.lambda_for([1.0], 2) == 0.0
    assert select.lambda_for([2.0, 2.0], 2) == 1.0
    assert select.base_features([(5, 5), (2, 9)]) == ([2, 5, 9], [(1, 1), (0, 2)])


def test_genomic_scores(spark):
    genome = frame(spark, [("c1", "ACGTACGTACGT"), ("c2", "AAAA")], "seqname string, sequence string")
    regions = frame(spark, [(0, "c1", 2, 10)], "region_id bigint, seqname string, start int, stop int")
    spec = KmerSpec(2, 2)
    known = frame(spark, [(0, 2, "ac", "ac")], "feature_id bigint, k int, kmer string, name string")
    model = Model([Member(0.0, {(0, 0): 1.0})], {0: "ac"}, spec)
    got = {r.start: r.prediction for r in windows.genomic_scores(regions, genome, [(model, known), (model, known)], 4, 2).collect()}
    assert set(got) == {0, 2} and got[0] == pytest.approx(-2 * math.log1p(math.exp(-1)))  # gtac, acgt
    lines = writers.wiggle_lines(windows.genomic_scores(regions, genome, [(model, known)], 4, 2), regions, 4, 2).orderBy("place").collect()
    assert lines[0].line == "fixedStep chrom=c1 start=4 step=2 span=2" and len(lines) == 3
    with pytest.raises(Exception, match="no such region"):
        windows.genomic_slices(frame(spark, [(0, "c2", 0, 9)], "region_id bigint, seqname string, start int, stop int"), genome).collect()


def test_range_tables(spark, tmp_path):
    (tmp_path / "r.table").write_text("seqnames from to counts\nchr1 5 9 1,2.5\n\nchr2 0 3 4,5\n")
    got = {r.seqname: (r.start, r.stop, r["values"]) for r in readers.read_ranges(spark, str(tmp_path / "r.table")).collect()}
    assert got == {"chr1": (5, 9, [1.0, 2.5]), "chr2": (0, 3, [4.0, 5.0])}
    assert readers.read_score_table(spark, str(tmp_path / "r.table")).count() == 2
    (tmp_path / "h.csv").write_text("1,2\n1,2\n3,4\n")
    assert readers.read_scores(spark, str(tmp_path / "h.csv"), header=True).count() == 2  # a row like the header stays
    (tmp_path / "r.bed").write_text("c1\t0\t3\nc2\t1\t2\n")
    ids = readers.with_ids(readers.read_bed(spark, str(tmp_path / "r.bed")))
    assert sorted(r.sample_id for r in ids.select("sample_id").collect()) == [0, 1]


def test_tables_are_written(spark, tmp_path):
    similarity = frame(spark, [(0, 0, 1.0), (0, 1, 0.5), (1, 1, 1.0)], "s1 bigint, s2 bigint, similarity double")
    writers.write_similarity(similarity, str(tmp_path / "s"))
    assert sorted(r.value.split() for r in spark.read.text(str(tmp_path / "s")).collect()) == [["0.5000", "1.0000"], ["1.0000", "0.5000"]]
    path = frame(spark, [(0, 0, 0.5, 1.0, [0.1, -1.0])], "estimator int, step int, lambda double, norm double, theta array<double>")
    writers.write_path(path, str(tmp_path / "p"))
    assert any("-1.000000e+00" in r.value for r in spark.read.text(str(tmp_path / "p")).collect())
    table = frame(spark, [(0, 1.0), (1, 2.0)], "src int, x double")
    writers.write_expanded(table, ["x"], str(tmp_path / "e"), 2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "e_1.table")).collect()) == ["2.000000e+00", "x"]
    cv = frame(spark, [(-0.5, True)], "prediction double, label boolean")
    writers.write_cv(cv, frame(spark, [(0.1, 0.2)], "train double, test double"), str(tmp_path / "cv"))
    assert spark.read.text(str(tmp_path / "cv_loss.table")).count() == 2
    trace = frame(spark, [(0.5, 0, 1.0, 3, 0.1, 0.6)], "duration double, iteration int, change double, nonzero int, lambda double, loss double")
    writers.write_trace(trace, str(tmp_path / "t"))
    writers.write_stability(frame(spark, [(0, 0, 2, 0.5)], "a bigint, b bigint, stability bigint, mean double"), str(tmp_path / "st"))
    assert spark.read.text(str(tmp_path / "t")).count() == spark.read.text(str(tmp_path / "st")).count() == 2


def test_fixed_dictionary_gives_the_same_features(spark):
    seqs = frame(spark, [(0, "acgtacca"), (1, "ggtaccgt")], "sample_id bigint, sequence string")
    spec = KmerSpec(3, 4, revcomp=True, alphabet="gapped-nucleotide")
    counts = kmers.kmer_counts(seqs, spec)
    known = kmers.dictionary(counts, spec)
    free, fixed = kmers.vectorise(counts, known), kmers.vectorise(kmers.kmer_counts(seqs, spec), known)
    assert free.exceptAll(fixed).isEmpty() and fixed.exceptAll(free).isEmpty()
    ids = [r.name for r in known.orderBy("feature_id").collect()]
    key = lambda n: (len(n.split("|")[0]), n.split("|")[0].replace("n", "z"))
    assert ids == sorted(ids, key=key)


def test_products_equal_their_factors(spark):
    features = frame(spark, [(0, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)], "sample_id bigint, feature_id bigint, value double")
    defs = kmers.feature_table(spark, [(0, 1), (1, 1)])
    got = {(r.sample_id, r.a, r.b): r.value for r in kmers.feature_values(features, defs).collect()}
    assert got == {(0, 0, 1): 6.0, (0, 1, 1): 3.0, (1, 1, 1): 4.0}


def test_folds_of_too_few_samples(spark):
    samples = frame(spark, [(0,), (1,)], "sample_id bigint")
    with pytest.raises(ValueError):
        dataset.folds(samples, 3)
    assert dataset.folds(samples, 1).select("fold").distinct().first().fold == -1
    with pytest.raises(ValueError):
        dataset.check_columns(["a"], {0: "b"})


def test_weights_add_up(spark):
    samples = frame(spark, [(i, i < 3) for i in range(10)], "sample_id bigint, label boolean")
    w = dataset.class_weights(samples).first()
    assert 7 * w.w0 + 3 * w.w1 == pytest.approx(10)
    values = frame(spark, [(0, 0, 0, 1.0), (5, 0, 0, 1.0)], "sample_id bigint, a bigint, b bigint, value double")
    r = report.abundance(values, samples).first()
    assert (r.foreground, r.background) == (pytest.approx(1 / 3), pytest.approx(1 / 7))
    assert samples.where(F.col("label")).count() == 3
