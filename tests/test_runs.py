"""Ensembles of different features, whole runs with their files, bounds of fits, windows of long sequences."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import nucleotides as nt
from quillon.operators import dataset, ensemble, kmers, linear, stats, tables, windows
from quillon.plans import fit
from quillon.plans.fit import Estimator
from quillon.plans.learn import learn
from quillon.sources import model_io, readers, writers
from quillon.spec import KmerSpec, Member, Model, Options


def test_models_of_different_words():
    spec = KmerSpec(2, 3, revcomp=True)
    one = Model([Member(1.0, {(0, 0): -3.0, (1, 1): 0.0})], {0: "ac|gt", 1: "aaa|ttt"}, spec, {(0, 0): (1.0, 2.0)}, "")
    two = Model([Member(-2.0, {(0, 0): 1.0, (1, 1): 5.0, (0, 1): 4.0})], {0: "aaa|ttt", 1: "ac|gt"}, spec, {(0, 0): (0.0, 1.0), (1, 1): (1.0, 2.0)}, "mean", False)
    whole = ensemble.joined([one, two])
    assert whole.names == {0: "ac|gt", 1: "aaa|ttt"} and whole.summary == "mean"
    assert [m.theta for m in whole.members] == [{(0, 0): -3.0}, {(1, 1): 1.0, (0, 0): 5.0, (0, 1): 4.0}]
    assert whole.transform == {(0, 0): (1.0, 2.0), (1, 1): (0.0, 1.0)}
    assert ensemble.combine_models([one, two], "max").members[0].theta == {(0, 0): 5.0, (0, 1): 4.0, (1, 1): 1.0}
    assert ensemble.combine_models([one, two], "min").members[0].theta == {(0, 0): -3.0, (0, 1): 0.0, (1, 1): 0.0}
    assert ensemble.combine_models([one, two], "mean").members[0].theta == {(0, 0): 1.0, (0, 1): 2.0, (1, 1): 0.5}
    third = Model([Member(0.0, {(0, 0): 1.0})], {0: "ac|gt"}, spec, {(0, 0): (1.0, 2.5)}, "mean")
    for models, said in (
        ([one, two, third], "transforms"), ([two, Model([Member(0.0)], {}, KmerSpec(2, 3, binarize=True))], "kinds"), ([two, Model([Member(0.0)], {}, None)], "kinds"),
        ([two, Model([Member(0.0)], {}, spec, {}, "max")], "summaries"), ([two, Model([Member(0.0, {(0, 0): 1.0})], {0: "ac|gt"}, spec)], "only one"),
    ):
        with pytest.raises(ValueError, match=said):
            ensemble.joined(models)
    with pytest.raises(ValueError, match="unknown"):
        ensemble.combine_models([one, two], "median")


def test_columns_of_one_place_have_one_name():
    one, two = (Model([Member(0.0, {(i, i): 1.0})], {i: n}) for i, n in ((3, "x"), (3, "y")))
    with pytest.raises(ValueError, match="column 4"):
        ensemble.joined([one, two])


def numbers(spark, n=60):
    r = random.Random(4)
    rows = [(i, i % 3 == 0, r.gauss(i % 3 == 0, 1.0), r.gauss(0, 1), r.gauss(0, 2), None if i % 7 == 0 else r.random()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id bigint, label boolean, a double, b double, c double, d double")


COLUMNS = ["a", "b", "c", "d"]


def test_wide_tables_give_what_long_features_give(spark):
    df = numbers(spark).cache()
    samples, features = df.select("sample_id", "label"), dataset.score_features(df, COLUMNS)
    model = Model([Member(0.2, {(0, 0): 1.0, (1, 3): -2.0}), Member(0.1, {(2, 2): 0.5})], dict(enumerate(COLUMNS)), None, {(0, 0): (0.3, 2.0), (1, 3): (0.1, 0.5)}, "product", True)
    got = {(r.sample_id, r.member): r.z for r in tables.scores(df, model, COLUMNS, ["sample_id"]).collect()}
    want = {(r.sample_id, r.member): r.z for r in linear.linear_scores(samples, features, model).collect()}
    assert got == pytest.approx(want)
    for how in ("mean", "product", "min", "max"):
        model.summary = how
        a = {r.sample_id: r.prediction for r in tables.predict(df, model, COLUMNS, ["sample_id"]).collect()}
        assert a == pytest.approx({r.sample_id: r.prediction for r in linear.predict(samples, features, model).collect()})
    every = tables.singles(COLUMNS) + tables.pairs(COLUMNS)
    values = stats.single_values(features).unionByName(kmers.pair_values(features))
    n = samples.count()
    for kind in ("standardizer", "variance-scaler", "max-abs-scaler", "mean-scaler"):
        a = {(r.a, r.b): (r.offset, r.scale) for r in stats.transform_of(tables.statistics(df, COLUMNS, every), n, kind).collect()}
        b = {(r.a, r.b): (r.offset, r.scale) for r in stats.fit_transform(values, n, kind).collect()}
        assert a.keys() == b.keys() and all(a[f] == pytest.approx(b[f]) for f in a)
    scored = linear.linear_scores(samples, features, model.component(0))
    a = {(r.a, r.b): r.gradient for r in tables.gradient(df, Model(model.members, model.names), COLUMNS, every, weights=(1.0, 2.0)).collect()}
    plain = Model([model.members[0]], model.names)
    b = {(r.a, r.b): r.gradient for r in linear.gradient(values, linear.residuals(linear.linear_scores(samples, features, plain), n, (1.0, 2.0))).collect()}
    assert a == pytest.approx(b) and scored.count() == n


def test_many_features_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(tables, "GROUP", 3)
    df = numbers(spark)
    assert tables.statistics(df, COLUMNS, tables.singles(COLUMNS) + tables.pairs(COLUMNS)).count() == 10


def test_a_missing_column_is_no_zero(spark):
    df = numbers(spark)
    model = Model([Member(0.0, {(5, 5): 1.0})], {5: "f"})
    with pytest.raises(ValueError, match="column 6"):
        tables.scores(df, model, COLUMNS, ["sample_id"])
    with pytest.raises(ValueError, match="column 6"):
        linear.linear_scores(df.select("sample_id", "label"), dataset.score_features(df, COLUMNS), model, 4)


def test_a_run_leaves_its_files(spark, tmp_path):
    df = numbers(spark)
    samples, features = df.select("sample_id", "label"), dataset.score_features(df, COLUMNS)
    names = dict(enumerate(COLUMNS))
    done = learn(samples, features, names, Options(lambda_auto=(1, 2), k_fold=2, seed=-1), output=str(tmp_path / "m"))
    assert len(done) == 4
    found = {p.name for p in tmp_path.iterdir()}
    assert found == {f"m_cv{k}_{n}.json" for k in (1, 2) for n in (1, 2)} | {f"m_cv{k}.{x}" for k in (1, 2) for x in ("trace", "path")} | {f"m_{n}{x}.table" for n in (1, 2) for x in ("", "_loss")}
    assert model_io.load(str(tmp_path / "m_cv1_2.json"), spark).names[0] == "a"
    assert spark.read.text(str(tmp_path / "m_1.table")).count() == 61 and spark.read.text(str(tmp_path / "m_1_loss.table")).count() == 3
    one = learn(samples, features, names, Options(lambda_auto=(1,)), output=str(tmp_path / "one"))
    assert len(one) == 1 and {p.name for p in tmp_path.iterdir()} - found == {"one.json", "one.trace", "one.path"}
    steps = spark.read.text(str(tmp_path / "one.trace")).count() - 1
    assert steps == len(one[0].estimates[0].trace) > 1  # a row a step of the solver


def test_bounds_of_epochs(spark, monkeypatch):
    df = numbers(spark)
    samples, features = df.select("sample_id", "label"), dataset.score_features(df, COLUMNS)
    monkeypatch.setattr(fit, "MOST_EPOCHS", 1)
    for options, settled in ((Options(lambda_=0.01), False), (Options(lambda_=0.01, max_epochs=9), True), (Options(lambda_auto=(2,)), False), (Options(lambda_auto=(2,), max_epochs=9), True)):
        est = Estimator(samples, features, options)
        assert est.estimate()[0].settled == settled
        est.close()


def test_parts_of_long_sequences(spark, monkeypatch):
    r = random.Random(6)
    seqs = ["".join(r.choice("acgtn") if i % 17 == 0 else r.choice("acgt") for i in range(n)) for n in (0, 1, 3, 4, 9, 10, 11, 57, 200)] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "sample_id bigint, sequence string")
    for k in (1, 3):
        cut = df.where("sequence is not null").select("sample_id", F.explode(nt.chunks(F.col("sequence"), k, 10)).alias("s")).collect()
        for i, s in enumerate(seqs[:-1]):
            own = [x.s[j : j + k] for x in cut if x.sample_id == i for j in range(len(x.s) - k + 1)]
            assert sorted(own) == sorted(s[j : j + k] for j in range(len(s) - k + 1))
    whole = sorted(tuple(x) for x in kmers.kmer_counts(df, KmerSpec(1, 3, revcomp=True)).collect())
    monkeypatch.setattr(kmers, "CHUNK", 10)
    assert sorted(tuple(x) for x in kmers.kmer_counts(df, KmerSpec(1, 3, revcomp=True)).collect()) == whole


def test_regions_across_parts(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK", 10)
    r = random.Random(3)
    seqs = {n: "".join(r.choice("acgt") for _ in range(n)) for n in (0, 1, 9, 10, 11, 35, 40)}
    genome = spark.createDataFrame([(str(n), s) for n, s in seqs.items()], "seqname string, sequence string")
    rows = [(str(n), a, b) for n in seqs for a in range(0, n + 1, 3) for b in {a, min(a + 1, n), min(a + 14, n), n}] * 2
    regions = spark.createDataFrame([(i, *x, "k") for i, x in enumerate(rows)], "region_id bigint, seqname string, start int, stop int, part string")
    got = windows.genomic_slices(regions, genome)
    assert got.columns == [*regions.columns, "sequence"]
    assert {x.region_id: x.sequence for x in got.collect()} == {i: seqs[int(n)][a:b] for i, (n, a, b) in enumerate(rows)}


@pytest.mark.parametrize("last", [False, True])
def test_running_sums_equal_counted_windows(spark, monkeypatch, last):
    r = random.Random(7)
    seqs = ["".join(r.choice("acgtn") if i % 13 == 0 else r.choice("ACGT") for i in range(n)) for n in (0, 5, 12, 13, 30, 61, 150)] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "sample_id bigint, sequence string")
    spec = KmerSpec(2, 3, revcomp=True)
    known = kmers.dictionary(kmers.kmer_counts(df, spec), spec).cache()
    n = known.count()
    model = Model([Member(0.3, {(i, i): (i - 7) / 9 for i in range(0, n, 2)}), Member(-0.1, {(1, 1): 1.5})], {}, spec, {(2, 2): (0.5, 3.0), (4, 4): (1.0, 1.0)})
    monkeypatch.setattr(windows, "CHUNK", 20)
    rows = lambda found: {(x.sample_id, x.start, x.member): x.z for x in found.collect()}
    got = rows(windows.window_scores(df, known, model, 12, 5, last))
    wide = Model([Member(m.bias, m.theta | {(0, 1): 1e-300}) for m in model.members], {}, spec, model.transform)  # a pair makes windows be counted
    assert got == pytest.approx(rows(windows.window_scores(df, known, wide, 12, 5, last))) and len(got) > 20


def test_exported_rows_of_a_dictionary_with_gaps(spark):
    features = spark.createDataFrame([(0, 3, 2.0), (0, 9, 1.0), (1, 9, 4.0)], "sample_id bigint, feature_id bigint, value double")
    known = spark.createDataFrame([(3, "x"), (7, "y"), (9, "z")], "feature_id bigint, name string")
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id bigint")
    got = {r.sample_id: r.line for r in writers.matrix_lines(features, samples, known).collect()}
    assert got == {0: "2,0,1", 1: "0,0,4", 2: "0,0,0"}


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.bed").write_text("".join(f"c\t{i}\t{i + 1}\n" for i in range(50)))
    got = readers.with_ids(readers.read_bed(spark, str(tmp_path / "a.bed")).repartition(3)).collect()
    assert sorted(r.sample_id for r in got) == list(range(50))


def test_model_kinds_are_told_by_structure():
    model = Model([Member(0.5, {(0, 0): 1.0})], {0: "x"})
    assert model_io.from_json(model_io.to_json(model, "some reader's name")).names == {0: "x"}
    assert '"Name": "scores"' in model_io.to_json(Model([Member(0.5, {(0, 0): 1.0})], {0: "x"}, summary=""))
    with pytest.raises(ValueError, match="not a model"):
        model_io.from_json('{"Name": "x", "Parameters": {"Features": []}, "Distributions": [{"Parameters": {}}]}')


def test_stored_tables_have_an_owner(spark):
    from quillon import session

    before = session.tables_written(spark)
    one, two = (session.stored(spark.range(n), "t") for n in (3, 4))
    paths = session.tables_written(spark)[len(before) :]
    assert len(paths) == 2 and one.count() == 3
    session.remove_tables(spark, paths[:1])
    assert session.tables_written(spark) == before + paths[1:] and two.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(paths[0])


def test_runs_side_by_side_own_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from quillon import session

    both = Barrier(2)

    def run(n):
        with session.owned() as outer, session.owned() as own:
            both.wait(60)
            table = session.stored(spark.range(n), f"run{n}")
            both.wait(60)
            session.remove_tables(spark, own if n == 3 else [])
            both.wait(60)
            return outer == own, [p for p in own if f"run{n}-" not in p], n == 3 or table.count()

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (3, 4))) == [(True, [], True), (True, [], 4)]


def test_the_check_before_a_broadcast(spark):
    from quillon.session import small

    df = spark.createDataFrame([("x" * 100, 1, [1, 2])] * 5, "s string, n int, a array<int>")
    assert small(df, 5) and not small(df, 4) and not small(df, 5, 400) and small(df.where("false"), 0)
