"""FASTA in parts: records over several stretches of a file, and what is computed from parts."""

import random

import pytest

from quillon.operators import kmers, windows
from quillon.sources import readers
from quillon.spec import KmerSpec, Member, Model


@pytest.fixture
def files(spark, tmp_path):
    r = random.Random(2)
    records = {f"r{i}": "".join(r.choice("acgtn") for _ in range(n)) for i, n in enumerate((0, 5, 61, 700, 6000, 1, 0, 2500))}
    names = list(records)
    (tmp_path / "in").mkdir()
    for k, own in enumerate((names[:5], names[5:])):
        lines = ["stray acgt"] * (k == 0)
        for name in own:
            s = records[name]
            lines += [f">{name} said {k}", *(s[i : i + 60] for i in range(0, len(s), 60))]
        (tmp_path / "in" / f"{k}.fa").write_text("\n".join(lines + ["", " "] * k) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield str(tmp_path / "in"), records
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("letters", [100, 100_000])
def test_parts(spark, files, letters):
    path, records = files
    parts = readers.read_fasta_parts(spark, path, letters)
    rows = parts.collect()
    assert max(len(x.part) for x in rows) < len(records["r4"]) / 4  # by several tasks
    got = {}
    for x in sorted(rows, key=lambda x: (x.seqname, x.offset)):
        assert x.offset == len(got.get(x.seqname, ""))
        got[x.seqname] = got.get(x.seqname, "") + x.part
    assert got == records
    whole = {x.seqname: x.sequence for x in readers.read_fasta(spark, path).collect() if x.seqname != "stray"}
    assert whole == records


def test_features_of_parts_equal_those_of_whole_records(spark, files, monkeypatch):
    path, records = files
    monkeypatch.setattr(kmers, "CHUNK", 150)
    monkeypatch.setattr(windows, "CHUNK", 150)
    whole = spark.createDataFrame(list(records.items()), "sample_id string, sequence string")
    parts = readers.read_fasta_parts(spark, path, 100).withColumnRenamed("seqname", "sample_id")
    spec = KmerSpec(1, 5, revcomp=True)
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(kmers.kmer_counts(parts, spec)) == key(kmers.kmer_counts(whole, spec))
    known = kmers.dictionary(kmers.kmer_counts(whole, spec), spec).cache()
    model = Model([Member(0.1, {(i, i): i / 10 for i in range(8)})], {}, spec)
    scored = [{(x.sample_id, x.start): x.z for x in windows.window_scores(df, known, model, 200, 7).collect()} for df in (parts, whole)]
    assert scored[0] == pytest.approx(scored[1]) and len(scored[0]) > 100


def test_a_name_that_comes_again(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nacgt\nac\n>y\n\n>x\ntt\n>\ngg\n")
    got = sorted(tuple(x) for x in readers.read_fasta_parts(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("", 0, "gg"), ("x", 0, "tt"), ("y", 0, "")]
    (tmp_path / "none.fa").write_text("")
    assert readers.read_fasta_parts(spark, str(tmp_path / "none.fa")).count() == 0
