"""Counts by classes within parts against counts of plain words that are widened and merged afterwards."""

import random

import pytest

from quillon import queries
from quillon.operators import kmers
from quillon.session import tables_written
from quillon.spec import KmerSpec

SPECS = [
    KmerSpec(1, 5, revcomp=True), KmerSpec(3, 3), KmerSpec(2, 3, reverse=True, complement=True), KmerSpec(3, 4, revcomp=True, alphabet="gapped-nucleotide"),
    KmerSpec(2, 4, alphabet="iupac-nucleotide", max_ambiguous=(0, 1, 1)), KmerSpec(2, 8, revcomp=True, binarize=True),
]


def rows(df):
    return sorted(map(tuple, df.select("sample_id", "k", "kmer", "n").collect()), key=repr)


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


@pytest.mark.parametrize("spec", SPECS)
def test_same_counts(spark, monkeypatch, spec):
    monkeypatch.setattr(kmers, "CHUNK", 20)
    r = random.Random(1)
    given = [(i // 2 if i % 5 == 0 else i, "".join(r.choice("acgtACGTn-") for _ in range(r.choice([0, 1, 3, 7, 25, 90])))) for i in range(40)]
    df = spark.createDataFrame([*given, (None, "acgtacg"), (None, "acg"), (77, None)], "sample_id bigint, sequence string").repartition(3)
    found = kmers.kmer_counts(df, spec)
    assert found.columns == ["sample_id", "k", "kmer", "n"]
    monkeypatch.setattr(kmers, "ENTRIES", 0)
    assert rows(found) == rows(kmers.kmer_counts(df, spec))


def test_words_are_not_shuffled(spark):
    """A sample's counts of one length move as one row, once."""
    df = spark.createDataFrame([(1, "acgt" * 100), (2, "ggta")], "sample_id bigint, sequence string")
    found = kmers.kmer_counts(df, KmerSpec(5, 5, revcomp=True))
    assert exchanged(found) == 1 and "collect_list" in found._jdf.queryExecution().executedPlan().toString()


def test_related_patterns_store_no_counts(spark, data):
    """How many samples have a class is one aggregation; counts by sample aren't written."""
    before = len(tables_written(spark))
    assert queries.queries()["related_patterns"](spark, data).count()
    names = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in tables_written(spark)[before:]]
    assert "held" in names and "counts" not in names
