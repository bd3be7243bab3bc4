"""Words as rolling codes: counts against plain loops, windows against windows that are counted one by one."""

import random
from collections import Counter

import pytest

from quillon.functions import packed
from quillon.operators import kmers, linear, windows
from quillon.spec import KmerSpec, Member, Model

SPECS = [
    KmerSpec(2, 3, revcomp=True), KmerSpec(2, 3, binarize=True), KmerSpec(3, 3, revcomp=True, binarize=True), KmerSpec(4, 4, revcomp=True, alphabet="gapped-nucleotide"),
    KmerSpec(3, 4, revcomp=True, alphabet="iupac-nucleotide", max_ambiguous=1, binarize=True), KmerSpec(2, 3, reverse=True, complement=True, cooccurrence=True),
    KmerSpec(3, 3, revcomp=True, alphabet="gapped-nucleotide", cooccurrence=True, binarize=True),
]


def sequences(spark):
    r = random.Random(7)
    seqs = ["".join(r.choice("acgtné") if i % 13 == 0 else r.choice("ACGTacgt") for i in range(n)) for n in (0, 1, 5, 11, 12, 13, 30, 61, 150)] + [None, "a" * 40, "gatc" * 10]
    return spark.createDataFrame(list(enumerate(seqs)), "sample_id bigint, sequence string"), seqs


@pytest.mark.parametrize("spec", SPECS, ids=str)
@pytest.mark.parametrize("last", [False, True])
def test_windows_equal_counted_windows(spark, monkeypatch, spec, last):
    df, _ = sequences(spark)
    known = kmers.dictionary(kmers.kmer_counts(df, spec), spec).cache()
    n = known.count()
    r = random.Random(n)
    theta = {(i, i): (i - 7) / 9 for i in range(0, n, 2)}
    if spec.cooccurrence:
        theta |= {(a, b): r.random() for a, b in ((r.randrange(n // 2), r.randrange(n // 2, n)) for _ in range(6))}
    model = Model([Member(0.3, theta), Member(-0.1, {(1, 1): 1.5})], {}, spec, {(2, 2): (0.5, 3.0), (4, 4): (1.0, 0.5)}, cooccurrence=spec.cooccurrence)
    cut = windows.slices(df, 12, 5, last).select("sample_id", "start", "sequence").collect()
    rows = spark.createDataFrame([(i, x.sequence) for i, x in enumerate(cut)], "sample_id bigint, sequence string")
    scored = linear.linear_scores(rows.select("sample_id"), kmers.vectorise(kmers.kmer_counts(rows, spec), known), model)
    want = {(cut[x.sample_id].sample_id, cut[x.sample_id].start, x.member): x.z for x in scored.collect()}
    monkeypatch.setattr(windows, "CHUNK", 20)
    got = {(x.sample_id, x.start, x.member): x.z for x in windows.window_scores(df, known, model, 12, 5, last).collect()}
    assert got == pytest.approx(want) and len(got) > 60


def test_window_bounds(spark):
    df, _ = sequences(spark)
    spec = KmerSpec(2, 2)
    known = kmers.dictionary(kmers.kmer_counts(df, spec), spec)
    model = Model([Member(0.5, {(0, 0): 1.0})], {}, spec)
    for wrong in ((0, 1), (5, 0)):
        with pytest.raises(ValueError):
            windows.window_scores(df, known, model, *wrong)
    short = windows.window_scores(df, known, model, 1, 50, True).collect()  # shorter than any word
    assert {x.z for x in short} == {0.5}
    assert windows.window_scores(df.where("false"), known, model, 5, 1).count() == 0


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_plain_counts(spark, monkeypatch, chunk):
    monkeypatch.setattr(kmers, "CHUNK", chunk)
    df, seqs = sequences(spark)
    got = {(x.sample_id, x.k, x.w): x.n for x in kmers.plain_counts(df, range(1, 6)).collect()}
    want = Counter((i, k, s[j : j + k].lower()) for i, s in enumerate(seqs) if s for k in range(1, 6) for j in range(len(s) - k + 1) if set(s[j : j + k].lower()) <= set("acgt"))
    assert got == dict(want)


def test_long_words():
    s = b"acgt" * 20 + b"n" + b"t" * 31
    places, codes = packed.rolling(s, 31)
    assert [packed.words(codes[[i]], 31)[0].as_py() for i in (0, -1)] == [s[:31].decode(), "t" * 31] and places[-1] == 81
    with pytest.raises(ValueError):
        packed.rolling(s, 32)
    assert packed.matching("an") == [0, 1, 2, 3] and packed.images("gntanc", KmerSpec(6, 6, revcomp=True, alphabet="gapped-nucleotide")) == {"gntanc"}
