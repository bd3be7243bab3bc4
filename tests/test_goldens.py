"""Known results of small data sets: fits, predictions, and counts of gapped words."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import dataset, kmers, linear
from quillon.plans.fit import Estimator, evaluate
from quillon.spec import KmerSpec, Member, Model, Options

# Eight rows of either label, seven columns, of which the product of the second and third tells labels apart.
CO_FG = """0.4,21.0,10.5,0.21,5.1,0.22,14.2|0.2,11.2,33.5,0.23,1.6,0.11,15.2|0.3,15.9,20.3,0.26,4.4,0.13,14.2|0.4,20.1,36.5,0.29,10.1,0.11,12.2
0.2,12.2,65.1,0.22,50.1,0.31,14.2|0.1,33.1,70.2,0.21,0.2,0.21,12.2|0.3,12.3,43.5,0.22,0.1,0.22,14.2|0.2,14.3,10.3,0.23,0.4,0.31,12.3"""
CO_BG = """0.2,22.4,10.5,0.53,13.3,0.11,1.42|0.4,1.15,33.1,0.54,3.6,0.42,45.2|0.5,15.4,24.2,0.44,1.6,0.31,2.42|0.2,2.13,26.5,0.20,0.3,0.14,21.2
0.4,11.1,10.3,0.20,10.4,0.61,1.42|0.2,3.14,50.2,0.11,65.3,0.18,12.2|1.1,1.12,32.5,0.13,2.1,0.32,1.42|1.3,13.4,70.3,0.45,6.4,0.99,12.3"""
CO_PREDICTIONS = [
    -0.6662065007234194, -0.6477490377012717, -0.6539634473226117, -0.6063887787494636, -0.5995933447812485, -0.4461679042826637, -0.6290620668667339, -0.6750691863398406,
    -0.664436851779278, -0.6884446417698201, -0.648046764432194, -0.6861810564115558, -0.679086111385735, -0.6738126996571452, -0.688649950605459, -0.5832453150753549,
]
# Places of two words in sequences of 80 a; the first label has both words, the other one of them twice.
BOTH = [(8, 42), (13, 47), (3, 70), (58, 70), (27, 61), (30, 70), (6, 72), (32, 73), (4, 27), (16, 71)]
TWICE = [((8, 42), 'c'), ((13, 47), 't'), ((3, 70), 't'), ((58, 70), 'c'), ((27, 61), 't'), ((30, 70), 'c'), ((6, 72), 't'), ((32, 73), 'c'), ((4, 27), 't'), ((16, 71), 'c')]
# Two sequences.
SEQUENCES = [
    "tacgtgtgtaacatctcagccttgaggtagcacacccatttctgtgatagggacatcagtccatttgtaatttaatcacctccaacagttcttcaagccttcaaactacactggggcttaaccttgccacactaccaatt"
    "tgggaagacatttaaagcatcgagaagtgttacgattagcaggggtgacgtgcaatcctgagactctagggaagagctggaagtcatcagagtccaagcaggccaggggtgtggtccctgtaggagaaagttaggaaatg"
    "ggattctacagccaggagcctgggtggaggaaggcaggtcttacagcgtagggaaacaaagaggggaggggcaggagctggaactggaaaatgggtttagttactagggagaagtctcactccagcaagacctaggctat"
    "cggattccagtgagcaagatgaatgcagagggtgtttcatggaagatacttcaaggtcagcctgggttgcatgagacttgttagaaaaaaaaaaaaaaaggagtttgctggtgagaggcagggtagtctcaaaagggagt"
    "gtgcgaaatgatttctacgcgtttggttttcagttctgctattatattcctgtttgttttcttttgaaagctcgattatgttgtctccacgagagaaatctgaccgtgattaaagctaccagcccaaacaaagatggaga"
    "gaaaagaggaggataagaggtagtgattttccataagcccggaaagcagatgtcagaggctgggaggaagtaggcaggggagtcactgctccctgggggcggggtttccccctggagtgataaaactgttcaggaactag"
    "ataagagttctgaaggttgcacaacctcaaggatttatgacgtgctcctgggttttgtactttgaaatgggtggattatttttaaatgtatattttatattttatcatgctcacaaaaatagtggtcttacacacaccat"
    "actttgtgagatttatgtct",
    "atccttcgcatggcacccaagaaggagaaacctaccgggagcgcaaactataagatatgggaaccttccctcatagctgcacacttgaaccaggtgagcccggcctctcaagtccctctagtccagggagcctggagctc"
    "tctgctcagcactgctctcccagatctgccaggtgcttgacaaaggagtgagctagagggatggggctacaactcagtggtggggctgagggaagaccctgggttcagtttgcagaaccagaagcaaaaacaagacagga"
    "agggaatctcagccctgccatttcaaaatggggtggtagatctgtgtgaggagaacgagaacggggttgtcattatgactcctgagtccccctttcagtgcaggcaggcttccagtgcttcccccctgccccccttgtac"
    "tgggactgttatccttgtgaactgtttccttcctgtttgaccggttgatccccccttgtactgggactgttatccttgtgaactgtttccttcctgtttgaccggttgatcattcgtatcattcgtggccccgcccacag"
    "caatattttaattaatgctggatgtaatcagccaagacccagaactacaatctgtaaaaatagaaagatctctagaagaaaatgttcttatgtgatggcttgctctgttttggtctctgttgctctgataaataacctat"
    "ttcattttaatgtttggggcaggaactagaagcagaaacccccgcaggaatcctgctccctgactctggctcatgctcagctagcttttttatacaccaccaggccacctaagataatgcctgatacaatgggctgggca"
    "ttcctccatcaagactctctcacacagacttggccacaggcccctctgagatgcacaatccctcctttgagaccctgtcagatgactacaggctgtgtcaagttgacagctaaacaaattagaacatactccatacctct"
    "gcatccaacgttttcatctg",
]


def table(text):
    return [[float(x) for x in r.split(",")] for r in text.replace("\n", "|").split("|")]


def test_pair_of_columns(spark):
    rows = [(i, i < 8, *r) for i, r in enumerate(table(CO_FG) + table(CO_BG))]
    df = spark.createDataFrame(rows, "sample_id bigint, label boolean, " + ", ".join(f"c{i} double" for i in range(7)))
    samples, features = df.select("sample_id", "label"), dataset.score_features(df, [f"c{i}" for i in range(7)])
    est = Estimator(samples, features, Options(lambda_auto=(1,), cooccurrence=True))
    found = est.estimate()[0]
    est.close()
    assert set(found.member.theta) == {(1, 2)} and found.settled
    # a stochastic solver's coefficients: their loss and predictions, and no better than the optimum
    names = {i: str(i + 1) for i in range(7)}
    model = Model([Member(-3.6698336905701286e-06, {(1, 2): 0.000247759511599005})], names, cooccurrence=True)
    assert evaluate(samples, features, model) == pytest.approx(0.6699931965725273, abs=1e-9)
    got = [r.prediction for r in linear.predict(samples, features, model).orderBy("sample_id").collect()]
    assert got == pytest.approx(CO_PREDICTIONS, abs=1e-9)
    own = Model([found.member], names, cooccurrence=True)
    assert evaluate(samples, features, own, found.lambda_) <= evaluate(samples, features, model, found.lambda_)


def planted(words):
    letters = ["a"] * 80
    for at, last in words:
        letters[at : at + 7] = "ggtctc" + last
    return "".join(letters)


def test_pair_of_words(spark):
    fg = [planted([(a, "c"), (b, "t")]) for a, b in BOTH]
    bg = [planted([(a, last), (b, last)]) for (a, b), last in TWICE]
    rows = [(i, i < len(fg), s) for i, s in enumerate(fg + bg)]
    seqs = spark.createDataFrame(rows, "sample_id bigint, label boolean, sequence string").cache()
    spec = KmerSpec(2, 6, revcomp=True, binarize=True, cooccurrence=True)
    features, _ = kmers.kmer_features(seqs, spec)
    samples = seqs.select("sample_id", "label")
    est = Estimator(samples, features, Options(lambda_auto=(2,), cooccurrence=True))
    found = est.estimate()[0]
    est.close()
    model = Model([found.member], {}, spec, cooccurrence=True)
    assert len(found.member.theta) == 2 and all(a != b for a, b in found.member.theta) and found.settled
    known = Model([Member(-0.1000970529629098, dict.fromkeys(found.member.theta, 0.09995715710821684))], {}, spec, cooccurrence=True)
    assert evaluate(samples, features, known) == pytest.approx(0.644417014007959, abs=1e-9)
    want = {True: -0.6444834689451768, False: -0.744447612033651}
    for r in linear.predict(samples, features, known).collect():
        assert r.prediction == pytest.approx(want[r.label], abs=1e-6)
    assert evaluate(samples, features, model, found.lambda_) <= evaluate(samples, features, known, found.lambda_) + 1e-9


def test_gapped_words(spark):
    seqs = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(SEQUENCES)], "sample_id bigint, sequence string")
    spec = KmerSpec(4, 8, revcomp=True, alphabet="gapped-nucleotide")
    counts = kmers.kmer_counts(seqs, spec).cache()
    known = kmers.dictionary(counts, spec).cache()
    place = {"gntanc|gntanc": 4671, "gntcaa|ttganc": 4672, "aaagaaa|tttcttt": 5068, "aagannt|anntctt": 5486, "aacgcgna|tncgcgtt": 19270, "tgaatgca|tgcattca": 57071}
    assert {r.name: r.feature_id for r in known.where(F.col("name").isin(*place)).collect()} == place
    got = {r.name: r.n for r in kmers.fixed_dictionary(counts.where("sample_id = 0"), known).join(known.select("feature_id", "name"), "feature_id").where(F.col("name").isin(*place)).collect()}
    assert got == {"gntanc|gntanc": 3, "aaagaaa|tttcttt": 1, "aagannt|anntctt": 7, "aacgcgna|tncgcgtt": 1, "tgaatgca|tgcattca": 1}
