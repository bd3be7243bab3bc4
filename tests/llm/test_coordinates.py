"""The inverted join of signatures against all pairs of whole sets."""

import random

import numpy as np
import pytest

from quillon.llm import coordinates, queries
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, cls string, sig int, token string, n int, k int, u string"


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("lorem ipsum dolor sit amet Élan ß x y z one two three".split()) + str(r.randint(0, 40))
    text = lambda n: [word() for _ in range(n)]
    docs = [None, "", " \n\t", "one", "ONE", "one two", "One  two\n", "a b c d e", "a b c d e f", "a b c d", "a b c d e f g h i j", "a b c d e f g h i k"]
    for n in (9, 12, 30, 80, 300):
        base = text(n)
        for _ in range(12):  # chains of changes: neighbours are alike, ends aren't
            docs += [" ".join(base), " ".join(base).upper()]
            base = list(base)
            for _ in range(max(1, n // 25)):
                base[r.randrange(n)] = word()
    edge = text(100)  # about the threshold on either side
    for i in range(1, 16):
        other = list(edge)
        for j in r.sample(range(100), i):
            other[j] = word()
        docs.append(" ".join(other))
    common = text(40)
    docs += [" ".join(text(60) + common) for _ in range(20)] + [" ".join(text(3000))] * 2
    ids = [None if i % 41 == 7 else i // 2 if i % 29 == 3 else i for i in range(len(docs))]
    return list(zip(ids, docs, strict=True))


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def expected(docs):
    return sorted(((d, *x) for (d, _), x in zip(docs, brute.jaccard_rows(docs), strict=True)), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    docs = corpus(seed)
    docs += docs[30:40]
    df = spark.createDataFrame([(*x, "c", 1, "t", 2, 3, "u") for x in docs], SCHEMA).repartition(3)
    assert found(coordinates.near_copies(df)) == expected(docs)


def test_lists_without_hubs(spark, monkeypatch):
    """Everything is left to whole lists, and lists are cut into blocks."""
    monkeypatch.setattr(coordinates, "BLOCK", 3)
    monkeypatch.setattr(coordinates, "BUCKET", 4000)
    monkeypatch.setattr(coordinates, "GROUP", 2000)
    monkeypatch.setattr(coordinates, "agreeing", lambda pairs, classes: pairs.where("false"))
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(coordinates.near_copies(df)) == expected(docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert coordinates.near_copies(df).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert found(coordinates.near_copies(nothing)) == [(1, 0, 1), (2, 0, 2)]


def test_signatures_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(0)
    agree = []
    for _ in range(200):
        x = r.integers(0, 1 << 64, 1000, np.uint64)
        a, b = np.unique(x[:900]), np.unique(x[100:])
        s = coordinates.signatures([a, b])
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.01


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op11_minhash(spark, data)
    assert found(rows) == expected(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())
