"""The whole pipeline against its stages' plain versions."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from quillon.llm import bpe, decontaminate, quality, queries  # noqa: E402
from tests.llm import brute  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")


def test_run(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    field = quality.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    texts = [(i, t) for i, t in sorted(docs.items()) if quality.judge([(t or "").encode()], field, 0.5)["kept"][0]]
    seen, count = set(), {}
    for _, t in texts:
        for k in {brute.line_key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    left = []
    for i, t in texts:
        kept = []
        for x in t.split("\n"):
            k = brute.line_key(x)
            if k and count[k] >= 10 and k in seen:
                continue
            seen.add(k)
            kept.append(x)
        if kept:
            left.append((i, "\n".join(kept)))
    roots = brute.jaccard_components(left)
    left = [(i, t) for (i, t), c in zip(left, roots, strict=True) if i == c]
    clean = [(i, t) for i, t in left if not any(w and brute.held(decontaminate.words_of(t), w) for w in items)]
    model = bpe.load(queries.tokenizer())
    want = {(i, *p) for i, t in clean for p in brute.pieces(model.library.encode(t, add_special_tokens=False).ids)}
    got = pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert brute.gapless([(r.sequence_id, r.offset, r.length) for r in got])


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), data).columns == docs.columns


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, component_id int, at string, row string"


def odd(spark):
    """Null ids and texts, repeated rows, ids with two texts, empty and long texts, and columns that stages use themselves."""
    good = lambda k: " ".join(f"word{k}x{i} and{i}" for i in range(30)) + f".\nline {k} of many"
    given = [(None, good(1)), (None, None), (1, good(2)), (1, good(2)), (2, good(3)), (2, good(4)), (3, ""), (4, None), (5, good(5) + " tail" * 3), (6, good(6) * 400)]
    given += [(10 + k, f"{good(20 + k)}\nthe same line in all of them") for k in range(12)]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, "y", "z") for i, t in given], ODD).repartition(3)


def test_stages_on_odd_rows(spark, data):
    docs = odd(spark)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == odd(spark).columns
        docs = docs.cache()
    left = docs.collect()
    assert {10 + k for k in range(12)} <= {r.doc_id for r in left} and not {3, 4} & {r.doc_id for r in left}
    lines = [x for r in left if r.doc_id and r.doc_id >= 10 for x in r.text.split("\n")]
    assert lines.count("the same line in all of them") == 1
    packed = pipeline.best_fit_packing(spark, docs, data).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in packed}) >= len({(r.doc_id, r.text) for r in left}) - 1
    assert brute.gapless([(r.sequence_id, r.offset, r.length) for r in packed])


def test_stages_on_an_empty_table(spark, data):
    docs = odd(spark).where("false")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0, name
