"""No join of op11 or the pipeline sends a side to the driver by Spark's own guess of its size."""

import pytest

from quillon.llm import components, coordinates, lines, packing, simhash

pipeline = pytest.importorskip("corpus_pipeline")
BOUNDS = [(coordinates, "FEW"), (components, "FEW_EDGES"), (simhash, "FEW_PAIRS"), (lines, "FEW_LINES"), (lines, "FEW_MAPS"), (pipeline, "FEW_IDS")]


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is stored, as Spark makes them before it knows any size, where no table counts as small."""
    seen = []

    def watched(store):
        def run(df, name="table"):
            seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return store(df, name)

        return run

    for module, bound in BOUNDS:
        monkeypatch.setattr(module, bound, -1)
    for module in (coordinates, components, simhash, lines, packing, pipeline):
        monkeypatch.setattr(module, "stored", watched(module.stored))
    return seen


def broadcasts(plans):
    return [name for name, plan in plans if "BroadcastExchange" in plan]


def test_op11(spark, data, plans):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = coordinates.near_copies(docs)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 10 and not broadcasts(plans)


def test_pipeline(spark, data, plans):
    found = pipeline.run(spark, data)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 20 and not broadcasts(plans)


def test_small_sides_are_broadcast(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    classes = coordinates.classes_of(coordinates.sketches(docs, "doc_id", "text", 2))
    plan = coordinates.best_hubs(coordinates.postings(classes), classes, 80)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
