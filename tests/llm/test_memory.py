"""What Python workers keep between tasks."""

import os
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, simhash
from quillon.llm.common import map_batches, map_groups
from quillon.llm.queries import tokenizer


def anonymous(pid: int) -> float:
    return int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="/proc")
def test_workers_give_freed_memory_back(spark):
    def holes(*_) -> pa.Table:
        """The worker's number; 128 MB are freed between blocks that stay."""
        many = [np.ones(4000) for _ in range(4000)]
        sys.kept = many[::64]
        return pa.table({"pid": [os.getpid()]})

    rows = spark.range(0, 1, 1, 1)
    for found in (map_batches(rows, holes, "pid bigint"), map_groups(rows, "id", holes, "pid bigint")):
        assert anonymous(found.collect()[0]["pid"]) < 140


def test_links_start_no_other_workers(spark):
    plan = simhash.links(spark.range(5).select(F.col("id").alias("fp")))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_ids_need_no_tables_of_prefixes():
    model = bpe.Bpe(tokenizer())
    assert len(model.ids("two words")) and not {"hashed", "_pair_key", "_pair_fits"} & set(vars(model))
