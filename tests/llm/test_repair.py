"""Repair of conversations against a plain best-first search over all edit sequences."""

import random

from quillon.llm import queries, repair
from tests.llm import brute

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, kind string, mark string, fault int, copies int"


def conversations():
    r = random.Random(5)
    rows = []
    for c in [None, *range(60)]:
        n = r.choice([0, 1, 2, 3, 5, 8, 8, 20])
        role = ["system"] * (r.random() < 0.3)
        for t in range(n):
            role.append("user" if t % 2 == 0 else "assistant")
        for t, x in enumerate(role):
            if r.random() < 0.2:
                x = r.choice(["user", "assistant", "system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No, really!", "cut off", "Why? ", " \n", "", None, "Ünï. \x0b", f"Line {t}.\nand {c}?"])
            rows.append((c, None if r.random() < 0.05 else t * r.choice([1, 1, 1, 2]), x, text))
    long = [(99, t, "user" if t % 2 == 0 else "assistant", r.choice(["A.", "b", f"{t}!", "x" * 5000 + "?"])) for t in range(300)]
    return rows + rows[10:20] + [(7, 3, "user", "Tie."), (7, 3, "user", "Other."), (7, 3, "assistant", "Tie.")] + long


def result(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.select("conv_id", *columns).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_repairs(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "a", "b", "c", 1, 2) for x in rows], SCHEMA).repartition(3)
    assert result(repair.repair_conversations(df)) == brute.repaired(rows)
    assert repair.repair_conversations(df.where("false")).count() == 0


def test_dropped_conversations(spark):
    gone = [(c, t, "user", "x.") for c in range(200) for t in range(1)]
    found = result(repair.repair_conversations(spark.createDataFrame(gone, "conv_id bigint, turn bigint, role string, text string")))
    assert found == brute.repaired(gone)
    assert any(x[6] == "" and x[5] == 0 for x in found.values())


def test_parts_give_the_whole_search():
    r = random.Random(3)
    for _ in range(200):
        rows = [(r.choice([0, 0, 0, 1, 2, 3]), r.choice("uuaast")) for _ in range(r.randint(1, 12))]
        whole = repair.search(rows, repair.START, repair.END)
        found = repair.Conversation(1)
        for fault, initial in rows:
            found.faults.append(fault)
            found.initials.append(initial)
        before, repair.PART = repair.PART, 3
        try:
            found.repair()
        finally:
            repair.PART = before
        assert found.audit.rstrip("I") == whole.rstrip("I")


def test_query(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert result(queries.op13_conversation_repair(spark, data)) == brute.repaired([tuple(r) for r in table.collect()])
