"""Symbolic expansion of numeric columns: unary and binary operations, level by level.

Columns to be are small expressions that tasks evaluate on arrays, so neither their
number nor their depth makes a plan larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship

_EXPS = frozenset({"exp", "expneg", "log", "logneg"})
#: Candidates that one job decides on; rows that a task evaluates at once.
TOGETHER, ROWS = 1024, 1024


@dataclass(frozen=True)
class Operation:
    """name: its own; label: how a result is called; apply: the function of arrays, NaN
    where undefined; rejects: last operations of a column that it isn't applied to;
    final: whether results may be output or only feed the next final operation."""

    name: str
    label: str
    apply: Callable[..., np.ndarray]
    arity: int = 1
    rejects: frozenset[str] = frozenset()
    final: bool = True


def _where(c: np.ndarray, ok: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.where(ok, f(np.where(ok, c, 1.0)), np.nan)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b != 0, a / np.where(b != 0, b, 1.0), np.nan)


UNARY = {
    o.name: o
    for o in (
        Operation("abs", "abs({})", np.abs, rejects=frozenset({"exp", "square", "sqrt"})),
        Operation("exp", "exp({})", np.exp, rejects=_EXPS),
        Operation("expneg", "exp(-{})", lambda c: np.exp(-c), rejects=_EXPS),
        Operation("log", "log({})", lambda c: _where(c, c > 0, np.log), rejects=_EXPS),
        Operation("logneg", "log(-{})", lambda c: _where(-c, c < 0, np.log), rejects=_EXPS),
        Operation("square", "({}^2)", lambda c: c * c),
        Operation("sqrt", "sqrt({})", lambda c: _where(c, c >= 0, np.sqrt)),
        Operation("sqrtneg", "sqrt(-{})", lambda c: _where(-c, c <= 0, np.sqrt)),
    )
}
BINARY = {
    o.name: o
    for o in (
        Operation("add", "({}+{})", lambda a, b: a + b, 2, final=False),
        Operation("sub", "({}-{})", lambda a, b: a - b, 2, final=False),
        Operation("subrev", "({1}-{0})", lambda a, b: b - a, 2, final=False),
        Operation("mul", "({}*{})", lambda a, b: a * b, 2),
        Operation("div", "({}/{})", _quotient, 2),
        Operation("divrev", "({1}/{0})", lambda a, b: _quotient(b, a), 2),
    )
}
#: What a name in a list of operations stands for; the default list is all of them.
EXPANDS_TO = {
    "abs": ["abs"], "exp": ["exp", "expneg"], "log": ["log", "logneg"], "square": ["square"], "sqrt": ["sqrt", "sqrtneg"],
    "add": ["add"], "sub": ["sub", "subrev"], "mul": ["mul"], "div": ["div", "divrev"],
}


def parse_operations(text: str = "") -> list[Operation]:
    """Operations of a comma-separated list, in its order; an empty one gives all."""
    names = [x.strip() for x in text.split(",") if x.strip()] or list(EXPANDS_TO)
    unknown = [x for x in names if x not in EXPANDS_TO]
    if unknown:
        raise ValueError(f"unknown operations: {', '.join(unknown)}")
    return [(UNARY | BINARY)[y] for x in names for y in EXPANDS_TO[x]]


@dataclass(frozen=True)
class Candidate:
    """A column to be: its name, its last operation (none: a column of the table) and what that is applied to."""

    name: str
    last: str = ""
    of: tuple["Candidate", ...] = ()

    def values(self, base: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> np.ndarray:
        """Its values out of the table's columns; known holds what was evaluated before."""
        if not self.of:
            return base[self.name]
        if self.name not in known:
            known[self.name] = (UNARY | BINARY)[self.last].apply(*(c.values(base, known) for c in self.of))
        return known[self.name]


def _arrays(columns: list[str], b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for lo in range(0, b.num_rows, ROWS):
        part = b.slice(lo, ROWS)
        yield part, {c: part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}


def valid(table: DataFrame, columns: list[str], candidates: list[Candidate], least: float = 0.0, most: float = 0.0) -> list[Candidate]:
    """The candidates that may stay, by one pass over the table for all of them.

    A column goes if a value is null, NaN or infinite, or (with most > 0) over `most` in
    size; if none is over `least` in size; or if, made of one other column, it nowhere
    differs from that by more than 1e-12.
    """
    if not candidates:
        return []

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros((3, len(candidates)), bool)
        some = False
        for b in batches:
            for _, base in _arrays(columns, b):
                known: dict[str, np.ndarray] = {}
                some = True
                with np.errstate(all="ignore"):
                    for i, c in enumerate(candidates):
                        v = c.values(base, known)
                        size = np.abs(v)
                        flags[0, i] |= not np.isfinite(v).all() or (most > 0 and bool((size > most).any()))
                        flags[1, i] |= bool((size > least).any())
                        flags[2, i] |= len(c.of) != 1 or bool((np.abs(v - c.of[0].values(base, known)) > 1e-12).any())
        if some:
            yield pa.record_batch([pa.array(np.arange(len(candidates), dtype=np.int32)), *(pa.array(f) for f in flags)], names=["i", "wrong", "large", "moved"])

    ship(table.sparkSession)
    rows = table.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(judge, "i int, wrong boolean, large boolean, moved boolean")
    told = rows.groupBy("i").agg(F.bool_or("wrong").alias("wrong"), F.bool_or("large").alias("large"), F.bool_or("moved").alias("moved"))
    ok = {r.i for r in told.where("not wrong and large and moved").collect()}
    return [c for i, c in enumerate(candidates) if i in ok]


def expand(
    table: DataFrame, columns: list[str], operations: list[Operation] | None = None, max_depth: int = 0, max_features: int = 100,
    least: float = 0.0, most: float = 0.0,
) -> DataFrame:
    """table with new columns after its own, up to max_features columns of features in all.

    Each level applies every operation to the columns of the level before (pairs of
    them for binary ones). Results of sums and differences aren't output but taken, and
    used up, by the next final operation. It ends at max_depth (0: none), at
    max_features, or when a level adds nothing. Validity is decided over all rows, a job
    for each operation, level and TOGETHER candidates, in order and only until there are
    enough; the new columns are made by one pass.
    """
    operations = parse_operations() if operations is None else operations
    made = [Candidate(c) for c in columns]
    level, depth = list(made), 0
    pending: list[Candidate] = []  # results that only feed the next final operation
    while level and len(made) < max_features and (not max_depth or depth < max_depth):
        before = {c.name for c in made}
        fresh: list[Candidate] = []
        for op in operations:
            found = (c for c in _results(op, level + pending if op.final else level) if c.name not in before)
            kept: list[Candidate] = []
            while part := list(islice(found, TOGETHER)):
                kept += valid(table, columns, part, least, most)
                if op.final and len(made) + len(kept) >= max_features:
                    break
            if not op.final:
                pending += kept
                continue
            pending = []
            for c in kept:
                if len(made) < max_features and c.name not in before:
                    made.append(c)
                    fresh.append(c)
                    before.add(c.name)
            if len(made) >= max_features:
                break
        level, depth = fresh, depth + 1
    new = made[len(columns) :]
    if not new:
        return table

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in _arrays(columns, b):
                known: dict[str, np.ndarray] = {}
                with np.errstate(all="ignore"):
                    values = [pa.array(np.asarray(c.values(base, known), float)) for c in new]
                yield pa.RecordBatch.from_arrays([*part.columns, *values], [*part.schema.names, *(c.name for c in new)])

    ship(table.sparkSession)
    return table.mapInArrow(make, StructType([*table.schema.fields, *(StructField(c.name, DoubleType()) for c in new)]))


def _results(op: Operation, columns: list[Candidate]) -> Iterator[Candidate]:
    free = [c for c in columns if c.last not in op.rejects]
    if op.arity == 1:
        yield from (Candidate(op.label.format(c.name), op.name, (c,)) for c in free)
        return
    for i, a in enumerate(free):
        for b in free[i + 1 :]:
            yield Candidate(op.label.format(a.name, b.name), op.name, (a, b))
