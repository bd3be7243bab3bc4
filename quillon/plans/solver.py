"""L1-regularised logistic regression on a small dense design: many problems over the same rows, one job an iteration.

A problem is a choice of columns, a penalty, and weights of the rows (a row that it
leaves out has weight 0). Rows and sums over them stay on Spark; coefficients, gradients
and, for coordinate descent, second derivatives of the chosen columns are the driver's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import ship

#: Bytes of a block of rows.
BLOCK = 1 << 20
#: Iterations of a run that names no bound; the change at which it ends, and, for coordinate
#: descent, the optimality gap (in units of the loss's own curvature).
MOST, EPSILON, GAP = 1000, 1e-11, 1e-9


@dataclass
class Problem:
    """columns of the design, the penalty, where to start (bias first), the columns' transform, and which of the weights."""

    columns: list[int]
    lambda_: float
    start: np.ndarray
    offset: np.ndarray
    scale: np.ndarray
    weight: int = 0

    def raw(self) -> np.ndarray:
        """Turns coefficients of the transformed columns into those of the columns as they are."""
        n = len(self.columns) + 1
        out = np.zeros((n, n))
        out[0, 0] = 1.0
        out[0, 1:] = -self.offset * self.scale
        out[np.arange(1, n), np.arange(1, n)] = self.scale
        return out


@dataclass
class Step:
    """What is told of an iteration: seconds since the run began, its number, relative change, nonzero coefficients (the bias counts), penalty, objective."""

    seconds: float
    iteration: int
    change: float
    nonzero: int
    lambda_: float
    value: float


class Design:
    """rows(label, w array<double>, items array<struct<i, v>>) in blocks of arrays; items name columns 0 to size - 1."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        self.size = size
        per = max(1, BLOCK // (8 * (size + 1)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, per):
                    part = b.slice(lo, per)
                    x = dense(part.column("items"), size)
                    w = part.column("w").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    y = part.column("label").to_numpy(zero_copy_only=False).astype(float)
                    yield pa.record_batch([pa.array([len(x)]), *(pa.array([v.tobytes()], pa.binary()) for v in (y, w, x))], names=["n", "y", "w", "x"])

        ship(rows.sparkSession)
        self.blocks = rows.select("label", "w", "items").mapInArrow(pack, "n bigint, y binary, w binary, x binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.jobs = 0

    def close(self) -> None:
        self.blocks.unpersist()

    def evaluate(self, points: list[tuple[Problem, np.ndarray]], second: bool) -> list[tuple[float, np.ndarray, np.ndarray | None]]:
        """Loss, gradient and (second) the matrix of second derivatives of each problem at its coefficients, all by one job."""
        size, many = self.size, len(points)
        raw = np.zeros((size + 1, many))
        for k, (p, theta) in enumerate(points):
            raw[[0, *(c + 1 for c in p.columns)], k] = p.raw() @ theta
        own = [p.weight for p, _ in points]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for n, y, w, x in zip(*(b.column(c) for c in ("n", "y", "w", "x")), strict=True):
                    one = _sums(n.as_py(), *(np.frombuffer(v.as_buffer(), float) for v in (y, w, x)), raw, own, second)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(many, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "v"])

        self.jobs += 1
        parts = self.blocks.mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("at", "v"))
        width = 1 + (size + 1) * (size + 2 if second else 1)
        out = np.zeros((many, width))
        for r in parts.groupBy("k", "at").agg(F.sum("v").alias("v")).collect():
            out[r.k, r.at] = r.v
        found = []
        for k, (p, _) in enumerate(points):
            at, to = [0, *(c + 1 for c in p.columns)], p.raw()
            h = out[k, size + 2 :].reshape(size + 1, size + 1)[np.ix_(at, at)] if second else None
            found.append((float(out[k, 0]), to.T @ out[k, 1 : size + 2][at], to.T @ h @ to if second else None))
        return found


def dense(items: pa.ListArray, size: int) -> np.ndarray:
    """A row of `size` numbers for each list of (i, v)."""
    ends = items.offsets.to_numpy()
    x = np.zeros((len(items), size))
    flat = items.flatten()
    x[np.repeat(np.arange(len(items)), np.diff(ends)), flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
    return x


def _sums(n: int, y: np.ndarray, w: np.ndarray, x: np.ndarray, raw: np.ndarray, own: list[int], second: bool) -> np.ndarray:
    """Of one block, a row a problem: loss, gradient, second derivatives."""
    x = np.column_stack([np.ones(n), x.reshape(n, -1)])
    w = w.reshape(n, -1)[:, own]
    z = x @ raw
    low = np.log1p(np.exp(-np.abs(z)))
    p = np.exp(np.minimum(z, 0) - low)
    nll = low - np.minimum(z, 0) + (1 - y)[:, None] * z
    out = [(w * nll).sum(axis=0)[:, None], ((p - y[:, None]) * w).T @ x]
    if second:
        v = p * (1 - p) * w
        out.append(np.stack([((x * v[:, [k]]).T @ x).ravel() for k in range(len(own))]))
    return np.hstack(out)


def shrunk(theta: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return np.sign(theta) * np.maximum(np.abs(theta) - by, 0.0)


@dataclass
class Run:
    """One problem on its way: points to be evaluated, and what was accepted."""

    problem: Problem
    second = False
    theta: np.ndarray = field(init=False)
    value: float = field(default=float("inf"), init=False)
    done: bool = field(default=False, init=False)
    steps: list[Step] = field(default_factory=list, init=False)
    began: float = field(default_factory=time.monotonic, init=False)

    def __post_init__(self) -> None:
        self.theta = np.array(self.problem.start, float)

    def objective(self, loss: float, theta: np.ndarray) -> float:
        return loss + self.problem.lambda_ * float(np.abs(theta[1:]).sum())

    def accept(self, theta: np.ndarray, value: float) -> float:
        """Take the point; its change relative to its largest coefficient."""
        change = np.abs(theta - self.theta).max() / (np.abs(theta).max() or 1.0)
        self.theta, self.value = theta, value
        self.steps.append(Step(time.monotonic() - self.began, len(self.steps), float(change), int((theta[1:] != 0).sum()) + 1, self.problem.lambda_, value))
        return change


class Coordinate(Run):
    """Newton steps with the penalty as it is: the loss's quadratic model at the current point is minimised by coordinate descent."""

    second = True

    def __post_init__(self) -> None:
        super().__post_init__()
        self.trial = self.theta

    def points(self) -> list[np.ndarray]:
        return [self.trial]

    def take(self, found: list[tuple[float, np.ndarray, np.ndarray]]) -> bool:
        """Whether the point was accepted; one that is worse is halved towards the last."""
        ((loss, g, h),) = found
        value = self.objective(loss, self.trial)
        if value > self.value + 1e-14 * abs(self.value):
            self.trial = (self.theta + self.trial) / 2
            self.done = bool(np.abs(self.trial - self.theta).max() <= 1e-15 * np.abs(self.theta).max())
            return False
        better = self.value - value
        self.accept(self.trial, value)
        size = np.sqrt(np.maximum(np.diag(h), 1e-300))
        l1 = self.problem.lambda_
        gap = np.where(self.theta != 0, np.abs(g + l1 * np.sign(self.theta)), np.maximum(np.abs(g) - l1, 0))
        gap[0] = abs(g[0])
        self.done = bool((gap / size).max() <= GAP or better <= 1e-15 * max(1.0, abs(value)))
        if not self.done:
            self.trial = self._descend(g, h)
        return True

    def _descend(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        theta, slope = self.theta.copy(), g.copy()  # slope: of the quadratic model at theta
        curve = np.maximum(np.diag(h), 1e-12 * max(np.trace(h), 1e-300))
        for _ in range(1000):
            moved = 0.0
            for j in range(len(theta)):
                to = theta[j] - slope[j] / curve[j]
                if j:
                    to = np.sign(to) * max(abs(to) - self.problem.lambda_ / curve[j], 0.0)
                by = to - theta[j]
                if by:
                    slope += h[:, j] * by
                    theta[j] = to
                    moved = max(moved, abs(by) * curve[j] ** 0.5)
            if moved <= GAP / 100:
                break
        return theta


class Proximal(Run):
    """Accelerated proximal gradient: a step against the gradient, then the soft threshold.

    step: set from the curvature at zero; a rise of the objective takes the step back,
    halves it and ends the momentum, ten falls in a row double it. A hook may set it, too.
    """

    def __post_init__(self) -> None:
        super().__post_init__()
        self.step, self.falls, self.speed = 0.0, 0, 1.0
        self.trial = self.ahead = self.theta

    def start(self, h: np.ndarray) -> None:
        """h: second derivatives at zero coefficients, the largest that there are."""
        self.step = 1.0 / max(float(np.linalg.eigvalsh(h)[-1]), 1e-300)

    def points(self) -> list[np.ndarray]:
        return [self.trial, self.ahead]

    def take(self, found: list[tuple[float, np.ndarray, None]]) -> bool:
        (loss, g, _), (_, g_ahead, _) = found
        value, first = self.objective(loss, self.trial), not self.steps
        ok = value <= self.value + 1e-15 * abs(self.value) if not first else True
        if ok:
            self.done = self.accept(self.trial, value) <= EPSILON and not first
            self.slope, self.falls = g, self.falls + 1
            if self.falls == 10:
                self.step, self.falls = self.step * 2, 0
            at, g = self.ahead, g_ahead
        else:
            self.step, self.falls, self.speed = self.step / 2, 0, 1.0
            at, g = self.theta, self.slope
        to = at - self.step * g
        to[1:] = shrunk(to[1:], self.step * self.problem.lambda_)
        if (at - to) @ (to - self.theta) > 0:  # the momentum points uphill
            self.speed = 1.0
        grown = (1 + (1 + 4 * self.speed**2) ** 0.5) / 2
        self.ahead = to + (self.speed - 1) / grown * (to - self.theta)
        self.speed, self.trial = grown, to
        return ok


METHODS = {"coordinate": Coordinate, "proximal": Proximal}
#: Called after each accepted iteration of a run, by the problem's number; true ends the run.
Hook = Callable[[int, Run], bool | None]


def minimise(design: Design, problems: list[Problem], method: str = "coordinate", epsilon: float = 0.0, epsilon_loss: float = 0.0, most: int = 0, hook: Hook | None = None) -> list[Run]:
    """Minimise each problem's weighted loss + lambda * |theta|, biases free: all of them together, a job an iteration.

    A run ends by its own rule, where its relative change is at most epsilon, where its
    objective moves by less than epsilon_loss, after `most` iterations, or by the hook.
    """
    runs = [METHODS[method](p) for p in problems]
    if method == "proximal" and runs:
        zero = design.evaluate([(p, np.zeros(len(p.columns) + 1)) for p in problems], True)
        for r, (_, _, h) in zip(runs, zero, strict=True):
            r.start(h)
    while left := [k for k, r in enumerate(runs) if not r.done]:
        points = [(k, x) for k in left for x in runs[k].points()]
        found = design.evaluate([(problems[k], x) for k, x in points], runs[0].second)
        for k in left:
            own, before = runs[k], runs[k].value
            if own.take([f for (j, _), f in zip(points, found, strict=True) if j == k]):
                last = own.steps[-1]
                own.done |= len(own.steps) > 1 and (last.change <= epsilon or abs(before - own.value) < epsilon_loss)
                own.done |= len(own.steps) > (most or MOST)
                own.done |= bool(hook and hook(k, own))
    return runs
