"""Whitening of embeddings: principal components by Jacobi-Davidson with distributed products."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, stored

log = logging.getLogger(__name__)

#: How an entry becomes a whole number: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Bytes of a block of vectors.
BLOCK = 1 << 19
#: Inner MINRES steps at most, and by how much they lower a correction equation's residual.
INNER, LESS = 12, 0.1
#: Outer rounds at most; a search space of so many times the components starts anew.
ROUNDS, SPACE = 200, 4
SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
Product = Callable[[np.ndarray], np.ndarray]


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector is whole and finite."""
    own = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return own.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """(ids array<bigint>, x binary): vectors of length d in blocks of 64-bit whole numbers, row by row."""
    size = max(1, BLOCK // (8 * d))

    def batch(b: pa.RecordBatch) -> pa.Table:
        ids, x = b.column(0), b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, d)
        starts = range(0, len(x), size)
        return pa.table({
            "ids": pa.array([ids.slice(i, size).to_pylist() for i in starts], pa.list_(pa.int64())),
            "x": pa.array([x[i : i + size].tobytes() for i in starts], pa.binary()),
        })

    return map_batches(rows.where(F.size("x") == d), batch, "ids array<bigint>, x binary", whole=True)


def gathered(data: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of part(x), x an array of rows of length d; parts have `width` columns.

    Each task adds its own blocks up and hands over one small matrix; these meet by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("x"):
                one = part(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d))
                total = one if total is None else total + one
        if total is not None:
            values = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64() if kind == "double" else pa.int64()))
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), values], names=["pos", "v"])

    ship(data.sparkSession)
    rows = data.select("x").mapInArrow(run, f"pos int, v array<{kind}>")
    sums = rows.groupBy("pos").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v")).collect()
    return np.array([r.v for r in sorted(sums, key=lambda r: r.pos)])


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x minus the mean, rounded once: n * x - S is exact."""
    return (n * x - total) / n


def minres(product: Product, theta: np.ndarray, away: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray) -> np.ndarray:
    """Approximate t of away((V - theta) t) = rhs, t in away's range, for a column each; all columns share each product.

    The columns' Lanczos recurrences are MINRES's own; a column that is done stands still.
    """
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    v, old = away(rhs), np.zeros_like(rhs)
    first = beta = np.linalg.norm(v, axis=0)
    v, eta = over(v, np.broadcast_to(beta, v.shape)), beta.copy()
    one, zero = np.ones_like(beta), np.zeros_like(beta)
    c, c_old, s, s_old = one, one, zero, zero
    w, w_old, t = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    beta = zero
    for _ in range(INNER):
        if (np.abs(eta) <= LESS * first).all():
            break
        moved = away(product(v) - v * theta)
        alpha = (v * moved).sum(axis=0)
        moved = away(moved - v * alpha - old * beta)
        after = np.linalg.norm(moved, axis=0)
        delta, lower, lowest = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho = np.hypot(delta, after)
        c_old, c, s_old, s = c, over(delta, rho), s, over(after, rho)
        w_old, w = w, over(v - w_old * lowest - w * lower, np.broadcast_to(rho, v.shape))
        t += w * (c * eta)
        eta = -s * eta
        old, v, beta = v, over(moved, np.broadcast_to(after, v.shape)), after
    return t


def orthogonal(t: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """A basis of what t adds to the spaces' orthonormal columns."""
    for _ in range(2):
        for q in spaces:
            t = t - q @ (q.T @ t)
        size = np.linalg.norm(t, axis=0)
        t = t[:, size > 1e-300] / size[size > 1e-300]
        if not t.shape[1]:
            return t
        u, sizes, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, sizes > 1e-10 * sizes[0]]
    return t


def components(product: Product, d: int, k: int, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric operator known by its products.

    Jacobi-Davidson: Rayleigh-Ritz in the search space, leading pairs whose residual is
    at most precision * (largest eigenvalue) are locked, and the others' corrections,
    from equations projected away from all wanted vectors, widen the space. A space that
    spans everything is exact.
    """
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = np.linalg.qr(np.random.default_rng(12).standard_normal((d, min(d, k + 2))))[0]
    image = product(space)
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, image = space @ y, image @ y
        want = min(k - len(values), space.shape[1])
        residual = image[:, :want] - space[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        whole = locked.shape[1] + space.shape[1] == d
        ok = size <= precision * max(values[0] if len(values) else theta[0], 0.0)
        done = want if whole else want if ok.all() else int(np.argmin(ok))
        log.info("%d components known, largest residual of the others %e", len(values) + done, size.max(initial=0.0))
        locked, values = np.hstack([locked, space[:, :done]]), np.concatenate([values, theta[:done]])
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        if len(values) == k or whole:
            break
        near = np.hstack([locked, space[:, : k - len(values)]])
        away = lambda t, q=near: t - q @ (q.T @ t)
        grown = orthogonal(minres(product, theta[: residual.shape[1]], away, -residual), locked, space)
        if not grown.shape[1]:  # the corrections lie in the space: go on from another direction
            grown = orthogonal(np.random.default_rng(len(values)).standard_normal((d, 1)), locked, space)
        if space.shape[1] + grown.shape[1] > SPACE * k:
            space, image = space[:, : 2 * k], image[:, : 2 * k]
        space, image = np.hstack([space, grown]), np.hstack([image, product(grown)])
    else:
        raise RuntimeError(f"residuals did not reach {precision} in {ROUNDS} rounds")
    # one more Rayleigh-Ritz among the locked vectors, on fresh products
    locked = np.linalg.qr(locked)[0]
    small = locked.T @ product(locked)
    theta, y = np.linalg.eigh((small + small.T) / 2)
    return theta[::-1], (locked @ y)[:, ::-1]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component, up to `most`.

    Rows whose vector is null, empty, or has null or non-finite entries go; so do vectors
    of another length than most have (of lengths equally frequent the longer stays).
    Components without variance, to double precision, can't be whitened and are left out:
    a single vector, or equal ones only, give no rows, and so does an empty table.
    Repeated rows and null ids give rows of their own. A deviation that exceeds 64 bits
    stops the query. Only sums of the size of (length x components) reach the driver.
    """
    spark = df.sparkSession
    rows = stored(vectors(df, id_col, vector_col), "vectors")
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], SCHEMA)
    d, n = length.d, length.n
    data = stored(blocks(rows, d), "blocks")
    total = gathered(data, d, 1, lambda x: x.sum(axis=0, dtype=np.int64)[:, None], "bigint")[:, 0]
    trace = float(gathered(data, d, 1, lambda x: (centred(x, n, total) ** 2).sum(axis=0)[:, None]).sum()) / n
    if trace == 0:
        return spark.createDataFrame([], SCHEMA)

    def product(b: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, total)
            return y.T @ (y @ b)

        return gathered(data, d, b.shape[1], part) / n

    eps = float(np.finfo(float).eps)
    values, u = components(product, d, min(most, d), eps * max(d, 64))
    there = values > d * eps * values[0]
    values, u = values[there], u[:, there]
    k = len(values)
    map_ = u / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, total) @ map_
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    sums = gathered(data, d, k + 1, moments) / n
    error = float(np.abs(sums[:, :k] - np.outer(sums[:, k], sums[:, k]) - np.eye(k)).max())
    explained = values / trace

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, raw in zip(b.column("ids"), b.column("x"), strict=True):
            x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d)
            away = n * x - total
            if float((away.astype(float) ** 2).sum(axis=1).max()) >= 2.0**63:
                raise OverflowError("a deviation exceeds 64 bits")
            m = len(x)
            own = np.repeat(np.arange(m, dtype=np.int64), k)
            yield pa.record_batch([
                ids.values.take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array((away * away).sum(axis=1)[own]), pa.array((away / n @ map_).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batch(b)

    return data.mapInArrow(run, SCHEMA)
