"""Sums over samples for pairs of sparse features, by tiles of the pair matrix: no row is a product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Features of a tile's side; bytes of tiles and of dense rows that a task holds.
SIDE, HELD, DENSE = 256, 1 << 27, 1 << 25


def _arrays(features: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(w, items): a row for each sample with its features as one array."""
    own = features.where("value <> 0").groupBy("sample_id").agg(F.collect_list(F.struct(F.col("feature_id").alias("i"), F.col("value").alias("v"))).alias("items"))
    return own.select(F.array().cast("array<double>").alias("w"), "items") if weights is None else own.join(weights, "sample_id").select("w", "items")


def _pieces(batches: Iterator[pa.RecordBatch], side: int, most: int) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Of some samples at once: their weights, and for each range of `side` features that occurs the dense rows."""
    for b in batches:
        items = b.column("items")
        sizes = np.diff(items.offsets.to_numpy())
        flat = items.flatten()
        ids, values = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        if not len(ids):
            continue
        ranges = np.unique(ids // side)
        w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        per = max(1, most // (8 * side * len(ranges)))
        row = np.repeat(np.arange(b.num_rows), sizes)
        for lo in range(0, b.num_rows, per):
            a, z = np.searchsorted(row, [lo, lo + per])
            which = np.searchsorted(ranges, ids[a:z] // side)
            x = np.zeros((len(ranges), min(per, b.num_rows - lo), side))
            x[which, row[a:z] - lo, ids[a:z] % side] = values[a:z]
            yield w[lo : lo + per], list(zip(ranges.tolist(), x, strict=True))


def _weighted(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of w * x * y for each column of w."""
    return np.stack([(x * w[:, [k]]).T @ y for k in range(w.shape[1])])


def _moments(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the products: how many aren't zero, their sum, sum of squares, and (negated, so that the least counts) largest size."""
    most = np.zeros((x.shape[1], y.shape[1]))
    for a, b in zip(np.abs(x), np.abs(y), strict=True):
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        if len(i) and len(j):
            at = np.ix_(i, j)
            most[at] = np.maximum(most[at], np.outer(a[i], b[j]))
    return np.stack([(x != 0).astype(float).T @ (y != 0), x.T @ y, (x * x).T @ (y * y), most])


def _tiles(features: DataFrame, weights: DataFrame | None, part, maxima: int = 0) -> DataFrame:
    """(a, b, sums array<double>), a < b, of the pairs for which some sum isn't zero.

    Each task multiplies its samples' arrays and adds up per tile; a tile goes through the
    shuffle once a task, or whenever a task's tiles exceed HELD bytes. Tiles of one place
    are merged as they stream by. The last `maxima` of a part's matrices are maxima, not sums.
    """

    side, most, wide = SIDE, HELD, DENSE  # what tasks see is what the driver has

    def merge(total: np.ndarray | None, one: np.ndarray) -> np.ndarray:
        if total is None:
            return one
        sums = len(one) - maxima
        total[:sums] += one[:sums]
        np.maximum(total[sums:], one[sums:], out=total[sums:])
        return total

    def flush(tiles: dict) -> Iterator[pa.RecordBatch]:
        for (i, j), m in tiles.items():
            yield pa.record_batch([pa.array([i]), pa.array([j]), pa.array([m.tobytes()], pa.binary())], names=["i", "j", "m"])
        tiles.clear()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict = {}
        held = 0
        for w, ranges in _pieces(batches, side, wide):
            for p, (i, x) in enumerate(ranges):
                for j, y in ranges[p:]:
                    one = part(w, x, y)
                    held += one.nbytes if (i, j) not in tiles else 0
                    tiles[i, j] = merge(tiles.get((i, j)), one)
                    if held > most:
                        yield from flush(tiles)
                        held = 0
        yield from flush(tiles)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = None, None
        for b in batches:
            at = at or (b.column("i")[0].as_py(), b.column("j")[0].as_py())
            for raw in b.column("m"):
                total = merge(total, np.frombuffer(raw.as_buffer(), float).reshape(-1, side, side).copy())
        there = (total != 0).any(axis=0) & ((at[0] != at[1]) | np.triu(np.ones((side, side), bool), 1))
        x, y = np.nonzero(there)
        for lo in range(0, len(x), 1 << 14):
            own = slice(lo, lo + (1 << 14))
            sums = total[:, x[own], y[own]].T
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), pa.array(sums.ravel()))
            yield pa.record_batch([pa.array(at[0] * side + x[own]), pa.array(at[1] * side + y[own]), lists], names=["a", "b", "sums"])

    ship(features.sparkSession)
    tiles = _arrays(features, weights).mapInArrow(multiply, "i bigint, j bigint, m binary")
    return tiles.groupBy("i", "j").applyInArrow(together, "a bigint, b bigint, sums array<double>")


def pair_sums(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, sums) of features(sample_id, feature_id, value): for each of weights(sample_id, w array<double>) the sum of w * x_a * x_b, a < b.

    A sample has a feature once. A pair that no sample has, or whose sums are all zero, has no row.
    """
    return _tiles(features, weights, _weighted)


def pair_gradient(features: DataFrame, residuals: DataFrame) -> DataFrame:
    """(a, b, gradient) of the loss by all products, residuals(sample_id, r)."""
    return pair_sums(features, residuals.select("sample_id", F.array("r").alias("w"))).select("a", "b", F.col("sums")[0].alias("gradient"))


def pair_statistics(features: DataFrame, n: int) -> DataFrame:
    """stats.statistics of all products over n samples: (a, b, nonzero, mean, sd, max_abs, total)."""
    found = _tiles(features, None, _moments, 1)
    s = lambda i: F.col("sums")[i]
    mean = s(1) / n
    spread = F.greatest(s(2) - F.lit(n) * mean * mean, F.lit(0.0))
    return found.select("a", "b", s(0).cast("bigint").alias("nonzero"), mean.alias("mean"), F.sqrt(spread / max(n - 1, 1)).alias("sd"), s(3).alias("max_abs"), s(1).alias("total"))


def tiles_of(features: int) -> int:
    """How many tiles the pairs of so many features have."""
    sides = math.ceil(features / SIDE)
    return sides * (sides + 1) // 2
