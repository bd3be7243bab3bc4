"""Best-fit packing of token sequences, improved by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import documents, map_batches, shuffled, stored

#: Items that are packed together; islands that work on each such block, their
#: solutions, the epochs between which elites migrate, and generations an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 16384, 2, 4, 3, 16
#: Mutations of a child; of how many of the emptiest bins and of how many others each; every
#: CROSS-th child is a mutated elite, the others come from a crossover.
MUTATIONS, WORST, OTHERS, CROSS = 6, 12, 28, 2

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Token pieces of whole texts (PIECES, and ids as little-endian uint32 if asked for).

    A document is its ids and end_id. One of over `capacity` tokens is cut into pieces
    of just that many, of which the first may be shorter. A null text is empty.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def batch(b: pa.RecordBatch) -> pa.Table:
        model = bpe.load(tokenizer)
        out: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = model.ids(text) + tail
            n = len(raw) // 4
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                own = raw[4 * i : 4 * j]
                out.append((doc, k, i, j - i, zlib.crc32(own), *([own] if with_ids else [])))
        cols = list(zip(*out, strict=True)) or [[]] * (5 + with_ids)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=False)})

    return map_batches(documents(docs, id_col, text_col), batch, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Bins of one capacity; best_fit finds the fullest one that still takes an item.

    Bins lie in stacks by what they have left; `open` has a bit for each stack that isn't empty.
    """

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, 0
        self.left: list[int] = []
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int) -> int:
        self.left.append(left)
        self._push(len(self.left) - 1, left)
        return len(self.left) - 1

    def _push(self, k: int, left: int) -> None:
        self.stacks[left].append(k)
        self.open |= 1 << left

    def best_fit(self, size: int) -> int:
        rest = self.open >> size
        if not rest:
            return self.add(self.capacity - size)
        room = size + (rest & -rest).bit_length() - 1
        stack = self.stacks[room]
        k = stack.pop()
        if not stack:
            self.open &= ~(1 << room)
        self.left[k] = room - size
        self._push(k, room - size)
        return k


def _pack(sizes: list[int], order, capacity: int) -> np.ndarray:
    bins, at = Bins(capacity), np.empty(len(sizes), np.int32)
    for i in order:
        at[i] = bins.best_fit(sizes[i])
    return at


def _fitness(at: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their fill."""
    fill = np.bincount(at, sizes)
    return -len(fill), float(np.square(fill / capacity).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of a go whole into b; b's bins that hold one of their items are
    dissolved, and the documents that lose their place are best-fitted, largest first."""
    fill_a, n_b = np.bincount(a, sizes), int(b.max()) + 1
    well = fill_a >= np.quantile(fill_a, 0.25)
    taken = (well & (rng.random(len(fill_a)) < rng.uniform(0.3, 0.9)))[a]
    hit = np.zeros(n_b, bool)
    hit[b[taken]] = True
    stay = ~taken & ~hit[b]
    child = np.full(len(a), -1, np.int64)
    child[taken], child[stay] = a[taken], b[stay] + len(fill_a)
    placed = child >= 0
    _, child[placed] = np.unique(child[placed], return_inverse=True)
    bins = Bins(capacity)
    for left in (capacity - np.bincount(child[placed], sizes[placed])).astype(int).tolist() if placed.any() else []:
        bins.add(left)
    for i in np.flatnonzero(~placed):  # sizes fall with the index
        child[i] = bins.best_fit(int(sizes[i]))
    return child.astype(np.int32)


def _fullest(sizes: list[int], room: int) -> list[int]:
    """Places of items whose sizes add up to the most that room holds, by the sums that can be reached."""
    reached, before = 1, []
    whole = (1 << (room + 1)) - 1
    for x in sizes:
        before.append(reached)
        reached |= (reached << x) & whole
    left, taken = reached.bit_length() - 1, []
    for k in range(len(sizes) - 1, -1, -1):
        if not before[k] >> left & 1:
            taken.append(k)
            left -= sizes[k]
    return taken


def mutate(at: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, worst: int, others: int) -> np.ndarray:
    """The emptiest bins and some others are dissolved and filled again, each around the
    largest document left, as full as the rest allows. A solution that it doesn't better stays."""
    fill = np.bincount(at, sizes)
    n = len(fill)
    gone = np.union1d(np.argsort(fill, kind="stable")[:worst], rng.choice(n, min(n, others), replace=False))
    pool = np.flatnonzero(np.isin(at, gone))
    rng.shuffle(pool)
    items = pool[np.argsort(-sizes[pool], kind="stable")].tolist()
    bins: list[list[int]] = []
    while items and len(bins) <= len(gone):
        head, rest = items[0], items[1:]
        small = rest[::-1] if len(bins) % 2 else rest
        taken = {small[k] for k in _fullest([int(sizes[i]) for i in small], capacity - int(sizes[head]))}
        bins.append([head, *taken])
        items = [i for i in rest if i not in taken]
    new = np.array([sizes[b].sum() for b in bins], float)
    if items or (-len(bins), np.square(new).sum()) <= (-len(gone), np.square(fill[gone]).sum()):
        return at
    child = at.copy()
    names = np.concatenate((gone, [n]))
    for k, b in zip(names, bins, strict=False):
        child[b] = k
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, seed: int, generations: int, size: int) -> list[np.ndarray]:
    """The island's next population, best first. It stops at the lower bound of bins."""
    rng, bound = np.random.default_rng(seed), -(-int(sizes.sum()) // capacity)
    plain = sizes.tolist()
    people = list(population) or [_pack(plain, range(len(plain)), capacity)]
    scored = [(_fitness(p, sizes, capacity), p) for p in people]
    best = max(s for s, _ in scored)
    while len(scored) < size and -best[0] > bound:
        p = _pack(plain, np.argsort(-sizes * rng.uniform(0.9, 1.0, len(sizes)), kind="stable"), capacity)
        scored.append((_fitness(p, sizes, capacity), p))
    for g in range(generations):
        scored.sort(key=lambda x: x[0], reverse=True)
        scored = scored[:size]
        if -scored[0][0][0] <= bound:
            break
        if g % CROSS and len(scored) > 1:
            i, j = rng.choice(len(scored), 2, replace=False)
            child = crossover(scored[i][1], scored[j][1], sizes, capacity, rng)
        else:
            child = scored[0][1]
        for _ in range(MUTATIONS):
            child = mutate(child, sizes, capacity, rng, WORST, OTHERS)
        score = _fitness(child, sizes, capacity)
        if all(score != s for s, _ in scored):
            scored.append((score, child))
    scored.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in scored[:size]]


ISLAND = "block bigint, island int, sizes array<int>, people array<binary>, bins bigint, fill double, elite binary"


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.Table:
        out = []
        for block, island, sizes, people in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s = np.array(sizes, np.int64)
            next_ = evolve([np.frombuffer(p, "<i4") for p in people], s, capacity, (block % 2**31) * 101 + island * 11 + epoch, GENERATIONS, POPULATION)
            score = _fitness(next_[0], s, capacity)
            raw = [p.astype("<i4").tobytes() for p in next_]
            out.append((block, island, sizes, raw, -score[0], score[1], raw[0]))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int64(), pa.float64(), pa.binary()]
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(ISLAND.split(", "), cols, kinds, strict=True)})

    return map_batches(islands.select("block", "island", "sizes", "people"), batch, ISLAND)


def best_bins(blocks: DataFrame, capacity: int) -> DataFrame:
    """(block, bins array<int>): the bin of each item of blocks (block, sizes falling).

    Every block is a population on ISLANDS islands. After each epoch an island's elite
    moves on to the next island, by a join of rows; the best solution of all is kept.
    """
    parts = max(1, min(blocks.count() * ISLANDS, blocks.sparkSession.sparkContext.defaultParallelism * 4))
    islands = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("people", F.array().cast("array<binary>"))
    islands = stored(_epoch(islands.repartition(parts, "block", "island"), capacity, 0), "islands")
    for k in range(1, EPOCHS):
        elites = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        met = islands.join(shuffled(elites), ["block", "island"]).withColumn("people", F.array_append("people", F.col("guest")))
        islands = stored(_epoch(met, capacity, k), "islands")
    best = islands.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))).alias("elite"))

    def batch(b: pa.RecordBatch) -> pa.Table:
        lists = [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
        return pa.table({"block": b.column(0), "bins": pa.array(lists, pa.list_(pa.int32()))})

    return map_batches(best, batch, "block bigint, bins array<int>")


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (columns doc_id, piece, start, length and any others) with sequence_id and offset added.

    Pieces of full length are sequences of their own. The others are dealt into blocks
    of about BLOCK by a hash, each packed by best_bins. Sequences have no gaps. Ties in
    length go by doc_id (null first), piece and checksum. Rows that are repeated, texts
    of null and documents without an id are pieces like others; an empty table gives an
    empty one.
    """
    cut = stored(cut, "pieces")
    full = cut.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = cut.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // BLOCK))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    ranked = rest.withColumn("block", deal).withColumn(
        "rank", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32"))
    )
    ranked = stored(ranked, "ranked")
    sizes = ranked.groupBy("block").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("sizes"))
    at = ranked.join(shuffled(best_bins(sizes, capacity)), "block").withColumn("bin", F.element_at("bins", F.col("rank"))).drop("bins")
    before = Window.partitionBy("block", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))
    at = at.withColumn("sequence_id", F.shiftleft("block", 32).bitwiseOR(F.col("bin").cast("bigint")))
    return full.unionByName(at.select(*full.columns))
