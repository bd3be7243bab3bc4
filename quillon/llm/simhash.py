"""SimHash fingerprints and their self-join in binary tries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coordinates
from .common import beside, documents, map_batches, map_groups, shuffled, stored, utf8
from .components import components

#: A trie node with at most so many fingerprints is joined inside one task.
NODE = 1 << 14
#: Bits by which a level of the distributed traversal goes down.
STEP = 4
#: Bound of the table of node pairs for a broadcast.
FEW_PAIRS = 1_000_000


def bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the lower-cased text's shingles in order; fewer words are one shingle, none are none."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + size]), 42) for i in range(n)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text's shingles, repeats included."""
    return bits(hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of whole texts; null texts are empty and get 0."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, shingle) for x in utf8(b.column(1))], np.uint64)
        return pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(documents(docs, id_col, text_col), batch, "doc_id bigint, fp bigint")


def close_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, used: np.ndarray | int, most: int, first: int):
    """Yield index arrays (i, j) of all a[i], b[j] within the budgets; b None: pairs i < j in a.

    a, b: sorted uint64 that share their first depth bits in each array, differing
    there in `used` bits. Node pairs of the two tries are traversed together, a bit a
    level; a pair is dropped once it differs in over `first` of the first 32 bits or
    over `most` in all. Small node pairs are compared directly.
    """
    own = b is None
    b = a if own else b
    one = lambda x: np.array([x], np.int64)
    front = [one(0), one(len(a)), one(0), one(len(b)), one(used)]
    for level in range(depth, 65):
        size = (front[1] - front[0]) * (front[3] - front[2])
        done = size <= 512 if level < 64 else size > 0
        if done.any():
            yield from _compare(a, b, [x[done] for x in front], own, most)
        front = [x[~done] for x in front]
        if not len(front[0]):
            return
        ones_a = np.concatenate(([0], np.cumsum((a >> np.uint64(63 - level)) & np.uint64(1)))).astype(np.int64)
        ones_b = ones_a if own else np.concatenate(([0], np.cumsum((b >> np.uint64(63 - level)) & np.uint64(1)))).astype(np.int64)
        al, ah, bl, bh, d = front
        am, bm = ah - (ones_a[ah] - ones_a[al]), bh - (ones_b[bh] - ones_b[bl])
        same = (al == bl) & (ah == bh) if own else np.zeros(len(al), bool)
        parts = [
            (al, am, bl, bm, d, np.ones(len(al), bool)),
            (am, ah, bm, bh, d, np.ones(len(al), bool)),
            (al, am, bm, bh, d + 1, np.ones(len(al), bool)),
            (am, ah, bl, bm, d + 1, ~same),  # a node with itself has this pair once
        ]
        limit = first if level < 32 else most
        kept = [(ok & (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= limit), x) for *x, ok in parts]
        front = [np.concatenate([x[k][m] for m, x in kept]) for k in range(5)]


def _compare(a, b, front, own, most, block=1 << 20):
    al, ah, bl, bh, _ = front
    size = (ah - al) * (bh - bl)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + block, "right")))
        n = size[at:to]
        if n[0] > block:  # nodes of equal bits: row by row
            for i in range(al[at], ah[at]):
                j = np.arange(bl[at], bh[at])
                yield from _near(a, b, np.full(len(j), i), j, own, most)
        else:
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(bh[at:to] - bl[at:to], n)
            yield from _near(a, b, np.repeat(al[at:to], n) + k // width, np.repeat(bl[at:to], n) + k % width, own, most)
        at = to


def _near(a, b, i, j, own, most):
    ok = np.bitwise_count(a[i] ^ b[j]) <= most
    if own:
        ok &= i < j
    if ok.any():
        yield i[ok], j[ok]


def _absorb(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in label, where every entry points at its class's least."""
    while True:
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            return
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _turned(fp):
    """The fingerprint with its halves exchanged."""
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def _prefix(value, depth: int):
    return F.shiftrightunsigned(value, 64 - depth) if depth else F.lit(0).cast("bigint")


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect all within `most` bits.

    fps: one column fp, distinct. Of `most` differing bits one half of the 64 has at
    most most // 2; so two tries are traversed, one with the halves exchanged, each
    with that budget for its first 32 bits. Upper levels are traversed as tables:
    pairs of nodes with their differing bits, of which those with a node of over NODE
    fingerprints go a level down. The others meet inside tasks of at most 2 * NODE
    rows, which return a spanning forest of the links found, never all pairs.
    """
    first = most // 2
    both = stored(
        fps.select(F.lit(0).alias("turn"), F.col("fp").alias("value")).unionByName(
            fps.select(F.lit(1).alias("turn"), _turned(F.col("fp")).alias("value"))
        ),
        "turned",
    )
    rows = None
    n = both.count() // 2
    # made by Spark itself: rows of the driver would start a second Python daemon with workers on each executor
    root = {"a": F.lit(0).cast("bigint"), "b": F.lit(0).cast("bigint"), "used": F.lit(0), "na": F.lit(n).cast("bigint"), "nb": F.lit(n).cast("bigint")}
    pairs = fps.sparkSession.range(0, 2, 1, 1).select(F.col("id").cast("int").alias("turn"), *(x.alias(c) for c, x in root.items()))
    depth = 0
    while True:
        big = F.greatest("na", "nb") > NODE if depth + STEP <= 64 else F.lit(False)
        leaves = pairs.where(~big)
        ends = leaves.withColumn("pair", F.struct("turn", "a", "b", "used", F.lit(depth).alias("depth")))
        ends = ends.select("turn", F.col("a").alias("node"), F.lit(0).alias("side"), "pair").unionByName(
            ends.where("a <> b").select("turn", F.col("b").alias("node"), F.lit(1).alias("side"), "pair")
        )
        if not leaves.isEmpty():
            found = both.withColumn("node", _prefix(F.col("value"), depth)).join(beside(ends, FEW_PAIRS), ["turn", "node"])
            found = found.select("pair", "side", "value")
            rows = found if rows is None else rows.unionByName(found)
        heavy = pairs.where(big)
        if heavy.isEmpty():
            break
        down = depth + STEP
        kids = (
            both.groupBy("turn", _prefix(F.col("value"), down).alias("kid")).agg(F.count("*").alias("n"))
            .withColumn("up", F.shiftrightunsigned("kid", STEP) if depth else F.lit(0).cast("bigint"))
        )
        left = kids.select("turn", F.col("up").alias("a"), F.col("kid").alias("ka"), F.col("n").alias("ma"))
        right = kids.select("turn", F.col("up").alias("b"), F.col("kid").alias("kb"), F.col("n").alias("mb"))
        grown = beside(heavy, FEW_PAIRS).join(left, ["turn", "a"]).join(shuffled(right), ["turn", "b"])
        grown = grown.where((F.col("a") != F.col("b")) | (F.col("ka") <= F.col("kb")))
        # the parents' bits are equal in number to used; only the new bits are added
        new_bits = F.bit_count(F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND((1 << STEP) - 1))
        grown = grown.select("turn", F.col("ka").alias("a"), F.col("kb").alias("b"), (F.col("used") + new_bits).cast("int").alias("used"), F.col("ma").alias("na"), F.col("mb").alias("nb"))
        pairs = stored(grown.where(F.col("used") <= (first if down <= 32 else most)), "nodes")
        depth = down

    def joined(key, group):
        pair = key[0].as_py()
        side, value = group.column("side").to_numpy(), group.column("value").to_numpy().view(np.uint64)
        a, b = np.sort(value[side == 0]), np.sort(value[side == 1])
        own = pair["a"] == pair["b"]
        every = a if own else np.concatenate((a, b))
        label = np.arange(len(every))
        for i, j in close_pairs(a, None if own else b, pair["depth"], pair["used"], most, first):
            _absorb(label, i, j if own else j + len(a))
        tied = np.flatnonzero(label != np.arange(len(every)))
        if pair["turn"]:
            every = (every << np.uint64(32)) | (every >> np.uint64(32))
        every = every.view(np.int64)
        return pa.table({"u": every[tied], "v": every[label[tied]]})

    return map_groups(rows, "pair", joined, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, shingle: int = 3
) -> DataFrame:
    """(doc_id, fp bigint, component_id): documents whose fingerprints a chain of links connects.

    Equal fingerprints count as one from the start, so exact copies never meet.
    component_id is the smallest doc_id of the component. A null id takes part as one
    document without a number: it is never the component's id unless nothing else is.
    Repeated rows give repeated rows. An empty table gives an empty table.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    root = components(links(classes.select("fp"), most))
    tied = classes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = tied.join(ids, "root").select("fp", "component_id")
    return own.join(tied, "fp").select("doc_id", "fp", "component_id")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, most: int = 3
) -> DataFrame:
    """(doc_id, component_id): documents that a chain of pairs of Jaccard similarity percent / 100 or more connects.

    Equal shingle sets are one class from the start, so copies never meet. The tries link
    classes within `most` bits first, and links whose whole sets confirm them stand. Similar
    texts may differ in more bits than any trie can search, so the inverted join of
    signatures completes the candidates among what is still apart. component_id is the smallest doc_id
    of the component; null ids and repeated rows are as in near_duplicates.
    """
    own = coordinates.sketches(docs, id_col, text_col, shingle, bits)
    own = stored(own.withColumn("key", F.coalesce("key", F.lit(bytearray()))), "sketches")  # texts without words are copies of each other
    classes = coordinates.classes_of(own)
    some = classes.where("n > 0")
    sets = coordinates.set_reader(docs, classes, id_col, text_col, shingle)
    hubs = stored(some.groupBy(F.col("more").alias("fp")).agg(F.min("cls").alias("hub")), "hubs")
    equal = some.join(shuffled(hubs), F.col("more") == F.col("fp")).where("cls <> hub").select(F.col("hub").alias("u"), F.col("cls").alias("v"))
    end = lambda x: shuffled(hubs).select(F.col("fp").alias(f"fp_{x}"), F.col("hub").alias(x))
    tied = links(hubs.select("fp"), most).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v"))
    close = tied.join(end("u"), "fp_u").join(end("v"), "fp_v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = coordinates.confirmed(equal.unionByName(close), classes.select("cls", "n"), sets, percent)
    edges = coordinates.connected(classes, sets, percent, edges)
    return coordinates.membership(own, classes, edges).select("doc_id", "component_id")
