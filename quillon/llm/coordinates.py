"""Near copies by Jaccard similarity: an inverted join of MinHash signatures by their coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, documents, map_batches, map_groups, shuffled, stored, utf8
from .components import components

#: Coordinates of a signature, and in how many of them a candidate pair agrees. A pair of
#: similarity 0.8 agrees in fewer with a chance of 2e-8, a more similar one with less.
SIZE, MATCHES = 64, 32
#: Of a pair that agrees in MATCHES coordinates, each side posts a common one among so many of its rarest.
PREFIX = SIZE - MATCHES + 1
#: Postings of one coordinate and value that are compared in one block; longer lists meet block by block.
BLOCK = 1024
#: Bytes that a task compares or confirms at once, and those of one class's partners.
BUCKET, GROUP = 8_000_000, 4_000_000
#: Bound of a table of classes for a broadcast.
FEW = 500_000
_RNG = np.random.default_rng(20261128)
_XOR = _RNG.integers(0, 1 << 64, SIZE, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, SIZE, np.uint64) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """XXH64 of words, each computed once while the table is kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def runs(text: bytes, size: int, known: Words) -> np.ndarray:
    """The hashes of a text's runs of `size` words in order; fewer words are one run, none are none."""
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    run = np.full(n, size, np.uint64)
    for i in range(size):  # order matters: every word mixes what came before it
        run = (run ^ h[i : i + n]) * _A
        run ^= run >> np.uint64(31)
    return run * _B


def shingles(text: bytes, size: int, known: Words) -> np.ndarray:
    """The distinct hashes of a text's runs, sorted."""
    return np.unique(runs(text, size, known))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SIZE values of 32 bits for each set, none of which may be empty."""
    out = np.empty((len(sets), SIZE), np.int32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 1 << 16):
            held += len(sets[hi])
            hi += 1
        every = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(x) for x in sets[lo : hi - 1]])
        for k in range(SIZE):
            low = np.minimum.reduceat((every ^ _XOR[k]) * _ODD[k], starts)
            low ^= low >> np.uint64(29)
            out[lo:hi, k] = (low * _B >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lo = hi
    return out


SKETCH = "doc_id bigint, mark binary, key binary, n bigint, sig array<int>"


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, more: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, mark, key, n, sig[, more]): mark is the text's MD5, key one for equal sets, n the set's size; without words key and sig are null.

    more: a 64-bit number of a text's runs, repeats included.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known = Words()
        every = [runs(x, size, known) for x in utf8(b.column(1))]
        sets = [np.unique(x) for x in every]
        some = [x for x in sets if len(x)]
        rows = iter(signatures(some)) if some else iter(())
        sig = [next(rows) if len(x) else None for x in sets]
        keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
        cols = [pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sig, pa.list_(pa.int32()))]
        own = [pa.array(np.array([more(x) for x in every], np.uint64).view(np.int64))] if more else []
        return pa.record_batch([b.column(0), b.column(2), *cols, *own], names=["doc_id", "mark", "key", "n", "sig", *["more"] * len(own)])

    marked = documents(docs, id_col, text_col).withColumn("mark", F.unhex(F.md5("text")))
    return map_batches(marked, batch, SKETCH + (", more bigint" if more else ""))


def classes_of(own: DataFrame) -> DataFrame:
    """(cls, key, least, mark, n, sig[, more]) of sketches: one for all documents of equal sets, numbered."""
    more = [F.min(c).alias(c) for c in own.columns if c == "more"]
    found = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("sig").alias("sig"), *more)
    return stored(found.withColumn("cls", F.monotonically_increasing_id()), "classes")


def postings(classes: DataFrame) -> DataFrame:
    """(cls, degree, prefix, tokens): for each class those PREFIX rarest of its coordinate-value pairs that others have, too.

    A token is coordinate and value; degree: how many classes have the tokens, in sum;
    prefix: a bit for each coordinate posted. A class that shares fewer than MATCHES
    tokens with others has no partner and posts nothing.
    """
    tokens = classes.select("cls", F.posexplode("sig").alias("k", "value"))
    token = F.shiftleft(F.col("k").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF))
    tokens = tokens.select("cls", token.alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = tokens.join(shuffled(often), "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("own"))
    # tokens that nobody else has are the rarest: they fill the prefix first
    left = F.size("own") - F.lit(SIZE - PREFIX)
    own = shared.where(left > 0).select("cls", F.slice("own", F.lit(1), left).alias("own"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(x["token"], 32).cast("int"))
    degree = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x["f"])
    prefix = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(bit(x)))
    return own.select("cls", degree.alias("degree"), prefix.alias("prefix"), F.col("own.token").alias("tokens"))


def alike_sizes(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def best_hubs(posted: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): each class v with that hub u with which it collides most often.

    The hub of a token is the class that has most neighbours: the text that others are copies of.
    """
    rows = posted.join(beside(classes.select("cls", "n"), FEW), "cls").select("cls", "n", "degree", F.explode("tokens").alias("token"))
    hubs = rows.groupBy("token").agg(F.max(F.struct("degree", "cls", "n")).alias("hub"))
    met = rows.join(shuffled(hubs), "token").where((F.col("hub.cls") != F.col("cls")) & alike_sizes(F.col("n"), F.col("hub.n"), percent))
    counted = met.groupBy(F.col("cls").alias("v"), F.col("hub.cls").alias("u")).agg(F.count("*").alias("c"))
    return counted.groupBy("v").agg(F.max(F.struct("c", "u")).alias("best")).select("best.u", "v")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose signatures agree in MATCHES coordinates."""
    sig = lambda x: shuffled(classes).select(F.col("cls").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(sig("v"), "v").join(sig("u"), "u")
    same = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda a, b: a == b), lambda x: x))
    return both.where(same >= MATCHES).select("u", "v")


def _near(sig: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (i, js), j > i in the order of n: those whose sizes allow the similarity and whose signatures agree enough.

    Most coordinates are counted first; what can't reach MATCHES in the rest is skipped.
    """
    first = SIZE * 3 // 4
    ends = np.searchsorted(n, n * 100 // percent, "right")
    for i in range(len(n)):
        js = np.arange(i + 1, ends[i])
        if not len(js):
            continue
        count = (sig[js, :first] == sig[i, :first]).sum(axis=1)
        fit = count >= MATCHES - (SIZE - first)
        js, count = js[fit], count[fit]
        js = js[count + (sig[js, first:] == sig[i, first:]).sum(axis=1) >= MATCHES]
        if len(js):
            yield i, js


def _told_here(lists: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (i, js) of rows of lists, sorted by list and n: pairs that agree enough, are of different roots, and have no lower coordinate in common that both have posted."""
    column = lambda c: lists.column(c).to_numpy()
    sig = lists.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    names = np.column_stack([column(c) for c in ("token", "i", "j")])
    cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
    n, prefix, own, root = column("n"), column("prefix").view(np.uint64), column("own"), column("root")
    for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
        lower = np.uint64((1 << int(names[lo, 0] >> 32)) - 1)
        two = names[lo, 1] != names[lo, 2]
        for i, js in _near(sig[lo:hi], n[lo:hi], percent):
            i, js = i + lo, js + lo
            js = js[(root[js] != root[i]) & ((own[js] != own[i]) | (not two))]
            if len(js):
                equal = np.packbits(sig[js] == sig[i], axis=1, bitorder="little").view("<u8")[:, 0]
                js = js[equal & prefix[js] & prefix[i] & lower == 0]
            if len(js):
                yield i, js


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by([(c, "ascending") for c in ("token", "i", "j", "n")])


def apart(posted: DataFrame, roots: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(u, v): links that connect all classes of different roots that are alike.

    Lists of one root have nothing to say. The others are merged in tasks, twice: first
    with signatures alone, which leaves the few rows of each list that agree enough with
    another one; then these with their whole sets, which return a spanning forest of the
    links found, never all pairs. A pair is told by the lowest coordinate that both have
    posted, so in one list. A list of over BLOCK rows, or GROUP bytes of sets, is cut into
    blocks, each pair of which is a list.
    """
    sizes = beside(classes.select("cls", "n"), FEW)
    rooted = posted.join(beside(roots, FEW), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    about = rooted.join(shuffled(classes.select("cls", "n", "sig")), "cls").select("cls", "n", "sig", "prefix", "root")
    tokens = rooted.join(sizes, "cls").select("cls", "n", "root", F.explode("tokens").alias("token"))
    open_ = tokens.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("all"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all") * 8 / GROUP)).cast("int")
    rows = stored(tokens.select("cls", "token").join(shuffled(open_.select("token", parts.alias("parts"))), "token"), "open")
    total = rows.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = rows.select("cls", "token", own.alias("own"), F.inline(meets))

    def met(key: tuple, group: pa.Table) -> pa.Table:
        group = _sorted(group)
        there = np.zeros(len(group), bool)
        for i, js in _told_here(group, percent):
            there[i] = there[js] = True
        return group.filter(pa.array(there)).select(["cls", "token", "own", "i", "j"])

    def measured(key: tuple, group: pa.Table) -> pa.Table:
        group = _sorted(group)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items")]
        cls, up = group.column("cls").to_numpy(), {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        u, v = [], []
        for i, js in _told_here(group, percent):
            for j in js:
                x, y = top(int(cls[i])), top(int(cls[j]))
                if x != y and similar(items[i], items[j], percent):
                    up[x] = y
                    u.append(cls[i])
                    v.append(cls[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def dealt(lists: DataFrame, size: int) -> DataFrame:
        return lists.withColumn("bucket", F.pmod(F.xxhash64("token", "i", "j"), F.lit(max(1, math.ceil(size / BUCKET)))))

    schema = "cls bigint, token bigint, own int, i int, j int"
    active = map_groups(dealt(rows.join(shuffled(about), "cls"), total * (SIZE * 4 + 64)), "bucket", met, schema)
    active = stored(active, "active")
    held = active.join(sizes, "cls").agg(F.coalesce(F.sum(F.col("n") * 8 + SIZE * 4 + 64), F.lit(0))).first()[0]
    whole = active.join(shuffled(about.join(shuffled(sets(active.select("cls").distinct())), "cls")), "cls")
    return stored(map_groups(dealt(whole, held), "bucket", measured, "u bigint, v bigint"), "links")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets that aren't empty."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Those pairs (u, v) of classes with 100 * intersection >= percent * union, by their whole sets.

    sizes(cls, n); sets(cls) gives (cls, items binary), sorted 64-bit hashes, of the classes
    named. A class u meets its partners in groups of some megabytes, and goes to each of
    them once, however many partners it has.
    """
    pairs = stored(pairs.distinct(), "pairs")
    sizes = beside(sizes, FEW)
    sized = pairs.join(sizes.select(F.col("cls").alias("v"), F.col("n").alias("nv")), "v")
    parts = sized.groupBy("u").agg(F.ceil(F.sum(F.col("nv") * 8) / GROUP).cast("int").alias("parts"))
    sized = sized.join(shuffled(parts), "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    ends = sized.select("u", "part", F.col("v").alias("cls")).unionByName(sized.select("u", "part").distinct().withColumn("cls", F.col("u")))
    ends = stored(ends, "ends")
    held = ends.join(sizes, "cls").agg(F.coalesce(F.sum(F.col("n") * 8 + 64), F.lit(0))).first()[0]
    count = max(1, math.ceil(held / BUCKET))
    rows = ends.join(shuffled(sets(ends.select("cls").distinct())), "cls").withColumn("bucket", F.pmod(F.xxhash64("u", "part"), F.lit(count)))

    def measured(key: tuple, group: pa.Table) -> pa.Table:
        heads, part, cls = (group.column(c).to_pylist() for c in ("u", "part", "cls"))
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items")]
        first = {(u, p): i for i, (u, p, c) in enumerate(zip(heads, part, cls, strict=True)) if u == c}
        u, v = [], []
        for i, (head, p, c) in enumerate(zip(heads, part, cls, strict=True)):
            if c != head and similar(items[first[head, p]], items[i], percent):
                u.append(head)
                v.append(c)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return stored(map_groups(rows.select("bucket", "u", "part", "cls", "items"), "bucket", measured, "u bigint, v bigint"), "confirmed")


def set_reader(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> Callable[[DataFrame], DataFrame]:
    """A function from (cls) to (cls, items): one text of each class is read again by its mark, and its set made anew."""
    marked = documents(docs, id_col, text_col).select("text", F.unhex(F.md5("text")).alias("mark"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known = Words()
        return pa.record_batch([b.column(0), pa.array([shingles(x, size, known).tobytes() for x in utf8(b.column(1))], pa.binary())], names=["cls", "items"])

    def read(wanted: DataFrame) -> DataFrame:
        named = stored(classes.select("cls", "mark").join(shuffled(wanted), "cls"), "wanted")
        texts = marked.join(beside(named, FEW), "mark").groupBy("cls").agg(F.first("text").alias("text"))
        return map_batches(texts, batch, "cls bigint, items binary")

    return read


def connected(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, edges: DataFrame | None = None) -> DataFrame:
    """(u, v): links that, with the given edges, connect all classes that are alike.

    Classes are posted under their signature's coordinate-value pairs, rare ones first.
    Each class meets the hub with which it collides most often; what isn't connected then
    meets in whole lists. Of either kind, pairs that agree in MATCHES coordinates are
    confirmed on their whole sets.
    """
    n = F.col("n")
    # a set so small that no set of another size, or of other members, is near enough
    lone = F.ceil(n * percent / 100) == F.floor(n * 100 / percent)
    posted = stored(postings(classes.where(~lone)), "postings")
    stars = stored(agreeing(best_hubs(posted, classes, percent), classes), "stars")
    found = confirmed(stars, classes.select("cls", "n"), sets, percent)
    edges = found if edges is None else edges.unionByName(found)
    return edges.unionByName(apart(posted, roots_of(edges), classes, sets, percent))


def roots_of(edges: DataFrame) -> DataFrame:
    return stored(components(edges).withColumnRenamed("node", "cls"), "roots")


def membership(own: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of sketches: the smallest doc_id that the edges between classes lead to."""
    tied = classes.select("key", "cls", "least").join(shuffled(roots_of(edges)), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    tied = tied.join(shuffled(ids), "root").select("key", "component_id")
    found = own.select("doc_id", "key", "n").join(shuffled(tied), "key", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents that a chain of pairs of Jaccard similarity percent / 100 or more connects.

    Equal sets are one class from the start; see connected for how classes meet.
    component_id is the smallest doc_id. Null and empty texts, and texts without words,
    have no shingles and no links. A null id takes part as a document without a number,
    and is alone under null. Repeated rows give repeated rows; an empty table gives an
    empty table. Very long texts are handled one at a time.
    """
    own = stored(sketches(docs, id_col, text_col, size), "sketches")
    classes = classes_of(own)
    edges = connected(classes, set_reader(docs, classes, id_col, text_col, size), percent)
    return membership(own, classes, edges)
