"""Suffix-array dedup: remove every byte of a long string that an earlier document has too.

Strings that repeat are found in three steps, each a shuffle of less than the texts:

1. Anchors. Of each window of `length` bytes the K bytes of the least hash are its
   anchor; equal windows have equal anchors. Six bytes of an anchor's hash, dealt by
   it, tell which anchors stand in two documents or more. A hash that several documents
   of one batch have is settled there and goes on once.
2. Strings. Runs of windows with one repeated anchor are cut out and dealt by the
   anchor. A string that several documents of one batch have goes on once, for the
   smallest of them; the others lose it at once. Where strings of one anchor are too many
   bytes the anchor grows: its windows are halved by the anchor's offset in them, each half
   has some more bytes in common, and these are the new anchor. Buckets of over HEAVY bytes
   are dealt again by longer anchors, and so are those of over TRANSFORM bytes in their task.
   After five halvings (of 27 offsets) an anchor is a window, and equal strings are one.
3. Intervals. In each bucket the suffixes of the distinct strings are sorted; backward
   extension on their Burrows-Wheeler transform, breadth first, gives the common
   prefixes of neighbours in rising order and stops at `length`. What it hasn't
   separated by then are the classes of equal windows; each has its smallest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import documents, large_batches, map_batches, small, stored, utf8

#: Bytes of an anchor; text that is scanned at once.
K, PART = 24, 1_500_000
#: Bytes of text whose anchors meet in one task; of one bucket of strings, of one anchor's
#: strings in a transform, and of a bucket that is dealt again; documents whose findings
#: are gathered in one task; rows of a broadcast (common.small bounds its bytes).
ANCHORED, BUCKET, TRANSFORM, HEAVY, GATHER, FEW = 12_000_000, 6_000_000, 2_000_000, 16_000_000, 20_000, 500_000
_NONE = np.iinfo(np.int64).max  # stands for a null id: after all others
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over a[i : i + width] for each i, by doubling."""
    done = 1
    while 2 * done <= width:
        a, done = op(a[:-done], a[done:]), 2 * done
    return op(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


class Scan:
    """Anchors of some texts: h (hash of the K bytes from each place), least (the least
    hash of each window, 0 where no window fits), at (the anchors' places), doc (of each place)."""

    def __init__(self, texts: list[bytes], length: int):
        self.body = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(size) - size
        n, width = len(self.body), length - K + 1
        self.at = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.uint64)
        if n < length:
            return
        h, base, step = self.body.astype(np.uint64) + np.uint64(1), int(_MIX) | 1, 1
        while 2 * step <= K:
            h = h[:-step] * np.uint64(base) + h[step:]
            base, step = base * base % 2**64, 2 * step
        if step < K:  # two overlapping halves
            h = h[: len(h) - (K - step)] * np.uint64(base) + h[K - step :]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        np.maximum(h, np.uint64(1), out=h)
        least = _sliding(np.minimum, h, width)
        fits = np.zeros(n + 1, np.int32)
        long = size >= length
        fits[self.start[long]] += 1
        fits[(self.start + size - length + 1)[long]] -= 1
        least[np.cumsum(fits)[: len(least)] == 0] = 0
        edge = np.zeros(width - 1, np.uint64)
        self.h, self.least, self.width = h, least, width
        self.at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), width) == h)

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, "right") - 1 if len(self.start) else places

    def short(self, places: np.ndarray) -> np.ndarray:
        """Six bytes of the hashes."""
        return self.h[places] >> np.uint64(16)

    def windows(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows with one of the places `among` as anchor (the first of equal ones): starts and anchors."""
        near = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(near, np.maximum(among - self.width + 1, 0), 1)
        np.add.at(near, among + 1, -1)
        i = np.flatnonzero((np.cumsum(near)[: len(self.least)] > 0) & (self.least > 0))
        k = np.searchsorted(self.at, i)
        todo = np.arange(len(i))
        while len(todo):
            todo = todo[self.h[self.at[k[todo]]] != self.least[i[todo]]]
            k[todo] += 1
        wanted = np.zeros(len(self.at), bool)
        wanted[np.searchsorted(self.at, among)] = True
        ok = wanted[k]
        return i[ok], self.at[k[ok]]


def _parts(texts: list[bytes]):
    """Ranges of texts of about PART bytes."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= PART:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def _id_array(ids) -> pa.Array:
    ids = np.asarray(ids, np.int64)
    return pa.array(ids, mask=ids == _NONE)


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs in a sorted array."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _per_doc(doc: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, hashes = doc[order], hashes[order]
    starts, sizes = _groups(doc)
    return doc[starts].tolist(), [_six(hashes[i : i + n]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


ANCHORS = "bucket bigint, settled boolean, docs binary, hashes binary, doc_id bigint"
FOUND = "part bigint, docs binary, a binary, b binary"


def _packed(doc: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int) -> pa.Table:
    """(FOUND): findings of documents, a row for each part of the documents."""
    part = np.where(doc == _NONE, 0, doc % parts)
    order = np.argsort(part, kind="stable")
    part, doc, a, b = part[order], doc[order], a[order], b[order]
    starts, sizes = _groups(part)
    cut = [slice(i, i + n) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    raw = lambda x: pa.array([x[c].tobytes() for c in cut], pa.binary())
    return pa.table({"part": pa.array(part[starts], pa.int64()), "docs": raw(doc), "a": raw(a), "b": raw(b)})


def _gathered(found: DataFrame, merge, schema: str) -> DataFrame:
    """A row for each document out of the findings of all buckets: merge(a, b) gives its columns."""

    def gather(key, table):
        doc, a, b = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(n).to_pylist()]) for n in ("docs", "a", "b"))
        order = np.argsort(doc, kind="stable")
        doc, a, b = doc[order], a[order], b[order]
        starts, sizes = _groups(doc)
        rows = [merge(a[i : i + n], b[i : i + n]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        cols = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
        return pa.table([_id_array(doc[starts]), *cols], names=[x.split()[0] for x in schema.split(", ")])

    return found.groupBy("part").applyInArrow(gather, schema)


def repeated_anchors(docs: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """(doc_id, hashes): of each document, anchors that another one has too. A hash may come up falsely."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        ids, texts = _ids(b.column(0)), utf8(b.column(1))
        doc, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in _parts(texts):
            scan = Scan(texts[i:j], length)
            if len(scan.at):
                d, h = scan.doc(scan.at), scan.short(scan.at)
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
                doc.append(ids[i:j][d[new]])
                hashes.append(h[new])
        d, h = np.concatenate(doc), np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        d, h = d[order], h[order]
        starts, sizes = _groups(h)
        many = np.repeat(sizes > 1, sizes)
        local_docs, local = _per_doc(d[many], h[many])
        d, h = d[starts], h[starts]  # one of each goes on; those of many documents only for the others' sake
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((d, bucket))
        d, h, bucket = d[order], h[order], bucket[order]
        starts, sizes = _groups(bucket)
        rows = [(int(bucket[i]), False, np.diff(d[i : i + n], prepend=0).astype("<i8").tobytes(), _six(h[i : i + n]), None) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        rows += [(x % buckets if x != _NONE else 0, True, None, raw, x) for x, raw in zip(local_docs, local, strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        ids_ = _id_array([x if x is not None else _NONE for x in cols[4]])
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), ids_], names=[x.split()[0] for x in ANCHORS.split(", ")])

    def bucket(key, table):
        settled = table.column("settled").to_pylist()
        ids, hashes, packed = table.column("doc_id").to_pylist(), table.column("hashes").to_pylist(), table.column("docs").to_pylist()
        d = [np.cumsum(np.frombuffer(x, "<i8")) for x, s in zip(packed, settled, strict=True) if not s]
        h = [_unsix(x) for x, s in zip(hashes, settled, strict=True) if not s]
        d = np.concatenate(d) if d else np.zeros(0, np.int64)
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        d, h = d[order], h[order]
        _, sizes = _groups(h)
        many = np.repeat(sizes > 1, sizes)
        d, h = [d[many]], [h[many]]
        for own, raw, s in zip(ids, hashes, settled, strict=True):
            if s:
                h.append(_unsix(raw))
                d.append(np.full(len(h[-1]), _NONE if own is None else own, np.int64))
        h = np.concatenate(h).astype(np.int64)
        return _packed(np.concatenate(d), h, np.zeros(len(h), np.int64), parts)

    rows = map_batches(docs, batch, ANCHORS, whole=True)
    ship(docs.sparkSession)
    found = rows.groupBy("bucket").applyInArrow(bucket, FOUND)
    return _gathered(found, lambda a, b: (_six(a.astype(np.uint64)),), "doc_id bigint, hashes binary")


def classes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every window of `length` bytes; equal windows have equal classes."""
    size = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    start = np.cumsum(size + 1) - size - 1
    text[start + size] = 0
    n = len(text)
    bwt_order, bwt = _suffixes(text, length)
    split = _boundaries(bwt, length)
    cls = np.cumsum(split[:n])
    string = np.searchsorted(start, bwt_order, "right") - 1
    offset = bwt_order - start[string]
    ok = offset + length <= size[string]
    return string[ok], offset[ok], cls[ok]


def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` or more symbols, ties by place, and the transform."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(4, np.int64)))
    key = ((padded[:n] * 512 + padded[1 : n + 1]) * 512 + padded[2 : n + 2]) * 512 + padded[3 : n + 3]
    known = 4
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        if known > depth:
            return order, text[order - 1]
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        rank[n] = 0
        key = rank[:n] * (n + 1) + rank[np.minimum(np.arange(n) + known, n)]
        known *= 2


def _boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """True at each rank whose suffix shares fewer than `length` symbols with the one before.

    Breadth-first: the intervals of level v are those of strings of v symbols whose
    right end was found at level v - 1. Extending one by a symbol to the left gives
    an interval again; if its right end is new, the common prefix there is v.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    moved = np.empty(n, np.int64)
    moved[by_symbol] = np.arange(n)  # where a suffix goes when its symbol is put before it
    follows, leads = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = np.flatnonzero(bwt[by_symbol[1:]] == bwt[by_symbol[:-1]])
    follows[by_symbol[same]], leads[by_symbol[same + 1]] = by_symbol[same + 1], by_symbol[same]
    split = np.zeros(n + 1, bool)
    split[[0, n]] = True
    left, right = np.array([0]), np.array([n - 1])
    for level in range(length):
        width = right - left + 1
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(left, width)
        last = np.sort(moved[at[follows[at] > np.repeat(right, width)]])
        first = np.sort(moved[at[leads[at] < np.repeat(left, width)]])
        new = ~split[last + 1]
        if level == 0:
            new |= last == n - 1  # the last symbol's interval ends where the text does
        left, right = first[new], last[new]
        if not len(left):
            break
        split[right + 1] = True
    return split


def _spread(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The numbers firsts[i], firsts[i] + 1, ... of each i, counts[i] of them."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - firsts, counts)


def _pieces(strings: list[bytes], length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, size, key) of the strings' pieces by longer anchors.

    All windows of a string have the anchor at one place. A piece holds those that have it
    at an offset of b * block to (b + 1) * block - 1; what all such windows have in common
    around the anchor is length - block + 1 bytes, and key is their hash. Equal windows
    have equal keys; with a block of 1 the key is the window's.
    """
    out = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.int64)]]
    for i, j in _parts(strings):
        scan = Scan(strings[i:j], length)
        size = np.diff(np.append(scan.start, len(scan.body)))
        windows, anchors = scan.windows(scan.at)
        place = anchors[np.searchsorted(windows, scan.start)] - scan.start
        low, high = (place - size + length) // block, place // block
        own = np.repeat(np.arange(len(size)), high - low + 1)
        b, place = _spread(high - low + 1, low) * block, place[own]
        start = place - np.minimum(b + block - 1, place)
        end = place - np.maximum(b, place - size[own] + length) + length
        at, key = scan.start[own] + place - b, b.astype(np.uint64) + np.uint64(1)
        for k in range(length - block + 1):
            key = (key ^ scan.body[at + k]) * _MIX
            key ^= key >> np.uint64(32)
        for column, x in zip(out, (own + i, start, end - start, (key >> np.uint64(1)).astype(np.int64)), strict=True):
            column.append(x)
    return tuple(np.concatenate(x) for x in out)


def _classed(strings: list[bytes], key: np.ndarray, length: int, block: int, owner=None, first=None):
    """(string, offset, class) of the windows that others may equal, in parts of about TRANSFORM bytes.

    Windows of one key come in one part, unless their strings are more bytes: then these
    go on as pieces with longer anchors. owner and first: instead of a string's number,
    for each number the strings that it stands for, and where it starts in them.
    """
    if owner is None:
        owner, first = np.arange(len(strings)), np.zeros(len(strings), np.int64)
        many = np.ones(len(strings), np.int64)
    else:
        many, owner, first = np.array([len(x) for x in owner], np.int64), np.concatenate(owner), np.concatenate(first)
    base = np.cumsum(many) - many
    size = np.array([len(x) for x in strings], np.int64)
    order = np.argsort(key, kind="stable")
    starts, counts = _groups(key[order])

    def part(own: np.ndarray):
        string, offset, cls = classes([strings[i] for i in own.tolist()], length)
        string = own[string]
        n = many[string]
        at = _spread(n, base[string])
        return owner[at], first[at] + np.repeat(offset, n), np.repeat(cls, n)

    own, total = [], 0
    for i, n in zip(starts.tolist(), counts.tolist(), strict=True):
        group = order[i : i + n]
        if many[group].sum() == 1:
            continue  # one string has no other windows to compare
        amount = int(size[group].sum())
        if amount > TRANSFORM and n > 1 and block > 1:
            half, seen = (block + 1) // 2, {}
            string, start, width, keys = _pieces([strings[k] for k in group.tolist()], length, half)
            string = group[string]
            for s, a, w, k in zip(string.tolist(), start.tolist(), width.tolist(), keys.tolist(), strict=True):
                old = seen.setdefault(strings[s][a : a + w], (k, [], []))
                old[1].append(owner[base[s] : base[s] + many[s]])
                old[2].append(first[base[s] : base[s] + many[s]] + a)
            below = np.array([x[0] for x in seen.values()], np.int64)
            yield from _classed(list(seen), below, length, half, [np.concatenate(x[1]) for x in seen.values()], [np.concatenate(x[2]) for x in seen.values()])
            continue
        own.append(group)
        total += amount
        if total > TRANSFORM:
            yield part(np.concatenate(own))
            own, total = [], 0
    if own:
        yield part(np.concatenate(own))


STRINGS = "bucket bigint, settled boolean, docs binary, starts binary, sizes binary, anchors binary, blob binary, counts binary"


class _Strings:
    """Different strings, of each the smallest document and its places there; the places of the others are gone."""

    def __init__(self):
        self.seen: dict[bytes, tuple[int, int, list[int]]] = {}  # document, anchor, all places in the document
        self.gone: list[tuple[int, int, int]] = []

    def add(self, rows) -> None:
        """rows: (text, document, anchor, places)."""
        seen, gone = self.seen, self.gone
        for text, own, a, places in rows:
            old = seen.get(text)
            if old is None:
                seen[text] = (own, a, places)
            elif own == old[0]:
                old[2].extend(places)
            elif own < old[0]:
                gone += [(old[0], x, x + len(text)) for x in old[2]]
                seen[text] = (own, a, places)
            else:
                gone += [(own, x, x + len(text)) for x in places]

    def table(self, buckets: int) -> pa.Table:
        """(STRINGS): a row for each bucket, and one of what is gone."""
        rows: list[tuple] = []
        if self.seen:
            text = list(self.seen)
            places = [x for _, _, x in self.seen.values()]
            info = np.array([x[:2] for x in self.seen.values()], np.int64)
            bucket = info[:, 1] % buckets
            order = np.argsort(bucket, kind="stable")
            firsts, sizes = _groups(bucket[order])
            for i, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                own = order[i : i + n]
                texts, at = [text[k] for k in own], [places[k] for k in own]
                rows.append((
                    int(bucket[own[0]]), False, info[own, 0].tobytes(), np.array([x for p in at for x in p], "<i4").tobytes(),
                    np.array([len(x) for x in texts], "<i4").tobytes(), info[own, 1].tobytes(), b"".join(texts),
                    np.array([len(p) for p in at], "<i4").tobytes(),
                ))
        if self.gone:
            g = np.array(self.gone, np.int64)
            rows.append((int(g[0, 0] % buckets), True, g[:, 0].tobytes(), g[:, 1].astype("<i4").tobytes(), g[:, 2].astype("<i4").tobytes(), None, None, None))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64(), pa.bool_()] + [pa.binary()] * 6
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(STRINGS.split(", "), cols, kinds, strict=True)})


def _strings_of(docs, starts, sizes, anchors, blob, counts):
    """(text, document, anchor, places) of the strings of one row that isn't settled."""
    at = k = 0
    places = np.frombuffer(starts, "<i4").tolist()
    for own, n, a, c in zip(*(np.frombuffer(x, kind).tolist() for x, kind in ((docs, np.int64), (sizes, "<i4"), (anchors, np.int64), (counts, "<i4"))), strict=True):
        yield blob[at : at + n], own, a, places[k : k + c]
        at, k = at + n, k + c


def repeated_spans(docs: DataFrame, repeated: DataFrame, length: int, buckets: int, parts: int) -> DataFrame:
    """(doc_id, starts, ends): the spans of documents that windows of smaller documents cover, merged."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        ids, texts, known = _ids(b.column(0)), utf8(b.column(1)), b.column(2).to_pylist()
        out = _Strings()
        for i, j in _parts(texts):
            scan = Scan(texts[i:j], length)
            if not len(scan.at):
                continue
            salt = lambda d: (d.astype(np.uint64) + np.uint64(1)) * _MIX
            mine = [_unsix(x) ^ salt(np.array([k], np.int64)) for k, x in enumerate(known[i:j])]
            there = np.isin(scan.short(scan.at) ^ salt(scan.doc(scan.at)), np.concatenate(mine))
            w, anchor = scan.windows(scan.at[there])
            if not len(w):
                continue
            d = scan.doc(w)
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1))))
            lo, hi = w[new], np.append(w[new[1:] - 1], w[-1]) + length
            body, marks = scan.body.tobytes(), scan.short(anchor[new]).tolist()
            rows = zip(lo.tolist(), hi.tolist(), ids[i:j][d[new]].tolist(), marks, (lo - scan.start[d[new]]).tolist(), strict=True)
            out.add((body[s:e], own, a, [start]) for s, e, own, a, start in rows)
        return out.table(buckets)

    joined = docs.join(repeated.withColumnRenamed("doc_id", "at"), F.col("doc_id").eqNullSafe(F.col("at"))).select("doc_id", "text", "hashes")
    strings = map_batches(joined, batch, STRINGS, whole=True)
    with large_batches(docs.sparkSession):
        strings = stored(strings, "strings")
    block, found = length - K + 1, None
    while True:
        heavy = strings.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("bytes")).where(F.col("bytes") > HEAVY)
        heavy = stored(heavy, "heavy")
        whole = heavy.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        if block == 1 or not whole:
            break
        side = heavy.select("bucket")
        side = F.broadcast(side) if small(side, FEW) else side
        again = strings.where("not settled").join(side, "bucket", "left_semi")
        kept = strings.where("settled").unionByName(strings.where("not settled").join(side, "bucket", "left_anti"))
        rows = kept.groupBy("bucket").applyInArrow(_met(length, block, parts), FOUND)
        found = rows if found is None else found.unionByName(rows)
        block = (block + 1) // 2
        strings = stored(map_batches(again.drop("bucket", "settled"), _dealt(length, block, int(2 * whole // BUCKET) + 1), STRINGS, whole=True), "strings")
    rows = strings.groupBy("bucket").applyInArrow(_met(length, block, parts), FOUND)
    return _gathered(rows if found is None else found.unionByName(rows), _union, "doc_id bigint, starts binary, ends binary")


def _dealt(length: int, block: int, buckets: int):
    """Rows of strings as rows of their pieces by longer anchors."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        rows = [x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in _strings_of(*row)]
        out = _Strings()
        string, start, size, key = _pieces([x[0] for x in rows], length, block)
        for s, a, n, k in zip(string.tolist(), start.tolist(), size.tolist(), key.tolist(), strict=True):
            text, own, _, places = rows[s]
            out.add([(text[a : a + n], own, k, [x + a for x in places])])
        return out.table(buckets)

    return batch


def _met(length: int, block: int, parts: int):
    """What documents lose in one bucket of strings (FOUND)."""

    def met(key, table):
        doc, start, end = ([np.zeros(0, np.int64)] for _ in range(3))
        out = _Strings()
        for settled, *row in zip(*(table.column(n).to_pylist() for n in ("settled", "docs", "starts", "sizes", "anchors", "blob", "counts")), strict=True):
            if settled:  # the sizes are ends
                doc.append(np.frombuffer(row[0], np.int64))
                start.append(np.frombuffer(row[1], "<i4").astype(np.int64))
                end.append(np.frombuffer(row[2], "<i4").astype(np.int64))
            else:
                out.add(_strings_of(*row))
        for column, x in zip((doc, start, end), np.array(out.gone, np.int64).reshape(-1, 3).T, strict=True):
            column.append(x)
        found = list(out.seen.values())
        owner, count = np.array([x[0] for x in found], np.int64), np.array([len(x[2]) for x in found], np.int64)
        places = np.array([x for _, _, at in found for x in at], np.int64)
        first = np.cumsum(count) - count
        for string, offset, cls in _classed(list(out.seen), np.array([x[1] for x in found], np.int64), length, block):
            least = np.full(int(cls.max()) + 1, _NONE)
            np.minimum.at(least, cls, owner[string])
            late = owner[string] > least[cls]
            string, offset = string[late], offset[late]
            by = np.lexsort((offset, string))
            string, offset = string[by], offset[by]
            if len(string):
                new = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))))
                ends = np.append(offset[new[1:] - 1], offset[-1]) + length
                s = string[new]  # every place of the string in its document loses the run
                n = count[s]
                at = places[_spread(n, first[s])]
                doc.append(np.repeat(owner[s], n))
                start.append(at + np.repeat(offset[new], n))
                end.append(at + np.repeat(ends, n))
        return _packed(*(np.concatenate(x) for x in (doc, start, end)), parts)

    return met


def _union(a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
    """The maximal runs that the spans [a, b) cover."""
    order = np.lexsort((b, a))
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
    return a[new].tobytes(), np.append(reach[new[1:] - 1], reach[-1]).tobytes()


def _cut(text: bytes, starts: bytes | None, ends: bytes | None, whole: bool):
    if whole:
        return [0], [len(text)], b""
    if starts is None:
        return [], [], text
    lo, hi = (np.frombuffer(x, np.int64).tolist() for x in (starts, ends))
    return lo, hi, b"".join(text[i:j] for i, j in zip([0, *hi], [*lo, len(text)], strict=True))


def substring_dedup(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256, kept) of every row.

    A byte of the UTF-8 text goes if a string of `length` bytes covers it that also
    starts in a document of a smaller id; what counts is the input. starts and ends:
    the maximal removed runs; kept: what is left, as bytes (null unless with_kept).
    A null text is empty. Null ids come after all others and are one document. Rows that
    share an id take nothing from each other; they must have one text, as spans are found by id. A copy of an earlier text goes as a whole,
    without taking part in the search.
    """
    if length < 2 * K:
        raise ValueError(f"length must be {2 * K} or more")
    own = documents(docs, id_col, text_col)
    marks = own.select("doc_id", F.md5("text").alias("mark"), F.octet_length("text").alias("size"))
    marks = stored(marks.where(F.col("size") >= length), "marks")
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    side = F.broadcast(first) if small(first, FEW) else first
    copies = marks.join(side, "mark").where(~F.col("doc_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    copies = stored(copies.select(F.col("doc_id").alias("copy")).distinct(), "copies")
    gone = F.broadcast(copies) if small(copies, FEW) else copies
    # an id may stand on several rows with different texts: then no row of it is left out
    twice = marks.groupBy("doc_id").agg(F.count_distinct("mark").alias("n")).where("n > 1").select(F.col("doc_id").alias("copy"))
    if not twice.isEmpty():
        gone = gone.join(twice, "copy", "left_anti")
    texts = own.where(F.octet_length("text") >= length).join(gone, F.col("doc_id").eqNullSafe(F.col("copy")), "left_anti")
    rows, size = marks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    inputs = max(16, size // ANCHORED + 1)
    parts = max(16, rows // GATHER + 1)
    anchors = repeated_anchors(texts, length, inputs, parts)
    with large_batches(docs.sparkSession):  # what equals within a batch is settled there
        repeated = stored(anchors, "repeated")
    size = repeated.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0] // 6 * 65
    buckets = int(max(inputs, size // BUCKET + 1))
    spans = stored(repeated_spans(texts, repeated, length, buckets, parts), "spans")
    side = spans.withColumnRenamed("doc_id", "at")
    side = F.broadcast(side) if small(spans, FEW) else side
    joined = own.join(side, F.col("doc_id").eqNullSafe(F.col("at")), "left").drop("at")
    gone = gone.withColumn("whole", F.lit(True)).withColumnRenamed("copy", "at")
    joined = joined.join(gone, F.col("doc_id").eqNullSafe(F.col("at")), "left")
    joined = joined.select("doc_id", "text", "starts", "ends", F.coalesce("whole", F.lit(False)).alias("whole"))

    def batch(b: pa.RecordBatch) -> pa.Table:
        out = []
        for doc, text, starts, ends, whole in zip(b.column(0).to_pylist(), utf8(b.column(1)), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            lo, hi, kept = _cut(text, starts, ends, whole)
            out.append((doc, len(text), len(text) - len(kept), len(lo), lo, hi, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256", "kept"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, starts array<int>, ends array<int>, kept_sha256 string, kept binary"
    return map_batches(joined, batch, schema)
