"""Benchmark decontamination: block-max WAND over an index of test items, then overlap checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, stored

#: Bytes of the items' texts in one index, and in all indexes that one pass over the documents uses.
SHARD, PASS = 16_000_000, 64_000_000
#: Postings of a block; passages whose cursors move together; words that are looked up at once.
BLOCK, ROWS, PART = 8, 512, 200_000
#: Ranges of items, and greatest weights of terms in them that an index keeps; terms that are added up at once.
RANGES, BOUNDS, SUMS = 64, 8_000_000, 50_000
_WORD = re.compile(r"[^\W_]+")
_SLACK = 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of all items: their number, mean and greatest length, and in how many each word stands."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[list[str]]) -> Statistics:
        size = [len(w) for w in items if w]
        return cls(len(size), sum(size) / max(len(size), 1), max(size, default=0), Counter(t for w in items for t in set(w)))


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 64 bits of the runs of `size` words; 0 where a word is unknown (-1)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        own = ids[k : k + n]
        known &= own >= 0
        out = (out ^ (own + 1).astype(np.uint64)) * _ODD
        out ^= out >> np.uint64(29)
    return np.where(known, np.maximum(out, np.uint64(1)), np.uint64(0))


class Index:
    """An inverted index of test items whose postings carry BM25 weights.

    Weights of an item are divided by the score it has for its own text, so a score
    is the share of the item's weight that a passage holds. The postings of a term lie
    in the order of items, in blocks of BLOCK; of each term and block the greatest
    weight is known, and of a block its last item. So is that of each term and range of
    items: passages whose terms don't reach the threshold in any range move no cursors.
    """

    def __init__(self, items: Iterable[tuple[int, str]], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75, shingle: int = 5):
        rows = [(i, w) for i, t in items if (w := words_of(t or ""))]
        rows.sort(key=lambda x: (x[1][0], x[1], x[0] is not None, x[0]))
        stats = stats or Statistics.of([w for _, w in rows])
        self.ids, self.longest = [i for i, _ in rows], stats.longest
        self.terms: dict[str, int] = {}
        posts: list[tuple[int, int, float]] = []
        self.size, self.cut, grams = [], [], []
        for k, (_, w) in enumerate(rows):
            own = {
                t: np.log1p((stats.n - stats.df[t] + 0.5) / (stats.df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / stats.mean))
                for t, f in Counter(w).items()
            }
            total = sum(own.values())
            posts += [(self.terms.setdefault(t, len(self.terms)), k, x / total) for t, x in own.items()]
            size = min(shingle, len(w))
            all_ = _shingles(self.encode(w), size)
            # the last quarter is the item's answer: shingles that reach into it, else the question
            cut = max(len(w) - max(1, len(w) // 4) - size + 1, 0)
            question, answer = np.unique(all_[:cut]), np.unique(all_[cut:])
            self.size.append(size)
            self.cut.append(len(question))
            grams += [question, answer]
        posts.sort()
        self.grams = np.concatenate([np.zeros(0, np.uint64), *grams])
        self.grams_at = np.cumsum([0] + [len(a) + len(b) for a, b in zip(grams[::2], grams[1::2], strict=True)])
        term = np.array([p[0] for p in posts], np.int64)
        self.item = np.array([p[1] for p in posts] + [0], np.int64)  # one more, so that every place may be looked at
        self.weight = np.array([p[2] for p in posts] + [0.0], np.float32)
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.top = np.zeros(len(self.terms) + 1, np.float32)
        np.maximum.at(self.top, term, self.weight[:-1])
        ranges = max(1, min(RANGES, len(rows), BOUNDS // max(len(self.terms), 1)))
        self.range_top = np.zeros((len(self.terms), ranges), np.float32)
        np.maximum.at(self.range_top, (term, self.item[:-1] * ranges // max(len(rows), 1)), self.weight[:-1])
        self.stride = len(rows) + 1
        self.post_key = term * self.stride + self.item[:-1]
        blocks = -(-np.diff(self.first) // BLOCK)
        self.block_first = np.concatenate(([0], np.cumsum(blocks)))
        block = self.block_first[term] + (np.arange(len(term)) - self.first[term]) // BLOCK
        self.block_max = np.zeros(self.block_first[-1] + 1, np.float32)
        np.maximum.at(self.block_max, block, self.weight[:-1])
        self.block_last = np.zeros(self.block_first[-1] + 1, np.int64)
        np.maximum.at(self.block_last, block, self.item[:-1])
        self.block_key = np.repeat(np.arange(len(self.terms)), blocks) * self.stride + self.block_last[:-1]

    def encode(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, -1 for those that no item has."""
        return np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))

    def passages(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document and first word of each passage, then passage and term of its different known words.

        A passage is two neighbouring steps of `longest` words (64 at least); each item
        that stands in a document as a whole stands in one of its passages.
        """
        step, none = max(64, self.longest), len(self.terms)
        length = np.array([len(d) for d in docs], np.int64)
        steps = -(-length // step)
        many = np.maximum(steps - 1, np.minimum(steps, 1))
        start, first = np.cumsum(length) - length, np.cumsum(many) - many
        ids = np.concatenate([np.zeros(0, np.int64), *docs])
        doc = np.repeat(np.arange(len(docs)), length)
        at = (np.arange(len(ids)) - start[doc]) // step
        known = ids >= 0
        ids, doc, at = ids[known], doc[known], at[known]
        into = [(at < many[doc], at), (at > 0, at - 1)]
        keys = np.concatenate([(first[doc] + a)[m] * none + ids[m] for m, a in into]) if none else np.zeros(0, np.int64)
        keys.sort()
        keys = keys[np.diff(keys, prepend=-1) > 0]
        of = np.repeat(np.arange(len(docs)), many)
        return of, (np.arange(len(of)) - first[of]) * step, keys // max(none, 1), keys % max(none, 1)

    def retrieve(self, docs: list[np.ndarray], least: float) -> list[tuple[int, int, int, float]]:
        """All (document, first word of the passage, item, score) with a score of `least` or more."""
        of, at, passage, term = self.passages(docs)
        whole = np.bincount(passage, self.top[term], len(of))
        ok = whole[passage] >= least - _SLACK
        passage, term = passage[ok], term[ok]
        ok = self._reached(term, np.flatnonzero(np.diff(passage, prepend=-1)), least)
        passage, term = passage[ok], term[ok]
        rows, cuts, width = np.unique(passage, return_index=True, return_counts=True)
        out = []
        order = np.argsort(width, kind="stable")  # passages of like numbers of terms together
        for lo in range(0, len(order), ROWS):
            own = order[lo : lo + ROWS]
            table = np.full((len(own), int(width[own[-1]])), -1, np.int64)
            row = np.repeat(np.arange(len(own)), width[own])
            column = np.arange(len(row)) - np.repeat(np.cumsum(width[own]) - width[own], width[own])
            table[row, column] = term[cuts[own][row] + column]
            for r, item, score in self._wand(table, least - _SLACK):
                p = rows[own[r]]
                out += zip(of[p].tolist(), at[p].tolist(), item.tolist(), score.tolist(), strict=True)
        return out

    def _reached(self, term: np.ndarray, cuts: np.ndarray, least: float) -> np.ndarray:
        """Of each term, whether the greatest weights of its passage reach `least` in a range of items; a passage starts at each cut."""
        ends, lo, out = np.append(cuts[1:], len(term)), 0, []
        while lo < len(cuts):
            hi = max(lo + 1, int(np.searchsorted(ends, cuts[lo] + SUMS, "right")))
            sums = np.add.reduceat(self.range_top[term[cuts[lo] : ends[hi - 1]]], cuts[lo:hi] - cuts[lo], axis=0)
            out.append(sums.max(axis=1) >= least - 100 * _SLACK)
            lo = hi
        return np.repeat(np.concatenate([np.zeros(0, bool), *out]), ends - cuts)

    def _wand(self, term: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block-max WAND for many queries (rows of terms, -1 for none): rows, items and their scores.

        A row's cursors are kept in the order of their items. The pivot is the first
        item at which the terms' greatest weights add up to `least`; below it no item
        reaches that. If the weights of the blocks around the pivot don't add up to it
        either, the cursors up to the pivot skip to the end of the nearest of these
        blocks or to the next cursor; else the pivot is scored and passed. Memory
        depends on the cursors, not on the number of items.
        """
        bits = max(1, int(term.shape[1] - 1).bit_length())
        kind = np.int32 if self.stride < 1 << (31 - bits) else np.int64
        none = np.iinfo(kind).max
        top = np.append(self.top[term], np.zeros((len(term), 1), np.float32), axis=1).astype(np.float64)  # the last is of no term
        name = np.arange(len(term))
        key = np.where(term >= 0, self.item[self.first[term]] << bits | np.arange(term.shape[1]), none).astype(kind)
        while True:
            key.sort(axis=1)
            slot = np.where(key == none, top.shape[1] - 1, key & ((1 << bits) - 1))
            run = np.take_along_axis(top, slot, axis=1).cumsum(axis=1)
            live = run[:, -1] >= least
            if not live.all():
                name, term, top, key, slot, run = (x[live] for x in (name, term, top, key, slot, run))
                if not len(name):
                    return
            width = int((key != none).sum(axis=1).max())
            key, slot, run = key[:, :width], slot[:, :width], run[:, :width]
            every = np.arange(len(name))
            pivot = (key[every, (run < least).sum(axis=1)] >> bits).astype(np.int64)
            ahead = key >> bits <= pivot.astype(kind)[:, None]
            reach = ahead.sum(axis=1)
            after = np.where(reach < width, key[every, np.minimum(reach, width - 1)], none) >> bits
            row, column = np.nonzero(ahead)
            own = slot[row, column]
            t = term[row, own]
            at = pivot[row]
            block = self.block_first[t]
            far = np.flatnonzero(self.block_last[block] < at)
            block[far] = np.searchsorted(self.block_key, t[far] * self.stride + at[far])
            inside = block < self.block_first[t + 1]
            bound = np.bincount(row, np.where(inside, self.block_max[block], 0), len(name))
            edge = np.minimum.reduceat(np.where(inside, self.block_last[block] + 1, self.stride), np.cumsum(reach) - reach)
            open_ = bound >= least
            to = np.where(open_, pivot, np.minimum(edge, after))[row]
            place, end = self.first[t], self.first[t + 1]
            far = np.flatnonzero(self.item[place] < to)
            more = end[far] - place[far] > 1  # a single posting is passed without a search
            place[far[~more]] += 1
            far = far[more]
            place[far] = np.searchsorted(self.post_key, t[far] * self.stride + np.minimum(to[far], self.stride - 1))
            there = open_[row] & (place < end) & (self.item[place] == at)
            score = np.bincount(row[there], self.weight[place[there]], len(name))
            hit = np.flatnonzero(score >= least)
            if len(hit):
                yield name[hit], pivot[hit], score[hit]
            place += there
            key[row, column] = np.where(place < end, self.item[place] << bits | own, none)

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float, float]:
        """Shares of the item's shingles that the words hold: of all, of the question's, of the answer's."""
        grams = self.grams[self.grams_at[item] : self.grams_at[item + 1]]
        there = np.isin(grams, _shingles(words, self.size[item]))
        cut = self.cut[item]
        both = np.isin(grams[cut:], grams[:cut])  # a shingle of question and answer counts once in all
        every = (there[:cut].sum() + (there[cut:] & ~both).sum()) / (len(grams) - both.sum())
        return float(every), float(there[:cut].mean()) if cut else 1.0, float(there[cut:].mean())


SCHEMA = "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double, word bigint"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_score: float = 0.5,
    least_overlap: float = 0.8,
    least_part: float = 0.65,
) -> DataFrame:
    """A row for each document and test item that it holds (SCHEMA), best passage first.

    Every passage of every document is a query of block-max WAND. Retrieved items are
    verified by shingles of five words (an item of fewer words is one shingle): a
    passage must hold least_part of the question's and of the answer's (the item's last
    quarter), or least_overlap of all. An item is retrieved only where a passage holds
    least_score of its weight: shingles of common words alone don't report it. Null or
    empty texts and items without words match nothing; repeated rows give repeated results.

    An index holds items of SHARD bytes and goes to the tasks; weights come from
    statistics of the whole benchmark, so they don't depend on how items are dealt. One
    pass over the documents asks the indexes of PASS bytes one after the other; a
    benchmark of more bytes takes more passes, each of which is written and its indexes
    removed before the next one's are built.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = -(-size // SHARD) or 1
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(shards))
    count = None if shards == 1 else _counts(items)
    sc, found = docs.sparkSession.sparkContext, None
    width = max(1, PASS // SHARD)
    for lo in range(0, shards, width):
        own = []
        for k in range(lo, min(shards, lo + width)):
            rows = [(x.item, x.text) for x in items.where(dealt == k).collect()]
            own.append(sc.broadcast(Index(rows, count and count(rows))))
        rows = map_batches(documents(docs, id_col, text_col), _matcher(own, least_score, least_overlap, least_part), SCHEMA)
        if shards <= width:
            return rows
        rows = stored(rows, "pass")
        for x in own:
            x.destroy()
        found = rows if found is None else found.unionByName(rows)
    return found


def _counts(items: DataFrame):
    """Statistics of all items, counted by Spark; of words only those that some rows have come to the driver."""

    def batch(b: pa.RecordBatch) -> pa.Table:
        words = [words_of(t) for t in b.column(0).to_pylist()]
        return pa.table({"size": pa.array([len(w) for w in words], pa.int64()), "words": pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))})

    split = stored(map_batches(items.select("text"), batch, "size bigint, words array<string>").where("size > 0"), "items")
    n, mean, longest = split.agg(F.count("*"), F.avg("size"), F.max("size")).first()
    df = stored(split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")

    def of(rows: list[tuple[int, str]]) -> Statistics:
        own = df.sparkSession.createDataFrame([(w,) for w in {w for _, t in rows for w in words_of(t)}], "word string")
        return Statistics(n or 0, mean or 0.0, longest or 0, {x.word: x.n for x in df.join(F.broadcast(own), "word", "left_semi").collect()})

    return of


def _matcher(indexes, least_score, least_overlap, least_part):
    def batch(b: pa.RecordBatch) -> pa.Table:
        out: list[tuple] = []
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, group in _groups(texts):
            for shared in indexes:
                own: Index = shared.value
                docs = [own.encode(w) for w in group]
                span = 2 * max(64, own.longest)
                best: dict[tuple[int, int], tuple] = {}
                for d, at, item, score in own.retrieve(docs, least_score):
                    every, q, a = own.verify(docs[d][at : at + span], item)
                    if every >= least_overlap or min(q, a) >= least_part:
                        row = (every, score, q, a, -at)
                        best[d, item] = max(best.get((d, item), row), row)
                for (d, item), (every, score, q, a, at) in sorted(best.items()):
                    out.append((ids[lo + d], own.ids[item], score, every, q, a, -at))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.int64()]
        return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(SCHEMA.split(", "), cols, kinds, strict=True)})

    return batch


def _groups(texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
    """Words of texts in groups of over PART words, each with the number of its first text."""
    lo, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(words_of(text))
        size += len(group[-1])
        if size > PART:
            yield lo, group
            lo, group, size = i + 1, [], 0
    if group:
        yield lo, group
