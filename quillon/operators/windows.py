"""Scores of sliding windows over sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import nucleotides as nt
from ..functions import packed
from ..functions.logistic import log_sigmoid
from ..session import ship
from ..spec import Model
from .kmers import CHUNK, parts_of
from .linear import biases

#: Windows that are handed over at once, and whose counts are held at once.
ROWS, BLOCK = 1 << 16, 1 << 12


def slices(sequences: DataFrame, window: int, step: int, include_last: bool = False) -> DataFrame:
    """(sample_id, start, sequence): windows at 0, step, 2 * step, ...

    A window starts before length - window; the one that ends with the sequence counts
    only with include_last.
    """
    if step < 1:
        raise ValueError("step must be 1 or more")
    last = F.length("sequence") - window - (0 if include_last else 1)
    cut = sequences.where(last >= 0).withColumn("start", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    return cut.withColumn("sequence", F.substring("sequence", F.col("start") + 1, F.lit(window)))


def window_scores(sequences: DataFrame, dictionary: DataFrame, model: Model, window: int, step: int, include_last: bool = False) -> DataFrame:
    """(sample_id, start, member, z, prediction) of every window, the model's transform applied.

    Sequences are cut into parts that overlap by a window less a letter, so each window
    lies in one part. Within a part words are rolling codes: counts come from running
    sums over the places, presence from the stretches of starts that each occurrence
    answers for, products from the counts of their two features. A row is a window.
    """
    if step < 1:
        raise ValueError("step must be 1 or more")
    if window < 1:
        raise ValueError("a window has 1 letter or more")
    table, size, less = WordTable(dictionary, model), max(CHUNK, window), 0 if include_last else 1
    members = len(model.members)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("sample_id")
            for i, (n, part, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "part", "s")), strict=True)):
                first = -(-part * size // step) * step  # the part's first start, then every step
                starts = np.arange(first, min((part + 1) * size, n - window - less + 1), step)
                if not len(starts):
                    continue
                scored = table.score(packed.plain(s), starts - part * size, window)
                for lo in range(0, len(starts), ROWS):
                    at, z = starts[lo : lo + ROWS], scored[:, lo : lo + ROWS]
                    m = len(at) * members
                    yield pa.record_batch([
                        ids.take(pa.array(np.full(m, i))), pa.array(np.tile(at, members).astype(np.int32)), pa.array(np.repeat(np.arange(members, dtype=np.int32), len(at))), pa.array(z.ravel())
                    ], names=["sample_id", "start", "member", "z"])

    ship(sequences.sparkSession)
    fields = [sequences.schema["sample_id"], *(StructField(c, t()) for c, t in (("start", IntegerType), ("member", IntegerType), ("z", DoubleType)))]
    parts = parts_of(sequences, window, size).where(F.col("n") >= window + less)
    scored = parts.mapInArrow(score, StructType(fields))
    return scored.withColumn("prediction", log_sigmoid(F.col("z")))


class WordTable:
    """A model's coefficients by the plain words that count for its features: sorted codes for each length."""

    def __init__(self, dictionary: DataFrame, model: Model) -> None:
        spec, members = model.spec, model.members
        features = sorted({f for m in members for f, t in m.theta.items() if t != 0})
        scale = lambda f: model.transform.get(f, (0.0, 1.0))[1]
        weight = {f: np.array([m.theta.get(f, 0.0) * scale(f) for m in members]) for f in features}
        base = sorted({i for f in features for i in f})
        side = dictionary.sparkSession.createDataFrame([(i,) for i in base], "feature_id bigint")
        known = {r.feature_id: r.kmer for r in dictionary.join(F.broadcast(side), "feature_id").select("feature_id", "kmer").collect()}
        number = {i: x for x, i in enumerate(base)}
        self.bias = np.array([b for _, b in biases(model)])
        self.presence = spec.binarize
        self.single = np.array([weight.get((i, i), np.zeros(len(members))) for i in base]).reshape(-1, len(members))
        self.pairs = [(number[a], number[b], weight[a, b]) for a, b in features if a != b]
        #: by length: sorted codes, where each one's features begin, and these
        self.words: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(spec.shortest, spec.longest + 1):
            hits = [(code, number[i]) for i, word in known.items() if len(word) == k for p in packed.images(word, spec) for code in packed.matching(p)]
            if hits:
                hits.sort()
                codes, begins = np.unique([c for c, _ in hits], return_index=True)
                self.words[k] = codes, np.append(begins, len(hits)), np.array([f for _, f in hits])

    def score(self, sequence: bytes, starts: np.ndarray, window: int) -> np.ndarray:
        """Each member's score of the windows at the starts, a row a member."""
        z = np.repeat(self.bias[:, None], len(starts), axis=1)
        found = {}
        for k, (codes, begins, features) in self.words.items():
            if k > window:
                continue
            places, own = packed.rolling(sequence, k)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            there = codes[at] == own
            places, at = places[there], at[there]
            many = begins[at + 1] - begins[at]
            which = np.repeat(begins[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found[k] = np.repeat(places, many), features[which]
        for k, (places, features) in found.items():
            z += (self._presence if self.presence else self._sums)(places, features, starts, window - k, len(sequence))
        if self.pairs:
            z += self._products(found, starts, window)
        return z

    def _sums(self, places: np.ndarray, features: np.ndarray, starts: np.ndarray, reach: int, n: int) -> np.ndarray:
        """Differences of running sums: places from a start to `reach` after it count."""
        out = []
        for t in self.single.T:
            run = np.concatenate([[0.0], np.cumsum(np.bincount(places, t[features], n))])
            out.append(run[starts + reach + 1] - run[starts])
        return np.array(out)

    def _presence(self, places: np.ndarray, features: np.ndarray, starts: np.ndarray, reach: int, n: int) -> np.ndarray:
        """A feature counts once: an occurrence answers for the starts up to it, `reach` back, that no earlier one answers for."""
        order = np.lexsort((places, features))
        places, features = places[order], features[order]
        low = np.maximum(places - reach, 0)
        again = np.flatnonzero(features[1:] == features[:-1]) + 1
        low[again] = np.maximum(low[again], places[again - 1] + 1)  # beyond its place where a word counts twice: no start is left
        out = []
        for t in self.single.T:
            change = np.bincount(low, t[features], n + 1) - np.bincount(places + 1, t[features], n + 1)
            out.append(np.cumsum(change)[starts])
        return np.array(out)

    def _products(self, found: dict[int, tuple[np.ndarray, np.ndarray]], starts: np.ndarray, window: int) -> np.ndarray:
        """Products of two features' counts, or of their presence, in each window."""
        wanted = np.unique([x for a, b, _ in self.pairs for x in (a, b)])
        by = {}
        for k, (places, features) in found.items():
            order = np.lexsort((places, features))
            cuts = np.searchsorted(features[order], wanted), np.searchsorted(features[order], wanted, "right")
            by |= {int(f): (places[order][lo:hi], window - k + 1) for f, lo, hi in zip(wanted, *cuts, strict=True) if lo < hi}
        out = np.zeros((len(self.bias), len(starts)))
        for lo in range(0, len(starts), BLOCK):
            own, count = starts[lo : lo + BLOCK], {}
            for f, (places, reach) in by.items():
                c = np.searchsorted(places, own + reach) - np.searchsorted(places, own)
                count[f] = np.minimum(c, 1) if self.presence else c
            for a, b, weight in self.pairs:
                if a in count and b in count:
                    out[:, lo : lo + BLOCK] += weight[:, None] * (count[a] * count[b])
        return out


def window_sums(positions: DataFrame, window: int) -> DataFrame:
    """(sample_id, start, total): sums of positions(sample_id, position, score) over `window` places from each on."""
    ahead = Window.partitionBy("sample_id").orderBy("position").rangeBetween(0, window - 1)
    return positions.select("sample_id", F.col("position").alias("start"), F.sum("score").over(ahead).alias("total"))


def genomic_slices(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """regions(region_id, seqname, start, stop) with their sequence [start, stop).

    Sequences are cut into parts; a region meets the parts that it touches, never a whole
    chromosome. A region of an unknown sequence, or beyond its end, stops the query.
    """
    asked = regions.select("seqname", "start", "stop").distinct()
    sizes = genome.select("seqname", F.length("sequence").alias("_n"))
    bad = F.col("_n").isNull() | (F.col("start") < 0) | (F.col("stop") > F.col("_n")) | (F.col("start") > F.col("stop"))
    stop = F.raise_error(F.concat(F.lit("no such region: "), F.coalesce("seqname", F.lit("null"))))
    known = asked.join(sizes, "seqname", "left").select("seqname", "start", "stop", F.when(bad, stop).otherwise(F.col("start")).cast("bigint").alias("_a"))
    part = lambda c: F.floor(c / CHUNK).cast("int")
    touched = known.withColumn("_part", F.explode(F.sequence(part(F.col("_a")), part(F.greatest(F.col("stop") - 1, F.col("_a"))))))
    parts = genome.select("seqname", F.posexplode(nt.chunks(F.col("sequence"), 1, CHUNK)).alias("_part", "_s"))
    first = F.greatest(F.col("_a") - F.col("_part") * CHUNK, F.lit(0))
    last = F.least(F.col("stop") - F.col("_part") * CHUNK, F.lit(CHUNK))
    piece = F.coalesce(F.substring("_s", (first + 1).cast("int"), (last - first).cast("int")), F.lit(""))
    pieces = touched.join(parts, ["seqname", "_part"], "left").select("seqname", "start", "stop", F.struct("_part", piece.alias("s")).alias("_p"))
    whole = pieces.groupBy("seqname", "start", "stop").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda x: x["s"]), "").alias("sequence"))
    return regions.join(whole, ["seqname", "start", "stop"]).select(*regions.columns, "sequence")


def genomic_scores(regions: DataFrame, genome: DataFrame, models: list[tuple[Model, DataFrame]], window: int, step: int) -> DataFrame:
    """(region_id, start, prediction): the sum of all models' log-probabilities for each window of each region."""
    cut = genomic_slices(regions, genome).select(F.col("region_id").alias("sample_id"), "sequence")
    total = None
    for model, dictionary in models:
        one = window_scores(cut, dictionary, model.component(0), window, step).select("sample_id", "start", "prediction")
        total = one if total is None else total.unionByName(one)
    return total.groupBy(F.col("sample_id").alias("region_id"), "start").agg(F.sum("prediction").alias("prediction"))
