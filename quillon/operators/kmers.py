"""K-mer features of sequences."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import nucleotides as nt
from ..functions import packed
from ..session import ship, small, stored
from ..spec import KmerSpec, Pair
from .dataset import joined_sources

#: Letters of a part of a sequence; classes up to whose number a dictionary goes to all executors.
CHUNK, FEW = 100_000, 500_000
#: Bound of a table of words and their patterns for classes that are counted within parts; samples whose counts are spread out at once.
ENTRIES, SAMPLES = 1 << 14, 1000


def kmer_counts(sequences: DataFrame, spec: KmerSpec) -> DataFrame:
    """(sample_id, k, kmer, n) for sequences(sample_id, sequence).

    kmer is the class's representative. Sequences are cut into overlapping parts, so that
    a whole chromosome's words are never in one row. Plain words are counted within each
    part before they are shuffled, and per sample before they are widened to patterns and
    merged into classes: these expressions run once a word and sample, not once a place.
    Lengths whose words and patterns fit a table are counted by classes in the parts, and a
    part's counts are shuffled as one row.
    """
    lengths = range(spec.shortest, spec.longest + 1)
    tables = {k: t for k in lengths if (t := class_table(k, spec))}
    found = [table_counts(sequences, tables)] if tables else []
    left = [k for k in lengths if k not in tables]
    plain = plain_counts(sequences, range(left[0], left[-1] + 1)) if left else None
    for k in left:
        most, own = spec.ambiguous_at(k), plain.where(F.col("k") == k)
        if most > 0:
            own = own.select("sample_id", "k", F.explode(nt.patterns(F.col("w"), k, spec.alphabet, most)).alias("w"), "n")
        if most <= 0 and not nt.merges(spec):
            found.append(own.select("sample_id", "k", F.col("w").alias("kmer"), "n"))
            continue
        classes = own.select("sample_id", "k", nt.representative(F.col("w"), spec).alias("kmer"), "n")
        found.append(classes.groupBy("sample_id", "k", "kmer").agg(F.sum("n").alias("n")))
    counts = reduce(DataFrame.unionByName, found)
    return counts.withColumn("n", F.lit(1).cast("bigint")) if spec.binarize else counts


def parts_of(sequences: DataFrame, reach: int, size: int) -> DataFrame:
    """(sample_id, n, part, s): sequences in parts of `size` letters and the reach - 1 that follow; n: the sequence's length.

    sequences: (sample_id, sequence), or pieces (sample_id, offset, part) of any lengths,
    which are cut and joined anew. Null sequences have no parts.
    """
    if "offset" in sequences.columns:
        return _regrouped(sequences, reach, size)
    own = sequences.where("sequence is not null").select("sample_id", "sequence", F.length("sequence").alias("n"))
    return own.select("sample_id", "n", F.posexplode(nt.chunks(F.col("sequence"), reach, size)).alias("part", "s"))


def _regrouped(pieces: DataFrame, reach: int, size: int) -> DataFrame:
    """parts_of for pieces: each piece goes to the parts that it touches, so a row is a part, never a sequence."""
    own = pieces.where("part is not null").select("sample_id", F.col("offset").cast("bigint").alias("offset"), F.col("part").alias("p"), F.length("part").alias("m"))
    whole = own.groupBy("sample_id").agg(F.max(F.col("offset") + F.col("m")).cast("int").alias("n"))
    own = own.join(whole, "sample_id")
    most = F.floor(F.greatest(F.col("n") - reach, F.lit(0)) / size)
    first = F.greatest(F.least(F.floor((F.col("offset") - reach + 1) / size), most), F.lit(0))
    last = F.greatest(F.least(F.floor((F.col("offset") + F.col("m") - 1) / size), most), first)
    cut = own.withColumn("part", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("part") * size, F.col("offset"))
    high = F.least((F.col("part") + 1) * size + reach - 1, F.col("offset") + F.col("m"))
    text = F.substr("p", (low - F.col("offset") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    one = F.sort_array(F.collect_list(F.struct(low.alias("low"), text.alias("s"))))
    joined = cut.groupBy("sample_id", "n", "part").agg(one.alias("x"))
    return joined.select("sample_id", "n", F.col("part").cast("int").alias("part"), F.array_join(F.transform("x", lambda x: x["s"]), "").alias("s"))


def class_table(k: int, spec: KmerSpec) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(classes, codes, starts) of words of k letters, or None if that is over ENTRIES: class i has the words codes[starts[i]:starts[i + 1]], one as often as patterns lead from it to the class."""
    most = spec.ambiguous_at(k)
    letters = [packed.wider(c, spec.alphabet) for c in "acgt"]
    if k < 1 or 4**k * (max(map(len, letters)) ** max(k - 2, 0) if most > 0 else 1) > ENTRIES:
        return None
    of: dict[str, list[int]] = {}
    for code, word in enumerate(map("".join, itertools.product("acgt", repeat=k))):
        inner = [letters["acgt".index(c)] if most > 0 and 0 < i < k - 1 else [c] for i, c in enumerate(word)]
        for pattern in map("".join, itertools.product(*inner)):
            if sum(c not in "acgt" for c in pattern) <= max(most, 0):
                of.setdefault(min(packed.images(pattern, spec), key=packed.order_key), []).append(code)
    sizes = [len(x) for x in of.values()]
    return list(of), np.array([c for x in of.values() for c in x]), np.cumsum([0, *sizes[:-1]])


def table_counts(sequences: DataFrame, tables: dict[int, tuple[list[str], np.ndarray, np.ndarray]]) -> DataFrame:
    """(sample_id, k, kmer, n) of the classes of tables, by length.

    Counts of a sample's parts that follow each other in a task are one row of arrays, and
    rows are merged by sample: no word is shuffled by itself.
    """
    size, longest = CHUNK, max(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, n, part = b.column("sample_id"), b.column("n").to_pylist(), b.column("part").to_pylist()
            texts = [packed.plain(s) for s in b.column("s").to_pylist()]
            first = [i for i in range(len(n)) if not (i and part[i] and ids[i] == ids[i - 1])]
            for k, (_, codes, starts) in tables.items():
                which, many = [], []
                for lo, hi in zip(first, [*first[1:], len(n)], strict=True):
                    total = np.zeros(4**k, np.int64)
                    for i in range(lo, hi):
                        places, own = packed.rolling(texts[i], k)
                        if part[i] < max(n[i] - longest, 0) // size:  # what begins further on is the next part's
                            own = own[places < size]
                        total += np.bincount(own, minlength=4**k)
                    total = np.add.reduceat(total[codes], starts)
                    there = np.flatnonzero(total)
                    which.append(there.astype("<i4").tobytes())
                    many.append(total[there].astype("<i8").tobytes())
                names = ["sample_id", "k", "which", "many"]
                yield pa.record_batch([ids.take(pa.array(first, pa.int64())), pa.array(np.full(len(first), k, np.int32)), pa.array(which, pa.binary()), pa.array(many, pa.binary())], names=names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {k: pa.array(classes, pa.string()) for k, (classes, _, _) in tables.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, SAMPLES):
                b = batch.slice(lo, SAMPLES)
                ids, lengths = b.column("sample_id"), b.column("k").to_numpy()
                rows = b.column("rows").to_pylist()
                for k in np.unique(lengths):
                    own = np.flatnonzero(lengths == k)
                    counts = [_merged(rows[i], len(words[k])) for i in own]
                    at = np.repeat(own, [len(x) for x, _ in counts])
                    which, many = (np.concatenate(x) for x in zip(*counts, strict=True))
                    yield pa.record_batch([ids.take(pa.array(at)), pa.array(np.full(len(at), k, np.int32)), words[k].take(pa.array(which)), pa.array(many)], names=["sample_id", "k", "kmer", "n"])

    ship(sequences.sparkSession)
    fields = [sequences.schema["sample_id"], StructField("k", IntegerType())]
    rows = parts_of(sequences, longest, size).mapInArrow(count, StructType([*fields, StructField("which", BinaryType()), StructField("many", BinaryType())]))
    rows = rows.groupBy("sample_id", "k").agg(F.collect_list(F.struct("which", "many")).alias("rows"))
    return rows.mapInArrow(spread, StructType([*fields, StructField("kmer", StringType()), StructField("n", LongType())]))


def _merged(rows: list[dict[str, bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, many) of a sample's rows in sum."""
    read = [(np.frombuffer(x["which"], "<i4"), np.frombuffer(x["many"], "<i8")) for x in rows]
    if len(read) == 1:
        return read[0]
    total = np.zeros(size, np.int64)
    for which, many in read:
        total[which] += many
    there = np.flatnonzero(total)
    return there.astype("<i4"), total[there]


def plain_counts(sequences: DataFrame, lengths: range) -> DataFrame:
    """(sample_id, k, w, n) of the words over acgt of the given lengths, whatever the case."""
    size, longest = CHUNK, lengths[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, part = b.column("sample_id"), b.column("n").to_pylist(), b.column("part").to_pylist()
            texts = [packed.plain(s) for s in b.column("s").to_pylist()]
            for k in lengths:
                codes, counts, rows = [], [], []
                for i, s in enumerate(texts):
                    places, own = packed.rolling(s, k)
                    if part[i] < max(n[i] - longest, 0) // size:  # what begins further on is the next part's
                        own = own[places < size]
                    own, m = packed.counted(own, k)
                    codes.append(own)
                    counts.append(m)
                    rows.append(np.full(len(own), i))
                if codes:
                    codes, counts, rows = (np.concatenate(x) for x in (codes, counts, rows))
                    yield pa.record_batch([ids.take(pa.array(rows)), pa.array(np.full(len(rows), k, np.int32)), packed.words(codes, k), pa.array(counts.astype(np.int64))], names=["sample_id", "k", "w", "n"])

    ship(sequences.sparkSession)
    fields = [sequences.schema["sample_id"], *(StructField(c, t()) for c, t in (("k", IntegerType), ("w", StringType), ("n", LongType)))]
    return parts_of(sequences, longest, size).mapInArrow(count, StructType(fields)).groupBy("sample_id", "k", "w").agg(F.sum("n").alias("n"))


def kmer_features(sequences: DataFrame, spec: KmerSpec, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, dictionary) of sequences; the counts that both need are stored, not counted twice.

    samples(sample_id): whose features are wanted, if not those of all that the dictionary is made of.
    """
    counts = stored(kmer_counts(sequences, spec), "counts")
    known = stored(dictionary(counts, spec), "dictionary")
    own = counts if samples is None else counts.join(samples.select("sample_id"), "sample_id", "left_semi")
    return vectorise(own, known), known


def compiled(tables: list[DataFrame], spec: KmerSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, features, dictionary) of several tables of sequences over one dictionary.

    A sample's id becomes the pair of its table's number (src) and its own id, so the
    result splits back by src.
    """
    whole = joined_sources([t.select("sample_id", "sequence") for t in tables])
    whole = whole.withColumn("sample_id", F.struct("src", "sample_id"))
    features, known = kmer_features(whole.select("sample_id", "sequence"), spec)
    return whole.select("sample_id", "src"), features, known


def kmer_presence(sequences: DataFrame, spec: KmerSpec) -> DataFrame:
    """(sample_id, k, kmer) of the classes that a sample has."""
    return kmer_counts(sequences, spec).select("sample_id", "k", "kmer")


def numbered(df: DataFrame, group: list, order: list, name: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of group, then order.

    Rows are ranked within their group; groups get offsets from their counts. So only
    the counts, never the rows, are ranked by one task.
    """
    keyed = df.select("*", F.struct(*(g.alias(f"g{i}") for i, g in enumerate(group))).alias("_g"))
    counts = keyed.groupBy("_g").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    return ranked.join(offsets, "_g").withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("bigint")).drop("_g", "_o", "_r")


def dictionary(counts: DataFrame, spec: KmerSpec) -> DataFrame:
    """(feature_id, k, kmer, name) of all classes that any sample has, by length and alphabet order."""
    seen = counts.select("k", "kmer").distinct()
    key = nt.order_key(F.col("kmer"))
    found = numbered(seen, [F.col("k"), F.substring(key, 1, 3)], [key], "feature_id")
    return found.select("feature_id", "k", "kmer", nt.class_name(F.col("kmer"), spec).alias("name"))


def count_features(counts: DataFrame) -> DataFrame:
    """One row: n_features, the number of classes observed."""
    return counts.agg(F.count_distinct("k", "kmer").alias("n_features"))


def fixed_dictionary(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """counts of the dictionary's classes only, with their feature_id; what is missing is zero by absence."""
    known = dictionary.select("feature_id", "k", "kmer")
    return counts.join(F.broadcast(known) if small(known, FEW) else known, ["k", "kmer"])


def vectorise(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """features(sample_id, feature_id, value)."""
    found = fixed_dictionary(counts, dictionary)
    return found.select("sample_id", "feature_id", F.col("n").cast("double").alias("value"))


def feature_table(spark, features: list[Pair]) -> DataFrame:
    """feature_def(position, a, b) of a list of features."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(features)], "position bigint, a bigint, b bigint")


def all_features(dictionary: DataFrame, cooccurrence: bool) -> DataFrame:
    """(a, b) of every feature, and of every pair a < b.

    The pairs are the range join of ids, which the dictionary's bounded size allows.
    """
    left = dictionary.select(F.col("feature_id").alias("a"))
    right = dictionary.select(F.col("feature_id").alias("b"))
    return left.join(right, F.col("a") <= F.col("b") if cooccurrence else F.col("a") == F.col("b"))


def feature_values(features: DataFrame, defs: DataFrame) -> DataFrame:
    """(sample_id, a, b, value) of single features (a = b) and of products (a < b), without zeros.

    defs(a, b) is small; products arise for its pairs only.
    """
    x = features.select("sample_id", F.col("feature_id").alias("a"), F.col("value").alias("x"))
    y = features.select("sample_id", F.col("feature_id").alias("b"), F.col("value").alias("y"))
    single = x.join(defs.where("a = b"), "a").select("sample_id", "a", "b", F.col("x").alias("value"))
    pairs = defs.where("a <> b")
    product = x.join(pairs, "a").join(y, ["sample_id", "b"]).select("sample_id", "a", "b", (F.col("x") * F.col("y")).alias("value"))
    return single.unionByName(product).where("value <> 0")


def pair_values(features: DataFrame) -> DataFrame:
    """(sample_id, a, b, value) of all products a < b of a sample's features."""
    x = features.select("sample_id", F.col("feature_id").alias("a"), F.col("value").alias("x"))
    y = features.select("sample_id", F.col("feature_id").alias("b"), F.col("value").alias("y"))
    return x.join(y, "sample_id").where("a < b").select("sample_id", "a", "b", (F.col("x") * F.col("y")).alias("value"))
