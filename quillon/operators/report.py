"""What is told about models and data: coefficients, abundance, related k-mers, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotides import wider_letters
from ..session import stored


def ranked_coefficients(coef: DataFrame, names: DataFrame, rescale: bool = False) -> DataFrame:
    """(member, place, feature, theta) by falling size, zeros left out; pairs are named `a & b`.

    rescale: theta is divided by the transform's scale (column scale).
    """
    theta = F.col("theta") / F.col("scale") if rescale else F.col("theta")
    n = names.select(F.col("feature_id"), F.col("name"))
    named = (
        coef.where("theta <> 0").withColumn("theta", theta)
        .join(n.select(F.col("feature_id").alias("a"), F.col("name").alias("_a")), "a")
        .join(n.select(F.col("feature_id").alias("b"), F.col("name").alias("_b")), "b")
    )
    label = F.when(F.col("a") == F.col("b"), F.col("_a")).otherwise(F.concat_ws(" & ", "_a", "_b"))
    order = Window.partitionBy("member").orderBy(F.desc(F.abs("theta")), "a", "b")
    return named.select("member", F.row_number().over(order).alias("place"), label.alias("feature"), "theta")


def listing(ranked: DataFrame) -> DataFrame:
    """(member, place, line) of ranked_coefficients: place, coefficient and name in columns as wide as each member needs."""
    widest = F.max(F.length("feature")).over(Window.partitionBy("member"))
    name = F.lpad("feature", widest, F.lit(" "))
    return ranked.select("member", "place", F.concat(F.format_string("%6d %14e ", "place", "theta"), name, F.lit(" ")).alias("line"))


def abundance(values: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, b, foreground, background): the shares of either label's samples that have the feature."""
    n1, n0 = samples.agg(F.count_if(F.col("label")), F.count_if(~F.col("label"))).first()
    there = values.where("value > 0").join(samples.select("sample_id", "label"), "sample_id")
    share = lambda c, n: F.try_divide(F.count_if(c).cast("double"), F.lit(n))
    return there.groupBy("a", "b").agg(share(F.col("label"), n1).alias("foreground"), share(~F.col("label"), n0).alias("background"))


def related(dictionary: DataFrame, coef: DataFrame) -> DataFrame:
    """(feature_id, other, theta, place): coefficients of k-mers that contain, or are contained in, a model's k-mer.

    A word contains another one where each of its letters stands for no other bases than
    the other's letter there: acgt contains cg and cn, and acnt contains an. Reverse
    complements count through the classes' names. Words meet in the trie of all words: from
    each place of a word all its more general readings go down together, a level a join,
    and only those that are prefixes of some word go on.
    """
    theta = coef.where("a = b and theta <> 0").select(F.col("a").alias("feature_id"), "theta")
    own = dictionary.join(theta, "feature_id").select("feature_id", "theta", F.explode(F.array_distinct(F.split("name", "\\|"))).alias("word"))
    own = stored(own, "words")
    n = F.length("word")
    nodes = own.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("word", F.lit(1), k))).alias("node")).distinct()
    nodes = stored(nodes, "nodes")
    ends = own.select(F.col("word").alias("node"), F.col("feature_id").alias("short"), F.col("theta").alias("_s"))
    general = F.create_map(*(x for c, wider in wider_letters().items() for x in (F.lit(c), F.array(*map(F.lit, wider)))))
    front = own.select(F.col("feature_id").alias("long"), F.col("theta").alias("_l"), "word", F.explode(F.sequence(F.lit(1), n)).alias("at"), F.lit("").alias("node"))
    found = None
    for _ in range(own.agg(F.coalesce(F.max(n), F.lit(0))).first()[0]):
        wider = F.explode(F.transform(F.element_at(general, F.substring("word", F.col("at"), F.lit(1))), lambda c: F.concat("node", c)))
        front = front.where(F.col("at") <= n).select("long", "_l", "word", (F.col("at") + 1).alias("at"), wider.alias("node")).join(nodes, "node")
        front = stored(front, "front")
        hits = front.join(ends, "node").where("long <> short").select("long", "_l", "short", "_s")
        found = hits if found is None else found.unionByName(hits)
    both = dictionary.sparkSession.createDataFrame([], "feature_id bigint, other bigint, theta double")
    if found is not None:
        both = found.select(F.col("long").alias("feature_id"), F.col("short").alias("other"), F.col("_s").alias("theta")).unionByName(
            found.select(F.col("short").alias("feature_id"), F.col("long").alias("other"), F.col("_l").alias("theta"))
        )
    order = Window.partitionBy("feature_id").orderBy(F.desc(F.abs("theta")), "other")
    return both.distinct().withColumn("place", F.row_number().over(order))


def similarity(samples: DataFrame, features: DataFrame, theta: DataFrame, bias: float, negate: bool = False) -> DataFrame:
    """(s1, s2, similarity), s1 <= s2: cosine of samples with coefficients as weights.

    theta(feature_id, theta). Weights are coefficients cut at zero (of negated ones with
    negate); the bias, cut alike, weighs a feature that every sample has once. A pair
    without a weighted feature in common has 0. Every pair of samples is asked for; the
    stated samples meet over the features they share, and pairs of the bias alone come
    from the join by s1 <= s2.
    """
    sign = -1.0 if negate else 1.0
    w0 = max(sign * bias, 0.0)
    weights = theta.select("feature_id", F.greatest(F.lit(sign) * F.col("theta"), F.lit(0.0)).alias("w")).where("w > 0")
    x = features.join(weights, "feature_id").select("sample_id", "feature_id", "value", "w")
    norms = x.groupBy("sample_id").agg(F.sum(F.col("w") * F.col("value") ** 2).alias("q"))
    norms = samples.select("sample_id").join(norms, "sample_id", "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + w0)
    left = x.select(F.col("sample_id").alias("s1"), "feature_id", (F.col("value") * F.col("w")).alias("u"))
    right = x.select(F.col("sample_id").alias("s2"), "feature_id", F.col("value").alias("v"))
    dots = left.join(right, "feature_id").where("s1 <= s2").groupBy("s1", "s2").agg(F.sum(F.col("u") * F.col("v")).alias("d"))
    n1, n2 = (norms.select(F.col("sample_id").alias(f"s{i}"), F.col("q").alias(f"q{i}")) for i in (1, 2))
    every = n1.join(n2, F.col("s1") <= F.col("s2")).join(dots, ["s1", "s2"], "left")
    d = F.coalesce("d", F.lit(0.0)) + w0
    return every.select("s1", "s2", F.when(d == 0, F.lit(0.0)).otherwise(d / F.sqrt("q1") / F.sqrt("q2")).alias("similarity"))
