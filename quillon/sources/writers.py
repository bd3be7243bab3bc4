"""Text outputs, written by Spark as folders of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kmers import numbered
from ..operators.stats import FEW
from ..session import small


def number(c: Column) -> Column:
    """A double in exponential notation with six digits, as %e."""
    return F.format_string("%e", c.cast("double"))


def matrix_lines(features: DataFrame, samples: DataFrame, dictionary: DataFrame, integers: bool = True, transform: DataFrame | None = None) -> DataFrame:
    """(src, sample_id, line): comma-separated rows over the whole dictionary, zeros included.

    A row is made from the sample's own map of values; of the dictionary only its size is
    needed. One whose ids have gaps is numbered anew. transform: offsets and scales of
    single features; zeros are transformed, too, and what it lacks stays as it is. It meets
    the samples as one row, which is no longer than a line of the output.
    """
    n, top = dictionary.agg(F.count("*"), F.coalesce(F.max("feature_id"), F.lit(-1))).first()
    if n != top + 1:
        place = numbered(dictionary.select("feature_id"), [F.shiftright("feature_id", 12)], [F.col("feature_id")], "_place")
        features = features.join(place, "feature_id").select("sample_id", F.col("_place").alias("feature_id"), "value")
        if transform is not None:
            transform = transform.join(place, transform["a"] == place["feature_id"]).select(F.col("_place").alias("a"), "offset", "scale")
    own = features.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("m"))
    rows = samples.join(own, "sample_id", "left")
    value = lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0))
    if transform is not None:
        rule = F.map_from_entries(F.collect_list(F.struct("a", F.struct("offset", "scale"))))
        one = transform.groupBy(F.lit(0).alias("_all")).agg(rule.alias("_t"))
        rows = rows.withColumn("_all", F.lit(0)).join(F.broadcast(one) if small(transform, FEW) else one, "_all", "left")
        of = lambda i, c, absent: F.coalesce(F.element_at(F.col("_t"), i)[c], F.lit(absent))
        stored_value = value
        value = lambda i: (stored_value(i) - of(i, "offset", 0.0)) * of(i, "scale", 1.0)
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n else F.array().cast("array<bigint>")
    text = F.transform(ids, lambda i: F.format_string("%d", value(i).cast("bigint")) if integers else number(value(i)))
    src = F.col("src") if "src" in samples.columns else F.lit(0)
    return rows.select(src.alias("src"), "sample_id", F.array_join(text, ",").alias("line"))


def header_line(dictionary: DataFrame) -> str:
    """The classes' names in order, comma-separated."""
    return ",".join(r["name"] for r in dictionary.orderBy("feature_id").select("name").toLocalIterator())


def write_lines(df: DataFrame, path: str, line: Column, header: str | None = None, order: list | None = None) -> None:
    """One text line a row, in the given order over the whole output; a header line comes first."""
    rows = df.select(F.lit(1).alias("_k"), *(o.alias(f"_o{i}") for i, o in enumerate(order or [])), line.alias("value"))
    if order:
        rows = rows.orderBy(*(f"_o{i}" for i in range(len(order))))
    if header is not None:
        head = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
        head.union(rows.select("value")).write.text(path)
        return
    rows.select("value").write.text(path)


def write_predictions(predicted: DataFrame, path: str) -> None:
    write_lines(predicted, path, F.format_string("%15e", "prediction"), "prediction", [F.col("sample_id")])


def window_lines(scores: DataFrame) -> DataFrame:
    """(sample_id, line): one line a sequence, its windows' predictions in order."""
    row = F.sort_array(F.collect_list(F.struct("start", "prediction")))
    return scores.groupBy("sample_id").agg(F.array_join(F.transform(row, lambda x: number(x["prediction"])), " ").alias("line"))


def wiggle_lines(scores: DataFrame, regions: DataFrame, window: int, step: int, digits: int = 15) -> DataFrame:
    """(region_id, place, line): a fixedStep header for each region, then exp(prediction) of its windows."""
    head = regions.select(
        "region_id", F.lit(-1).alias("place"),
        F.format_string(f"fixedStep chrom=%s start=%d step={step} span={step}", "seqname", F.col("start") + window // 2).alias("line"),
    )
    body = scores.select("region_id", F.col("start").cast("int").alias("place"), F.format_string(f"%.{digits}f", F.exp("prediction")).alias("line"))
    return head.unionByName(body)


def write_windows(scores: DataFrame, path: str) -> None:
    """One line a sequence, in their order: its windows' predictions."""
    write_lines(window_lines(scores), path, F.col("line"), None, [F.col("sample_id")])


def write_wiggle(scores: DataFrame, regions: DataFrame, path: str, window: int, step: int, digits: int = 15) -> None:
    """A wiggle file as a folder of parts: each region's header, then its windows, regions in order.

    Lines are range-partitioned by region and place, so the parts one after the other, by
    their names, are the file; a region of many windows may go over several of them.
    """
    write_lines(wiggle_lines(scores, regions, window, step, digits), path, F.col("line"), None, [F.col("region_id"), F.col("place")])


def write_cv(predictions: DataFrame, losses: DataFrame, path: str) -> None:
    """predictions(prediction, label) and losses(train, test) as tab-separated tables."""
    write_lines(predictions, f"{path}.table", F.concat_ws("\t", number(F.col("prediction")), F.col("label").cast("int").cast("string")), "prediction\tlabels")
    write_lines(losses, f"{path}_loss.table", F.concat_ws("\t", number(F.col("train")), number(F.col("test"))), "train\ttest")


def write_trace(trace: DataFrame, path: str) -> None:
    """Right-aligned columns: duration, iteration, change and nonzero (the bias counts), lambda, loss; what is unknown is nan."""
    real = lambda c: F.format_string("%12s", F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%e", c)))
    parts = [
        F.format_string("%15s", F.format_string("%.6fs", "duration")), F.format_string("%9d", "iteration"), real("change"),
        F.format_string("%8s", F.coalesce(F.col("nonzero").cast("string"), F.lit("nan"))), real("lambda"), real("loss"),
    ]
    head = f"{'duration':>15} {'iteration':>9} {'change':>12} {'nonzero':>8} {'lambda':>12} {'loss':>12}"
    write_lines(trace, path, F.concat_ws(" ", *parts), head, [F.col("iteration"), F.col("duration")])


def write_loss(loss: float, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(f"{loss:15e}",)], "value string").coalesce(1).write.text(path)


def write_matrices(lines: DataFrame, dictionary: DataFrame, base: str, sources: int) -> None:
    """A table for each source of matrix_lines, <base>_<i>.table, its header the classes' names."""
    head = header_line(dictionary)
    for i in range(sources):
        write_lines(lines.where(F.col("src") == i), f"{base}_{i}.table", F.col("line"), head, [F.col("sample_id")])


def write_path(path_table: DataFrame, path: str) -> None:
    """estimator, lambda, norm and the coefficients of each step of a regularisation path."""
    theta = F.array_join(F.transform("theta", number), ",")
    parts = [F.col("estimator").cast("string"), number(F.col("lambda")), number(F.col("norm")), theta]
    write_lines(path_table, path, F.concat_ws("\t", *parts), "estimator\tlambda\tnorm\ttheta", [F.col("estimator"), F.col("step")])


def write_similarity(similarity: DataFrame, path: str) -> None:
    """The whole symmetric matrix of similarity(s1, s2, similarity), a row a sample."""
    flipped = similarity.where("s1 <> s2").select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "similarity")
    row = F.sort_array(F.collect_list(F.struct("s2", "similarity")))
    rows = similarity.unionByName(flipped).groupBy("s1").agg(F.array_join(F.transform(row, lambda x: F.format_string("%8.4f", x["similarity"])), " ").alias("line"))
    write_lines(rows, path, F.col("line"), None, [F.col("s1")])


def write_expanded(table: DataFrame, columns: list[str], base: str, sources: int, src: str = "src") -> None:
    """A table for each source, <base>_<i>.table."""
    for i in range(sources):
        line = F.concat_ws(",", *(number(F.col(f"`{c}`")) for c in columns))
        write_lines(table.where(F.col(src) == i), f"{base}_{i}.table", line, ",".join(columns))


def write_stability(stability: DataFrame, path: str) -> None:
    write_lines(stability, path, F.concat_ws("\t", F.col("stability").cast("string"), number(F.col("mean"))), "stability\tmean", [F.col("a"), F.col("b")])


def output_name(base: str, n: int | None = None, fold: int | None = None, many: bool = False) -> str:
    """<base>[_cv<fold + 1>][_<n>]: n where several numbers of features are fitted."""
    return base + (f"_cv{fold + 1}" if fold is not None else "") + (f"_{n}" if many and n is not None else "")
