"""Samples: labels, unions, limits, weights, folds, and score columns as features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Model


def training_data(foreground: DataFrame, background: DataFrame) -> DataFrame:
    """Both with label true and false, one after the other in source order (column src)."""
    fg = foreground.withColumns({"label": F.lit(True), "src": F.lit(0)})
    return fg.unionByName(background.withColumns({"label": F.lit(False), "src": F.lit(1)}))


def joined_sources(tables: list[DataFrame]) -> DataFrame:
    """Several tables as one, with the number of its table in src."""
    out = tables[0].withColumn("src", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("src", F.lit(i)))
    return out


def limit_samples(samples: DataFrame, most: int) -> DataFrame:
    """The first int(n1 / n * most) samples of label true, and the first of label false up to
    `most`, in the order of sample_id. Both must be left."""
    if most <= 0:
        return samples
    counts = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    if n1 + n0 <= most:
        return samples
    keep1 = int(n1 / (n1 + n0) * most)
    if keep1 <= 0 or most - keep1 <= 0:
        raise ValueError("a class would have no samples left")
    first = [samples.where(F.col("label") == v).orderBy("sample_id").limit(n) for v, n in ((True, keep1), (False, most - keep1))]
    return first[0].unionByName(first[1])


def class_weights(samples: DataFrame) -> DataFrame:
    """One row: n, w0, w1, where w = n / (2 * samples of the class); all weights add up to n."""
    n0, n1 = F.count_if(~F.col("label")), F.count_if(F.col("label"))
    return samples.agg(
        F.count("label").alias("n"), F.try_divide(n0 + n1, 2 * n0).alias("w0"), F.try_divide(n0 + n1, 2 * n1).alias("w1")
    )


def score_features(table: DataFrame, columns: list[str], id_col: str = "sample_id") -> DataFrame:
    """features of numeric columns, feature_id by their order; stored zeros are left out."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    long = table.select(F.col(id_col).alias("sample_id"), F.posexplode(values).alias("feature_id", "value"))
    return long.where("value <> 0").select("sample_id", F.col("feature_id").cast("bigint").alias("feature_id"), "value")


def require_columns(known: list[int] | range, model: Model) -> None:
    """A model's base features must all be there; a column that a table lacks isn't taken for zero."""
    for f in model.features():
        for i in f:
            if i not in known:
                raise ValueError(f"the model needs column {i + 1} ({model.names.get(i, 'unnamed')}), which the data lack")


def check_columns(found: list[str], expected: dict[int, str]) -> None:
    """A table's columns must be the model's, place by place."""
    for i, name in expected.items():
        if i >= len(found) or found[i] != name:
            raise ValueError(f"column {i + 1} must be {name}")


def folds(samples: DataFrame, k: int, validation: float = 0.0, seed: int = -1, position: str | None = None) -> DataFrame:
    """samples with fold and is_validation.

    fold is the place modulo k; k <= 1: -1 for all. A sample is for validation if its
    block of k lies within the first `validation` of all and isn't the last. Places
    follow sample_id, or a hash of seed and sample_id unless seed is -1; a column with
    the places (from 0) may be named instead and saves numbering them.
    """
    n = samples.count()
    if k > 1 and n < k or validation > 0 and n < 2 * k:
        raise ValueError("too few samples for so many folds")
    if position is None:
        samples, position = placed(samples, "_at", seed), "_at"
    at = F.col(position)
    fold = F.pmod(at, F.lit(k)) if k > 1 else F.lit(-1)
    block = (at - F.pmod(at, F.lit(max(k, 1)))).cast("double")
    chosen = (block < F.lit(validation * n)) & (at + max(k, 1) < n)
    return samples.withColumns({"fold": fold.cast("int"), "is_validation": chosen if validation > 0 else F.lit(False)}).drop("_at")


def placed(samples: DataFrame, name: str, seed: int = -1) -> DataFrame:
    """samples with their places from 0, in the order of sample_id, or of a hash of seed and sample_id unless seed is -1."""
    from .kmers import numbered

    key = F.col("sample_id") if seed == -1 else F.xxhash64(F.lit(seed), "sample_id")
    # ranges of the key share a group, so that numbering is spread over tasks
    return numbered(samples, [_range_of(samples, key)], [key, F.col("sample_id")], name)


def _range_of(samples: DataFrame, key: Column, parts: int = 256) -> Column:
    low, high = samples.agg(F.min(key), F.max(key)).first()
    if low is None or high == low:
        return F.lit(0)
    step = (int(high) - int(low)) // parts + 1
    return F.floor((key.cast("decimal(38,0)") - F.lit(int(low)).cast("decimal(38,0)")) / F.lit(step).cast("decimal(38,0)")).cast("bigint")


def split(samples: DataFrame, fold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test) of a fold: test is the fold, the rest is validation where marked."""
    test = samples.where(F.col("fold") == fold)
    rest = samples.where(F.col("fold") != fold)
    return rest.where(~F.col("is_validation")), rest.where("is_validation"), test


def first_place(samples: DataFrame) -> DataFrame:
    """sample_id and its place in each label, from 1, in the order of sample_id."""
    return samples.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("sample_id")))
