"""A header is the first line of the first file by name, however long the other files are."""

from pyspark.sql import functions as F

from quillon.sources import readers, writers


def _folder(tmp_path, *parts):
    for i, text in enumerate(parts):
        (tmp_path / f"part-{i:05}.txt").write_text(text)
    return str(tmp_path)


def test_header_in_the_shortest_part(spark, tmp_path):
    path = _folder(tmp_path, "x,y\n", "1,2\n" * 500, "3,4\n" * 2000)
    assert readers.score_names(spark, path) == ["x", "y"]
    found = readers.read_scores(spark, path, header=True).groupBy("values").count().collect()
    assert sorted((tuple(r["values"]), r["count"]) for r in found) == [((1.0, 2.0), 500), ((3.0, 4.0), 2000)]


def test_empty_parts_come_before_the_header(spark, tmp_path):
    path = _folder(tmp_path, "", "x\n1\n", "2\n" * 9)
    assert readers.score_names(spark, path) == ["x"]
    assert readers.read_scores(spark, path, header=True).count() == 10


def test_a_row_like_the_header_stays(spark, tmp_path):
    path = _folder(tmp_path, "7,8\n", "7,8\n" * 50)
    assert readers.read_scores(spark, path, header=True).count() == 50


def test_nothing_to_read(spark, tmp_path):
    path = _folder(tmp_path, "")
    assert readers.score_names(spark, path) == []
    assert readers.read_scores(spark, path, header=True).count() == 0


def test_ranges_in_parts(spark, tmp_path):
    path = _folder(tmp_path, "seqnames from to counts\n", "a 1 2 3,4\n" * 300)
    rows = readers.read_score_table(spark, path)
    assert rows.count() == 300 and rows.first()["values"] == [3.0, 4.0]


def test_matrix_lines_with_a_transform(spark):
    """Zeros are transformed too, and ids with gaps take their features' entries along."""
    features = spark.createDataFrame([(1, 2, 4.0), (2, 9, 6.0)], "sample_id long, feature_id long, value double")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")
    known = spark.createDataFrame([(2,), (5,), (9,)], "feature_id long")
    fitted = spark.createDataFrame([(2, 2, 1.0, 0.5), (9, 9, 2.0, 0.25)], "a long, b long, offset double, scale double")
    lines = writers.matrix_lines(features, samples, known, integers=False, transform=fitted)
    rows = {r.sample_id: r.v for r in lines.select("sample_id", F.split("line", ",").cast("array<double>").alias("v")).collect()}
    assert rows == {1: [1.5, 0.0, -0.5], 2: [-0.5, 0.0, 1.0], 3: [-0.5, 0.0, -0.5]}
