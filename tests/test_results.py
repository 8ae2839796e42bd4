import pytest
from pyspark.errors import PySparkException

from gleanset.sources import results


def test_training_rows(spark):
    p = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 1), (3, [3.0], 1)], "row_id bigint, features array<double>, label int")
    plain = {r.row_id: (r.features, r.label, r.soft, r.sample_weight) for r in results.training_rows(p).collect()}
    assert plain == {1: ([1.0], 0, None, 1.0), 2: ([2.0], 1, None, 1.0), 3: ([3.0], 1, None, 1.0)}
    fix = spark.createDataFrame([(1, [9.0], None, [1.0, 3.0]), (2, None, 0, [0.0, 0.0]), (3, None, None, None)], "row_id bigint, features array<double>, label int, soft array<double>")
    chosen = spark.createDataFrame([(1, 2.5), (2, 1.0)], "row_id bigint, sample_weight double")
    got = {r.row_id: (r.features, r.label, r.soft, r.sample_weight) for r in results.training_rows(p, chosen, fix, fix, fix).collect()}
    assert got == {1: ([9.0], 0, [0.25, 0.75], 2.5), 2: ([2.0], 0, [0.0, 0.0], 1.0)}
    assert results.training_rows(p.limit(0)).count() == 0
    for bad in (fix.where("row_id < 3"), fix.union(fix.where("row_id = 3")), fix.withColumn("row_id", fix.row_id + 1)):
        with pytest.raises(ValueError):
            results.training_rows(p, labels=bad)


def test_sinks(spark, tmp_path):
    h = results.history([spark.sql("SELECT 1 AS stage, 0.5D AS loss"), spark.sql("SELECT 2 AS stage, 7 AS removed")])
    assert h.columns == ["stage", "loss", "removed"] and sorted(map(tuple, h.collect())) == [(1, 0.5, None), (2, None, 7)]
    results.write_output(h, f"{tmp_path}/a", {"method": "é", "n": [1]})
    assert results.read_metadata(spark, f"{tmp_path}/a") == {"method": "é", "n": [1]} and spark.read.parquet(f"{tmp_path}/a/rows").count() == 2
    with pytest.raises(PySparkException):
        results.write_output(h, f"{tmp_path}/a", {})
    results.write_output(h, f"{tmp_path}/b", {}, arrays=False)
    assert not (tmp_path / "b" / "rows").exists()
