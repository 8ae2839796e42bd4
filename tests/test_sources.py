import gzip
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gleanset.sources import tables as t


def rows(df):
    return sorted((r.row_id, list(r.features), r.label) for r in df.collect())


def test_text_tables(spark, tmp_path):
    (tmp_path / "b.csv").write_text("1,2,3,4,b\n\n5,6,7,8, a\n")
    assert rows(t.read_table(spark, f"{tmp_path}/b.csv", t.LAYOUTS["banknote"])) == [(0, [1, 2, 3, 4], 1), (1, [5, 6, 7, 8], 0)]
    (tmp_path / "s.txt").write_text(" 1 2  3\t10\n4 5 6 2\n")
    assert rows(t.read_table(spark, f"{tmp_path}/s.txt", t.LAYOUTS["skin"])) == [(0, [1, 2, 3], 1), (1, [4, 5, 6], 0)]
    (tmp_path / "x.csv").write_text("1,2,z,4,b\n")
    with pytest.raises(PySparkException):
        t.read_table(spark, f"{tmp_path}/x.csv", t.LAYOUTS["banknote"]).collect()
    (tmp_path / "m.txt").write_text("2 1\n1 1\n2 2\n3 3\n")
    assert rows(t.read_counted_signal(spark, f"{tmp_path}/m.txt")) == [(0, [1, 1], 1), (1, [2, 2], 1), (2, [3, 3], 0)]
    (tmp_path / "m.txt").write_text("2 2\n1 1\n2 2\n3 3\n")
    with pytest.raises(ValueError):
        t.read_counted_signal(spark, f"{tmp_path}/m.txt")


def test_archives_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d.gz", gzip.compress(b"1,2\n3,4\n"))
    assert [r.value for r in t.read_zip_member(spark, f"{tmp_path}/a.zip", "d.gz").collect()] == ["1,2", "3,4"]
    np.savez(tmp_path / "p.npz", X=np.ones((2, 3)), y=np.array([0, 1]))
    assert rows(t.read_npz(spark, f"{tmp_path}/p.npz")) == [(0, [1, 1, 1], 0), (1, [1, 1, 1], 1)]


def test_pairs_layout_and_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,y\n1,p\n2,\n3,q\n")
    (tmp_path / "d.csv").write_text("y,a\np,9\nq,2\nq,8\n")
    got = sorted((r.row_id, r.clean.a, r.dirty.a) for r in t.read_clean_dirty(spark, f"{tmp_path}/c.csv", f"{tmp_path}/d.csv", "y").collect())
    assert got == [(0, "1", "9"), (2, "3", "8")]
    p = spark.createDataFrame([(1, [1.0], 0)], "row_id bigint, features array<double>, label int")
    t.write_noisy(p, f"{tmp_path}/n", "wdbc", "random", 0.2)
    assert rows(t.read_noisy(spark, f"{tmp_path}/n", "wdbc", "random", 0.2)) == [(1, [1.0], 0)]
    with pytest.raises(PySparkException):
        t.write_noisy(p, f"{tmp_path}/n", "wdbc", "random", 0.2)
    a = {"x": {"y": 1, "z": [1]}}
    assert t.deep_update(a, {"x": {"y": 2}}, {"w": 3}) == {"x": {"y": 2, "z": [1]}, "w": 3} and a["x"]["y"] == 1
    t.check_header(["feature_0", "feature_1", "label"])
    with pytest.raises(ValueError):
        t.check_header(["feature_1", "label"])
    with pytest.raises(ValueError):
        t.checked(spark.createDataFrame([(1, [None], 0)], "row_id bigint, features array<double>, label int"))
