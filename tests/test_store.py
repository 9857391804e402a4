"""Commits of a store: writers at once, failures between files, look-ups by id, summaries of the log."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store as M
from tidemark.sources.store import Conflict, Store


def _rows(spark, n, tag):
    return spark.range(n).select(F.lit(tag).alias("tag"), F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("label"))


def test_two_writers_at_once(spark, tmp_path):
    """Ids are distinct, and every row of every write is there once."""
    errors = []

    def write(tag):
        try:
            for _ in range(3):
                Store(spark, str(tmp_path)).write("t", _rows(spark, 40, tag), order=["k"])
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(tag,)) for tag in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = Store(spark, str(tmp_path)).open("t").collect()
    assert len(got) == 360 and {r["id"] for r in got} == set(range(360))
    assert {(r["tag"], r["k"]) for r in got} == {(t, k) for t in "abc" for k in range(40)}


def test_a_commit_number_is_taken_once(spark, tmp_path):
    log = Store(spark, str(tmp_path)).log
    log._write("x", {"a": 1})
    with pytest.raises(Conflict):
        log._write("x", {"a": 2})
    assert log._read("x") == {"a": 1}


def test_all_tables_or_none(spark, tmp_path, monkeypatch):
    """A failure after the data was written, before its annotations are: readers see neither."""
    s = Store(spark, str(tmp_path))
    annot = spark.createDataFrame([(0, 1, 0.0, 1.0)], "data_index long, label int, start double, `end` double")
    s.write("t", _rows(spark, 5, "a"), annot, order=["k"])
    whole = Store._files

    def fails(self, table, *rest):
        if table.endswith("_annot"):
            raise OSError("lost")
        return whole(self, table, *rest)

    monkeypatch.setattr(Store, "_files", fails)
    with pytest.raises(OSError):
        s.write("t", _rows(spark, 5, "b"), annot, order=["k"])
    monkeypatch.undo()
    assert s.load("t").count() == 5 and s.open("t_annot").count() == 1
    s.write("t", _rows(spark, 5, "c"), order=["k"])
    got = sorted((r["id"], r["tag"]) for r in s.open("t").collect())
    assert [t for _, t in got] == ["a"] * 5 + ["c"] * 5 and len({i for i, _ in got}) == 10 and got[5][0] == 10


def test_look_up_opens_files_that_may_hold_the_ids(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    annot = spark.range(1000).select(F.col("id").alias("data_index"), F.lit(1).alias("label"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")).repartitionByRange(5, "data_index")
    s.write("t", _rows(spark, 1000, "a"), annot, order=["k"], max_records=100)
    s.write("t", _rows(spark, 1000, "b"), order=["k"], max_records=100)
    whole, some = s.open("t"), s.load("t", [3, 1500])
    assert len(whole.inputFiles()) >= 20 and len(s.open("t", [3, 1500]).inputFiles()) == 2
    assert sorted((r["id"], r["tag"], len(r["annotations"])) for r in some.collect()) == [(3, "a", 1), (1500, "b", 0)]
    assert len(some.inputFiles()) <= 3 and s.load("t", [9999]).count() == 0


def test_summaries_and_modes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SUMMARY", 3)
    s = Store(spark, str(tmp_path))
    for tag in "abcd":
        s.write("t", _rows(spark, 2, tag), order=["k"])
    assert any(p.name.endswith(".sum") for p in (tmp_path / "_log").iterdir()) and s.open("t").count() == 8
    s.write("t", _rows(spark, 3, "e").withColumn("more", F.lit(1)), order=["k"])
    assert s.open("t").where("more IS NULL").count() == 8
    s.write("t", _rows(spark, 1, "f"), mode="w", order=["k"], attrs={"rate": 5})
    s.write("t", _rows(spark, 1, "g"), order=["k"])
    assert [(r["id"], r["tag"]) for r in s.open("t").orderBy("id").collect()][0] == (0, "f") and s.open("t").count() == 2 and s.attributes("t") == {"rate": 5}
    s.write("p", _rows(spark, 30, "x"), order=["k"], partition_by=["label"])
    assert s.open("p").where("label = 2").count() == 10 and len(s.open("p").where("label = 2").inputFiles()) >= 1
    with pytest.raises(KeyError):
        s.open("none")
