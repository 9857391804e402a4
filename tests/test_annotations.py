import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import annotations as A
from tidemark.operators import intervals as I


def std(spark):
    rows = [(f"f{i % 3}.wav", x, float(i), i + 3.3) for i, x in enumerate([1, 2, 3, 0, 0, -1])]
    return spark.createDataFrame(rows, "filename string, label int, start double, end double")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_labels_count_in_text_order(spark):
    got = A.standardize(std(spark))
    assert A.label_map(got) == {"-1": 0, "0": 1, "1": 2, "2": 3, "3": 4}
    assert rows(got, "filename", "annot_id", "label") == [("f0.wav", 0, 2), ("f0.wav", 1, 1), ("f1.wav", 0, 3), ("f1.wav", 1, 1), ("f2.wav", 0, 4), ("f2.wav", 1, 0)]


def test_listed_labels_and_groups(spark):
    t = spark.createDataFrame([("a", x, 0.0, 1.0) for x in ("1", "2", "k", "-99", "whale", "zebra")], "fname string, label string, start double, STOP double")
    got = A.standardize(t, {"filename": "fname", "end": "STOP"}, [["-99", "whale"], "1", "k"])
    assert A.label_map(got) == {"-99": 0, "whale": 0, "1": 1, "k": 2, "2": -1, "zebra": -1}
    assert A.label_map(A.standardize(t, {"filename": "fname", "end": "STOP"}, ["k"], start_labels_at_1=True))["k"] == 1
    with pytest.raises(ValueError, match="not in the table"):
        A.standardize(t, {"filename": "fname", "end": "STOP"}, ["none"])


def test_clash_duration_paths_and_trim(spark):
    t = spark.createDataFrame([("x", "folder\\f1.wav", 1, 2.0, 3.0)], "filename string, path string, label int, start double, duration double")
    got = A.standardize(t, {"filename": "path"})
    assert got.first()["filename"] == "folder/f1.wav" and got.first()["filename_orig"] == "x" and got.first()["end"] == 5.0
    assert "filename_orig" not in A.standardize(t, {"filename": "path"}, trim_table=True).columns
    computed = A.standardize(t, {"filename": "path", "freq_min": "start * 100"})
    assert computed.first()["freq_min"] == 200.0
    with pytest.raises(schema.SchemaError):
        A.standardize(t.drop("label"))


def test_unfold_and_datetime(spark):
    t = spark.createDataFrame([("empty_HMS_12_ 5_28__DMY_23_ 2_84.wav", "1,2"), ("b.wav", "3")], "filename string, label string")
    got = A.standardize(t, unfold_labels=True, datetime_format="*HMS_%H_%M_%S__DMY_%d_%m_%y*")
    assert got.count() == 3
    seen = {r["filename"]: r["datetime"] for r in got.collect()}
    assert str(seen["empty_HMS_12_ 5_28__DMY_23_ 2_84.wav"]) == "1984-02-23 12:05:28" and seen["b.wav"] is None


def test_query_crop_shift_segment(spark):
    a = spark.createDataFrame([("f", 0, 1, 1.0, 3.0, 10.0, 50.0), ("f", 1, 2, 5.0, 7.0, None, None)], schema.ANNOTATIONS)
    assert A.query(a, start=3.0).count() == 1 and A.query(a, label=[1, 9], filename="f").count() == 1 and A.query(a, filename="none").count() == 0
    c = A.crop(a, 2.0, 6.0)
    assert rows(c, "annot_id", "start", "end") == [(0, 0.0, 1.0), (1, 3.0, 4.0)]
    assert rows(A.crop(a, freq_min=20.0, freq_max=40.0), "annot_id", "freq_min", "freq_max") == [(0, 20.0, 40.0)]
    assert rows(A.shift(a, -2.0), "annot_id", "start", "end") == [(0, 0.0, 1.0), (1, 3.0, 5.0)]
    one = spark.createDataFrame([("f", 0, 1, 0.0, 5.0)], "filename string, annot_id int, label int, start double, end double")
    parts = A.segment(one, 4, 2.0, 1.5)
    assert rows(parts, "segment_id", "start", "end") == [(0, 0.0, 2.0), (1, 0.0, 2.0), (2, 0.0, 2.0), (3, 0.0, 0.5)]


def test_sets_append_and_presence(spark):
    a = spark.createDataFrame([("f", 0, 1, 1.0, 3.0)], "filename string, annot_id int, label int, start double, end double")
    more = spark.createDataFrame([("f", 2, "1 min", "70 s")], "filename string, label int, start string, end string")
    got = A.append(a, more)
    assert rows(got, "annot_id", "label", "start", "end") == [(0, 1, 1.0, 3.0), (1, 2, 60.0, 70.0)]
    both = A.stack([a, a.withColumn("extra", F.lit(1))], [3, 4])
    assert rows(A.counts_by_set(both), "set_id", "num_annotations") == [(3, 1), (4, 1)] and A.get(both, set_id=9).count() == 0
    assert A.label_array(a, 1, 5, 1.0).first()["presence"] == [0, 1, 1, 0, 0]


def test_union_duration_golden(spark):
    t = A.standardize(std(spark))
    assert I.union_duration(t).first()[0] == pytest.approx(expected_union(std(spark)))


def expected_union(table):
    total = 0.0
    for f in {r["filename"] for r in table.collect()}:
        end = float("-inf")
        for s, e in sorted((r["start"], r["end"]) for r in table.where(F.col("filename") == f).collect()):
            total += max(0.0, e - max(s, end))
            end = max(end, e)
    return total


def test_interval_joins_agree(spark):
    import random

    rng = random.Random(4)
    make = lambda n, k: spark.createDataFrame([(rng.choice("ab"), i, s, s + rng.random() * 30) for i in range(n) for s in [rng.random() * 100]], f"filename string, {k} int, start double, end double")
    a, b = make(60, "x"), make(60, "y")
    plain = rows(I.interval_join(a, b), "filename", "x", "y")
    assert plain and plain == rows(I.nested_join(a, b), "filename", "x", "y")
    assert I.interval_join(a, b, how="left_anti").count() + I.interval_join(a, b, how="left_semi").count() == 60
