import pytest
from pyspark.sql import functions as F

from tidemark.operators import annotations as A
from tidemark.operators import selections as S


def annot(spark):
    rows = [(f"f{i % 3}.wav", x, float(i), i + 3.3) for i, x in enumerate([1, 2, 3, 0, 0, -1])]
    return A.standardize(spark.createDataFrame(rows, "filename string, label int, start double, end double"))


def rows(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_centred(spark):
    got = rows(S.select(annot(spark), 1.0, center=True), "filename", "sel_id", "label", "start", "end")
    assert got[0] == ("f0.wav", 0, 2, 1.15, 2.15) and len(got) == 6


def test_stepped_count_and_shift(spark):
    assert S.select(annot(spark), 1.0, step=0.5, center=True).count() == 54
    one = spark.createDataFrame([(0.0, 3.3, -0.35)], "start double, end double, start_new double")
    got = [r[0] for r in S.time_shift(one, 4.0, 0.5, 0.8).select(F.round("start_new", 6)).orderBy("start_new").collect()]
    assert got == [x for x in [-1.35, -0.85, -0.35, 0.15, 0.65] if (min(3.3, x + 4) - max(0.0, x)) / 3.3 >= 0.8 or x == -0.35]


def test_shift_keeps_the_reference_and_empty_annotations(spark):
    t = spark.createDataFrame([(5.0, 5.0, 4.0), (0.0, 1.0, 9.0)], "start double, end double, start_new double")
    assert sorted(r["start_new"] for r in S.time_shift(t, 2.0, 1.0, 0.9).collect()) == [4.0, 9.0]


def test_avoid_is_closed_and_outside(spark):
    a = spark.createDataFrame([("f", 0, 1, 2.0, 3.0), ("f", 1, 2, 3.5, 4.0)], "filename string, annot_id int, label int, start double, end double")
    assert S.select(a, 2.0, center=True, label=1, avoid_label=2).count() == 0  # touches at 3.5
    assert S.select(a, 1.9, center=True, label=1, avoid_label="ALL").count() == 1
    files = spark.createDataFrame([("f", 4.2)], "filename string, duration double")
    assert rows(S.select(a, 1.0, center=True, files=files), "sel_id") == [(0,)]


def test_segmenting_golden(spark):
    files = spark.createDataFrame([(f"f{i}.wav", 30.0 + i) for i in range(6)], "filename string, duration double")
    sel, found = S.select_by_segmenting(files, 5.1, annot(spark), 4.0, discard_empty=True)
    assert (sel.count(), found.count()) == (7, 12)
    empty, none = S.select_by_segmenting(files, 16.0, annot(spark), 4.0, pad=False, keep_only_empty=True, label_empty=4)
    assert none is None and {r["label"] for r in empty.collect()} == {4}
    assert S.segment_files(files, 40.0, pad=False).count() == 0 and S.frames(files, 40.0).count() == 6


def test_segment_annotation_overlap(spark):
    a = spark.createDataFrame([("f", 0, 1, 0.5, 1.5)], "filename string, annot_id int, label int, start double, end double")
    got = rows(S.segment_annotations(a, 3, 1.0, compute_overlap=True), "sel_id", "start", "end", "overlap")
    assert got == [(0, 0.5, 1.5, 0.5), (1, -0.5, 0.5, 0.5)]


def test_random_selections_hold_their_promises(spark):
    files = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 1.0)], "filename string, duration double")
    a = spark.createDataFrame([("a", 0, 1, 20.0, 60.0)], "filename string, annot_id int, label int, start double, end double")
    got = S.random_selections(files, 2.0, 12, 7, a, no_overlap=True, buffer=1.0, seed=5)
    found = sorted((r["filename"], r["start"], r["end"]) for r in got.collect())
    assert len(found) == 12 and got.schema["label"] and all(f != "c" for f, _, _ in found)
    assert all(f != "a" or e <= 19.0 or s >= 61.0 for f, s, e in found)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(found, found[1:]))
    assert found == sorted((r["filename"], r["start"], r["end"]) for r in S.random_selections(files, 2.0, 12, 7, a, no_overlap=True, buffer=1.0, seed=5).collect())


def test_choice_and_status(spark):
    t = annot(spark)
    assert S.random_choice(t, 4).count() == 4 and S.random_choice(t, 99).count() == 6
    files = spark.createDataFrame([("f", 10.0)], "filename string, duration double")
    sel = spark.createDataFrame([("f", 0, -2.0, -1.0), ("f", 1, 11.0, 12.0), ("f", 2, 3.0, 3.0), ("f", 3, 9.0, 12.0), ("f", 4, 1.0, 2.0)], "filename string, sel_id int, start double, end double")
    assert [r["status"] for r in S.outside_status(sel, files).orderBy("sel_id").collect()] == ["before", "after", "empty", "mostly_outside", "ok"]


def test_attached_annotations_over_parts(spark):
    sel = spark.createDataFrame([(0, 0, "a", 8.0, 10.0), (0, 1, "b", 0.0, 1.0)], "sel_id int, part int, filename string, start double, end double")
    a = spark.createDataFrame([("a", 0, 1, 7.0, 9.0), ("b", 0, 2, 0.5, 3.0)], "filename string, annot_id int, label int, start double, end double")
    got = {r["part"]: [(x["start"], x["end"], x["label"]) for x in r["annotations"]] for r in S.attach_annotations(sel, a).collect()}
    assert got == {0: [(-1.0, 1.0, 1)], 1: [(2.5, 5.0, 2)]}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    a = annot(spark).limit(0)
    assert S.select(a, 1.0, center=True).count() == 0 and S.segment_annotations(a, 5, 1.0).count() == 0


def test_large_draws_are_the_rows_with_the_least_hashes(spark):
    t = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("filename"), F.col("id").alias("sel_id"))
    for n in (0, 40, 700, 4999, 5000, 9000):
        ids = [r["sel_id"] for r in S.random_choice(t, n, 4).collect()]
        assert ids == [r["sel_id"] for r in S.random_choice(t, n, 4, few=10).collect()] and len(set(ids)) == min(n, 5000)
