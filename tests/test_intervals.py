"""Nested bins against the plain join, and random places that are exact."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import selections as S


def _table(spark, rng, n, lengths, key="x"):
    rows = []
    for i in range(n):
        start = rng.choice([rng.uniform(-1e3, 1e3), rng.randint(-4, 4) * 16.0, rng.uniform(0, 1e9)])
        rows.append((rng.choice("abc"), i, start, start + rng.choice(lengths)))
    return spark.createDataFrame(rows, f"filename string, {key} long, start double, `end` double")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_lengths_in_one_table(spark, closed, seed):
    rng = random.Random(seed)
    lengths = [0.0, 0.001, 0.5, 1.0, 1.0000001, 16.0, 17.3, 600.0, 4096.0, 1e6, 1e9, -3.0]
    a, b = _table(spark, rng, 250, lengths), _table(spark, rng, 250, lengths, "y")
    pairs = lambda df: sorted((r["x"], r["y"]) for r in df.collect())
    plain = pairs(I.interval_join(a, b, closed=closed))
    assert plain and plain == pairs(I.nested_join(a, b, closed=closed)) and len(set(plain)) == len(plain)
    windows = a.withColumn("end", F.col("start") + 21.5)
    assert pairs(I.interval_join(windows, b, closed=closed)) == pairs(I.nested_join(windows, b, closed=closed, lengths=(21.5, None)))


def test_copies_of_a_row_are_bounded_by_levels(spark):
    """One annotation of a century beside windows of a second: nobody is copied for each second."""
    windows = spark.range(20_000).select(F.lit("f").alias("filename"), F.col("id").cast("int").alias("sel_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("end"))
    a = spark.createDataFrame([("f", 0, 1, 0.5, 3e9), ("f", 1, 2, 5.25, 5.5), ("f", 2, 3, float("-inf"), float("inf")), ("f", 3, 4, None, 7.0)], "filename string, annot_id int, label int, start double, end double")
    got = {r["sel_id"]: sorted(x["label"] for x in r["annotations"]) for r in S.attach_annotations(windows, a).collect()}
    assert len(got) == 20_000 and got[5] == [1, 2, 3] and all(v == [1, 3] for k, v in got.items() if k != 5)


def test_clashing_names_and_empty_sides(spark):
    a = spark.createDataFrame([("f", 0.0, 2.0, 7)], "filename string, start double, `end` double, llo int")
    b = spark.createDataFrame([("f", 1.0, 3.0, 8)], "filename string, start double, `end` double, llo int")
    assert I.nested_join(a, b).columns == ["filename", "start", "end", "llo", "start_right", "end_right", "llo_right"] and I.nested_join(a, b).count() == 1
    assert I.nested_join(a.limit(0), b).count() == I.nested_join(a, b.limit(0)).count() == 0


FILES = [("a", 100.0, "s"), ("b", 50.0, "t"), ("c", 1.0, "u"), ("d", 2.0, "v")]


def _files(spark):
    return spark.createDataFrame(FILES, "filename string, duration double, site string")


def _annotations(spark):
    rows = [("a", 20.0, 60.0), ("a", 25.0, 30.0), ("a", 58.0, 61.0), ("a", 90.0, 90.0), ("b", -5.0, 3.0), ("b", 45.0, 99.0), ("x", 0.0, 1.0)]
    return spark.createDataFrame(rows, "filename string, start double, `end` double")


def test_gaps_are_what_annotations_leave(spark):
    got = sorted((r["filename"], r["gap_start"], r["gap_end"]) for r in S.free_gaps(_files(spark), 2.0, _annotations(spark), 1.0).collect())
    assert got == [("a", 0.0, 19.0), ("a", 62.0, 89.0), ("a", 91.0, 100.0), ("b", 4.0, 44.0), ("d", 0.0, 2.0)]
    assert sorted(r["gap_end"] for r in S.free_gaps(_files(spark), 2.0).collect()) == [2.0, 50.0, 100.0]


@pytest.mark.parametrize("no_overlap", [False, True])
def test_exactly_as_many_as_asked(spark, no_overlap):
    files, a, length = _files(spark), _annotations(spark), 2.0
    gaps = [(r["filename"], r["gap_start"], r["gap_end"]) for r in S.free_gaps(files, length, a, 1.0).collect()]
    room = sum(math.floor((e - s) / length) for _, s, e in gaps)
    for num in (0, 7, room, *([300] if not no_overlap else [])):
        for seed in (num % 3,):
            got = S.random_selections(files, length, num, 5, a, no_overlap, 1.0, seed).collect()
            assert len(got) == num
            for r in got:
                assert r["end"] == pytest.approx(r["start"] + length) and (r["label"], r["site"]) == (5, dict((f, s) for f, _, s in FILES)[r["filename"]])
                assert any(f == r["filename"] and s - 1e-9 <= r["start"] and r["end"] <= e + 1e-9 for f, s, e in gaps)
            for f in "abd":
                own = sorted((r["start"], r["sel_id"]) for r in got if r["filename"] == f)
                assert [k for _, k in own] == list(range(len(own)))
                assert not no_overlap or all(y[0] - x[0] >= length - 1e-9 for x, y in zip(own, own[1:], strict=False))
    with pytest.raises(ValueError, match="room"):
        S.random_selections(files, length, room + 1, 5, a, True, 1.0)
    with pytest.raises(ValueError, match="room"):
        S.random_selections(files, 1000.0, 1)


def test_places_follow_durations(spark):
    """Half the places of a long draw lie in a file with half the duration, and evenly in it."""
    files = spark.createDataFrame([("a", 1000.0), ("b", 600.0), ("c", 400.0)], "filename string, duration double")
    for no_overlap in (False, True):
        got = S.random_selections(files, 0.1, 4000, no_overlap=no_overlap, seed=4)
        n = {r["filename"]: (r["n"], r["m"]) for r in got.groupBy("filename").agg(F.count("*").alias("n"), F.avg("start").alias("m")).collect()}
        for f, d in (("a", 1000), ("b", 600), ("c", 400)):
            assert n[f][0] == pytest.approx(2 * d, rel=0.12) and n[f][1] == pytest.approx(d / 2, rel=0.08)
        assert sorted(map(str, got.collect())) == sorted(map(str, S.random_selections(files.repartition(3), 0.1, 4000, no_overlap=no_overlap, seed=4).collect()))
