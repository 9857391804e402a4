import pytest
from pyspark.sql import functions as F

from tidemark.operators import detections as D


def frames(spark, scores, name="f", start=0.0, step=0.5):
    return spark.createDataFrame([(name, start + i * step, float(s) if s is not None else None) for i, s in enumerate(scores)], "filename string, offset double, score double")


def scores(df):
    return [round(r["score"], 6) for r in df.orderBy("offset").collect()]


@pytest.mark.parametrize(
    ("given", "win", "expected"),
    [
        ([0.1, 0.2, 0.3, 0.4, 0.5], 3, [0.0, 0.2, 0.3, 0.4, 0.0]),
        ([0, 0, 1, 1, 1, 0], 5, [0.0, 0.0, 0.6, 0.6, 0.0, 0.0]),
        ([1.0, None, 3.0], 3, [0.0, 2.0, 0.0]),
    ],
)
def test_moving_average(spark, given, win, expected):
    assert scores(D.moving_average(frames(spark, given), win)) == expected


def test_even_windows_are_refused(spark):
    with pytest.raises(ValueError, match="odd"):
        D.moving_average(frames(spark, [1]), 2)


def test_groups_by_threshold_and_file(spark):
    one = frames(spark, [0, 0.6, 0.8, 0, 0.9, 0.2])
    got = D.group(one.union(frames(spark, [0.7, 0.7], "g")), [0.5, 0.85], 0.5, 0.0)
    found = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got.collect())
    assert found == [(0.5, "f", 0.5, 1.0, 0.7), (0.5, "f", 2.0, 0.5, 0.9), (0.5, "g", 0.0, 1.0, 0.7), (0.85, "f", 2.0, 0.5, 0.9)]


def test_buffers_stay_within_the_file(spark):
    got = D.group(frames(spark, [0.9, 0, 0, 0.9]), 0.5, 0.5, 1.0).orderBy("start").collect()
    assert [(r["start"], r["duration"]) for r in got] == [(0.0, 1.5), (0.5, 1.5)]


def fold(items):
    out = []
    for s, d, x in sorted(items):
        if out and s <= out[-1][0] + out[-1][1]:
            a = out[-1]
            out[-1] = (a[0], max(a[0] + a[1], s + d) - a[0], 0.5 * (x + a[2]))
        else:
            out.append((s, d, x))
    return out


def test_merge_is_the_left_fold(spark):
    items = [(0.0, 3.0, 0.8), (3.0, 1.0, 0.4), (3.5, 2.0, 0.9), (7.0, 1.0, 0.5), (7.5, 0.2, 0.1)]
    got = D.merge(spark.createDataFrame([("f", *x) for x in items], "filename string, start double, duration double, score double"))
    found = [(r["start"], r["duration"], r["score"]) for r in got.orderBy("start").collect()]
    assert [pytest.approx(x) for x in fold(items)] == found


def test_detect_and_save(spark, tmp_path):
    found = D.detect(frames(spark, [0, 0.9, 0.9, 0.9, 0]), 0.5, win_len=3, grouped=True, merged=True)
    assert found.count() == 1
    D.save(found, str(tmp_path / "out"))
    D.save(found, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert D.detect(frames(spark, [0.9]), 0.5).select(F.col("duration")).first()[0] == 3.0
