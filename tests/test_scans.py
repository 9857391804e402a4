"""Files longer than a task: cut into ranges, they give the rows that whole files give."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import annotations as A
from tidemark.operators import detections as D
from tidemark.operators import intervals as I
from tidemark.operators import scans


@pytest.fixture(scope="module")
def frames(spark):
    """One long file, a short one, one of a single frame, and frames without a file."""
    n = F.xxhash64(F.lit(3), "id")
    name = F.when(F.col("id") < 20_000, "long").when(F.col("id") < 20_300, "short").when(F.col("id") == 20_300, "one")
    rows = spark.range(20_400).select(name.alias("filename"), (F.col("id") * 0.5).alias("offset"), F.when(n % 11 != 0, F.abs(n % 100) / 100).alias("score"))
    return rows.repartition(6).cache()


@pytest.fixture(scope="module")
def spans(frames):
    """Intervals with gaps, nests, ties and chains that run over many ranges."""
    h = F.abs(F.xxhash64(F.lit(9), "offset"))
    long = F.when(h % 97 == 0, 400.0).when(h % 5 == 0, 0.0).otherwise(F.col("offset") % 0.7)
    return frames.where("filename IS NOT NULL").select("filename", F.floor(F.col("offset")).alias("start"), long.alias("duration"), "score", (h % 3).alias("label"))


def same(one, other):
    clean = lambda df: sorted(str([round(x, 7) if isinstance(x, float) else x for x in r]) for r in df.collect())
    a, b = clean(one), clean(other)
    assert a and a == b


@pytest.mark.parametrize("win_len", [3, 51, 999])
def test_moving_average(frames, win_len, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 700)
    same(D.moving_average(frames, win_len, spread=True), D.moving_average(frames, win_len, spread=False))


@pytest.mark.parametrize("threshold", [0.5, [0.0, 0.03, 0.99]])
def test_groups(frames, threshold):
    """Threshold 0 gives one run through all ranges of the long file (but for missing scores)."""
    filled = frames.fillna(0.5)
    for f in (frames, filled):
        same(D.group(f, threshold, 0.5, 1.0, spread=True), D.group(f, threshold, 0.5, 1.0, spread=False))
    assert D.group(filled, 0.0, spread=True).where("filename = 'long'").count() == 1


def test_merge_and_union(spans):
    same(D.merge(spans.drop("label"), spread=True), D.merge(spans.drop("label"), spread=False))
    ends = spans.withColumn("end", F.col("start") + F.col("duration"))
    for by in (None, ["filename"], ["label"]):
        same(I.union_duration(ends, by=by, spread=True), I.union_duration(ends, by=by, spread=False))
    chain = spans.withColumn("duration", F.lit(5.0))
    same(D.merge(chain, spread=True), D.merge(chain, spread=False))
    assert D.merge(chain.where("filename = 'long'"), spread=True).count() == 1


def test_ordinals_and_all_steps(frames, spans):
    order = ["start", "duration", F.col("score"), "label"]
    same(A.ordinal(spans, "k", order, spread=True), A.ordinal(spans, "k", order, spread=False))
    same(*(D.detect(frames, [0.4, 0.6], 5, True, True, buffer=0.2, spread=s) for s in (True, False)))


def test_long_groups_are_found_and_spread_over_tasks(frames):
    assert not scans.has_long_group(frames, ["filename"], small=0) and scans.has_long_group(frames, ["filename"], limit=10_000, small=0)
    parts = scans.Parts.of(frames, ["filename"], ["offset"], True)
    sizes = [r[0] for r in parts.df.where("filename = 'long'").groupBy(scans.PART).count().select("count").collect()]
    assert len(sizes) >= 3 and max(sizes) < 10_000


def test_empty_tables(frames, spans):
    for s in (True, False):
        assert D.group(frames.limit(0), spread=s).count() == 0 and D.merge(spans.limit(0), spread=s).count() == 0 and D.moving_average(frames.limit(0), 3, spread=s).count() == 0
        assert I.union_duration(spans.withColumn("end", F.col("start")).limit(0), spread=s).first()[0] == 0.0
