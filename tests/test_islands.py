"""The event-time stream against the batch operators: unordered files, late frames, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detections as D
from tidemark.streaming import islands


@pytest.fixture(autouse=True)
def rocksdb(spark):
    islands.use_rocksdb(spark)
    yield
    spark.conf.unset(islands.PROVIDER)


def _write(spark, path, rows, files, seed=1):
    """Frames dealt at random over files that are read one after another; a last one far ahead moves the watermark."""
    rng = random.Random(seed)
    parts = [[] for _ in range(files)]
    for r in rows:
        parts[rng.randrange(files)].append(r)
    for part in [*parts, [("end", 1e6, 0.0)]]:
        frames = spark.createDataFrame(part, "filename string, offset double, score double")
        islands.event_times(frames).coalesce(1).write.mode("append").parquet(path)


def _rows(n=140, names=("a", "b", "c")):
    rng = random.Random(7)
    return [(f, i * 0.5 + 3.0, None if rng.random() < 0.03 else round(min(1.0, max(0.0, rng.gauss(0.5, 0.3))), 3)) for f in names for i in range(n)] + [("one", 2.0, 0.9)]


def _stream(spark, path, out, state, per=1, stop_after=None, **options):
    frames = spark.readStream.schema("filename string, offset double, score double, ts timestamp").option("maxFilesPerTrigger", per).parquet(path)
    found = islands.detections(frames, late="400 seconds", idle="30 seconds", **options)

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if stop_after is not None and number == stop_after:
            raise RuntimeError("lost")

    return found.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()


def _found(df):
    return sorted((r["threshold"], r["filename"], round(r["start"], 6), round(r["duration"], 6), round(r["score"], 6)) for r in df.collect() if r["filename"] != "end")


def _batch(spark, rows, threshold, win_len=1, **options):
    frames = spark.createDataFrame(rows, "filename string, offset double, score double")
    return _found(D.group(D.moving_average(frames, win_len) if win_len > 1 else frames, threshold, **options))


@pytest.mark.parametrize(("win_len", "buffer"), [(1, 0.0), (5, 1.0)])
def test_unordered_files_give_the_batch_rows(spark, tmp_path, win_len, buffer):
    rows = _rows()
    _write(spark, f"{tmp_path}/in", rows, 3)
    assert _stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", threshold=[0.4, 0.7], win_len=win_len, buffer=buffer).awaitTermination(180)
    assert _found(spark.read.parquet(f"{tmp_path}/out")) == _batch(spark, rows, [0.4, 0.7], win_len, step=0.5, buffer=buffer)


def test_a_stream_that_fails_goes_on_where_it_was(spark, tmp_path):
    rows = _rows(90, ("a", "b"))
    _write(spark, f"{tmp_path}/in", rows, 4)
    lost = _stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", stop_after=2, threshold=0.5, win_len=3)
    with pytest.raises(Exception, match="lost"):
        lost.awaitTermination(180)
    assert _stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", threshold=0.5, win_len=3).awaitTermination(180)
    assert _found(spark.read.parquet(f"{tmp_path}/out")) == _batch(spark, rows, 0.5, 3, step=0.5)


def test_frames_come_out_as_the_watermark_passes(spark, tmp_path):
    """Runs are emitted before the file's end, and frames behind the watermark are dropped."""
    for part in ([("a", i * 0.5, float(i % 10 < 4)) for i in range(0, 2000)], [("a", i * 0.5, float(i % 10 < 4)) for i in range(2000, 2400)], [("a", 1.25, 1.0), ("a", 1200.0, 0.0)]):
        islands.event_times(spark.createDataFrame(part, "filename string, offset double, score double")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert _stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", threshold=0.5).awaitTermination(180)
    got = _found(spark.read.parquet(f"{tmp_path}/out"))
    assert 100 < len(got) < 240 and {(r[2] % 5, r[3], r[4]) for r in got} == {(0.0, 2.0, 1.0)}


def test_smoothing_of_pieces():
    import numpy as np

    x = np.arange(9.0)
    assert islands.smooth(x, 3, True, True).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 0]
    assert islands.smooth(x, 3, False, False).tolist() == [1, 2, 3, 4, 5, 6, 7] and islands.smooth(x[:1], 3, True, False).tolist() == [] and islands.smooth(x[:2], 3, True, True).tolist() == [0, 0]


class _State:
    """A state variable or a handle in memory, which counts what is asked of it."""

    asked = 0

    def __init__(self):
        self.value, self.timers = None, set()

    def getListState(self, *_):
        return _State()

    getValueState = getMapState = getListState

    def exists(self):
        _State.asked += 1
        return self.value is not None

    def get(self):
        _State.asked += 1
        return self.value

    def update(self, value):
        _State.asked += 1
        self.value = value

    def appendValue(self, value):
        self.update([*(self.value or ()), value])

    def clear(self):
        self.update(None)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_many_short_files_are_worked_on_together(spark):
    """2000 files in one group, in three unordered parts: a few questions to the state for all of them, and the rows of the batch operator."""
    from types import SimpleNamespace as Answers

    import pandas as pd

    rng = random.Random(5)
    rows = [(f"f{f}", i * 0.5, round(rng.random(), 3)) for f in range(2000) for i in range(1 + f % 9)]
    parts = [[] for _ in range(3)]
    for r in rows:
        parts[rng.randrange(3)].append((r[0], int(r[1] * 1000), r[1], r[2]))
    handle, processor = _State(), islands.Islands([0.4, 0.7], 0.5, 0.25, 3, 60_000)
    processor.init(handle)
    _State.asked, out = 0, []
    at = lambda w: Answers(getCurrentWatermarkInMs=lambda: w)
    for part in parts:
        out += processor.handleInputRows((0,), iter([pd.DataFrame(part, columns=["filename", "ts", "offset", "score"])]), at(-1))
    while due := [t for t in handle.timers if t <= 10**6]:
        out += processor.handleExpiredTimer((0,), at(10**6), Answers(getExpiryTimeInMs=lambda t=due[0]: t))
        handle.timers.discard(due[0])
    assert _State.asked < 40 and not handle.timers
    assert _found(spark.createDataFrame(pd.concat(out))) == _batch(spark, rows, [0.4, 0.7], 3, step=0.5, buffer=0.25)
