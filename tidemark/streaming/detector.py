"""Detections from unbounded streams of scored frames.

``detections`` keeps for each file the frames that its moving average still needs and the island that
is open. Frames of a file arrive in the order of their offsets within a batch or across batches; those
older than what was already emitted are dropped. A file is finished, and its last island emitted, when
no frame came for ``idle``. A query that is to end when it has read what is there (``availableNow``) must
switch batches without data off (spark.sql.streaming.noDataMicroBatches.enabled), and then leaves the
last open islands in its state for the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.schema import DETECTIONS

STATE = "recent array<struct<offset: double, score: double>>, first double, start double, last double, total double, n long, done double"


def frame_stream(spark: SparkSession, path: str, schema: str = "filename string, offset double, score double", files_per_trigger: int = 1) -> DataFrame:
    """Frames that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detections(frames: DataFrame, threshold: float = 0.5, step: float = 0.5, win_len: int = 1, idle: str = "10 minutes") -> DataFrame:
    """(filename, start, duration, score) of each run of smoothed scores at or above the threshold."""
    half = win_len // 2
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, first, start, last, total, n, done = state.get if state.exists else ([], None, None, None, 0.0, 0, -1.0)
        recent = [(float(r[0]), float(r[1])) for r in recent]
        out = []

        def close():
            nonlocal start, total, n
            if start is not None:
                out.append((key[0], start, last + step - start, total / n))
            start, total, n = None, 0.0, 0

        def take(offset: float, score: float):
            nonlocal start, last, total, n, done
            if score >= threshold:
                start = offset if start is None else start
                last, total, n = offset, total + score, n + 1
            else:
                close()
            done = offset

        if not state.hasTimedOut:
            new = pd.concat(list(parts)).sort_values("offset")
            recent = sorted(recent + [(o, s) for o, s in new[["offset", "score"]].itertuples(index=False) if o > done])
            first = recent[0][0] if first is None and recent else first
        # A frame is smoothed once its right neighbours are there; the file's edges count as 0.
        at = next((i for i, (o, _) in enumerate(recent) if o > done), len(recent))
        while at + half < len(recent) or (state.hasTimedOut and at < len(recent)):
            window = recent[max(0, at - half) : at + half + 1]
            take(recent[at][0], sum(s for _, s in window) / win_len if len(window) == win_len else 0.0)
            at += 1
        recent = recent[max(0, at - half) :]
        if state.hasTimedOut:
            close()
            state.remove()
        else:
            state.update((recent, first, start, last, total, n, done))
            state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["filename", "start", "duration", "score"])

    return frames.groupBy("filename").applyInPandasWithState(run, DETECTIONS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts by event-time window and type; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def save_stream(found: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append detections as CSV; the checkpoint makes a restart resume where it stopped."""
    return found.writeStream.outputMode("append").format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_stream(spark: SparkSession, path: str, handle, checkpoint: str):
    """New audio files of a folder, batch by batch, to ``handle(frame_of_files, batch_id)``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
