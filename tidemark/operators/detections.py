"""Detections from scores: moving average, thresholds, islands of frames, merging.

Every operator works within a file, in the order of ``offset``, over one hash partitioning by file. A file
that is too long for one task is cut into ranges of time (``scans``): numbers and running maxima then have two levels, moving
averages get a halo from the neighbours, and a run that crosses a border is put together from its pieces.
``spread`` forces the one or the other; by default the longest file decides. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scans import PART, Parts, has_long_group

#: Least number of frames in one task of a moving average over a long file.
BLOCK = 1 << 16


def moving_average(frames: DataFrame, win_len: int, score: str = "score", spread: bool | None = None) -> DataFrame:
    """Centred mean of an odd number of scores, missing ones left out; 0 where the window is cut off."""
    if win_len % 2 == 0:
        raise ValueError("win_len must be odd")
    half = win_len // 2
    parts = Parts.of(frames, ["filename"], ["offset"], spread)
    if not parts.whole:
        parts = parts.scan(__i=("count", F.lit(1)))
    rows, block, own = parts.blocks("__i", max(BLOCK, 4 * win_len), half)
    w = block.rowsBetween(-half, half)
    clean = F.nanvl(F.col(score), F.lit(None).cast("double"))
    smooth = F.when(F.count(F.lit(1)).over(w) == win_len, F.avg(clean).over(w)).otherwise(F.lit(0.0))
    return rows.withColumn(score, smooth).where(own).select(*frames.columns)


def to_time(first, last, t0, t1, step: float, buffer: float) -> tuple[Column, Column]:
    """Start and duration of frames first..last of a file whose frames run from t0 to t1."""
    start = F.greatest(t0, first * step - buffer + t0)
    end = F.least(t1, last * step + buffer + t0) + step
    return start, end - start


def threshold_frames(frames: DataFrame, threshold: float | list[float], spec_dur: float) -> DataFrame:
    """Each frame at or above the threshold is a detection of its own."""
    return _with_thresholds(frames, threshold).where("score >= threshold").select("threshold", "filename", F.col("offset").alias("start"), F.lit(float(spec_dur)).alias("duration"), "score")


def _with_thresholds(frames: DataFrame, threshold: float | list[float]) -> DataFrame:
    values = [float(t) for t in (threshold if isinstance(threshold, list) else [threshold])]
    return frames.withColumn("threshold", F.explode(F.array(*map(F.lit, values))))


def group(frames: DataFrame, threshold: float | list[float] = 0.5, step: float = 0.5, buffer: float = 0.0, spread: bool | None = None) -> DataFrame:
    """Runs of frames at or above a threshold, as (threshold, filename, start, duration, score).

    Frames are numbered once in a file; a run is where number minus rank among hits stays the same.
    Several thresholds share the numbering.
    """
    parts = Parts.of(frames.select("filename", "offset", "score"), ["filename"], ["offset"], spread)
    numbered = parts.scan(i=("count", F.lit(1))).totals(t0=("min", "offset"), t1=("max", "offset"))
    hits = _with_thresholds(numbered.df.withColumn("i", F.col("i") - 1), threshold).where("score >= threshold")
    ranked = Parts(hits, ["filename", "threshold"], ["i"], numbered.whole).scan(__rank=("count", F.lit(1)))
    runs = ranked.df.withColumn("run", F.col("i") - F.col("__rank"))
    grouped = runs.groupBy("threshold", "filename", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.avg("score").alias("score"))
    start, duration = to_time(F.col("a"), F.col("b"), F.col("t0"), F.col("t1"), step, buffer)
    return grouped.select("threshold", "filename", start.alias("start"), duration.alias("duration"), "score")


def merge(detections: DataFrame, by: tuple[str, ...] = ("filename",), spread: bool | None = None) -> DataFrame:
    """Overlapping or touching detections become one; scores fold from the left, halving each time.

    The fold 0.5 * (next + so far) has fixed weights by place, counted from the end of a run, so it is a weighted
    sum, and that of a run in several pieces is the sum of theirs, halved for every detection that follows.
    """
    ends = detections.withColumn("__end", F.col("start") + F.col("duration"))
    parts = Parts.of(ends, list(by), ["start", "duration", "score"], spread).scan(inclusive=False, __seen=("max", F.col("__end")))
    new = F.when(F.col("__seen").isNull() | (F.col("start") > F.col("__seen")), 1).otherwise(0)
    runs = parts.with_df(parts.df.withColumn("__new", new)).scan(__run=("sum", F.col("__new")))
    piece = [*by, "__run", PART]
    inside = Window.partitionBy(*piece)
    placed = runs.df.withColumns({"__i": F.row_number().over(inside.orderBy(*parts.order)), "__n": F.count("*").over(inside)})
    # The first detection of a run is not halved against anything before it.
    weight = F.pow(F.lit(2.0), F.col("__i") - F.col("__n") - 1 + F.col("__new"))
    pieces = placed.groupBy(*piece).agg(F.min("start").alias("start"), F.max("__end").alias("__end"), F.sum(weight * F.col("score")).alias("score"), F.count("*").alias("__n"))
    if not runs.whole:
        following = Window.partitionBy(*by, "__run").orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
        later = F.coalesce(F.sum("__n").over(following), F.lit(0))
        pieces = pieces.withColumn("score", F.col("score") * F.pow(F.lit(2.0), -later))
        pieces = pieces.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("__end").alias("__end"), F.sum("score").alias("score"))
    return pieces.select(*by, "start", (F.col("__end") - F.col("start")).alias("duration"), "score")


def detect(frames: DataFrame, threshold: float | list[float] = 0.5, win_len: int = 1, grouped: bool = False, merged: bool = False, step: float = 0.5, spec_dur: float = 3.0, buffer: float = 0.0, spread: bool | None = None) -> DataFrame:
    """Scores to detections: smooth, then threshold each frame or group runs, then merge if asked."""
    if spread is None and (win_len > 1 or grouped or merged):
        spread = has_long_group(frames, ["filename"])  # looked at once for all steps
    smooth = moving_average(frames, win_len, spread=spread) if win_len > 1 else frames
    found = group(smooth, threshold, step, buffer, spread) if grouped else threshold_frames(smooth, threshold, spec_dur)
    return merge(found, ("threshold", "filename"), spread) if merged else found


def save(detections: DataFrame, path: str) -> None:
    """Append detections as CSV files with a header each; partitions write in parallel."""
    detections.select("filename", "start", "duration", "score").write.mode("append").csv(path, header=True)
