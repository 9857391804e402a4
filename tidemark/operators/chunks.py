"""Signals of any length as rows of chunks: frames with a halo, recursive filters by prefix scans.

A signal is rows (id, chunk, data) with chunks 0, 1, 2, ... of ``size`` samples each, the last one shorter. No operation holds
a signal: what a chunk needs of its neighbours is sent by (id, chunk), and a linear recurrence runs in three steps:

1. each chunk is solved from a zero state and leaves its last values,
2. the state before every chunk is an affine prefix scan over these (``state' = T state + end``, where T is the recurrence's matrix
   to the power of the chunk's length): folded in groups of ``GROUP`` chunks, the groups' own ends in groups again, and so on,
3. each chunk is solved again from the state before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays

#: Chunks whose states are folded together.
GROUP = 128


def to_chunks(signals: DataFrame, size: int, id: str = "id", data: str = "data") -> DataFrame:
    """Arrays cut into chunks; an empty array has none."""
    count = F.ceil(F.size(data) / F.lit(float(size))).cast("int")
    cut = signals.where(F.size(data) > 0).select(F.col(id).alias("id"), data, F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return cut.select("id", F.col("chunk").cast("long").alias("chunk"), F.slice(data, F.col("chunk") * size + 1, size).cast("array<double>").alias("data"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """(id, data): signals whole again, for those that fit into a row."""
    parts = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"))
    return parts.select("id", F.flatten(F.transform("parts", lambda p: p["data"])).alias("data"))


def with_halo(chunks: DataFrame, size: int, left: int = 0, right: int = 0) -> DataFrame:
    """Chunks with ``left`` samples before and ``right`` after them, as far as there are such: (id, chunk, data, before, wide).

    ``before`` says how many samples of ``wide`` lie before the chunk. A chunk sends its ends to those that need them.
    """
    sent = [F.struct(F.lit(0).alias("to"), F.col("data").alias("part"))]
    for d in range(1, -(-left // size) + 1):
        n = min(size, left - (d - 1) * size)
        sent.append(F.struct(F.lit(d).alias("to"), F.slice("data", F.greatest(F.size("data") - n, F.lit(0)) + 1, n).alias("part")))
    for d in range(1, -(-right // size) + 1):
        n = min(size, right - (d - 1) * size)
        sent.append(F.struct(F.lit(-d).alias("to"), F.slice("data", 1, n).alias("part")))
    rows = chunks.withColumn("__s", F.explode(F.array(*sent))).select("id", (F.col("chunk") + F.col("__s.to")).alias("chunk"), (-F.col("__s.to")).alias("__from"), F.col("__s.part").alias("__part"))
    met = rows.groupBy("id", "chunk").agg(F.array_sort(F.collect_list(F.struct("__from", "__part"))).alias("__parts"))
    own = F.get(F.filter("__parts", lambda p: p["__from"] == 0), F.lit(0))["__part"]
    before = F.aggregate(F.filter("__parts", lambda p: p["__from"] < 0), F.lit(0), lambda s, p: s + F.size(p["__part"]))
    wide = F.flatten(F.transform("__parts", lambda p: p["__part"]))
    return met.where(own.isNotNull()).select("id", "chunk", own.alias("data"), before.alias("before"), wide.alias("wide"))


def frames(chunks: DataFrame, size: int, win: int, step: int) -> DataFrame:
    """(id, frame, data): all whole frames of ``win`` samples every ``step``. A frame is made where its first sample is."""
    wide = with_halo(chunks, size, 0, win - 1)
    at = F.col("chunk") * size
    first = F.ceil(at / F.lit(float(step))).cast("long")
    last = F.floor((at + F.least(F.size("data"), F.size("wide") - win + 1) - 1) / F.lit(float(step))).cast("long")
    cut = wide.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    return cut.select("id", "frame", F.slice("wide", (F.col("frame") * step - at + 1).cast("int"), win).alias("data"))


def spectra(chunks: DataFrame, size: int, win: int, step: int, window: str = "hamming") -> DataFrame:
    """(id, frame, data): magnitudes of the Fourier transform of each frame."""
    return frames(chunks, size, win, step).select("id", "frame", arrays.dft_magnitude("data", win, window).alias("data"))


def recurrence(chunks: DataFrame, size: int, feedback: list[float], init: DataFrame | None = None) -> DataFrame:
    """``y[i] = x[i] + feedback[0] * y[i-1] + ...`` along each signal; ``init`` has (id, state), the values before the first."""
    order = len(feedback)
    solved = chunks.select("id", "chunk", arrays.linear_recurrence("data", feedback).alias("y"))
    end = F.array(*[F.coalesce(F.get("y", F.size("y") - 1 - j), F.lit(0.0)) for j in range(order)])
    states = _states(solved.select("id", "chunk", end.alias("end")), np.linalg.matrix_power(_companion(feedback), size), init)
    joined = chunks.join(states, ["id", "chunk"])
    return joined.select("id", "chunk", arrays.linear_recurrence("data", feedback, [F.get("state", F.lit(j)) for j in range(order)]).alias("data"))


def _companion(feedback: list[float]) -> np.ndarray:
    out = np.eye(len(feedback), k=-1)
    out[0] = feedback
    return out


def _times(m: np.ndarray, state: Column) -> list[Column]:
    return [sum((float(m[i, j]) * F.get(state, F.lit(j)) for j in range(m.shape[1])), F.lit(0.0)) for i in range(m.shape[0])]


def _states(ends: DataFrame, turn: np.ndarray, init: DataFrame | None) -> DataFrame:
    """(id, chunk, state before the chunk), where a chunk's state is ``turn`` times the one before plus its end."""
    order = len(turn)
    most = ends.agg(F.max("chunk")).first()[0] or 0
    grouped = ends.groupBy("id", F.floor(F.col("chunk") / GROUP).alias("group")).agg(F.array_sort(F.collect_list(F.struct("chunk", "end"))).alias("ends"))
    none = F.struct(F.array(*[F.lit(0.0)] * order).alias("s"), F.array().cast("array<array<double>>").alias("all"))
    step = lambda a, e: F.struct(F.array(*[x + F.get(e["end"], F.lit(i)) for i, x in enumerate(_times(turn, a["s"]))]).alias("s"), F.array_append(a["all"], a["s"]).alias("all"))
    folded = grouped.select("id", "group", "ends", F.aggregate("ends", none, step).alias("f")).select("id", "group", F.arrays_zip(F.col("ends.chunk").alias("chunk"), F.col("f.all").alias("state")).alias("chunks"), F.col("f.s").alias("end"))
    if most < GROUP:
        outer = folded.select("id", "group")
        outer = outer.join(init.select("id", "state"), "id", "left") if init is not None else outer.withColumn("state", F.lit(None).cast("array<double>"))
        outer = outer.select("id", "group", F.coalesce("state", F.array(*[F.lit(0.0)] * order)).alias("outer"))
    else:
        upper = _states(folded.select("id", F.col("group").alias("chunk"), "end"), np.linalg.matrix_power(turn, GROUP), init)
        outer = upper.select("id", F.col("chunk").alias("group"), F.col("state").alias("outer"))
    powers = [np.linalg.matrix_power(turn, k) for k in range(GROUP)]
    table = [[F.lit([float(p[i, j]) for p in powers]) for j in range(order)] for i in range(order)]
    rows = folded.join(outer, ["id", "group"]).select("id", "outer", F.explode("chunks").alias("c")).select("id", F.col("c.chunk").alias("chunk"), "outer", F.col("c.state").alias("own"))
    k = (F.col("chunk") % GROUP).cast("int")
    state = [F.get("own", F.lit(i)) + sum((F.get(table[i][j], k) * F.get("outer", F.lit(j)) for j in range(order)), F.lit(0.0)) for i in range(order)]
    return rows.select("id", "chunk", F.array(*state).alias("state"))


def running_residual(chunks: DataFrame, size: int, time_const: float) -> DataFrame:
    """Signals less their exponential background, which starts at the signal's mean (``arrays.ema_residual``)."""
    eps = 1 - float(np.exp(np.log(0.15) / time_const))
    sums = chunks.select("id", F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("s"), F.size("data").alias("n"))
    means = sums.groupBy("id").agg(F.array(F.sum("s") / F.sum("n")).alias("state"))
    scaled = chunks.select("id", "chunk", F.transform("data", lambda v: eps * v).alias("data"))
    after = recurrence(scaled, size, [1 - eps], means)
    wide = with_halo(after, size, 1).select("id", "chunk", F.when(F.col("before") > 0, F.slice("wide", 1, F.size("data"))).otherwise(F.slice("data", 1, F.size("data") - 1)).alias("bg"))
    joined = chunks.join(wide, ["id", "chunk"]).join(means, "id")
    bg = F.when(F.col("chunk") == 0, F.concat("state", "bg")).otherwise(F.col("bg"))
    return joined.select("id", "chunk", F.zip_with("data", bg, lambda v, b: v - b).alias("data"))


def filter_signal(chunks: DataFrame, size: int, forward: list[float], back: list[float]) -> DataFrame:
    """A recursive filter from rest: ``y[i] = forward[0] x[i] + forward[1] x[i-1] + ... - back[0] y[i-1] - back[1] y[i-2] - ...``."""
    taps = len(forward) - 1
    wide = with_halo(chunks, size, taps) if taps else chunks.withColumns({"before": F.lit(0), "wide": F.col("data")})
    value = lambda i: sum((float(f) * F.when(i + F.col("before") - j >= 0, F.get("wide", i + F.col("before") - j)).otherwise(F.lit(0.0)) for j, f in enumerate(forward)), F.lit(0.0))
    mixed = wide.select("id", "chunk", F.transform("data", lambda v, i: value(i)).alias("data"))
    return recurrence(mixed, size, [-float(b) for b in back]) if back else mixed
