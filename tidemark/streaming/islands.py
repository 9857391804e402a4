"""Detections from a stream in event time: late and unordered frames, timers, keyed state in RocksDB.

Frames have an event time ``ts`` beside their ``offset`` in the file. They may come in any order within
the watermark's delay; a frame is final when the watermark has passed its time, for then no earlier one can come. Files are dealt by
a hash into groups, so that a call of the stateful processor (``transformWithState``) has many short files to work on at once. It keeps for each group

* a list of chunks of frames: those that are not final yet, and the last ``win_len // 2`` of each file that are (for the moving average),
* a value: the least time among the frames that are not final, and the time of the group's timer,
* a value: for each file its first offset, how many frames are final, the last offset and when it has been idle for long enough; for each threshold
  the runs that are open, and those that are closed but whose end the file's last frame may still cut.

New frames are a new chunk; the others are not touched until the watermark has passed one of them or a file is done. Then
all files of the group are worked on as arrays: smoothed, cut into runs, joined with the open ones. An event-time timer
finishes the files for which no frame came for ``idle`` of event time; what is left of them is emitted and their state goes.
The rows are those of ``detections.detect(..., grouped=True)`` over all frames that were not too late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FOUND = "threshold double, filename string, start double, duration double, score double"

#: What lies beyond all times.
NEVER = 1 << 62
#: Frames in a chunk of state, and windows that are averaged at once.
CHUNK = 1 << 18
_FILES = {"filename": object, "t0": float, "n": "int64", "t1": float, "upto": "int64", "due": "int64"}
_RUNS = {"threshold": float, "file": "int64", "a": "int64", "b": "int64", "total": float, "n": "int64"}
_FRAMES = {"file": "int64", "ts": "int64", "offset": float, "score": float, "final": bool}


def use_rocksdb(spark: SparkSession) -> None:
    """State that is larger than memory, changes of which alone are written: what this processor needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def centred(scores: np.ndarray, win_len: int, place: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Means of the windows around each score, missing scores left out, for stretches one after another; 0 where a window leaves its stretch.

    ``place`` is where a score is in its stretch, ``size`` how long that is.
    """
    half = win_len // 2
    if not half:
        return scores
    out = np.zeros(len(scores))
    whole = np.flatnonzero((place >= half) & (place < size - half))
    for k in range(0, len(whole), CHUNK):
        at = whole[k : k + CHUNK]
        windows = np.lib.stride_tricks.sliding_window_view(scores, win_len)[at - half]
        known = (~np.isnan(windows)).sum(axis=1)
        out[at] = np.where(known > 0, np.nansum(windows, axis=1) / np.maximum(known, 1), np.nan)
    return out


def smooth(scores: np.ndarray, win_len: int, first: bool, last: bool) -> np.ndarray:
    """Centred means of the scores that have all neighbours, missing ones left out; 0 at a file's own edges.

    Without ``first`` (or ``last``) the scores begin (end) inside the file, and those half a window from there are left out.
    """
    half = win_len // 2
    if not half:
        return scores
    n = len(scores)
    out = centred(scores, win_len, np.arange(n), n)
    return out[0 if first else half : n if last else max(0, n - half)]


def _empty(kinds: dict) -> pd.DataFrame:
    return pd.DataFrame({c: np.empty(0, kind) for c, kind in kinds.items()})


def _pack(df: pd.DataFrame, names: np.ndarray | None = None) -> bytes:
    """A table as Arrow's bytes, with the file names that its column ``file`` counts."""
    table = pa.table({c: pa.array(df[c], pa.string()) if c == "filename" else pa.array(df[c].to_numpy()) for c in df})
    if names is not None:
        table = table.set_column(0, "file", pa.DictionaryArray.from_arrays(pa.array(df["file"].to_numpy("int32")), pa.array(names, pa.string())))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


class Islands(StatefulProcessor):
    def __init__(self, thresholds: list[float], step: float, buffer: float, win_len: int, idle_ms: int):
        self.thresholds, self.step, self.buffer, self.win_len, self.idle_ms = thresholds, step, buffer, win_len, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "chunk binary")
        self.times = handle.getValueState("times", "least long, timer long")
        self.files = handle.getValueState("files", "files binary, open binary, closed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new.loc[new["ts"].notna()]
        least, timer = self.times.get() if self.times.exists() else (NEVER, NEVER)
        if len(new):
            codes, names = self._coded(new["filename"].to_numpy(object))
            frames = pd.DataFrame({"file": codes, "ts": new["ts"].to_numpy("int64"), "offset": new["offset"].to_numpy(float), "score": new["score"].to_numpy(float), "final": False})
            self._append(frames, names)
            last = np.full(len(names), -NEVER)
            np.maximum.at(last, codes, frames["ts"].to_numpy())
            least = min(least, int(frames["ts"].min()))
            timer = self._alarm(timer, min(timer, int(last.min()) + self.idle_ms))  # too early for a file with later frames: it is set anew then
            self.times.update((least, timer))
        watermark = timerValues.getCurrentWatermarkInMs()
        if least <= watermark:
            yield from self._work(watermark, timer, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists() and self.times.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._work(timerValues.getCurrentWatermarkInMs(), NEVER, True)  # Spark deletes the timer itself

    def close(self) -> None:
        pass

    def _alarm(self, old: int, new: int) -> int:
        """Move the group's timer."""
        if new != old:
            if old < NEVER:
                self.handle.deleteTimer(old)
            if new < NEVER:
                self.handle.registerTimer(new)
        return new

    @staticmethod
    def _coded(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each name's number, and the names; null is one of them."""
        codes, found = pd.factorize(names, use_na_sentinel=False)
        return codes, np.where(pd.isna(found), None, found)

    def _append(self, frames: pd.DataFrame, names: np.ndarray) -> None:
        for k in range(0, len(frames), CHUNK):
            self.frames.appendValue((_pack(frames.iloc[k : k + CHUNK], names),))

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, pd.DataFrame]:
        """The group's files, with those that are new; its frames; its open and its closed runs."""
        files, open_, closed = (_unpack(x).to_pandas() for x in self.files.get()) if self.files.exists() else (_empty(_FILES), _empty(_RUNS), _empty(_RUNS))
        chunks = [_unpack(r[0]) for r in self.frames.get()] if self.frames.exists() else []
        dictionaries = [c.column("file").combine_chunks().dictionary.to_numpy(zero_copy_only=False) for c in chunks]
        codes, names = self._coded(np.concatenate([files["filename"].to_numpy(object), *dictionaries]))
        more = len(names) - len(files)  # the files' own names come first, each once
        start = pd.DataFrame({"filename": names[len(files) :], "t0": np.nan, "n": np.zeros(more, "int64"), "t1": np.nan, "upto": -NEVER, "due": -NEVER})
        at, parts = len(files), []
        for c, d in zip(chunks, dictionaries, strict=True):
            part = {k: c.column(k).to_numpy() for k in list(_FRAMES)[1:]}
            parts.append({"file": codes[at : at + len(d)][c.column("file").combine_chunks().indices.to_numpy()], **part})
            at += len(d)
        frames = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in _FRAMES}) if parts else _empty(_FRAMES)
        files = pd.concat([files, start], ignore_index=True) if len(files) else start
        return files, frames, open_, closed

    def _work(self, watermark: int, timer: int, expired: bool) -> Iterator[pd.DataFrame]:
        """Take in what is final, finish idle files if the timer has expired, emit the runs that can't change any more, keep the rest."""
        files, held, open_, closed = self._held()
        half, count = self.win_len // 2, len(files)
        n, t0, t1, upto, due = (files[c].to_numpy().copy() for c in ("n", "t0", "t1", "upto", "due"))
        file, ts, final = held["file"].to_numpy(), held["ts"].to_numpy(), held["final"].to_numpy()
        known = final | (ts > upto[file])  # what was final is not opened again
        held, file, ts, final = held[known], file[known], ts[known], final[known]
        np.maximum.at(due, file[~final], ts[~final] + self.idle_ms)
        end = (due <= watermark) & expired
        order = np.lexsort((held["offset"].to_numpy(), ~final, file))
        held, file, ts, final = held.iloc[order], file[order], ts[order], final[order]
        ready = final | (ts <= watermark) | end[file]
        now, rest = held[ready], held[~ready]
        # Each file's final frames are one stretch of the arrays.
        file, offset, score = file[ready], now["offset"].to_numpy(), now["score"].to_numpy()
        size = np.bincount(file, minlength=count)
        first = np.cumsum(size) - size
        some = size > 0
        t0[some] = np.where(np.isnan(t0[some]), offset[first[some]], t0[some])
        t1[some] = offset[(first + size - 1)[some]]
        np.maximum.at(upto, file, ts[ready])
        # Frames n, n + 1, ... get their smoothed scores now; up to half a window of them before is kept.
        place, lead = np.arange(len(file)) - first[file], np.minimum(half, n)
        to = np.where(end, size, size - half)
        smoothed = (place >= lead[file]) & (place < to[file])
        value = centred(score, self.win_len, place, size[file])
        index = (n - lead)[file] + place
        done = np.bincount(file[smoothed], minlength=count)
        n += done
        over, still = self._runs(value[smoothed], file[smoothed], index[smoothed], open_, n, end)
        waiting, out = self._settled(pd.concat([x for x in (closed, over) if len(x)] or [closed], ignore_index=True), files["filename"].to_numpy(object), t0, t1, end)
        keep = now[(place >= np.maximum(0, lead + done - half)[file]) & ~end[file]].assign(final=True) if half else now.iloc[:0]
        files = files.assign(n=n, t0=t0, t1=t1, upto=upto, due=due)[~end]
        self.frames.clear()
        if len(files):
            code = np.cumsum(~end) - 1
            left = pd.concat([x for x in (keep, rest) if len(x)] or [rest], ignore_index=True)
            self._append(left.assign(file=code[left["file"].to_numpy("int64")]), files["filename"].to_numpy(object))
            self.files.update((_pack(files), *(_pack(x.assign(file=code[x["file"].to_numpy("int64")])) for x in (still, waiting))))
            least = int(rest["ts"].min()) if len(rest) else NEVER
            self.times.update((least, self._alarm(timer, int(due[~end].min()))))
        else:
            self._alarm(timer, NEVER)
            self.files.clear()
            self.times.clear()
        if len(out):
            yield out

    def _runs(self, scores: np.ndarray, file: np.ndarray, index: np.ndarray, open_: pd.DataFrame, n: np.ndarray, end: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Runs of all thresholds that are over, and those that are open."""
        parts = [open_] if len(open_) else []
        for threshold in self.thresholds:
            hit = np.flatnonzero(scores >= threshold)
            if len(hit):
                of = file[hit]
                new = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(of) != 0)])
                last = np.r_[new[1:], len(hit)] - 1
                parts.append(pd.DataFrame({"threshold": threshold, "file": of[new], "a": index[hit[new]], "b": index[hit[last]], "total": np.add.reduceat(scores[hit], new), "n": last - new + 1}))
        if not parts:
            return open_, open_
        runs = pd.concat(parts, ignore_index=True).sort_values(["threshold", "file", "a"], ignore_index=True)
        # A run goes on with the one before if that ends just before it: only open ones do.
        before = runs.shift()
        new = np.flatnonzero(~((runs["threshold"] == before["threshold"]) & (runs["file"] == before["file"]) & (runs["a"] == before["b"] + 1)).to_numpy())
        last = np.r_[new[1:], len(runs)] - 1
        sums = {c: np.add.reduceat(runs[c].to_numpy(), new) for c in ("total", "n")}
        runs = runs.iloc[new].assign(b=runs["b"].to_numpy()[last], **sums)[list(_RUNS)]
        of = runs["file"].to_numpy()
        still = (runs["b"].to_numpy() == n[of] - 1) & ~end[of]
        return runs[~still], runs[still]

    def _settled(self, runs: pd.DataFrame, names: np.ndarray, t0: np.ndarray, t1: np.ndarray, end: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The runs whose end the file's last frame may still cut, and rows of the others."""
        of = runs["file"].to_numpy("int64")
        full = runs["b"].to_numpy() * self.step + self.buffer + t0[of]
        done = end[of] | (t1[of] >= full)
        over, of, full = runs[done], of[done], full[done]
        start = np.maximum(t0[of], over["a"].to_numpy() * self.step - self.buffer + t0[of])
        out = {"threshold": over["threshold"].to_numpy(), "filename": names[of], "start": start, "duration": np.minimum(t1[of], full) + self.step - start, "score": over["total"].to_numpy() / over["n"].to_numpy()}
        return runs[~done], pd.DataFrame(out)


def detections(frames: DataFrame, threshold: float | list[float] = 0.5, step: float = 0.5, buffer: float = 0.0, win_len: int = 1, late: str = "10 minutes", idle: str = "10 minutes", groups: int = 1024) -> DataFrame:
    """Runs of (smoothed) scores at or above each threshold in a stream of (filename, ts, offset, score).

    ``groups`` is how many groups files are dealt into: so many tasks can share the work, and a group's frames are in memory
    together. It stays the same as long as a checkpoint is used.
    """
    if win_len % 2 == 0:
        raise ValueError("win_len must be odd")
    values = [float(t) for t in (threshold if isinstance(threshold, list) else [threshold])]
    processor = Islands(values, float(step), float(buffer), win_len, int(pd.Timedelta(idle).total_seconds() * 1000))
    group = F.pmod(F.xxhash64("filename"), F.lit(groups)).cast("int").alias("group")
    timed = frames.withWatermark("ts", late).select(group, "filename", F.unix_millis("ts").alias("ts"), "offset", "score", F.col("ts").alias("event_time"))
    return timed.groupBy("group").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")


def event_times(frames: DataFrame, origin: str = "2000-01-01") -> DataFrame:
    """Frames with an event time, as if all files were recorded from ``origin`` on."""
    return frames.withColumn("ts", F.timestamp_millis(F.unix_millis(F.lit(origin).cast("timestamp")) + F.round(F.col("offset") * 1000).cast("long")))
