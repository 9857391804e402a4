"""WAV files of any length as rows of chunks: a Python data source for batches and streams.

``spark.read.format("wav")`` splits files by ranges of bytes, as Spark splits text, and packs small files together;
nobody holds a file. A row is a chunk of ``chunk`` frames, whichever task reads it: a chunk belongs to the range that its first
byte lies in. Tasks read headers themselves, so the driver only lists names and sizes. Filters on filename, start and end
reach the reader: other files are not opened, and other chunks not read. ``readStream`` takes up files as they come.

Folders are opened by pyarrow, so any store that it knows works. PCM of 8 to 32 bits and floats are read, plain or
extensible, in RIFF or (beyond 4 GB) RF64 form; a data part of unknown size goes to the file's end. A file that is
no WAV is one row with an ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

CHUNK = 1 << 16
#: Bytes of files in one partition.
RANGE = 64 << 20
#: Samples that leave a task together.
BATCH = 1 << 20

CHUNKS = "filename string, path string, rate int, chunk bigint, first bigint, start double, `end` double, data array<double>, error string"
HEADERS = "filename string, path string, rate int, channels int, width int, frames bigint, duration double, error string"
_ARROW = pa.schema([("filename", pa.string()), ("path", pa.string()), ("rate", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("data", pa.list_(pa.float64())), ("error", pa.string())])


class NotWav(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    rate: int
    channels: int
    width: int
    real: bool
    at: int
    frames: int

    @property
    def block(self) -> int:
        return self.channels * self.width


def layout(file, size: int) -> Layout:
    """Where the samples of an open WAV file are; reads the heads of its parts alone."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise NotWav("no RIFF WAVE header")
    at, form, long = 12, None, None
    while at + 8 <= size:
        kind, n = struct.unpack("<4sI", read(at, 8))
        if kind == b"ds64":
            long = struct.unpack("<Q", read(at + 16, 8))[0]
        elif kind == b"fmt ":
            raw = read(at + 8, min(n, 40))
            if len(raw) < 16:
                break
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            code = struct.unpack("<H", raw[24:26])[0] if code == 0xFFFE and len(raw) >= 26 else code
            form = code, channels, rate, -(-bits // 8)
        elif kind == b"data":
            if form is None:
                raise NotWav("samples before their format")
            code, channels, rate, width = form
            if not rate or not channels or (code, width) not in {(1, 1), (1, 2), (1, 3), (1, 4), (3, 4), (3, 8)}:
                raise NotWav(f"format {code} with {8 * width} bits")
            n = long if n == 0xFFFFFFFF and long is not None else n
            n = size - at - 8 if n in (0xFFFFFFFF, 0) or n > size - at - 8 else n
            return Layout(rate, channels, width, code == 3, at + 8, n // (channels * width))
        at += 8 + n + n % 2
    raise NotWav("no samples")


def samples(raw: bytes, form: Layout, channel: int = 0) -> np.ndarray:
    """Samples of one channel, whole numbers scaled to [-1, 1)."""
    if form.real:
        x = np.frombuffer(raw, f"<f{form.width}").astype(float)
    elif form.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif form.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{form.width}").astype(float) / 2.0 ** (8 * form.width - 1)
    return x.reshape(-1, form.channels)[:, channel]


@dataclass
class Ranges(InputPartition):
    """(path, file size, first byte, end) of the parts of files that one task reads."""

    parts: list

    def __init__(self, parts: list):
        self.parts = parts


def _store(path: str):
    from pyarrow import fs

    path = path.replace("file:", "file://", 1) if path.startswith("file:") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _listed(options: dict) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of the WAV files in the folder, or of the one file."""
    from pyarrow import fs

    store, root = _store(options["path"])
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(options["path"])
    deep = str(options.get("recursive", "false")).lower() == "true"
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=deep))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.is_file and f.path.lower().endswith(".wav"))


def _ranged(files: list[tuple[str, int]], size: int, together: int, whole: bool = False) -> list[Ranges]:
    """Files cut into parts of at most ``size`` bytes, and parts of about ``together`` bytes for each task."""
    out, held, n = [], [], 0
    for path, length in files:
        for low in range(0, 1 if whole else max(1, length), size):
            high = length if whole else min(length, low + size)
            held.append((path, length, low, high))
            n += min(size, high - low)
            if n >= together:
                out.append(Ranges(held))
                held, n = [], 0
    return [*out, Ranges(held)] if held else out


_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


class _Chunks:
    """Reads ranges of files; shared by batches and streams."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.chunk, self.channel = int(options.get("chunk", CHUNK)), int(options.get("channel", 0))
        self.range, self.heads = int(options.get("rangebytes", RANGE)), options.get("heads", "false") == "true"
        self.together = int(options.get("taskbytes", self.range))
        self.tests: list[tuple[str, type, object]] = []

    def passes(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, v) for c, kind, v in self.tests if c == column)

    def read(self, partition: Ranges) -> Iterator:
        store = _store(self.options["path"])[0]
        rows, n = [], 0
        for path, size, low, high in partition.parts:
            name = path.rsplit("/", 1)[-1]
            if not self.passes("filename", name):
                continue
            with store.open_input_file(path) as file:
                try:
                    form = layout(file, size)
                except NotWav as e:
                    if low == 0 and not any(c in ("start", "end") for c, _, _ in self.tests):
                        if self.heads:
                            yield (name, path, None, None, None, None, None, str(e))
                        else:
                            rows.append((name, path, None, None, None, None, None, None, str(e)))
                    continue
                if self.heads:
                    yield (name, path, form.rate, form.channels, form.width, form.frames, form.frames / form.rate, None)
                    continue
                step = self.chunk * form.block
                k = 0 if low == 0 else max(1, -((form.at - low) // step))
                while k * self.chunk < form.frames and (k == 0 or form.at + k * step < high):
                    first, stop = k * self.chunk, min(form.frames, (k + 1) * self.chunk)
                    k += 1
                    if not (self.passes("start", first / form.rate) and self.passes("end", stop / form.rate)):
                        continue
                    file.seek(form.at + first * form.block)
                    x = samples(file.read((stop - first) * form.block), form, self.channel)
                    rows.append((name, path, form.rate, k - 1, first, first / form.rate, stop / form.rate, x, None))
                    n += len(x)
                    if n >= BATCH:
                        yield _batch(rows)
                        rows, n = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WavReader(_Chunks, DataSourceReader):
    def pushFilters(self, filters):
        """Comparisons of filename, start and end are done here; Spark does the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and column in (("filename",) if self.heads else ("filename", "start", "end")):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self):
        files = [(p, n) for p, n, _ in _listed(self.options) if self.passes("filename", p.rsplit("/", 1)[-1])]
        return _ranged(files, 1 << 30, 1 << 30, True) if self.heads else _ranged(files, self.range, self.together)


class WavStream(_Chunks, DataSourceStreamReader):
    """Files in the order in which they were last changed; an offset is the last one that was taken."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((t, p) for p, _, t in _listed(self.options)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict):
        after, upto = ((x["changed"], x["path"]) for x in (start, end))
        return _ranged([(p, n) for p, n, t in _listed(self.options) if after < (t, p) <= upto], self.range, self.together)


class WavSource(DataSource):
    """Options: path, recursive, chunk (frames in a row), rangeBytes (of one part of a file), taskBytes (of one task's parts), channel; heads=true gives a row for each file from headers alone."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADERS if self.options.get("heads", "false") == "true" else CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def streamReader(self, schema) -> WavStream:
        return WavStream(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("wav")`` known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


def chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("wav").options(**options).load(path)


def heads(spark: SparkSession, path: str, **options) -> DataFrame:
    """(filename, path, rate, channels, width, frames, duration, error), from the files' headers alone."""
    return chunks(spark, path, heads="true", **options)


def load_windows(spark: SparkSession, path: str, selections: DataFrame, chunk: int = CHUNK, mode: str = "reflect", **options) -> DataFrame:
    """Selections (filename, start, end, ...) with ``rate`` and ``data``, cut from chunks that hold part of them.

    A window's chunks follow from its times, so windows and chunks meet by (filename, chunk) however long the files are.
    What lies outside a file is mirrored or, with another mode, 0. Files that are missing or no WAV give null data.
    """
    rate_of = heads(spark, path, **options).where("error IS NULL").select(F.col("filename").alias("__name"), F.col("rate"), F.col("frames").alias("__frames"))
    keyed = selections.withColumn("__key", F.struct(*selections.columns))
    sized = keyed.join(rate_of, F.col("filename") == F.col("__name"), "left").drop("__name")
    first, n = F.round(F.col("start") * F.col("rate")).cast("long"), F.round((F.col("end") - F.col("start")) * F.col("rate")).cast("long")
    low, high = F.least(F.greatest(first, F.lit(0)), F.col("__frames")), F.least(F.greatest(first + n, F.lit(0)), F.col("__frames"))
    sized = sized.withColumns({"__first": first, "__n": n, "__low": low, "__high": high})
    needs = sized.select("filename", "__key", "__low", "__high", F.explode(F.sequence(F.floor(F.col("__low") / chunk), F.floor((F.greatest("__high", F.col("__low") + 1) - 1) / chunk))).alias("chunk"))
    parts = chunks(spark, path, chunk=chunk, **options).select("filename", "chunk", F.col("first").alias("__at"), "data")
    a = F.greatest(F.col("__low") - F.col("__at"), F.lit(0)).cast("int")
    b = F.least(F.col("__high") - F.col("__at"), F.size("data")).cast("int")
    met = needs.join(parts, ["filename", "chunk"]).select("__key", "chunk", F.slice("data", a + 1, F.greatest(b - a, F.lit(0))).alias("part"))
    read = met.groupBy("__key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("__read"))
    joined = sized.join(read.withColumnRenamed("__key", "__right"), F.col("__key").eqNullSafe(F.col("__right")), "left")

    def sample(x, i):
        at, m = F.col("__first") - F.col("__low") + i, F.size(x)
        if mode != "reflect":
            return F.when((at >= 0) & (at < m), F.get(x, at.cast("int"))).otherwise(F.lit(0.0))
        lead = F.greatest(F.lit(0), F.col("__low") - F.col("__first"))
        back = F.when(at < m, at).otherwise(2 * (m - 1) - at)
        place = F.when(back < -lead, F.lit(-1)).otherwise(F.abs(back))
        return F.when((place >= 0) & (place < m), F.get(x, place.cast("int"))).otherwise(F.lit(0.0))

    every = F.when(F.col("__n") > 0, F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).otherwise(F.array().cast("array<bigint>"))
    data = F.when(F.col("__frames").isNotNull(), F.transform(every, lambda i: sample(F.coalesce(F.col("__read"), F.array().cast("array<double>")), i)))
    return joined.select(*[F.col(f"__key.{c}").alias(c) for c in selections.columns], "rate", data.alias("data"))


def frames_efficient(spark: SparkSession, path: str, selections: DataFrame, rate: float, window: float, step: float, **options) -> DataFrame:
    """(..., frame, data): windows every ``step`` centred on their steps, of selections that are read once as a whole.

    Each selection is widened by what its first and last frames need, and frames are cut from the wider one, so that neighbours share no reading.
    """
    from tidemark.functions.scalar import num_samples
    from tidemark.sources.audio import widen_for_frames

    win, hop = num_samples(window, rate, even=True), num_samples(step, rate, even=True)
    own = selections.withColumns({"__start": F.col("start"), "__end": F.col("end")})
    wide = load_windows(spark, path, widen_for_frames(own, rate, window, step), **options)
    cut = wide.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("num_frames").cast("int") - 1)))
    data = F.slice("data", (F.col("frame") * hop + 1).cast("int"), F.lit(win).cast("int"))
    rest = [c for c in selections.columns if c not in ("start", "end")]
    return cut.select(*rest, F.col("__start").alias("start"), F.col("__end").alias("end"), "frame", data.alias("data"))

