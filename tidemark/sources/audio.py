"""Audio files as tables: listing, headers, samples, archives, synthetic signals, and a WAV sink.

Files are read by Spark's binary reader, so any store that Spark reads works. Decoding is vectorised
on the executors; headers alone are decoded where only they are needed. Headers of WAV and FLAC files are
read here; samples of FLAC files are decoded by the package ``soundfile`` where that is installed, and
are an error of their row where it is not.
"""

from __future__ import annotations

import io
import struct
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import kernels as K
from tidemark.functions.scalar import morlet, num_samples, parse_datetime

AUDIO = "*.{wav,WAV,flac,FLAC}"


def find_files(spark: SparkSession, path: str, substrings: list[str] | str | None = None, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, filename, length, modified) of files whose name holds any of the substrings, by path.

    The contents are not read: the binary reader prunes that column.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = files.select("path", name.alias("filename"), "length", F.col("modificationTime").alias("modified"))
    if substrings:
        found = F.lit(False)
        for s in [substrings] if isinstance(substrings, str) else substrings:
            found = found | F.contains("filename", F.lit(s))
        out = out.where(found)
    return out.orderBy("path")


def read_header(content: bytes) -> tuple[int, int, int, int] | None:
    """(rate, channels, bytes a sample, frames) of a WAV or FLAC file; null if it is neither."""
    if content[:4] == b"fLaC" and len(content) >= 26:
        # Block head (4 bytes), block and frame sizes (10), then 20 bits rate, 3 channels, 5 bits a sample, 36 frames.
        packed = int.from_bytes(content[18:26], "big")
        return packed >> 44, (packed >> 41 & 7) + 1, ((packed >> 36 & 31) + 8) // 8, packed & (1 << 36) - 1
    try:
        with wave.open(io.BytesIO(content)) as w:
            return w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
    except (wave.Error, EOFError, struct.error):
        return None


def decode(content: bytes, channel: int = 0, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples [start, stop) of one channel, scaled to [-1, 1)."""
    if content[:4] == b"fLaC":
        import soundfile  # not installed everywhere

        x, _ = soundfile.read(io.BytesIO(content), start=max(0, start), stop=stop, dtype="float64", always_2d=True)
        return x[:, channel]
    with wave.open(io.BytesIO(content)) as w:
        width, channels, n = w.getsampwidth(), w.getnchannels(), w.getnframes()
        start = min(max(0, start), n)
        stop = n if stop is None else min(max(start, stop), n)
        w.setpos(start)
        raw = w.readframes(stop - start)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (b[:, 0].astype(np.int32) << 8 | b[:, 1].astype(np.int32) << 16 | b[:, 2].astype(np.int32) << 24) / 2.0**31
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels)[:, channel]


def wav_header(content) -> Column:
    """The header of each WAV file as a struct of rate, channels, width and frames."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_header(c) or (None,) * 4 for c in values], columns=["rate", "channels", "width", "frames"]).astype("Int64")

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "rate int, channels int, width int, frames long")(content)


def headers(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, filename, rate, channels, width, frames, duration); files that are no WAV have nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", AUDIO).load(path)
    h = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), wav_header("content").alias("h"))
    return h.select("path", "filename", "h.*", (F.col("h.frames") / F.col("h.rate")).alias("duration"))


def file_durations(spark: SparkSession, path: str, recursive: bool = False, datetime_format: str | None = None) -> DataFrame:
    """(filename, duration[, datetime]) of the audio files of a folder."""
    out = headers(spark, path, recursive).select("filename", "duration")
    return out.withColumn("datetime", parse_datetime(F.col("filename"), datetime_format)) if datetime_format else out


def sampling_rates(table: DataFrame) -> DataFrame:
    """(rate, mixed): the least rate of the files, and whether there are several."""
    return table.agg(F.min("rate").alias("rate"), (F.count_distinct("rate") > 1).alias("mixed"))


def samples_of(content: bytes, offset: float, duration: float | None, rate: float | None = None, channel: int = 0, mode: str = "reflect", normalize: bool = False) -> tuple[float, np.ndarray]:
    """A window of a file; what lies outside is padded, and another rate is resampled."""
    got = read_header(content)
    if got is None:
        raise ValueError("not a WAV file")
    own = float(got[0])
    first, n = round(offset * own), got[3] - round(offset * own) if duration is None else round(duration * own)
    x = decode(content, channel, first, first + n)
    x = K.pad(x, min(n, max(0, -first)) if first < 0 else 0, 0, mode)[:n]
    x = K.pad(x, 0, n - len(x), mode)
    if rate and rate != own:
        x, own = K.resample(x, own, rate), float(rate)
    if normalize and len(x) and x.std() > 0:
        x = (x - x.mean()) / x.std()
    return own, x


WAVEFORM = "rate: double, data: array<double>, error: string"


def load_waveforms(selections: DataFrame, files: DataFrame, rate: float | None = None, channel: int = 0, mode: str = "reflect", normalize: bool = False) -> DataFrame:
    """Selections (filename, start, end, ...) with ``wave``: rate, samples, or what went wrong.

    ``files`` has (filename, content). The selections of a file are grouped before the join, so a file is read by
    one task however many selections it has; its windows leave the task in batches of about ``BATCH_SAMPLES``, so
    that only its bytes and one batch are held. A null filename gives zeros.
    """
    rest = [c for c in selections.columns if c != "filename"]
    grouped = selections.groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("start", *[c for c in rest if c != "start"]))).alias("sel"))
    joined = grouped.join(files.select("filename", "content"), "filename", "left")
    kind = T.StructType([selections.schema["filename"], *[selections.schema[c] for c in rest], T.StructField("wave", T.StructType.fromDDL(WAVEFORM))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, sel, content in frame[["filename", "sel", "content"]].itertuples(index=False):
                made, size = [], 0
                for s in sel:
                    row = s if isinstance(s, dict) else s.asDict()
                    wave_ = _load(content, row, rate, channel, mode, normalize)
                    made.append((name, *(row[c] for c in rest), wave_))
                    size += len(wave_["data"] or ())
                    if size >= BATCH_SAMPLES:
                        yield pd.DataFrame(made, columns=kind.names)
                        made, size = [], 0
                if made:
                    yield pd.DataFrame(made, columns=kind.names)

    return joined.mapInPandas(run, kind)


#: Samples of the windows that leave a task together.
BATCH_SAMPLES = 1_000_000


def _load(content, s, rate, channel, mode, normalize) -> dict:
    try:
        if content is None:
            if not rate:
                raise ValueError("missing file")
            return {"rate": float(rate), "data": [0.0] * round(rate * (s["end"] - s["start"])), "error": "missing file"}
        own, x = samples_of(content, s["start"], s["end"] - s["start"], rate, channel, mode, normalize)
        return {"rate": own, "data": x.tolist(), "error": None}
    except Exception as e:  # one bad file must not fail the others; its rows say why
        return {"rate": None, "data": None, "error": f"{type(e).__name__}: {e}"}


def widen_for_frames(selections: DataFrame, rate: float, window: float, step: float) -> DataFrame:
    """Selections widened so that frames of ``window`` every ``step`` are centred on their steps."""
    win, hop = num_samples(window, rate, even=True), num_samples(step, rate, even=True)
    first = num_samples(F.col("start"), rate) - F.floor(win / 2) + F.floor(hop / 2)
    frames = num_samples(F.col("end") - F.col("start"), rate / hop)
    return selections.withColumns({"start": first / rate, "end": (first + (frames - 1) * hop + win) / rate, "num_frames": frames})


def write_wavs(df: DataFrame, uri: str, name: str = "filename", data: str = "data", rate: str = "rate", loud: bool = True) -> int:
    """A WAV file for each row under ``uri`` (any store that pyarrow opens), written by the executors.

    Files are replaced as a whole, so a task that runs twice leaves the same files. Returns how many.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for n, d, r in zip(batch[name], batch[data], batch[rate], strict=True):
                with store.open_output_stream(f"{root}/{n}") as out:
                    out.write(encode_wav(d, r, loud))
            yield pd.DataFrame({"n": [len(batch)]})

    return int(df.select(name, data, rate).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def stitch(waves: DataFrame, n_smooth: int = 0) -> DataFrame:
    """Parts of a selection (sel_id, part, data) as one signal, blended over n_smooth samples."""
    from tidemark.functions.arrays import join_smooth

    parts = waves.groupBy("sel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "data"))), lambda p: p["data"]).alias("parts"))
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    return parts.select("sel_id", F.aggregate(rest, F.get("parts", F.lit(0)), lambda a, b: join_smooth(a, b, n_smooth)).alias("data"))


def archive_members(spark: SparkSession, path: str, members: list[str] | None = None) -> DataFrame:
    """(archive, filename, content) of the files in tar archives; only wanted members are read out."""
    return members_of(spark.read.format("binaryFile").load(path), members)


def members_of(archives: DataFrame, members: list[str] | None = None, suffixes: tuple[str, ...] = ("",)) -> DataFrame:
    """``archive_members`` of a table (path, content); names may also be wanted by how they end."""
    wanted = set(members) if members is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and (wanted is None or m.name in wanted) and m.name.endswith(suffixes):
                            yield pd.DataFrame({"archive": [archive], "filename": [m.name], "content": [tar.extractfile(m).read()]})

    return archives.select("path", "content").mapInPandas(run, "archive string, filename string, content binary")


def encode_wav(data: np.ndarray, rate: float, loud: bool = True) -> bytes:
    """16-bit PCM; with ``loud`` the greatest amplitude becomes full scale if it exceeds 1."""
    x = np.asarray(data, float)
    x = x * (32760 / max(1.0, float(np.abs(x).max(initial=0)))) if loud else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(round(rate))
        w.writeframes(np.clip(np.round(x), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_bytes(data: Column, rate: Column, loud: bool = True) -> Column:
    """Signals as WAV files in a binary column."""


    def run(signals: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(x, y, loud) if x is not None else None for x, y in zip(signals, rates, strict=True)])

    run.__annotations__ = {"signals": pd.Series, "rates": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(data, rate)


# Synthetic signals -----------------------------------------------------------------------------


def hashed_uniform(seed, *key) -> Column:
    """A number in (0, 1) from a hash of seed and key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *key), 11) + 0.5) / F.lit(2.0**53)


def normal(seed, *key) -> Column:
    """A normal number from two hashed uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(hashed_uniform(seed, *key, F.lit(1)))) * F.cos(2 * np.pi * hashed_uniform(seed, *key, F.lit(2)))


def _times(samples: int, rate: float) -> Column:
    return (F.col("id") - (samples - 1) / 2) / rate


def cosine(spark: SparkSession, rate: float, frequency: float, duration: float = 1.0, height: float = 1.0, displacement: float = 0.0) -> DataFrame:
    """(pos, value) of a cosine, with time 0 in the middle."""
    n = round(duration * rate)
    return spark.range(n).select(F.col("id").alias("pos"), (height * F.cos(2 * np.pi * (frequency * _times(n, rate) + displacement))).alias("value"))


def gaussian_noise(spark: SparkSession, sigma: float, samples: int, seed: int = 1) -> DataFrame:
    """(pos, value) of normal noise, by hashes of seed and place: the same on every layout."""
    return spark.range(samples).select(F.col("id").alias("pos"), (normal(seed, F.col("id")) * sigma).alias("value"))


def morlet_wavelet(spark: SparkSession, rate: float, frequency: float, width: float, samples: int | None = None, height: float = 1.0, displacement: float = 0.0, dfdt: float = 0.0) -> DataFrame:
    n = samples or int(6 * width * rate)
    t = _times(n, rate)
    wave_ = morlet(t, frequency, width, displacement, norm=False, dfdt=dfdt)
    return spark.range(n).select(F.col("id").alias("pos"), (height * wave_).alias("value"))


def random_floats(spark: SparkSession, size: int = 1, low: float = 0.0, high: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(size).select((low + (high - low) * hashed_uniform(seed, F.col("id"))).alias("value"))


def add_noise(df: DataFrame, sigma: float, data: str = "data", seed: int = 1) -> DataFrame:
    """Normal noise on every sample, by hashes of the row and the place, so that reruns agree."""
    key = F.xxhash64(F.lit(seed), *[c for c in df.columns if c != data])
    return df.withColumn(data, F.transform(data, lambda v, i: v + sigma * normal(key, i)))
