"""WAV files by ranges of bytes: all forms, long files, filters, streams, windows, and what headers say."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import audio, wav

RATE = 100


def _wave(path, x, width=2, channels=1, rate=RATE):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        raw = np.round(np.asarray(x) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        w.writeframes((raw + 128).astype(np.uint8).tobytes() if width == 1 else raw.astype("<i4").tobytes() if width == 4 else raw.astype("<i2").tobytes() if width == 2 else raw.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wavs")
    rng = np.random.default_rng(1)
    for name, n in (("a", 1000), ("b", 37), ("c", 0), ("d", 4096)):
        _wave(d / f"{name}.wav", rng.uniform(-1, 1, n))
    for width in (1, 3, 4):
        _wave(d / f"w{width}.WAV", rng.uniform(-1, 1, 90), width)
    _wave(d / "stereo.wav", rng.uniform(-1, 1, 120), channels=2)
    real = rng.uniform(-1, 1, 50).astype("<f4").tobytes()
    extensible = struct.pack("<HHIIHHHHI16s", 0xFFFE, 1, RATE, RATE * 4, 4, 32, 22, 32, 4, b"\x03\x00" + bytes(14))
    parts = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(extensible)) + extensible
    (d / "float.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + parts + b"data" + struct.pack("<I", len(real)) + real)
    plain = struct.pack("<HHIIHH", 1, 1, RATE, 2 * RATE, 2, 16)
    (d / "rf64.wav").write_bytes(b"RF64\xff\xff\xff\xffWAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 40, 20, 0) + b"fmt " + struct.pack("<I", 16) + plain + b"data\xff\xff\xff\xff" + bytes(40) + b"more")
    (d / "bad.wav").write_bytes(b"no audio")
    (d / "other.txt").write_bytes(b"x")
    return d


def _whole(spark, folder, **options):
    rows = wav.chunks(spark, str(folder), **options).where("error IS NULL").select("filename", "chunk", "first", "data").collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["filename"], r["chunk"])):
        assert r["first"] == len(out.setdefault(r["filename"], []))
        out[r["filename"]] += r["data"]
    return out


@pytest.mark.parametrize(("chunk", "size"), [(64, 100), (1000, 1 << 20), (7, 333)])
def test_every_sample_once(spark, folder, chunk, size):
    """However files are cut into ranges, chunks are the same and all samples are there."""
    got = _whole(spark, folder, chunk=chunk, rangeBytes=size)
    for f in folder.iterdir():
        if f.name in ("float.wav", "rf64.wav", "bad.wav", "other.txt", "c.wav"):
            continue
        assert got[f.name] == pytest.approx(audio.decode(f.read_bytes()).tolist())
    assert len(got["float.wav"]) == 50 and got["rf64.wav"] == [0.0] * 20 and "c.wav" not in got and set(got) >= {"w1.WAV", "w3.WAV", "stereo.wav"}


def test_headers_and_errors(spark, folder):
    got = {r["filename"]: r for r in wav.heads(spark, str(folder)).collect()}
    assert (got["stereo.wav"]["channels"], got["stereo.wav"]["frames"], got["w3.WAV"]["width"], got["a.wav"]["duration"]) == (2, 60, 3, 10.0)
    assert got["bad.wav"]["error"] and got["bad.wav"]["rate"] is None and "other.txt" not in got
    assert [r["filename"] for r in wav.chunks(spark, str(folder)).where("error IS NOT NULL").collect()] == ["bad.wav"]
    with pytest.raises(Exception, match="nowhere"):
        wav.chunks(spark, "/nowhere").count()


def test_filters_reach_the_reader(spark, folder):
    reader = wav.WavReader({"path": str(folder), "chunk": "100", "rangebytes": "200"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

    left = list(reader.pushFilters([EqualTo(("filename",), "d.wav"), GreaterThan(("end",), 20.0), LessThan(("start",), 30.0), IsNotNull(("rate",))]))
    assert left == [IsNotNull(("rate",))]
    parts = reader.partitions()
    assert {p[0].rsplit("/", 1)[-1] for r in parts for p in r.parts} == {"d.wav"} and len(parts) > 30
    assert [s for r in parts for b in reader.read(r) for s in b.column("start").to_pylist()] == [float(k) for k in range(20, 30)]
    got = wav.chunks(spark, str(folder), chunk=100).where("filename = 'd.wav' AND start >= 12 AND start < 15.5 AND chunk % 2 = 0")
    assert sorted(r["start"] for r in got.collect()) == [12.0, 14.0]


def test_a_file_above_2_gb_in_parts(spark, tmp_path):
    """A sparse file of 3 GB: only the ranges and chunks that a filter leaves are read, and no row is large."""
    n = 3 << 30
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", n + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 48_000, 96_000, 2, 16) + b"data" + struct.pack("<I", n))
        f.seek(44 + n - 2)
        f.write(struct.pack("<h", 16384))
    assert wav.heads(spark, str(tmp_path)).first()["frames"] == n // 2
    assert len(wav.WavReader({"path": str(tmp_path)}).partitions()) == -(-(n + 44) // wav.RANGE)
    last = wav.chunks(spark, str(tmp_path)).where(F.col("end") > n / 2 / 48_000 - 0.5).select("end", F.element_at("data", -1).alias("x"), F.size("data").alias("n")).collect()
    assert max((r["end"], r["x"]) for r in last) == (n / 2 / 48_000, 0.5) and all(r["n"] <= wav.CHUNK for r in last)
    sel = spark.createDataFrame([("long.wav", 20_000.0, 20_000.01), ("long.wav", n / 2 / 48_000 - 0.001, n / 2 / 48_000 + 0.001)], "filename string, start double, `end` double")
    got = sorted((r["start"], len(r["data"]), max(r["data"])) for r in wav.load_windows(spark, str(tmp_path), sel).collect())
    assert [(x[1], x[2]) for x in got] == [(480, 0.0), (96, 0.5)]


@pytest.mark.parametrize("mode", ["reflect", "zero"])
def test_windows_are_those_of_whole_files(spark, folder, mode):
    rng = np.random.default_rng(3)
    sel = [(f, float(s), float(s + d), i) for i, (f, s, d) in enumerate([(f, round(rng.uniform(-2, top), 2), round(rng.uniform(0.05, 4), 2)) for f, top in (("a.wav", 12), ("b.wav", 1), ("d.wav", 41)) for _ in range(12)])]
    sel += [("a.wav", 0.0, 10.0, 90), ("b.wav", -0.2, 0.5, 91), ("nowhere.wav", 0.0, 1.0, 92), ("bad.wav", 0.0, 1.0, 93)]
    table = spark.createDataFrame(sel, "filename string, start double, `end` double, i int")
    got = {r["i"]: r["data"] for r in wav.load_windows(spark, str(folder), table, chunk=128, mode=mode).collect()}
    files = spark.read.format("binaryFile").load(str(folder)).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")
    want = {r["i"]: r["wave"]["data"] for r in audio.load_waveforms(table, files, mode=mode).collect() if r["wave"]["error"] is None}
    assert set(got) == {s[3] for s in sel} and got[92] is None and got[93] is None
    for i, x in want.items():
        assert got[i] == pytest.approx(x), sel[i] if i < len(sel) else i


def test_frames_of_selections_read_once(spark, folder):
    sel = spark.createDataFrame([("d.wav", 1.0, 3.0), ("a.wav", 0.0, 1.0)], "filename string, start double, `end` double")
    got = {(r["filename"], r["frame"]): r["data"] for r in wav.frames_efficient(spark, str(folder), sel, RATE, 0.16, 0.08, chunk=50).collect()}
    x = audio.decode((folder / "d.wav").read_bytes())
    assert len([k for k in got if k[0] == "d.wav"]) == 25
    for k in range(25):
        first = 100 - 8 + 4 + 8 * k
        assert got["d.wav", k] == pytest.approx(x[first : first + 16].tolist())
    assert got["a.wav", 0][4:] == pytest.approx(audio.decode((folder / "a.wav").read_bytes())[:12].tolist())


def test_a_stream_takes_files_up_once(spark, tmp_path):
    wav.register(spark)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for names in (("a", "b"), ("c",)):
        for n in names:
            _wave(tmp_path / "in" / f"{n}.wav", np.zeros(250))
        q = spark.readStream.format("wav").option("chunk", 100).load(src).select("filename", "chunk").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start()
        assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(f"{n}.wav", k) for n in "abc" for k in range(3)]
