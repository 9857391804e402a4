import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import representations as R
from tidemark.sources import audio
from tidemark.sources.store import Store, create_database, fit_shape


@pytest.fixture(scope="module")
def wavs(tmp_path_factory):
    d = tmp_path_factory.mktemp("wavs")
    t = np.arange(2000) / 1000
    (d / "a.wav").write_bytes(audio.encode_wav(0.5 * np.sin(2 * np.pi * 50 * t), 1000, loud=True))
    (d / "rec_20200102.wav").write_bytes(audio.encode_wav(np.zeros(500), 500))
    (d / "bad.wav").write_bytes(b"nothing")
    (d / "note.txt").write_text("x")
    return d


def contents(spark, d):
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(str(d)).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content")


def test_listing_headers_durations(spark, wavs):
    assert [r["filename"] for r in audio.find_files(spark, str(wavs), ".txt").collect()] == ["note.txt"]
    h = {r["filename"]: r for r in audio.headers(spark, str(wavs)).collect()}
    assert h["a.wav"]["duration"] == 2.0 and h["a.wav"]["rate"] == 1000 and h["bad.wav"]["rate"] is None
    assert tuple(audio.sampling_rates(audio.headers(spark, str(wavs))).first()) == (500, True)
    d = audio.file_durations(spark, str(wavs), datetime_format="rec_%Y%m%d.wav").where("filename LIKE 'rec%'").first()
    assert d["duration"] == 1.0 and str(d["datetime"]) == "2020-01-02 00:00:00"


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decoding_of_all_widths(width):
    import wave

    x = np.array([0.0, 0.5, -0.5, 0.25])
    raw = {1: lambda: (x * 128 + 128).astype(np.uint8).tobytes(), 2: lambda: (x * 2**15).astype("<i2").tobytes(), 3: lambda: b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x), 4: lambda: (x * 2**31).astype("<i4").tobytes()}[width]()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(8), w.writeframes(raw)
    assert audio.decode(out.getvalue(), 0, 1, 3).tolist() == pytest.approx([0.5, -0.5], abs=1e-6)


def test_loading_pads_resamples_and_reports(spark, wavs):
    sel = spark.createDataFrame([("a.wav", 0.5, 1.5), ("a.wav", -0.5, 0.5), ("a.wav", 1.5, 2.5), ("bad.wav", 0.0, 1.0), ("none.wav", 0.0, 1.0)], "filename string, start double, end double")
    got = {(r["filename"], r["start"]): r["wave"] for r in audio.load_waveforms(sel, contents(spark, wavs), rate=1000.0).collect()}
    assert len(got) == 5 and all(len(w["data"]) == 1000 for (f, _), w in got.items() if f != "bad.wav")
    assert "WAV" in got["bad.wav", 0.0]["error"] and got["none.wav", 0.0]["error"] == "missing file"
    low = audio.load_waveforms(sel.limit(1), contents(spark, wavs), rate=500.0).first()["wave"]
    assert low["rate"] == 500.0 and len(low["data"]) == 500


def test_archive_noise_and_synthetic(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name in ("w1.wav", "a/w2.wav", "a/b/w1.wav"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    assert audio.archive_members(spark, str(tmp_path / "x.tar")).count() == 3
    assert [r["filename"] for r in audio.archive_members(spark, str(tmp_path / "x.tar"), ["a/w2.wav"]).collect()] == ["a/w2.wav"]
    c = [r["value"] for r in audio.cosine(spark, 100.0, 5.0).orderBy("pos").collect()]
    assert len(c) == 100 and max(c) <= 1.0 and audio.morlet_wavelet(spark, 100.0, 5.0, 0.5).count() == 300
    assert audio.gaussian_noise(spark, 2.0, 500).agg(F.stddev_pop("value")).first()[0] == pytest.approx(2.0, rel=0.2)
    assert 3 <= audio.random_floats(spark, 1, 3, 4).first()[0] < 4
    noisy = audio.add_noise(spark.createDataFrame([(1, [0.0] * 400)], "id int, data array<double>"), 1.0).first()["data"]
    assert np.std(noisy) == pytest.approx(1.0, rel=0.2)
    parts = spark.createDataFrame([(0, 1, [3.0, 4.0]), (0, 0, [1.0, 2.0])], "sel_id int, part int, data array<double>")
    assert audio.stitch(parts).first()["data"] == [1.0, 2.0, 3.0, 4.0]


def test_store_round_trip(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    with pytest.raises(KeyError):
        s.open("t")
    s.create("empty", schema.data_table((4,)))
    assert s.open("empty").count() == 0
    rows = spark.createDataFrame([([1.0, 2.0], "b", 0.0, 2), ([3.0, 4.0, 5.0], "a", 1.0, 1)], "data array<double>, filename string, offset double, label int")
    annot = spark.createDataFrame([(0, 3, 0.0, 1.0), (0, 4, 0.5, 1.0)], "data_index long, label int, start double, end double")
    s.write("t", rows, annot, order=["filename"], attrs={"rate": 1000}, shape=(3,), resize=1)
    got = {r["filename"]: r for r in s.load("t").collect()}
    assert got["a"]["id"] == 0 and len(got["a"]["annotations"]) == 2 and got["b"]["data"] == [1.0, 2.0, 2.0] and got["b"]["annotations"] == []
    assert s.unique_labels("t") == [1, 2]
    s.write("t", rows.where("label = 1").withColumn("label", F.lit(7)), order=["filename"], shape=(3,), discard=True)
    assert s.unique_labels("t") == [1, 2, 7]
    assert sorted(r["id"] for r in s.open("t").select("id").collect()) == [0, 1, 2]
    assert [r["id"] for r in s.ids_with_label("t", 4).collect()] == [0] and s.load("t", [1]).count() == 1
    with pytest.raises(TypeError):
        s.ids_with_label("t", ["x"])
    with pytest.raises(Exception, match="not of shape"):
        fit_shape(rows, (3,)).collect()


def test_database_from_selections(spark, wavs, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    sel = spark.createDataFrame([("a.wav", 0, 0.0, 1.0, 1), ("bad.wav", 0, 0.0, 1.0, 0)], "filename string, sel_id int, start double, end double, label int")
    config = {"type": "MagSpectrogram", "rate": "1 kHz", "window": "0.128 s", "step": "64 ms", "window_func": "hamming", "freq_max": "250 Hz", "transforms": [{"name": "normalize"}]}
    failed = create_database(s, "specs", sel, contents(spark, wavs), rate=1000.0, represent=lambda df: R.represent(df, {**config, "decibel": False}), attrs=R.encode_config(R.parse_config(config)))
    assert [r["filename"] for r in failed.collect()] == ["bad.wav"]
    row = s.open("specs").first()
    assert np.shape(row["data"]) == R.infer_shape(config, 1.0) and row["label"] == 1


def test_configurations():
    c = {"spec": {"type": "MagSpectrogram", "rate": "1000 Hz", "window": "0.256 s", "decibel": "true", "transforms": [{"name": "crop", "first": 1}]}}
    p = R.parse_config(c)["spec"]
    assert p["rate"] == 1000.0 and p["window"] == 0.256 and p["decibel"] is True and R.is_encoded(c["spec"]) and not R.is_encoded(p)
    assert R.encode_config(p)["rate"] == "1000 Hz"
    with pytest.raises(ValueError, match="quantity"):
        R.parse_parameter("rate", "fast")


@pytest.mark.parametrize("kind", ["Waveform", "MagSpectrogram", "PowerSpectrogram", "MelSpectrogram", "CQTSpectrogram", "GammatoneFilterBank"])
def test_representations(spark, kind):
    x = np.sin(2 * np.pi * 100 * np.arange(500) / 1000).tolist()
    df = spark.createDataFrame([(x, 1000.0)], "data array<double>, rate double")
    got = R.represent(df, {"type": kind, "rate": 1000.0, "window": 0.1, "step": 0.05, "bins_per_oct": 4, "freq_min": 20.0, "num_filters": 8, "num_chan": 4}).first()["data"]
    assert len(got) > 5 and (kind == "Waveform" or len(got[0]) > 1)


def test_unknown_transforms_are_errors(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0],)], "data array<double>")
    with pytest.raises(ValueError, match="unknown transforms"):
        R.apply_transforms(df, [{"name": "twist"}])
    assert R.apply_transforms(df, [{"name": "adjust_range"}, {"name": "crop", "first": 1, "last": 2}]).first()["data"] == [1.0, 0.25]


def test_widened_windows_and_wav_sink(spark, tmp_path):
    sel = spark.createDataFrame([("a.wav", 0.0, 3.0)], "filename string, start double, end double")
    w = audio.widen_for_frames(sel, 1000.0, 0.1, 0.02).first()
    assert (w["start"], w["end"], w["num_frames"]) == (-0.04, pytest.approx(-0.04 + 149 * 0.02 + 0.1), 150)
    df = spark.createDataFrame([("x.wav", [0.0, 0.5, -0.5], 100.0)], "filename string, data array<double>, rate double")
    assert audio.write_wavs(df, f"file://{tmp_path}/out", loud=False) == 1
    assert audio.read_header((tmp_path / "out" / "x.wav").read_bytes()) == (100, 1, 2, 3)


def test_numbers_of_many_stored_rows(spark, tmp_path):
    """Rows of several columns and appends: every id once, and annotations point to the rows meant."""
    s = Store(spark, str(tmp_path / "many"))
    rows = spark.range(60_000, numPartitions=7).select((F.xxhash64("id") % 1000).alias("k"), F.col("id").alias("own"), F.concat(F.lit("x"), "id").alias("name"), F.lit(1).alias("label"))
    s.write("t", rows, order=["k", "own"])
    s.write("t", rows, order=["k", "own"])
    t = s.open("t")
    assert t.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first() == (120_000, 120_000, 0, 119_999)
    assert t.where("id >= 60000").agg(F.count_distinct("own")).first()[0] == 60_000


def test_headers_of_compressed_files(spark, tmp_path):
    """A FLAC header alone: rate, channels, width and frames; without the codec the samples' row says what is missing."""
    info = (48_000 << 44 | 1 << 41 | 23 << 36 | 96_000).to_bytes(8, "big")
    (tmp_path / "a.flac").write_bytes(b"fLaC" + b"\x80\x00\x00\x22" + bytes(10) + info + bytes(16))
    assert audio.read_header((tmp_path / "a.flac").read_bytes()) == (48_000, 2, 3, 96_000)
    h = audio.headers(spark, str(tmp_path)).first()
    assert (h["filename"], h["rate"], h["duration"]) == ("a.flac", 48_000, 2.0)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit("a.flac").alias("filename"), "content")
    sel = spark.createDataFrame([("a.flac", 0.0, 1.0)], "filename string, start double, end double")
    assert audio.load_waveforms(sel, files).first()["wave"]["error"]


def test_a_log_is_stored_and_replayed(spark, tmp_path):
    """What was stored is what its log makes of the raw signals again."""
    raw = spark.range(6).select(F.col("id").alias("k"), F.lit(100.0).alias("rate"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.sin(i * (F.col("id") + 1) * 0.1)).alias("data")).cache()
    config = {"type": "MagSpectrogram", "window": "0.2 s", "step": "0.1 s", "window_func": "hamming", "waveform_transforms": [{"name": "preemphasis", "coeff": 0.9}, {"name": "normalize", "mean": 1.0, "std": 2.0}], "transforms": [{"name": "reduce_tonal_noise", "method": "MEDIAN"}, {"name": "adjust_range"}]}
    made = R.represent(raw, config, lineage="lineage")
    s = Store(spark, str(tmp_path / "logged"))
    s.write("t", made, order=["k"])
    stored = s.open("t")
    (log,) = R.lineages(stored)
    assert [e["name"] for e in log] == ["preemphasis", "normalize", "represent", "reduce_tonal_noise", "adjust_range"] and log[0]["coeff"] == 0.9
    again = R.replay(raw, log, lineage="lineage")
    rows = lambda df: [(r["k"], r["data"], r["lineage"]) for r in df.orderBy("k").collect()]
    assert rows(again) == rows(stored)
    more = R.apply_transforms(stored, [{"name": "blur", "sigma_time": 1.0}], image=True, lineage="lineage")
    assert len(R.lineages(more)[0]) == 6 and R.lineages(raw.limit(0).withColumn("lineage", F.array().cast(R.LINEAGE))) == []
