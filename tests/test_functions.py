import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, metrics, scalar
from tidemark.functions import kernels as K
from tidemark.functions.axis import LinearAxis, Log2Axis, MelAxis


def one(spark, *columns):
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return got[0] if len(columns) == 1 else tuple(got)


def test_overlap_rounding_and_units(spark):
    assert one(spark, scalar.fractional_overlap(3.0, 7.0, 5.5, 10.0)) == pytest.approx(0.375)
    assert one(spark, scalar.fractional_overlap(0.0, 0.0, 0.0, 1.0)) == 0.0
    assert one(spark, scalar.ceil_to(1.234, 2), scalar.floor_to(1.234, 2), scalar.signif(0.012345, 3), scalar.signif(0.0, 3)) == (1.24, 1.23, pytest.approx(0.0123), 0.0)
    assert one(spark, scalar.ceil_tolerant(3.0000000001), scalar.ceil_tolerant(3.1), scalar.floor_tolerant(2.9999999999), scalar.floor_tolerant(2.9)) == (3, 4, 3, 2)
    assert one(spark, scalar.to_seconds("22 min"), scalar.to_hertz("5 kHz"), scalar.to_seconds("7"), scalar.to_seconds("x")) == (1320.0, 5000.0, 7.0, None)
    assert one(spark, scalar.num_samples(0.1, 1001.0), scalar.num_samples(0.1, 1001.0, even=True), scalar.num_samples(1.0, 1000.0)) == (101, 102, 1000)
    assert scalar.segment_args(1000.0, 0.0, 0.1, 0.02, 3.0) == {"win_len": 100, "step_len": 20, "num_segs": 150, "offset_len": -40}


def test_morlet_octaves_and_levels(spark):
    got = one(spark, *[scalar.morlet(t, 10.0, 3.0) for t in (-1.0, 0.0, 0.5)])
    assert got == pytest.approx((0.41022718, 0.43366254, 0.42768108), abs=1e-7)
    band = one(spark, scalar.octave_band(F.lit(1)))
    assert band["centre"] == 62.5 and band["high"] / band["low"] == pytest.approx(2.0)
    assert one(spark, scalar.to_decibel(10.0), scalar.to_decibel(0.0), scalar.from_decibel(20.0)) == (20.0, None, 10.0)
    assert one(spark, scalar.mel_to_hz(scalar.hz_to_mel(440.0))) == pytest.approx(440.0)
    freqs = scalar.erb_centre_frequencies(20, 1000.0, 1.0)
    assert freqs[0] == pytest.approx(1.0) and freqs == sorted(freqs) and freqs[-1] < 500
    assert one(spark, scalar.factors(12)) == [1, 2, 3, 4, 6, 12]


def test_strings_and_dates(spark):
    assert one(spark, scalar.is_int("+12"), scalar.is_int("-1", signed=False), scalar.to_bool("Yes")) == (True, False, True)
    assert one(spark, scalar.relative_dir("/a/b/c.wav", "/a"), scalar.relative_dir("c\\d.wav")) == ("b/", "c/")
    assert str(one(spark, scalar.parse_datetime("x_20160511_0900.wav", "*_%Y%m%d_%H%M.wav"))) == "2016-05-11 09:00:00"
    assert str(one(spark, scalar.parse_datetime("240101", "%y%m%d", now="2023-06-01"))) == "1924-01-01 00:00:00"
    assert one(spark, scalar.parse_datetime("nope", "%Y%m%d")) is None
    assert one(spark, scalar.to_text(F.array(F.lit(1.0), F.lit(2.5)))) == "[1,2.5]"


def test_axes(spark):
    a = LinearAxis(200, 0.0, 100.0)
    assert [one(spark, a.bin(x)) for x in (0.6, 0.0, 100.0, -2.1)] == [1, 0, 199, -5]
    assert [one(spark, a.bin(x, closed_right=True)) for x in (0.0, 0.5, 1.0, 100.0)] == [0, 0, 1, 199]
    assert one(spark, a.bin(105.0, truncate=True), a.bin(-3.0, truncate=True)) == (199, 0)
    assert tuple(one(spark, a.cut(10.0, 20.0))) == (20, 39) and tuple(one(spark, a.cut(10.0, bins=3))) == (20, 22)
    o = Log2Axis(8 * 16, 16, 1.0)
    assert one(spark, o.bin(2.0), o.low_edge(16), o.maximum()) == (16, 2.0, 256.0)
    m = MelAxis.of(40, 500.0)
    assert one(spark, m.minimum()) == 0.0 and one(spark, m.maximum()) == pytest.approx(500.0)
    edges = one(spark, *[m.low_edge(b) for b in range(41)])
    assert list(edges) == sorted(edges) and one(spark, m.bin(250.0)) == max(i for i, e in enumerate(edges) if e <= 250.0)
    assert a.resize(100).dx == 1.0 and len(one(spark, a.labels(100))) == 3


def test_array_expressions_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    col = F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, arrays.normalize(col, 1.0, 2.0)) == pytest.approx((x - x.mean()) / x.std() * 2 + 1)
    assert one(spark, arrays.adjust_range(col)) == pytest.approx((x - x.min()) / np.ptp(x))
    assert np.allclose(one(spark, arrays.frames(col, 16, 8)), K.frames(x, 16, 8))
    assert np.allclose(one(spark, arrays.frames(col, 16, 8, offset=-5)), K.frames(x, 16, 8, offset=-5))
    assert one(spark, arrays.dft_magnitude(col, 40)) == pytest.approx(np.abs(np.fft.rfft(x * np.hamming(40))))
    assert one(spark, arrays.pad_reflect(col, 3, 2)) == pytest.approx(K.pad(x, 3, 2)) and len(one(spark, arrays.pad_zero(col, 1, 2))) == 43
    assert one(spark, arrays.pad_reflect(col, 3, 2, invert=True)) == pytest.approx(K.pad(x, 3, 2, invert=True))
    assert one(spark, arrays.preemphasis(col)) == pytest.approx(np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]]))
    assert one(spark, arrays.add(col, F.array(F.lit(1.0), F.lit(2.0)), 3, 2.0))[2:6] == pytest.approx([x[2], x[3] + 2, x[4] + 4, x[5]])
    assert len(one(spark, arrays.join_smooth(col, col, 6))) == 80
    assert one(spark, arrays.nearest_values(F.array(*map(F.lit, range(10))), 0, 3)) == [0, 1, 2]
    assert one(spark, arrays.ema_residual(col, 5.0))[0] == pytest.approx(x[0] - x.mean())
    assert one(spark, arrays.normalize(F.array(F.lit(2.0), F.lit(2.0)))) == [2.0, 2.0]


def test_one_hot_and_argmax(spark):
    assert one(spark, scalar.one_hot(2, 4)) == [0.0, 0.0, 1.0, 0.0]
    assert one(spark, scalar.arg_max(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == 1


def test_kernels(spark):
    rate, t = 1000.0, np.arange(1000) / 1000
    tone, low = np.sin(2 * np.pi * 200 * t), np.sin(2 * np.pi * 10 * t)
    assert K.stft(tone, 256, 128).argmax(1).tolist() == [round(200 / 1000 * 256)] * len(K.stft(tone, 256, 128))
    kept = K.bandpass(tone + low, rate, 100.0, 400.0)
    assert np.abs(kept[100:-100] - tone[100:-100]).max() < 0.05
    assert np.allclose(K.resample(low, 1000, 500)[50:450], low[::2][50:450], atol=0.05)
    bank = K.mel_bank(512, 16000, 20)
    assert bank.shape == (20, 257) and bank.max() == 1.0 and (bank >= 0).all()
    assert np.allclose(K.dct2(np.eye(8)) @ K.dct2(np.eye(8)).T, np.eye(8))
    assert K.mfcc(K.stft(tone, 256, 128), 256, rate, 20, 12).shape[1] == 12
    c = K.cqt(tone, rate, 100, 12, 50.0, 400.0)
    assert abs(50 * 2 ** (c.mean(0).argmax() / 12) - 200) < 15
    m = K.stft(tone, 128, 64)
    again = K.stft(K.griffin_lim(m, 128, 64, 60), 128, 64)
    assert np.abs(again[2 : len(m) - 2] - m[2:-2]).mean() < 0.2 * m.mean()
    g = K.gammatone(tone, rate, [50.0, 200.0, 400.0], weight=False)
    assert np.abs(g[200:-200]).mean(0).argmax() == 1
    image = np.zeros((6, 6))
    image[1, 1] = image[4, 4] = image[4, 5] = 1
    assert K.drop_isolated(image).sum() == 2
    assert np.allclose(K.blur(np.full((5, 5), 3.0), 1, 1), 3.0) and K.median_blur(np.eye(5), 3).shape == (5, 5)
    assert K.resize(np.arange(16.0).reshape(4, 4), (2, 8)).shape == (2, 8)
    assert K.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0])).tolist() == [1, 3, 6] and K.peaks(np.array([0, 1, 0, 3, 0]), prominence=2).tolist() == [3]
    assert K.peak_flags(np.array([[0, 0], [9, 9], [0, 1], [1, 0]], float), multiplicity=2).tolist() == [0, 1, 0, 0]
    got = spark.createDataFrame([([0.0, 3.0, 4.0],)], "data array<double>").select(K.kernel(lambda a: a * 2)("data")).first()[0]
    assert got == [0.0, 6.0, 8.0]


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 2, 200), rng.random(200).round(2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    m = metrics
    got = df.agg(m.accuracy("y", "p").alias("a"), m.precision("y", "p").alias("b"), m.recall("y", "p").alias("c"), m.root_mean_squared_error("y", "p").alias("d"), m.huber("y", "p").alias("e"), m.hinge("y", "p").alias("f"), m.log_cosh("y", "p").alias("g")).first()
    h = p >= 0.5
    assert got["a"] == pytest.approx((y == h).mean()) and got["b"] == pytest.approx(y[h].mean()) and got["c"] == pytest.approx(h[y == 1].mean())
    assert got["d"] == pytest.approx(math.sqrt(((y - p) ** 2).mean())) and got["e"] == pytest.approx((0.5 * (y - p) ** 2).mean())
    assert got["f"] == pytest.approx(np.maximum(0, 1 - (2 * y - 1) * p).mean()) and got["g"] == pytest.approx(np.log(np.cosh(y - p)).mean())
    pos, neg = p[y == 1], p[y == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert m.auc(df, "y", "p").first()[0] == pytest.approx(expected)
    assert 0 <= m.sensitivity_at_specificity(df, "y", "p", 0.9).first()[0] <= m.sensitivity_at_specificity(df, "y", "p", 0.5).first()[0] <= 1
    assert m.specificity_at_sensitivity(df, "y", "p", 0.0).first()[0] == 1.0
    iou = m.mean_iou(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, q int"), "t", "q").first()[0]
    assert iou == pytest.approx((1 / 2 + 2 / 3) / 2)
    s = spark.createDataFrame([(1, [0.1, 0.7, 0.2]), (0, [0.3, 0.5, 0.2])], "y int, s array<double>")
    got = s.agg(m.top_k_accuracy("y", "s", 1).alias("a"), m.top_k_accuracy("y", "s", 2).alias("b"), m.sparse_crossentropy("y", "s").alias("c"), m.categorical_hinge("y", "s").alias("d"), m.cosine_similarity("s", "s").alias("e")).first()
    assert (got["a"], got["b"]) == (0.5, 1.0) and got["c"] == pytest.approx(-(math.log(0.7) + math.log(0.3)) / 2) and got["d"] == pytest.approx((0.5 + 1.2) / 2) and got["e"] == pytest.approx(1.0)
