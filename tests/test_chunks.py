"""Signals in chunks against whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import chunks as C

SIZES = [1, 5, 64, 1000]


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(4)
    x = {i: rng.normal(1, 2, n) for i, n in enumerate((0, 1, 2, 63, 64, 65, 700))}
    return spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, data array<double>").cache(), x


def _whole(df):
    return {r["id"]: r["data"] for r in C.from_chunks(df).collect()}


def test_there_and_back(signals):
    df, x = signals
    for size in SIZES:
        got = _whole(C.to_chunks(df, size))
        assert {i: pytest.approx(v.tolist()) for i, v in x.items() if len(v)} == got


@pytest.mark.parametrize("size", [5, 64])
@pytest.mark.parametrize(("left", "right"), [(0, 3), (4, 0), (17, 40)])
def test_halo(signals, size, left, right):
    df, x = signals
    for r in C.with_halo(C.to_chunks(df, size), size, left, right).collect():
        v, at = x[r["id"]], r["chunk"] * size
        low, high = max(0, at - left), min(len(v), min(len(v), at + size) + right)
        assert r["wide"] == pytest.approx(v[low:high].tolist()) and r["before"] == at - low


@pytest.mark.parametrize(("win", "step"), [(16, 8), (7, 10), (130, 64)])
def test_frames_and_spectra(signals, win, step):
    df, x = signals
    got = {(r["id"], r["frame"]): r["data"] for r in C.frames(C.to_chunks(df, 50), 50, win, step).collect()}
    want = {(i, f): v[f * step : f * step + win].tolist() for i, v in x.items() for f in range(max(0, (len(v) - win) // step + 1))}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    if win == 16:
        mags = {(r["id"], r["frame"]): r["data"] for r in C.spectra(C.to_chunks(df, 50), 50, win, step).collect()}
        for k, v in want.items():
            assert mags[k] == pytest.approx(np.abs(np.fft.rfft(np.array(v) * np.hamming(win))).tolist(), abs=1e-9)


def _recur(x, feedback, init=()):
    y = [*reversed(init)] if len(init) else [0.0] * len(feedback)
    for v in x:
        y.append(v + sum(f * y[-1 - j] for j, f in enumerate(feedback)))
    return y[len(feedback) :]


@pytest.mark.parametrize("feedback", [[0.7], [1.0], [1.6, -0.81], [0.3, 0.2, -0.1]])
def test_recurrences_in_an_array(signals, feedback):
    df, x = signals
    init = [0.5, -1.0, 2.0][: len(feedback)]
    for block in (4, 256):
        got = {r["id"]: r["y"] for r in df.select("id", arrays.linear_recurrence("data", feedback, [F.lit(v) for v in init], block).alias("y")).collect()}
        for i, v in x.items():
            assert got[i] == pytest.approx(_recur(v, feedback, init), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size", [5, 64])
@pytest.mark.parametrize("feedback", [[0.9], [1.6, -0.81]])
def test_recurrences_over_chunks(signals, size, feedback, monkeypatch):
    """Groups of three chunks, so that states are scanned over several levels."""
    monkeypatch.setattr(C, "GROUP", 3)
    df, x = signals
    got = _whole(C.recurrence(C.to_chunks(df, size), size, feedback))
    assert got == {i: pytest.approx(_recur(v, feedback), rel=1e-9, abs=1e-9) for i, v in x.items() if len(v)}


def test_running_residual_and_filters(signals):
    df, x = signals
    want = {r["id"]: r["y"] for r in df.select("id", arrays.ema_residual("data", 8.0).alias("y")).collect()}
    got = _whole(C.running_residual(C.to_chunks(df, 16), 16, 8.0))
    assert got == {i: pytest.approx(v, abs=1e-9) for i, v in want.items() if len(v)} and want[0] == []
    b, a = [0.2, 0.3, -0.1], [-1.1, 0.5]
    filtered = _whole(C.filter_signal(C.to_chunks(df, 16), 16, b, a))
    for i, v in x.items():
        mixed = [sum(f * v[k - j] for j, f in enumerate(b) if k >= j) for k in range(len(v))]
        if len(v):
            assert filtered[i] == pytest.approx(_recur(mixed, [1.1, -0.5]), abs=1e-9)


def test_a_long_array_is_linear(spark):
    """60 000 values in one array: a fold that copies would move some ten billion."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: (i % 7).cast("double")).alias("data"))
    y = df.select(arrays.ema_residual("data", 100.0).alias("y")).select(F.size("y"), F.get("y", F.lit(0))).first()
    assert y[0] == 60_000 and y[1] == pytest.approx(0 - np.mean([i % 7 for i in range(60_000)]))
