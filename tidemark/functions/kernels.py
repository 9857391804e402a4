"""Signal kernels on NumPy arrays, and their use on array columns in Arrow batches.

They cover what native expressions express badly: Fourier transforms, filters, resampling, images.
``kernel`` turns a function on arrays into a column function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = {"hamming": np.hamming, "hann": np.hanning, "hanning": np.hanning, "blackman": np.blackman, "none": np.ones}
SIGNAL, IMAGE = "array<double>", "array<array<double>>"


def kernel(fn: Callable, returns: str = SIGNAL, image: bool = False, together: bool = False) -> Callable[..., Column]:
    """A column function that applies ``fn`` to each array; null stays null.

    With ``together`` the signals of equal length in a batch are the columns of one matrix, for kernels
    that work along the first axis sample by sample.
    """

    def at_once(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        lengths = values.map(len, na_action="ignore")
        for n in lengths.dropna().unique():
            own = (lengths == n).to_numpy().nonzero()[0]
            for i, y in zip(own, fn(np.stack(values.iloc[own].to_list()).astype(float).T).T.tolist(), strict=True):
                out[i] = y
        return pd.Series(out)

    def run(values: pd.Series) -> pd.Series:
        if together:
            return at_once(values)
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            got = fn(np.vstack(v) if image and len(v) else np.asarray(v, float))
            out.append(got.tolist() if isinstance(got, np.ndarray) else got)
        return pd.Series(out)

    return F.pandas_udf(run, returns)


# Padding and frames -----------------------------------------------------------------------------


def pad(x: np.ndarray, left: int = 0, right: int = 0, mode: str = "reflect", invert: bool = False) -> np.ndarray:
    """Zeros, or the signal mirrored about its ends (and about their values if ``invert``), then zeros."""
    zeros = lambda n: np.zeros((n, *x.shape[1:]))
    if mode == "zero":
        return np.concatenate([zeros(left), x, zeros(right)])

    def mirrored(values: np.ndarray, edge: float, want: int) -> np.ndarray:
        got = values[:want]
        got = 2 * edge - got if invert else got
        return np.concatenate([got, zeros(want - len(got))])

    head = mirrored(x[1:], x[0] if len(x) else 0.0, left)[::-1]
    tail = mirrored(x[-2::-1] if len(x) > 1 else x[:0], x[-1] if len(x) else 0.0, right)
    return np.concatenate([head, x, tail])


def frames(x: np.ndarray, win: int, step: int, num: int | None = None, offset: int = 0, mode: str = "reflect") -> np.ndarray:
    if num is None:
        num = max(1, math.ceil((len(x) - offset - win) / step) + 1)
    right = max(0, offset + (num - 1) * step + win - len(x))
    y = pad(x, max(0, -offset), right, mode)
    at = max(0, offset) + step * np.arange(num)[:, None] + np.arange(win)
    return y[at]


# Spectra ----------------------------------------------------------------------------------------


def stft(x: np.ndarray, win: int, step: int, window: str = "hamming", num: int | None = None, offset: int = 0, decibel: bool = False) -> np.ndarray:
    """Magnitudes of windowed frames, (time, frequency); null-free decibels need positive magnitudes."""
    f = np.abs(np.fft.rfft(frames(x, win, step, num, offset) * WINDOWS[window](win)))
    return to_decibel(f) if decibel else f


def phases(x: np.ndarray, win: int, step: int, window: str = "hamming") -> np.ndarray:
    return np.angle(np.fft.rfft(frames(x, win, step) * WINDOWS[window](win)))


def to_decibel(x: np.ndarray) -> np.ndarray:
    """20 log10, NaN where undefined."""
    return 20 * np.log10(x, where=x > 0, out=np.full(x.shape, np.nan))


def power(magnitude: np.ndarray, num_fft: int) -> np.ndarray:
    return magnitude**2 / num_fft


def mel_bank(num_fft: int, rate: float, num_filters: int) -> np.ndarray:
    """(filters, bins) triangles over bins between mel-spaced corners, which are whole bins."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    corner = np.floor((num_fft + 1) * 700 * (10 ** (np.linspace(0, top, num_filters + 2) / 2595) - 1) / rate)
    k = np.arange(num_fft // 2 + 1)
    low, mid, high = corner[:-2, None], corner[1:-1, None], corner[2:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        rise, fall = (k - low) / (mid - low), (high - k) / (high - mid)
    return np.where((k >= low) & (k < mid), rise, np.where((k >= mid) & (k < high), fall, 0.0))


def mel(magnitude: np.ndarray, num_fft: int, rate: float, num_filters: int = 40, decibel: bool = True) -> np.ndarray:
    bands = power(magnitude, num_fft) @ mel_bank(num_fft, rate, num_filters).T
    return to_decibel(np.maximum(bands, np.finfo(float).eps)) if decibel else bands


def dct2(x: np.ndarray) -> np.ndarray:
    """Orthonormal DCT-II along the last axis."""
    n = x.shape[-1]
    basis = np.cos(np.pi / n * np.outer(np.arange(n), np.arange(n) + 0.5)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return x @ basis.T


def mfcc(magnitude: np.ndarray, num_fft: int, rate: float, num_filters: int = 40, num_ceps: int = 20, lifter: int = 20) -> np.ndarray:
    """Coefficients 1 to ``num_ceps`` of the cosine transform of mel decibels, with sinusoidal liftering."""
    ceps = dct2(mel(magnitude, num_fft, rate, num_filters))[:, 1 : num_ceps + 1]
    k = np.arange(ceps.shape[1])
    return ceps * (1 + lifter / 2 * np.sin(np.pi * k / lifter)) if lifter else ceps


def cqt(x: np.ndarray, rate: float, step: int, bins_per_oct: int, freq_min: float = 1.0, freq_max: float | None = None, window: str = "hann") -> np.ndarray:
    """Constant-Q magnitudes, (time, bin): each bin correlates with a windowed tone of Q periods."""
    top = min(freq_max or rate / 2, rate / 2)
    bins = max(1, int(math.floor(bins_per_oct * math.log2(top / freq_min))))
    q = 1 / (2 ** (1 / bins_per_oct) - 1)
    num = max(1, len(x) // step + 1)
    out = np.empty((num, bins))
    for b in range(bins):
        f = freq_min * 2 ** (b / bins_per_oct)
        n = max(2, min(len(x), int(math.ceil(q * rate / f))))
        tone = WINDOWS[window](n) * np.exp(-2j * np.pi * f / rate * (np.arange(n) - n / 2))
        norm = np.abs(WINDOWS[window](n)).sum() or 1.0
        y = np.concatenate([np.zeros(n // 2), x, np.zeros(n + step)])
        at = np.minimum(step * np.arange(num), len(x))[:, None] + np.arange(n)
        out[:, b] = np.abs(y[at] @ tone) / norm * math.sqrt(n)
    return out


def griffin_lim(magnitude: np.ndarray, win: int, step: int, rounds: int = 25, window: str = "hamming", phase: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """A signal whose spectrum has these magnitudes, by alternating projections from a random phase."""
    w = WINDOWS[window](win)
    n = step * (len(magnitude) - 1) + win
    angle = np.random.default_rng(seed).uniform(-np.pi, np.pi, magnitude.shape) if phase is None else phase
    at = step * np.arange(len(magnitude))[:, None] + np.arange(win)
    weight = np.zeros(n)
    np.add.at(weight, at, np.broadcast_to(w * w, at.shape))
    x = np.zeros(n)
    for _ in range(max(1, rounds)):
        x = np.zeros(n)
        np.add.at(x, at, np.fft.irfft(magnitude * np.exp(1j * angle), win) * w)
        x /= np.maximum(weight, 1e-12)
        angle = np.angle(np.fft.rfft(x[at] * w))
    return x


# Filters ----------------------------------------------------------------------------------------


def resample(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """To another rate by cutting or padding the spectrum."""
    n = int(round(len(x) * new_rate / rate))
    if n == len(x) or not len(x):
        return x
    spectrum = np.fft.rfft(x)
    size = n // 2 + 1
    fitted = np.zeros(size, complex)
    k = min(size, len(spectrum))
    fitted[:k] = spectrum[:k]
    return np.fft.irfft(fitted, n) * (n / len(x))


def butterworth(rate: float, low: float | None, high: float | None, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter: high-pass above ``low``, low-pass below ``high``, or
    band-pass between them, of twice the order. Poles of the analogue prototype are moved and then mapped bilinearly."""
    prototype = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    low = low if low and low > 0 else None
    high = high if high and high < rate / 2 else None
    if low is None and high is None:
        return np.ones(1), np.ones(1)
    w1, w2 = (2 * rate * math.tan(math.pi * f / rate) if f else None for f in (low, high))
    if low is None:
        poles, zeros, at = prototype * w2, 0, 1.0
    elif high is None:
        poles, zeros, at = w1 / prototype, order, -1.0
    else:
        half, square = prototype * (w2 - w1) / 2, w1 * w2
        root = np.sqrt(half * half - square)
        poles, zeros = np.concatenate([half + root, half - root]), order
        at = np.exp(2j * math.atan(math.sqrt(square) / (2 * rate)))
    b = np.poly(np.concatenate([np.ones(zeros), -np.ones(len(poles) - zeros)]))
    a = np.real(np.poly((2 * rate + poles) / (2 * rate - poles)))
    return b * np.real(np.polyval(a, at) / np.polyval(b, at)), a


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
    """Direct form II transposed, any order, along the first axis; ``z`` is the state to begin in."""
    order = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, order + 1 - len(b))) / a[0], np.pad(a, (0, order + 1 - len(a))) / a[0]
    x = np.asarray(x, float)
    z, y = np.zeros((order + 1, *x.shape[1:])) if z is None else np.concatenate([z, z[:1] * 0]), np.empty(x.shape)
    column = (slice(1, None), *[None] * (x.ndim - 1))
    for n, v in enumerate(x):
        y[n] = b[0] * v + z[0]
        z[:-1] = b[column] * v + z[1:] - a[column] * y[n]
    return y


def settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of ``iir`` after a long run of ones."""
    order = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, order + 1 - len(b))) / a[0], np.pad(a, (0, order + 1 - len(a))) / a[0]
    level = b.sum() / a.sum()
    return np.cumsum((b[1:] - a[1:] * level)[::-1])[::-1]


def zero_phase(filters: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward through each filter, over a signal extended by odd reflection, from a settled state."""
    for b, a in filters:
        extra = min(len(x) - 1, 3 * max(len(a), len(b)))
        if len(a) == len(b) == 1 or extra < 1:
            continue
        y, z = pad(x, extra, extra, "reflect", invert=True), settled(b, a)
        for _ in range(2):
            y = iir(b, a, y, np.multiply.outer(z, y[0]))[::-1]
        x = y[extra : extra + len(x)]
    return x


def bandpass(x: np.ndarray, rate: float, freq_min: float | None = None, freq_max: float | None = None, order: int = 3) -> np.ndarray:
    return zero_phase([butterworth(rate, freq_min, freq_max, order)], x)


def gammatone_section(rate: float, freq: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """A fourth-order all-pole gammatone: four equal resonators with unit gain at their centre."""
    width = 1.019 * 24.7 * (4.37e-3 * freq + 1)
    pole = np.exp((-2 * np.pi * width + 2j * np.pi * freq) / rate)
    a = np.array([1.0, -2 * pole.real, abs(pole) ** 2])
    z = np.exp(-2j * np.pi * freq / rate)
    gain = abs(a[0] + a[1] * z + a[2] * z * z)
    return [(np.array([gain, 0.0, 0.0]), a)] * 4


def gammatone(x: np.ndarray, rate: float, freqs: list[float], weight: bool = True) -> np.ndarray:
    """(time, channel) outputs of zero-phase gammatone filters, C-weighted if asked."""
    from tidemark.functions.scalar import C_HIGH, C_LEVEL, C_LOW

    out = np.stack([zero_phase(gammatone_section(rate, f), x) for f in freqs], 1)
    f2 = np.asarray(freqs) ** 2
    return out * (C_LEVEL * C_HIGH**2 * f2 / ((f2 + C_LOW**2) * (f2 + C_HIGH**2))) if weight else out


# Images -----------------------------------------------------------------------------------------


def _smooth(x: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    if sigma <= 0:
        return x
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    y = np.moveaxis(x, axis, 0)
    n = len(y)
    at = np.arange(-r, n + r) % (2 * n)
    at = np.where(at >= n, 2 * n - 1 - at, at)
    z = y[at]
    return np.moveaxis(sum(w[i] * z[i : i + n] for i in range(2 * r + 1)), 0, axis)


def blur(image: np.ndarray, sigma_time: float, sigma_freq: float = 0.0) -> np.ndarray:
    """Gaussian blur with deviations in bins; edges are mirrored."""
    return _smooth(_smooth(image, sigma_time, 0), sigma_freq, 1)


def median_blur(image: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    y = np.pad(image, [(r, size - 1 - r)] * 2, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(y, (size, size)), axis=(2, 3))


def resize(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear interpolation to another shape."""
    out = image
    for axis, n in enumerate(shape):
        m = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, m - 1)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(2)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def drop_isolated(image: np.ndarray) -> np.ndarray:
    """Zero all connected regions (eight neighbours) of non-zero pixels whose values sum to 1."""
    label, out = np.zeros(image.shape, int), image.copy()
    count = 0
    for start in zip(*np.nonzero(image), strict=True):
        if label[start]:
            continue
        count += 1
        todo, region = [start], []
        label[start] = count
        while todo:
            y, x = todo.pop()
            region.append((y, x))
            for v in range(max(0, y - 1), min(image.shape[0], y + 2)):
                for u in range(max(0, x - 1), min(image.shape[1], x + 2)):
                    if image[v, u] and not label[v, u]:
                        label[v, u] = count
                        todo.append((v, u))
        if sum(image[p] for p in region) == 1:
            for p in region:
                out[p] = 0
    return out


# Peaks ------------------------------------------------------------------------------------------


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0, height: float | None = None) -> np.ndarray:
    """Places of local maxima (the middle of a plateau), high and prominent enough, ``distance`` apart."""
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept = [p for p in found if (height is None or x[p] >= height)]
    if distance > 1:
        chosen: list[int] = []
        for p in sorted(kept, key=lambda p: (-x[p], p)):
            if all(abs(p - q) >= distance for q in chosen):
                chosen.append(p)
        kept = sorted(chosen)

    def prominence_of(p: int) -> float:
        sides = []
        for part in (x[p::-1], x[p:]):
            higher = np.flatnonzero(part > x[p])
            sides.append(part[: higher[0] if len(higher) else len(part)].min())
        return float(x[p] - max(sides))

    return np.array([p for p in kept if prominence_of(p) >= prominence], int)


def mad(x: np.ndarray) -> float:
    """Median distance from the median."""
    return float(np.median(np.abs(x - np.median(x))))


def peak_flags(series: np.ndarray, distance: int = 1, multiplicity: int = 1, prominence: float = 1.0, height: float | None = None) -> np.ndarray:
    """For each row of (row, series) whether so many series peak there; prominence in units of MAD."""
    hits = np.zeros(len(series), int)
    for x in series.T:
        hits[peaks(x, distance, prominence * mad(x), height)] += 1
    return (hits >= multiplicity).astype(int)
