"""Representations of signals and the transforms that a configuration lists for them.

A configuration is a dictionary, usually read from JSON, in which quantities are texts with units:
``{"type": "MagSpectrogram", "rate": "1000 Hz", "window": "0.256 s", "step": "0.032 s", "transforms": [...]}``.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.functions import kernels as K
from tidemark.functions.scalar import HERTZ, SECONDS
from tidemark.sources.audio import add_noise

# Configuration parameters that carry units, with the unit they are given in without one.
UNITS = {"duration": "s", "rate": "Hz", "window": "s", "step": "s", "freq_min": "Hz", "freq_max": "Hz", "freq_res": "Hz", "time_res": "s", "resolution": "s", "offset": "s"}
INTEGERS = ("bins_per_oct", "num_filters", "num_chan", "order", "N", "filter_n")
FLAGS = ("normalize_wav", "decibel", "compute_phase")
_NUMBER = re.compile(r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(\S*)\s*$")


def parse_parameter(name: str, value):
    """A configuration value as a number in base units, a flag, a list of transforms, or as it is."""
    if name in UNITS and isinstance(value, str):
        m = _NUMBER.match(value)
        if not m:
            raise ValueError(f"{name}: {value!r} is no quantity")
        table = SECONDS if UNITS[name] == "s" else HERTZ
        unit = m.group(2) or ("s" if UNITS[name] == "s" else "hz")
        factor = table.get(unit, table.get(unit.lower()))
        if factor is None:
            raise ValueError(f"{name}: unknown unit {unit!r}")
        return float(m.group(1)) * factor
    if name in INTEGERS and value is not None:
        return int(value)
    if name in FLAGS and isinstance(value, str):
        return value.lower() in ("yes", "true", "t", "y", "1")
    if name in ("transforms", "waveform_transforms"):
        return [{k: parse_parameter(k, v) if k != "name" else v for k, v in t.items()} for t in value or []]
    if name in ("input_shape", "range") and isinstance(value, str):
        return tuple(json.loads(value.replace("(", "[").replace(")", "]")))
    return value


def encode_parameter(name: str, value):
    if name in UNITS and isinstance(value, (int, float)):
        return f"{value:g} {UNITS[name]}"
    if name in ("transforms", "waveform_transforms"):
        return [{k: encode_parameter(k, v) if k != "name" else v for k, v in t.items()} for t in value]
    return list(value) if isinstance(value, tuple) else value


def is_encoded(config: dict) -> bool:
    return all(isinstance(v, str) for k, v in config.items() if k in UNITS)


def parse_config(config: dict) -> dict:
    """One section, or a dictionary of sections, parsed."""
    if config and all(isinstance(v, dict) for v in config.values()):
        return {k: parse_config(v) for k, v in config.items()}
    return {k: parse_parameter(k, v) for k, v in config.items()}


def encode_config(config: dict) -> dict:
    if config and all(isinstance(v, dict) for v in config.values()):
        return {k: encode_config(v) for k, v in config.items()}
    return {k: encode_parameter(k, v) for k, v in config.items()}


def load_config(path: str, name: str | None = None, parsed: bool = True) -> dict:
    config = json.loads(Path(path).read_text())
    config = config[name] if name else config
    return parse_config(config) if parsed else config


# Representations: each is a function of samples and rate to an image ---------------------------


def _win(p: dict, rate: float, key: str) -> int:
    n = int(np.ceil(p[key] * rate - 1e-7))
    return n + n % 2


def _mag(x, rate, p):
    image = K.stft(x, _win(p, rate, "window"), _win(p, rate, "step"), p.get("window_func") or "none")
    return _band(image, rate / 2, p)


def _band(image, top, p):
    n = image.shape[1]
    low = int(np.floor((p.get("freq_min") or 0) / top * n))
    high = int(np.ceil((p.get("freq_max") or top) / top * n))
    return image[:, max(0, min(low, n - 1)) : max(low + 1, min(high, n))]


REPRESENTATIONS = {
    "Waveform": lambda x, rate, p: x,
    "MagSpectrogram": lambda x, rate, p: K.to_decibel(_mag(x, rate, p)) if p.get("decibel", True) else _mag(x, rate, p),
    "PowerSpectrogram": lambda x, rate, p: (K.to_decibel if p.get("decibel", True) else lambda y: y)(K.power(_mag(x, rate, p), _win(p, rate, "window"))),
    "MelSpectrogram": lambda x, rate, p: K.mel(_mag(x, rate, {**p, "freq_min": None, "freq_max": None}), _win(p, rate, "window"), rate, p.get("num_filters", 40), p.get("decibel", True)),
    "CQTSpectrogram": lambda x, rate, p: K.to_decibel(K.cqt(x, rate, _win(p, rate, "step"), p["bins_per_oct"], p.get("freq_min", 1), p.get("freq_max"), p.get("window_func") or "hann")),
    "GammatoneFilterBank": lambda x, rate, p: K.gammatone(x, rate, _erb(p, rate), p.get("weight_func", True)),
}


def _erb(p, rate):
    from tidemark.functions.scalar import erb_centre_frequencies

    return erb_centre_frequencies(p.get("num_chan", 20), rate, p.get("freq_min", 1))


def _clean(image: np.ndarray) -> list:
    return [[None if np.isnan(v) else float(v) for v in row] for row in image] if image.ndim == 2 else image.tolist()


def represent(df: DataFrame, config: dict, data: str = "data", rate: str = "rate", lineage: str | None = None) -> DataFrame:
    """Signals in ``data`` turned into the configured representation; undefined values are null.

    With ``lineage`` a column of that name tells what was done, in order (``apply_transforms``, ``replay``).
    """
    p = parse_config(config)
    kind = p.get("type", "Waveform")
    if kind not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {kind!r}")
    if p.get("waveform_transforms"):
        df = apply_transforms(df, p["waveform_transforms"], data, lineage=lineage)
    if kind != "Waveform":
        fn = REPRESENTATIONS[kind]
        @F.pandas_udf(K.IMAGE)
        def run(x: pd.Series, r: pd.Series) -> pd.Series:
            return pd.Series([_clean(fn(np.asarray(a, float), float(b), p)) if a is not None and len(a) else [] for a, b in zip(x, r, strict=True)])

        df = df.withColumn(data, run(data, rate))
    if lineage:
        own = {k: v for k, v in encode_config({k: v for k, v in p.items() if k not in ("waveform_transforms", "transforms")}).items()}
        df = _logged(df, lineage, "represent", own)
    return apply_transforms(df, p.get("transforms") or [], data, kind != "Waveform", lineage)


LINEAGE = "array<struct<name: string, arguments: string>>"


def _logged(df: DataFrame, lineage: str, name: str, arguments: dict) -> DataFrame:
    """One more entry at the end of the log, which is begun if there is none."""
    before = F.coalesce(F.col(lineage), F.array().cast(LINEAGE)) if lineage in df.columns else F.array().cast(LINEAGE)
    entry = F.struct(F.lit(name).alias("name"), F.lit(json.dumps(arguments, sort_keys=True)).alias("arguments"))
    return df.withColumn(lineage, F.concat(before, F.array(entry)))


def lineages(df: DataFrame, lineage: str = "lineage") -> list[list[dict]]:
    """The distinct logs of a table, one for each way in which its rows were made, so few."""
    found = df.select(lineage).distinct().collect()
    return [[{"name": e["name"], **json.loads(e["arguments"])} for e in r[0] or ()] for r in found]


def replay(df: DataFrame, log: list[dict], data: str = "data", rate: str = "rate", lineage: str | None = None) -> DataFrame:
    """Do to the rows what a log says, so that raw signals become what was stored."""
    image = False
    for entry in log:
        arguments = {k: v for k, v in entry.items() if k != "name"}
        if entry["name"] == "represent":
            df = represent(df, arguments, data, rate, lineage)
            image = image or arguments.get("type", "Waveform") != "Waveform"
        else:
            df = apply_transforms(df, [entry], data, image, lineage)
    return df


def _native(fn):
    return lambda df, data, image, **kw: df.withColumn(data, fn(F.col(data), **kw))


def _on_image(fn):
    def run(df, data, image, **kw):
        return df.withColumn(data, K.kernel(lambda a: fn(a, **kw), K.IMAGE if image else K.SIGNAL, image)(data))

    return run


def _adjust(a, range=(0, 1)):
    lo, hi = a.min(0), a.max(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return range[0] + (range[1] - range[0]) * (a - lo) / (hi - lo)


def _normalize(a, mean=0.0, std=1.0):
    return (a - a.mean()) / a.std() * std + mean if a.std() > 0 else a


def _enhance(a, enhancement=1.0):
    return a / (np.exp(-(a - np.median(a) - a.std()) / (a.std() / enhancement)) + 1) if a.std() > 0 and enhancement > 0 else a


def _tonal(a, method="MEDIAN", time_const_len=None):
    if method == "MEDIAN":
        return a - np.median(a, axis=0)
    eps, background, out = 1 - np.exp(np.log(0.15) / time_const_len), a.mean(0), np.empty_like(a)
    for t, row in enumerate(a):
        out[t] = row - background
        background = (1 - eps) * background + eps * row
    return out


TRANSFORMS = {
    "normalize": _on_image(_normalize),
    "adjust_range": _on_image(_adjust),
    "crop": lambda df, data, image, first=0, last=None: df.withColumn(data, F.slice(data, first + 1, (last - first + 1) if last is not None else (1 << 30))),
    "add_gaussian_noise": lambda df, data, image, sigma=1.0, seed=1: add_noise(df, sigma, data, seed),
    "bandpass_filter": lambda df, data, image, rate=1000.0, freq_min=None, freq_max=None, N=3: df.withColumn(data, K.kernel(lambda a: K.bandpass(a, rate, freq_min, freq_max, N), together=True)(data)),
    "blur": _on_image(lambda a, sigma_time=1.0, sigma_freq=0.0: K.blur(a, sigma_time, sigma_freq)),
    "enhance_signal": _on_image(_enhance),
    "reduce_tonal_noise": _on_image(_tonal),
    "resize": _on_image(lambda a, shape=None: K.resize(a, tuple(shape))),
    "preemphasis": _native(arrays.preemphasis),
}


def apply_transforms(df: DataFrame, transforms: list[dict], data: str = "data", image: bool = False, lineage: str | None = None) -> DataFrame:
    """Named transforms in order; an unknown name is an error. ``lineage`` names a column that they are logged in."""
    unknown = [t.get("name") for t in transforms if t.get("name") not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")

    def step(d: DataFrame, t: dict) -> DataFrame:
        arguments = {k: v for k, v in t.items() if k != "name"}
        done = TRANSFORMS[t["name"]](d, data, image, **arguments)
        return _logged(done, lineage, t["name"], arguments) if lineage else done

    return reduce(step, transforms, df)


def infer_shape(config: dict, duration: float, rate: float | None = None) -> tuple[int, ...]:
    """The shape of a representation of so many seconds, from zeros."""
    p = parse_config(config)
    r = rate or p["rate"]
    return tuple(np.shape(REPRESENTATIONS[p.get("type", "Waveform")](np.full(int(duration * r), 1e-3), r, p)))
