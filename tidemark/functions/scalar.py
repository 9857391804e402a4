"""Scalar functions as native column expressions: rounding, units, dates, intervals, decibels, mel."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors to seconds and hertz, bits of float32 resolution.
SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hr": 3600.0, "hour": 3600.0, "hours": 3600.0, "day": 86400.0, "days": 86400.0}
HERTZ = {"mhz": 1e-3, "hz": 1.0, "khz": 1e3, "MHz": 1e6, "ghz": 1e9}
FLOAT32_EPS = 1.1920928955078125e-07


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ceil_to(x, decimals: int = 0) -> Column:
    return F.ceil(col(x) * 10.0**decimals) / 10.0**decimals


def floor_to(x, decimals: int = 0) -> Column:
    return F.floor(col(x) * 10.0**decimals) / 10.0**decimals


def ceil_tolerant(x, decimals: int = 6) -> Column:
    """The ceiling, but the floor for what lies less than one unit of the last decimal above it."""
    over = floor_to(col(x) - F.floor(col(x)), decimals)
    return F.when(over < 10.0**-decimals, F.floor(col(x))).otherwise(F.ceil(col(x))).cast("long")


def floor_tolerant(x, decimals: int = 6) -> Column:
    """The floor, but the ceiling for what lies less than one unit of the last decimal below it."""
    under = floor_to(F.ceil(col(x)) - col(x), decimals)
    return F.when(under < 10.0**-decimals, F.ceil(col(x))).otherwise(F.floor(col(x))).cast("long")


def signif(x, p: int) -> Column:
    """``x`` with p significant digits, half to even; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(p - 1) - F.floor(F.log10(F.abs(col(x)))))
    return F.when(col(x) == 0, F.lit(0.0)).otherwise(F.rint(col(x) * scale) / scale)


def fractional_overlap(a_start, a_end, b_start, b_end) -> Column:
    """Overlap by the shorter length: negative for disjoint intervals, 0 if either is empty."""
    shorter = F.least(col(a_end) - col(a_start), col(b_end) - col(b_start))
    inner = F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start))
    return F.when(shorter == 0, F.lit(0.0)).otherwise(inner / F.nullif(shorter, F.lit(0.0)))


def num_samples(time, rate, even: bool = False) -> Column:
    """Samples in a time: rounded up if a remainder exceeds float32 resolution, up to even if asked."""
    f = col(time) * col(rate)
    n = (F.floor(f) + F.when(f - F.floor(f) > FLOAT32_EPS, 1).otherwise(0)).cast("long")
    return n + n % 2 if even else n


def segment_args(rate: float, offset: float, window: float, step: float, duration: float) -> dict[str, int]:
    """Window, step, number of frames and offset in samples for frames centred on multiples of the step."""

    def samples(t: float, even: bool = False) -> int:
        f = t * rate
        n = math.floor(f) + (f - math.floor(f) > FLOAT32_EPS)
        return n + n % 2 if even else n

    win, hop = samples(window, True), samples(step, True)
    frames = math.floor(duration * rate / hop)
    frames += duration * rate / hop - frames > FLOAT32_EPS
    first = math.floor(offset * rate) + (offset * rate - math.floor(offset * rate) > FLOAT32_EPS)
    return {"win_len": win, "step_len": hop, "num_segs": frames, "offset_len": first - win // 2 + hop // 2}


def frame_arguments(rate, offset, window, step, duration) -> Column:
    """``segment_args`` of columns, as a struct."""
    win, hop = num_samples(window, rate, True), num_samples(step, rate, True)
    frames = num_samples(duration, col(rate) / hop)
    first = num_samples(offset, rate) - F.floor(win / 2) + F.floor(hop / 2)
    return F.struct(win.alias("win_len"), hop.alias("step_len"), frames.alias("num_segs"), first.cast("long").alias("offset_len"))


def to_decibel(x) -> Column:
    """20 log10 x, null where that is undefined."""
    return F.when(col(x) > 0, 20 * F.log10(col(x)))


def from_decibel(y) -> Column:
    return F.pow(F.lit(10.0), col(y) / 20.0)


def mag_to_power(x, num_fft) -> Column:
    return col(x) * col(x) / col(num_fft)


def hz_to_mel(f) -> Column:
    return 2595.0 * F.log10(1.0 + col(f) / 700.0)


def mel_to_hz(m) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), col(m) / 2595.0) - 1.0)


def to_number(x, units: dict[str, float]) -> Column:
    """'22 min' or '5 kHz' in the base unit; plain numbers pass, unknown units give null."""
    s = col(x).cast("string")
    number = F.regexp_extract(s, r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([^0-9\s]*)\s*$", 1)
    unit = F.regexp_extract(s, r"^\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*([^0-9\s]*)\s*$", 2)
    table = F.create_map(*[F.lit(v) for k, f in units.items() for v in (k, f)])
    factor = F.when(unit == "", F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(table, unit), F.try_element_at(table, F.lower(unit))))
    return F.when(number != "", number.cast("double")) * factor


def to_seconds(x) -> Column:
    return to_number(x, SECONDS)


def to_hertz(x) -> Column:
    return to_number(x, HERTZ)


# Signs of date patterns, each with its regular expression.
DATE_SIGNS = {"%Y": r"(\d{4})", "%y": r"(\d{2})", "%m": r"(\d{1,2})", "%d": r"(\d{1,2})", "%H": r"(\d{1,2})", "%M": r"(\d{1,2})", "%S": r"(\d{1,2})", "%ms": r"(\d{1,3})", "%f": r"(\d{1,6})", "%p": r"(AM|PM|am|pm)", "%j": r"(\d{1,3})"}


def date_regex(fmt: str) -> tuple[str, list[str]]:
    """A pattern with ``*`` and ``?`` wildcards and % signs as a regular expression, and its signs."""
    out, signs, i = "", [], 0
    while i < len(fmt):
        sign = next((s for s in (fmt[i : i + 3], fmt[i : i + 2]) if s in DATE_SIGNS), None)
        if sign:
            out, i = out + DATE_SIGNS[sign], i + len(sign)
            signs.append(sign)
        else:
            out += {"*": ".*", "?": "."}.get(fmt[i], re.escape(fmt[i]))
            i += 1
    return f"^{out}$", signs


def parse_datetime(x, fmt: str, now: str | None = None, replace_spaces: str = "0") -> Column:
    """A timestamp found in a string by a pattern; null on mismatch.

    Two-digit years that would lie after ``now`` (today if not given) are in the century before.
    """
    s = F.regexp_replace(col(x), " ", replace_spaces)
    pattern, signs = date_regex(fmt.replace(" ", replace_spaces))

    def part(sign: str, default: int) -> Column:
        return F.regexp_extract(s, pattern, signs.index(sign) + 1).cast("int") if sign in signs else F.lit(default)

    year = part("%Y", 1900) if "%y" not in signs else part("%y", 0) + F.lit(2000)
    hour = part("%H", 0)
    if "%p" in signs:
        late = F.lower(F.regexp_extract(s, pattern, signs.index("%p") + 1)) == "pm"
        hour = hour % 12 + F.when(late, 12).otherwise(0)
    second = part("%S", 0) + part("%ms", 0) / 1000.0 + part("%f", 0) / 1e6
    made = F.try_make_timestamp(year, part("%m", 1), part("%d", 1), hour, part("%M", 0), second.cast("decimal(16,6)"))
    if "%j" in signs:
        made = made + F.make_dt_interval(part("%j", 1) - 1)
    if "%y" in signs:
        today = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        made = F.when(made > today, F.add_months(made, -1200).cast("timestamp") + (made - F.date_trunc("day", made))).otherwise(made)
    return F.when(s.rlike(pattern), made)


def relative_dir(path, root: str = "") -> Column:
    """The folder of a path relative to ``root``, with / and a trailing / unless empty."""
    unix = F.regexp_replace(col(path), r"\\", "/")
    base = root.replace("\\", "/").rstrip("/")
    inner = F.when(unix.startswith(f"{base}/"), F.substring(unix, len(base) + 2, 1 << 30)).otherwise(unix) if base else unix
    return F.regexp_extract(inner, r"^(.*/)?[^/]*$", 1)


def is_int(s, signed: bool = True) -> Column:
    return col(s).rlike(r"^[+-]?[0-9]+$" if signed else r"^[0-9]+$")


def to_bool(s) -> Column:
    return F.lower(col(s)).isin("yes", "true", "t", "y", "1")


def factors(n) -> Column:
    """All divisors of n in ascending order."""
    return F.filter(F.sequence(F.lit(1), col(n).cast("int")), lambda i: col(n) % i == 0)


def octave_band(p) -> Column:
    """Centre, low and high frequency of octave band p, with band 5 at 1000 Hz."""
    centre = 1000.0 * F.pow(F.lit(2.0), col(p) - 5)
    return F.struct(centre.alias("centre"), (centre / math.sqrt(2)).alias("low"), (centre * math.sqrt(2)).alias("high"))


def morlet(time, frequency, width, displacement=0.0, norm: bool = True, dfdt=0.0) -> Column:
    """Real part of the admissible Morlet wavelet, with an optional linear change of frequency."""
    t, s = col(time) - col(displacement), col(width)
    w = 2 * math.pi * (col(frequency) + t * col(dfdt)) * s
    x = t / s
    wave = (F.cos(w * x) - F.exp(-0.5 * w * w)) * F.exp(-0.5 * x * x)
    if not norm:
        return wave
    return wave / F.sqrt(s * math.sqrt(math.pi) * (1 + F.exp(-w * w) - 2 * F.exp(-0.75 * w * w)))


def complex_value(mag, angle) -> Column:
    return F.struct((col(mag) * F.cos(col(angle))).alias("re"), (col(mag) * F.sin(col(angle))).alias("im"))


# Corner of the ERB scale in Hz, corners and level of C-weighting.
ERB_CORNER = 228.8
C_LOW, C_HIGH, C_LEVEL = 20.6, 12200.0, 1.007


def erb_centre_frequencies(num_chan: int, rate: float, freq_min: float) -> list[float]:
    """Centre frequencies in equal steps of the logarithmic ERB scale, ascending from ``freq_min``."""
    top, low = math.log(rate / 2 + ERB_CORNER), math.log(freq_min + ERB_CORNER)
    return [math.exp(low + k * (top - low) / num_chan) - ERB_CORNER for k in range(num_chan)]


def c_weight(freq) -> Column:
    """C-weighting gain at a frequency."""
    f2 = col(freq) * col(freq)
    return C_LEVEL * C_HIGH**2 * f2 / ((f2 + C_LOW**2) * (f2 + C_HIGH**2))


def to_text(values, decimals: int | None = None) -> Column:
    """A numeric array as '[1,2.5,3]', rounded half to even if asked."""
    a = F.transform(values, lambda v: F.bround(v, decimals)) if decimals is not None else values
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def one_hot(value, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == col(value)).cast("double"))


def arg_max(values) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_and_confidence(scores) -> Column:
    return F.struct(arg_max(scores).alias("class_id"), F.array_max(scores).alias("confidence"))
