"""Signals in array columns, as native higher-order expressions: padding, framing, blending, scaling."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once: lambdas would otherwise compute it for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def pad_zero(x, left: int = 0, right: int = 0) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), left), _c(x), F.array_repeat(F.lit(0.0), right))


def pad_reflect(x, left: int = 0, right: int = 0, invert: bool = False) -> Column:
    """Pad by the signal mirrored about its ends; what a short signal can't fill is 0.

    ``invert`` mirrors about the end values as well, so that the slope goes on.
    """
    a = _c(x)
    n = F.size(a)

    def side(part: Column, edge: Column, want: int, front: bool) -> Column:
        got = F.transform(part, lambda v: 2 * edge - v) if invert else part
        rest = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(want) - F.size(part)))
        return F.concat(rest, got) if front else F.concat(got, rest)

    k_left, k_right = F.least(F.lit(left), n - 1), F.least(F.lit(right), n - 1)
    head = F.reverse(F.slice(a, 2, k_left))
    tail = F.reverse(F.slice(a, n - k_right, k_right))
    return F.concat(side(head, F.get(a, F.lit(0)), left, True), a, side(tail, F.get(a, n - 1), right, False))


def frames(x, win: int, step: int, num: int | None = None, offset: int = 0, pad: str = "reflect") -> Column:
    """Frames of ``win`` samples every ``step``; as many as the signal needs, padded at the ends."""
    a = _c(x)
    n = F.size(a)
    count = F.lit(num) if num is not None else F.greatest(F.lit(1), F.ceil((n - offset - win) / F.lit(float(step))).cast("int") + 1)
    left = max(0, -offset)
    need = F.greatest(F.lit(0), offset + (count - 1) * step + win - n)
    fill = F.when(need > 0, F.transform(F.sequence(F.lit(1), F.greatest(need, F.lit(1))), lambda i: F.coalesce(F.get(a, n - 1 - i), F.lit(0.0)) if pad == "reflect" else F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    front = F.transform(F.sequence(F.lit(left), F.lit(1), F.lit(-1)), lambda i: F.coalesce(F.get(a, i), F.lit(0.0)) if pad == "reflect" else F.lit(0.0)) if left else F.array().cast("array<double>")
    whole = F.concat(front, a.cast("array<double>"), fill)
    return let(whole, lambda x_: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(x_, i * step + 1 + max(0, offset), win)))


def preemphasis(x, coeff: float = 0.97) -> Column:
    a = _c(x)
    return F.transform(a, lambda v, i: F.when(i == 0, v).otherwise(v - coeff * F.get(a, i - 1)))


def add(a, b, offset: int | Column = 0, scale: float = 1.0) -> Column:
    """``a`` plus ``scale`` times ``b`` starting ``offset`` samples into a; as long as a."""
    second = _c(b)
    off = col(offset)
    return F.transform(_c(a), lambda v, i: v + scale * F.when(i >= off, F.coalesce(F.get(second, i - off), F.lit(0.0))).otherwise(F.lit(0.0)))


def join_smooth(a, b, n: int = 0) -> Column:
    """One signal after the other; around the joint n samples of both, mirrored, blend by a smooth step."""
    x, y = _c(a), _c(b)
    if n == 0:
        return F.concat(x, y)
    m, half = F.size(x), n // 2

    def blend(i: Column) -> Column:
        t = (i + 1) / F.lit(float(n + 1))
        w = t * t * (3 - 2 * t)
        first = F.when(i < half, F.get(x, m - half + i)).otherwise(F.get(x, m - 1 - (i - half)))
        second = F.when(i < half, F.get(y, F.lit(half - 1) - i)).otherwise(F.get(y, i - half))
        return (1 - w) * first + w * second

    return F.concat(F.slice(x, 1, m - half), F.transform(F.sequence(F.lit(0), F.lit(2 * half - 1)), blend), F.slice(y, half + 1, F.greatest(F.size(y) - half, F.lit(0))))


def nearest_values(x, i: int, n: int) -> Column:
    """The n values nearest to place i, in order of place; windows are shifted at the ends."""
    a = _c(x)
    size = F.size(a)
    first = F.greatest(F.lit(0), F.least(F.lit(i - n // 2), size - n))
    return F.slice(a, first + 1, F.least(F.lit(n), size))


def dft_magnitude(x, n: int, window: str = "hamming") -> Column:
    """Magnitudes of the real DFT of a short windowed frame of ``n`` samples as one expression, checkable in SQL.

    The windowed cosines and sines are a constant, folded once for the whole query.
    """
    level, depth = {"hamming": (0.54, 0.46), "hanning": (0.5, 0.5), None: (1.0, 0.0), "none": (1.0, 0.0)}[window]
    shape = [level - depth * math.cos(2 * math.pi * i / max(1, n - 1)) for i in range(n)]
    basis = [{"c": [w * math.cos(2 * math.pi * k * i / n) for i, w in enumerate(shape)], "s": [w * math.sin(2 * math.pi * k * i / n) for i, w in enumerate(shape)]} for k in range(n // 2 + 1)]
    constant = F.from_json(F.lit(json.dumps(basis)), "array<struct<c: array<double>, s: array<double>>>")
    dot = lambda b: F.aggregate(F.zip_with(_c(x), b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    return F.transform(constant, lambda b: F.sqrt(F.pow(dot(b["c"]), F.lit(2.0)) + F.pow(dot(b["s"]), F.lit(2.0))))


def mean(x) -> Column:
    a = _c(x)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def std(x) -> Column:
    """Population standard deviation."""
    a = _c(x)
    return let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)))


def normalize(x, mu: float = 0.0, sd: float = 1.0) -> Column:
    """To a mean and population standard deviation; a constant signal stays as it is."""
    a = _c(x)
    scaled = lambda p: F.when(p["s"] > 0, F.transform(a, lambda v: sd * (v - p["m"]) / p["s"] + mu)).otherwise(a)
    return let(F.struct(mean(a).alias("m"), std(a).alias("s")), scaled)


def adjust_range(x, low: float = 0.0, high: float = 1.0) -> Column:
    """Least to ``low``, greatest to ``high``; null values for a constant signal."""
    a = _c(x)
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return let(ends, lambda e: F.transform(a, lambda v: low + (high - low) * F.try_divide(v - e["lo"], e["hi"] - e["lo"])))


def crop(x, first: Column, last: Column) -> Column:
    """Bins first to last of a signal, both included."""
    return F.slice(_c(x), col(first) + 1, col(last) - col(first) + 1)


def linear_recurrence(x, feedback: list[float], init: list[Column] | None = None, block: int = 256) -> Column:
    """``y[i] = x[i] + feedback[0] * y[i-1] + feedback[1] * y[i-2] + ...``, with ``init`` as y[-1], y[-2], ... (0 if not given).

    A fold that appends copies what it has, so it runs over blocks: each block is solved from 0, the states between
    blocks are folded, and each block adds its response to the state that it starts from. Linear in
    the length up to ``block * block`` values; longer signals come as chunks (``operators.chunks``).
    """
    order = len(feedback)
    response = _responses(tuple(feedback), block)
    zero = F.array().cast("array<double>")

    def solve(b: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(f"y{j}") for j in range(order)], zero.alias("out"))

        def step(s: Column, v: Column) -> Column:
            y = v
            for j, f in enumerate(feedback):
                y = y + f * s[f"y{j}"]
            return let(y, lambda y_: F.struct(y_.alias("y0"), *[s[f"y{j - 1}"].alias(f"y{j}") for j in range(1, order)], F.array_append(s["out"], y_).alias("out")))

        return F.aggregate(b, start, step, lambda s: s["out"])

    def after(state: Column, solved: Column, i) -> list[Column]:
        """The state behind a full block that starts from ``state``."""
        return [F.get(solved, F.lit(block - 1 - j)) + sum((float(response[m][block - 1 - j]) * F.get(state, F.lit(m)) for m in range(order)), F.lit(0.0)) for j in range(order)]

    first = F.array(*[c.cast("double") for c in init]) if init else F.array(*[F.lit(0.0)] * order)

    def join(solved: Column) -> Column:
        none = F.struct(first.alias("c"), F.array().cast("array<array<double>>").alias("all"))
        step = lambda s, b: F.struct(F.array(*after(s["c"], b, None)).alias("c"), F.array_append(s["all"], s["c"]).alias("all"))
        states = F.aggregate(solved, none, step, lambda s: s["all"])
        table = [F.lit(r) for r in response]

        def add(b: Column, c: Column) -> Column:
            return F.transform(b, lambda v, i: v + sum((F.get(table[m], i) * F.get(c, F.lit(m)) for m in range(order)), F.lit(0.0)))

        return F.flatten(F.zip_with(solved, states, add))

    def run(a: Column) -> Column:
        count = F.ceil(F.size(a) / F.lit(float(block))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(a, k * block + 1, block))
        return F.when(F.size(a) > 0, let(F.transform(blocks, solve), join)).otherwise(zero)

    return let(_c(x).cast("array<double>"), run)


def _responses(feedback: tuple[float, ...], n: int) -> list[list[float]]:
    """For each value before the start, what a 1 there gives in the next ``n`` values."""
    out = []
    for m in range(len(feedback)):
        y = [1.0 if j == m else 0.0 for j in range(len(feedback))]  # y[-1], y[-2], ...
        row = []
        for _ in range(n):
            new = sum(f * v for f, v in zip(feedback, y, strict=True))
            row.append(new)
            y = [new, *y[:-1]]
        out.append(row)
    return out


def ema_residual(x, time_const: float) -> Column:
    """Signal less its exponential background, which starts at the mean: eps = 1 - exp(ln 0.15 / T)."""
    eps = 1 - math.exp(math.log(0.15) / time_const)

    def run(p: Column) -> Column:
        after = linear_recurrence(F.transform(p["a"], lambda v: eps * v), [1 - eps], [p["m"]])
        before = F.concat(F.array(p["m"]), F.slice(after, 1, F.greatest(F.size(p["a"]) - 1, F.lit(0))))
        return F.zip_with(p["a"], before, lambda v, b: v - b)

    a = _c(x)
    return F.when(F.size(a) > 0, let(F.struct(a.alias("a"), mean(a).alias("m")), run)).otherwise(a)
