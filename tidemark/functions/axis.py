"""Axes of bins as expression builders: linear, octave (log2) and mel.

An axis turns values into positions in units of bins, positions into bin numbers, and bin numbers
back into the values at their edges. Bins are closed on the left unless asked otherwise; the last bin
has the upper end of the axis. Outside the axis, numbers below 0 or from ``bins`` on result, unless
``truncate`` is set.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col, hz_to_mel, mel_to_hz


def bin_number(position: Column, bins: int, truncate: bool = False, closed_right: bool = False) -> Column:
    """The bin of a position; positions below 0 count one bin further down, toward zero otherwise."""
    b = position
    if closed_right:
        b = F.when((b == F.floor(b)) & (b > 0), b - 1).otherwise(b)
    else:
        b = F.when(b == bins, F.lit(float(bins - 1))).otherwise(b)
    if truncate:
        b = F.when(b < 0, F.lit(0.0)).when(b >= bins, F.lit(float(bins - 1))).otherwise(b)
    else:
        b = F.when(b < 0, b - 1).otherwise(b)
    return b.cast("int")


@dataclass(frozen=True)
class Axis:
    bins: int

    def position(self, x) -> Column:
        raise NotImplementedError

    def low_edge(self, b) -> Column:
        raise NotImplementedError

    def bin(self, x, truncate: bool = False, closed_right: bool = False) -> Column:
        return bin_number(self.position(x), self.bins, truncate, closed_right)

    def up_edge(self, b) -> Column:
        return self.low_edge(col(b) + 1)

    def minimum(self) -> Column:
        return self.low_edge(F.lit(0))

    def maximum(self) -> Column:
        return self.up_edge(F.lit(self.bins - 1))

    def bin_width(self, b=0) -> Column:
        return self.up_edge(b) - self.low_edge(b)

    def cut(self, low=None, high=None, bins: int | None = None) -> Column:
        """First and last bin of [low, high], or of ``bins`` bins from low, within the axis."""
        first = self.bin(low, truncate=True) if low is not None else F.lit(0)
        if bins is not None:
            last = first + bins - 1
        elif high is not None:
            last = F.greatest(first, self.bin(high, truncate=True, closed_right=True))
        else:
            last = F.lit(self.bins - 1)
        return F.struct(first.alias("first"), last.alias("last"))

    def resize(self, bins: int) -> Axis:
        raise NotImplementedError

    def labels(self, step_bins: int = 1, digits: int = 1) -> Column:
        """Ticks (bin edges) and their texts, every ``step_bins`` bins."""
        ticks = F.sequence(F.lit(0), F.lit(self.bins), F.lit(step_bins))
        return F.transform(ticks, lambda b: F.struct(self.low_edge(b).alias("tick"), F.format_string(f"%.{digits}f", self.low_edge(b)).alias("text")))


@dataclass(frozen=True)
class LinearAxis(Axis):
    low: float = 0.0
    high: float = 1.0

    @property
    def dx(self) -> float:
        return (self.high - self.low) / self.bins

    def position(self, x) -> Column:
        return (col(x) - self.low) / self.dx

    def low_edge(self, b) -> Column:
        return self.low + col(b) * self.dx

    def resize(self, bins: int) -> LinearAxis:
        return replace(self, bins=bins)

    def from_zero(self) -> LinearAxis:
        return replace(self, low=0.0, high=self.high - self.low)


@dataclass(frozen=True)
class Log2Axis(Axis):
    bins_per_octave: float = 1.0
    low: float = 1.0

    def position(self, x) -> Column:
        return self.bins_per_octave * F.log2(col(x) / self.low)

    def low_edge(self, b) -> Column:
        return self.low * F.pow(F.lit(2.0), col(b) / self.bins_per_octave)

    def resize(self, bins: int) -> Log2Axis:
        return replace(self, bins=bins, bins_per_octave=self.bins_per_octave * bins / self.bins)


@dataclass(frozen=True)
class MelAxis(Axis):
    """Centres of ``num_filters`` mel filters up to ``freq_max``; the outer bins reach the ends of the scale."""

    num_filters: int = 40
    freq_max: float = 1000.0
    start_bin: int = 0
    factor: float = 1.0

    @classmethod
    def of(cls, num_filters: int, freq_max: float, start_bin: int = 0, bins: int | None = None) -> MelAxis:
        return cls(num_filters - start_bin if bins is None else bins, num_filters, freq_max, start_bin)

    @property
    def _span(self) -> float:
        return 2595.0 * math.log10(1.0 + self.freq_max / 700.0)

    def position(self, x) -> Column:
        n = self.num_filters
        p = hz_to_mel(x) / self._span * (n + 1) - 0.5
        placed = (
            F.when(p < -0.5, p + 0.5)
            .when(p < 1.0, 1.0 - (1.0 - p) / 1.5)
            .when(p > n + 0.5, p - 0.5)
            .when((p > n - 1) & (p < n + 0.5), n - 1 + (p - (n - 1)) / 1.5)
            .otherwise(p)
        )
        return (placed - self.start_bin) * self.factor

    def low_edge(self, b) -> Column:
        p = col(b) / self.factor + self.start_bin
        p = F.when(p >= self.num_filters, p + 1.0).when(p > 0, p + 0.5).otherwise(p)
        return mel_to_hz(p * (self._span / (self.num_filters + 1)))

    def resize(self, bins: int) -> MelAxis:
        return replace(self, bins=bins, factor=self.factor * bins / self.bins)
