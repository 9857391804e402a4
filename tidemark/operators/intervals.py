"""Interval predicates and joins: rows meet by key and overlap, never by a bare product.

``interval_join`` uses the equality key alone, which suits many keys with few rows each. For keys with
very many intervals ``nested_join`` also cuts time into bins of powers of two and joins on (key, level, bin).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import Parts


#: Intervals shorter than ``2 ** LEAST_LEVEL`` seconds share its bins.
LEAST_LEVEL = -20
ENDLESS = 127


def overlaps(a_start, a_end, b_start, b_end, closed: bool = False) -> Column:
    """Whether two intervals share more than an end point, or at least that if ``closed``."""
    return (a_end >= b_start) & (a_start <= b_end) if closed else (a_end > b_start) & (a_start < b_end)


def _condition(left: DataFrame, right: DataFrame, on: list[str], closed: bool) -> Column:
    same = reduce(lambda x, y: x & y, [left[c] == right[c] for c in on])
    return same & overlaps(left["start"], left["end"], right["start"], right["end"], closed)


def interval_join(left: DataFrame, right: DataFrame, on: str | list[str] = "filename", how: str = "inner", closed: bool = False, suffix: str = "_right") -> DataFrame:
    """Rows of both sides whose (start, end) overlap; clashing names of the right side get a suffix."""
    keys = [on] if isinstance(on, str) else on
    l, r = left.alias("l"), right.alias("r")
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys])
    joined = l.join(r, same & overlaps(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"), closed), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("l.*", *[F.col(f"r.{c}").alias(c + suffix if c in left.columns else c) for c in right.columns if c not in keys])


def _level(lo: Column, hi: Column, least: int) -> Column:
    """The binary order of magnitude of an interval: bins of ``2 ** level`` are no shorter than it is.

    Far from 0 bins are as long as exact bin numbers need; endless intervals have a level of their own.
    """
    order = F.ceil(F.log2(F.greatest(hi - lo, F.lit(2.0**least))))
    exact = F.ceil(F.log2(F.greatest(F.abs(lo), F.abs(hi), F.lit(1.0)))) - 45
    return F.when(hi - lo < 2.0**60, F.greatest(order, exact, F.lit(least))).otherwise(ENDLESS).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.when(level == ENDLESS, F.lit(0).cast("long")).otherwise(F.floor(at / F.pow(F.lit(2.0), level)).cast("long"))


def _bounded(df: DataFrame, side: str, least: int) -> DataFrame:
    """Columns under new names, so that those of both sides never clash, with least and greatest time and level."""
    named = df.toDF(*[f"{side}{i}" for i in range(len(df.columns))])
    start, end = (F.col(f"{side}{df.columns.index(c)}").cast("double") for c in ("start", "end"))
    named = named.where(start.isNotNull() & end.isNotNull()).withColumns({f"{side}lo": F.least(start, end), f"{side}hi": F.greatest(start, end)})
    return named.withColumn(f"{side}level", _level(F.col(f"{side}lo"), F.col(f"{side}hi"), least))


def nested_join(left: DataFrame, right: DataFrame, on: str = "filename", suffix: str = "_right", closed: bool = False, lengths: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """``interval_join`` for keys with very many intervals of any lengths, by nested bins (an implicit interval tree).

    Each interval is at home in the bins of its own level, two at most. A pair overlaps where the later of
    its starts lies in the other interval; so each start looks into one bin of every level that the other
    side has, and each pair is found once. A row makes as many copies as there are levels, some forty
    for intervals from a millisecond to a century in one table, whatever their lengths are.
    Levels in use are looked up unless all intervals of a side have one known length. Rows with a null start or end meet nothing.
    """
    known = [None if length is None else max(LEAST_LEVEL, math.ceil(math.log2(length)) + 1 if length > 0 else LEAST_LEVEL) for length in lengths]
    # Beside intervals of one length shorter ones share its bins: they are looked for in all of such a bin anyway.
    least = max((level for level in known if level is not None), default=LEAST_LEVEL)
    levels = {side: [level] for side, level in zip("lr", known, strict=True) if level is not None}
    l, r = (df if level is None else df.withColumn(f"{side}level", F.lit(level)) for df, side, level in zip((_bounded(left, "l", least), _bounded(right, "r", least)), "lr", known, strict=True))
    unknown = [df.select(F.lit(side).alias("side"), F.col(f"{side}level").alias("level")) for side, df in (("l", l), ("r", r)) if side not in levels]
    if unknown:
        found = reduce(DataFrame.union, unknown).distinct().collect()
        levels |= {side: sorted(x["level"] for x in found if x["side"] == side) for side in {"l", "r"} - set(levels)}

    def home(df: DataFrame, side: str) -> DataFrame:
        level = F.col(f"{side}level")
        return df.withColumns({"__level": level, "__bin": F.explode(F.sequence(_bin(F.col(f"{side}lo"), level), _bin(F.col(f"{side}hi"), level)))})

    def probe(df: DataFrame, side: str, of: list[int]) -> DataFrame:
        return df.withColumn("__level", F.explode(F.array(*map(F.lit, of)).cast("array<int>"))).withColumn("__bin", _bin(F.col(f"{side}lo"), F.col("__level")))

    name = lambda df, side, c: F.col(f"{side}{df.columns.index(c)}")
    meet = overlaps(*(name(left, "l", c) for c in ("start", "end")), *(name(right, "r", c) for c in ("start", "end")), closed)
    same = (name(left, "l", on) == name(right, "r", on)) & meet

    def pairs(a: DataFrame, b: DataFrame, first: Column) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        found = a.join(b, same & first & (F.col("a.__level") == F.col("b.__level")) & (F.col("a.__bin") == F.col("b.__bin")))
        return found.select(*[F.col(f"l{i}") for i in range(len(left.columns))], *[F.col(f"r{i}") for i in range(len(right.columns))])

    lo = F.col("llo"), F.col("rlo")
    both = pairs(home(l, "l"), probe(r, "r", levels["l"]), lo[0] <= lo[1]).unionByName(pairs(home(r, "r"), probe(l, "l", levels["r"]), lo[1] < lo[0]))
    return both.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col(f"r{i}").alias(c + suffix if c in left.columns else c) for i, c in enumerate(right.columns) if c != on])


def touching(left: DataFrame, right: DataFrame, keys: list[str], on: str = "filename", closed: bool = False, lengths: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """The distinct ``keys`` of left rows that meet a right row, by nested bins; for semi and anti joins."""
    met = nested_join(left.select(*keys, *[c for c in (on, "start", "end") if c not in keys]), right.select(on, "start", "end"), on, closed=closed, lengths=lengths)
    return met.select(*keys).distinct()


def union_duration(table: DataFrame, label: int | list[int] | None = None, by: list[str] | None = None, spread: bool | None = None) -> DataFrame:
    """Time covered by at least one interval of a file, summed by ``by`` (all rows together if none)."""
    rows = table if label is None else table.where(F.col("label").isin(label if isinstance(label, list) else [label]))
    parts = Parts.of(rows, ["filename"], ["start", "end"], spread).scan(inclusive=False, __seen=("max", F.col("end")))
    seen = F.coalesce(F.col("__seen"), F.col("start"))
    new = F.greatest(F.lit(0.0), F.col("end") - F.greatest(F.col("start"), seen))
    covered = parts.df.withColumn("__new", new)
    return (covered.groupBy(*by) if by else covered.groupBy()).agg(F.coalesce(F.sum("__new"), F.lit(0.0)).alias("duration"))
