"""Exact medians of groups of any size, by radix selection.

``F.median`` keeps the values of a group in one task. Here each double becomes a whole number of the same order, and the
middle ones are found 16 bits at a time: values that begin with what is known so far are counted by their next 16 bits,
summed in Spark (65,536 numbers a group at most, combined before the shuffle), and the part that the rank falls into is taken. Four
rounds give all bits. Even groups have two middle values, and their mean is the median.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scans import LONG, has_long_group
from tidemark.storage import discard, stored

DIGIT = 16
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; what is no number comes last, whatever its bits are."""
    x = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = x.view(np.int64)
    return np.where(np.isnan(x), _FLIP, np.where(bits < 0, bits ^ _FLIP, bits))


def from_bits(keys: np.ndarray) -> np.ndarray:
    x = np.where(keys < 0, keys ^ _FLIP, keys).view(np.float64)
    return np.where(keys == _FLIP, np.nan, x)


def _udf(fn, kind: str):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(fn(values.to_numpy()))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def medians(table: DataFrame, by: list[str], value: str = "value", out: str = "median") -> DataFrame:
    """(by, out): the interpolated median of each group's values that are not null, or null if it has none."""
    keys = [f"__g{i}" for i in range(len(by))]
    named = table.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"))
    rows = stored(named.where("v IS NOT NULL").select(*keys, _udf(ordered_bits, "long")("v").alias("key")), "keys")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)).cast("array<bigint>")
    goals = stored(sizes.select(*keys, F.posexplode(ranks).alias("which", "rank")).withColumn("prefix", F.lit(0).cast("long")), "goals")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("key", shift) if shift == 64 - DIGIT else F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        met = _same(rows, goals, keys)
        if shift < 64 - DIGIT:
            met = met.where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        counts = met.groupBy(*keys, "which", "prefix", "rank", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "which").orderBy("digit"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        prefix = F.col("digit") if shift == 64 - DIGIT else F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))
        narrowed = stored(found.select(*keys, "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), prefix.cast("long").alias("prefix")), "goals")
        discard(goals)
        goals = narrowed
    discard(rows)
    middle = goals.withColumn("v", _udf(from_bits, "double")("prefix")).groupBy(*keys).agg(F.avg("v").alias(out))
    groups = named.select(*keys).distinct()
    joined = _same(groups, middle, keys, "left")
    return joined.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], out)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which a null is a value like others."""
    other = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys], how).drop(*[f"{k}_r" for k in keys])


def with_median(table: DataFrame, by: list[str], value: str, out: str, spread: bool | None = None) -> DataFrame:
    """The table with a column ``out``, the median of each row's group; long groups are neither sorted nor held."""
    spread = has_long_group(table, by, LONG) if spread is None else spread
    if not spread:
        return table.withColumn(out, F.median(F.col(value).cast("double")).over(Window.partitionBy(*by)))
    found = medians(table, by, value, out).withColumnsRenamed({b: f"__b_{b}" for b in by})
    return table.join(found, [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by], "left").drop(*[f"__b_{b}" for b in by])
