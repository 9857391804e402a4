"""Medians by bits against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import medians as M
from tidemark.operators import signals as X


def test_bits_are_in_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, 1.0000000000000002, 3.0, np.inf, np.nan])
    keys = M.ordered_bits(x)
    assert (np.diff(keys) >= 0).all() and np.array_equal(M.from_bits(keys), x, equal_nan=True)


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(2)
    rows = [("odd", float(v)) for v in rng.normal(0, 1e6, 501)] + [("even", float(v)) for v in rng.lognormal(0, 30, 500)] + [("tied", 7.0)] * 30 + [("tied", -1.0)] * 29
    rows += [("one", -3.5), ("two", 1.0), ("two", 2.0), ("null", None), ("some", None), ("some", 4.0), (None, 5.0), (None, 6.0), ("small", 5e-324), ("small", -5e-324), ("small", 0.0), ("same", 1.0), ("same", 1.0000000000000002), ("same", 1.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {r["g"]: r["median"] for r in M.medians(df, ["g"]).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("value").alias("m")).collect()}
    assert got == want and len(got) == 10


def test_signal_operators_agree(spark):
    long = spark.range(4000).select(F.when(F.col("id") < 3900, "a").otherwise("b").alias("filename"), (F.col("id") % 50).alias("t_bin"), F.floor(F.col("id") / 50).alias("f_bin"), (F.abs(F.xxhash64("id") % 1000) / 7).alias("value"))
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for fn in (lambda s: X.enhance(long, 2.0, spread=s), lambda s: X.reduce_tonal_median(long, spread=s), lambda s: X.median_filter(long, 1.2, 1.1, spread=s), lambda s: X.statistics(long, ("filename",), spread=s)):
        assert rows(fn(True)) == rows(fn(False))


def test_a_million_values_of_one_group(spark):
    df = spark.range(1_000_001).select(F.lit("g").alias("g"), ((F.col("id") * 48271) % 1_000_003).cast("double").alias("value"))
    want = sorted((i * 48271) % 1_000_003 for i in range(1_000_001))[500_000]
    assert M.medians(df, ["g"]).first()["median"] == pytest.approx(want)
