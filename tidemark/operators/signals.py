"""Two-dimensional signals in long form (object, t_bin, f_bin, value) and per-object statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.medians import medians, with_median
from tidemark.operators.scans import has_long_group

KEY = "filename"


def explode_image(df: DataFrame, data: str = "data", key: str = KEY) -> DataFrame:
    """array<array<double>> (time by frequency) to a row for each value."""
    rows = df.select(key, F.posexplode(data).alias("t_bin", "row"))
    return rows.select(key, "t_bin", F.posexplode("row").alias("f_bin", "value"))


def implode_image(long: DataFrame, key: str = KEY) -> DataFrame:
    rows = long.groupBy(key, "t_bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("f_bin", "value"))), lambda s: s["value"]).alias("row"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t_bin", "row"))), lambda s: s["row"]).alias("data"))


def statistics(long: DataFrame, by: tuple[str, ...] = (KEY, "f_bin"), value: str = "value", spread: bool | None = None) -> DataFrame:
    """Maximum, minimum, population deviation, mean and interpolated median along the other axis."""
    v = F.col(value).cast("double")
    spread = has_long_group(long, list(by)) if spread is None else spread
    plain = [F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), F.avg(v).alias("average")]
    if not spread:
        return long.groupBy(*by).agg(*plain, F.median(v).alias("median"))
    return _join(long.groupBy(*by).agg(*plain), medians(long, list(by), value), list(by))


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    other = right.withColumnsRenamed({b: f"__b_{b}" for b in by})
    return left.join(other, [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by], "left").drop(*[f"__b_{b}" for b in by])


def normalize(long: DataFrame, mu: float = 0.0, sd: float = 1.0, key: str = KEY, value: str = "value") -> DataFrame:
    w = Window.partitionBy(key)
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    return long.withColumn(value, F.when(s > 0, sd * (F.col(value) - m) / s + mu).otherwise(F.col(value)))


def adjust_range(long: DataFrame, low: float = 0.0, high: float = 1.0, key: str = KEY, value: str = "value") -> DataFrame:
    """Linear map by frequency bin; null where a bin is constant."""
    w = Window.partitionBy(key, "f_bin")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return long.withColumn(value, low + (high - low) * F.try_divide(F.col(value) - lo, hi - lo))


def enhance(long: DataFrame, enhancement: float = 1.0, key: str = KEY, value: str = "value", spread: bool | None = None) -> DataFrame:
    """Values times a logistic weight of their distance from median plus deviation."""
    spread = has_long_group(long, [key]) if spread is None else spread
    rows = with_median(long, [key], value, "__median", spread)
    if spread:
        rows = _join(rows, long.groupBy(key).agg(F.stddev_pop(value).alias("__std")), [key])
    else:
        rows = rows.withColumn("__std", F.stddev_pop(value).over(Window.partitionBy(key)))
    s = F.col("__std")
    z = F.try_divide(F.col(value) - F.col("__median") - s, s / enhancement)
    return rows.withColumn(value, F.when(s > 0, F.col(value) / (F.exp(-z) + 1)).otherwise(F.col(value))).drop("__median", "__std")


def reduce_tonal_median(long: DataFrame, key: str = KEY, value: str = "value", spread: bool | None = None) -> DataFrame:
    return with_median(long, [key, "f_bin"], value, "__median", spread).withColumn(value, F.col(value) - F.col("__median")).drop("__median")


def reduce_tonal_running(df: DataFrame, time_const: float, data: str = "data") -> DataFrame:
    """Running-mean background of each frequency bin, for images as arrays of rows in time."""
    from tidemark.functions.arrays import ema_residual, let

    image = F.col(data)
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get(image, F.lit(0))) - 1), lambda f: ema_residual(F.transform(image, lambda row: F.get(row, f)), time_const))
    times = F.sequence(F.lit(0), F.size(image) - 1)
    return df.withColumn(data, let(columns, lambda cs: F.transform(times, lambda t: F.transform(cs, lambda c: F.get(c, t)))))


def median_filter(long: DataFrame, row_factor: float = 3.0, col_factor: float = 4.0, key: str = KEY, value: str = "value", spread: bool | None = None) -> DataFrame:
    """1 for values above a multiple of their row's median and then of their column's median, else 0."""
    spread = has_long_group(long, [key]) if spread is None else spread
    rows = with_median(long, [key, "t_bin"], value, "__row", spread)
    kept = rows.withColumn("__v", F.when(F.col(value) > row_factor * F.col("__row"), F.col(value)).otherwise(0.0))
    both = with_median(kept, [key, "f_bin"], "__v", "__col", spread)
    return both.withColumn(value, F.when((F.col("__v") > col_factor * F.col("__col")) & (F.col("__v") > 0), 1.0).otherwise(0.0)).drop("__v", "__row", "__col")


def detect_peaks(df: DataFrame, distance: int = 1, multiplicity: int = 1, prominence: float = 1.0, height: float | None = None, data: str = "data", out: str = "peaks") -> DataFrame:
    """Images (time by series) with ``out``: 1 for each time at which at least ``multiplicity`` series peak, else 0.

    Prominence is in units of a series' median distance from its median; peaks are ``distance`` apart.
    """
    from tidemark.functions import kernels as K

    flags = K.kernel(lambda a: K.peak_flags(a, distance, multiplicity, prominence, height), "array<int>", image=True)
    return df.withColumn(out, flags(data))


def add_images(a: DataFrame, b: DataFrame, t_offset: int = 0, scale: float = 1.0, key: str = KEY) -> DataFrame:
    """Value by value sum of two images of an object, the second moved in time; the extent is the first's."""
    moved = b.select(key, (F.col("t_bin") + t_offset).alias("t_bin"), "f_bin", (F.col("value") * scale).alias("__b"))
    return a.join(moved, [key, "t_bin", "f_bin"], "left").withColumn("value", F.col("value") + F.coalesce("__b", F.lit(0.0))).drop("__b")


def weighted_bands(long: DataFrame, bank: DataFrame, key: str = KEY) -> DataFrame:
    """Sums of values by weights: ``bank`` is (m, f_bin, weight), small by its nature."""
    joined = long.join(bank, "f_bin")
    return joined.groupBy(key, "t_bin", "m").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
