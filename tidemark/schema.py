"""Standard tables as Spark schemas, and the checks that the operators make on their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ANNOTATIONS = "filename string, annot_id int, label int, start double, end double, freq_min double, freq_max double"
SELECTIONS = "filename string, sel_id int, start double, end double, label int"
FILES = "filename string, duration double"
DETECTIONS = "filename string, start double, duration double, score double"
FRAMES = "filename string, offset double, score double"

#: Columns that a table keeps when it is trimmed, in no particular order.
STANDARD = ("filename", "label", "start", "end", "freq_min", "freq_max")
FLOATS = ("start", "end", "freq_min", "freq_max")

# Names of stored column types.
TYPES = {
    "int": T.IntegerType(), "uint": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "datetime": T.TimestampType(),
    "int8": T.ByteType(), "uint8": T.ShortType(), "int32": T.IntegerType(), "uint32": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}


class SchemaError(ValueError):
    """A table lacks what an operator needs."""


def column(name: str, dtype: str, shape: tuple[int, ...] = ()) -> T.StructField:
    """A field for a type name; unsigned types widen, and a shape nests arrays and is kept as metadata."""
    if dtype not in TYPES:
        raise SchemaError(f"unknown type {dtype!r}")
    kind: T.DataType = TYPES[dtype]
    for _ in shape:
        kind = T.ArrayType(kind)
    return T.StructField(name, kind, True, {"shape": list(shape)} if shape else {})


def data_table(shapes: dict[str, tuple[int, ...]] | tuple[int, ...] | list, label: bool = True, source: bool = True, attrs: dict[str, str] | None = None) -> T.StructType:
    """Schema of a data table: id, tensors of float32, source and offset, label, further attributes.

    One shape names its column ``data``, a list of shapes ``data0``, ``data1``, ...
    """
    if isinstance(shapes, dict):
        named = shapes
    elif isinstance(shapes, list):
        named = {f"data{i}": s for i, s in enumerate(shapes)}
    else:
        named = {"data": shapes}
    fields = [column("id", "uint32"), *[column(k, "float32", s) for k, s in named.items()]]
    if source:
        fields += [column("filename", "str"), column("offset", "float64")]
    if label:
        fields.append(column("label", "int32"))
    return T.StructType([*fields, *[column(k, t) for k, t in (attrs or {}).items()]])


def annotation_table(freq: bool = False) -> T.StructType:
    """Schema of stored annotations, many for each row of a data table."""
    fields = [column("data_index", "uint32"), column("label", "int32"), column("start", "float64"), column("end", "float64")]
    return T.StructType(fields + [column(k, "float32") for k in ("freq_min", "freq_max")] * freq)


def empty_annotations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "filename string, annot_id int, label int, start double, end double")


def empty_selections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "filename string, sel_id int, start double, end double")


def dimensions(kind: T.DataType) -> int:
    """How deep arrays nest in a column type: 0 for a scalar, 2 for an image."""
    return 1 + dimensions(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def missing(df: DataFrame, time: bool = False) -> list[str]:
    """Required columns that a table lacks."""
    return [c for c in ("filename", "label", *(("start", "end") if time else ())) if c not in df.columns]


def is_standard(df: DataFrame, time: bool = False) -> bool:
    """Whether a table has the keys and columns of standard annotations."""
    return not missing(df, time) and ("annot_id" in df.columns or "sel_id" in df.columns)


def require(df: DataFrame, *columns: str) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise SchemaError(f"missing columns: {', '.join(lacking)}")
