"""Helpers that several operators share: shared storage, bounded Arrow batches, words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one step of a vectorised kernel works on; bounds a worker's memory.
STEP_BYTES = 6 << 20

#: The local default is for tests on one machine; a cluster names its own shared folder.
LOCAL_CHECKPOINTS = "/tmp/tidemark-checkpoints"

_U = np.uint64
MIX = _U(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (tests) a local folder is used; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        found = f"file://{LOCAL_CHECKPOINTS}"
    return found.rstrip("/")


def column(name: str) -> Column:
    """The column of exactly this name, also if the name has dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(name) for name in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (names match without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined on ``key`` with ``table``, which has one row for each key.

    Keys that hold at least one of ``parts`` shares of the rows, of which there can be no more than
    ``parts``, travel to their rows by broadcast; the others are shuffled. So no key, however many
    rows it has, lands in one task. ``rows`` should be a stored table: it is read three times.
    """
    parts = max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count()
    held = rows.groupBy(key).count().where((F.col("count") * parts >= total) & F.col(key).isNotNull())
    hot = [r[0] for r in held.select(key).collect()] if total > 10 * parts else []
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, "left")
    return few.unionByName(rows.where(~is_hot).join(table.where(~is_hot), key, "left"))


#: Lists of the folders that were named inside ``temporary``.
_NAMED: list[list[str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    for names in _NAMED:
        names.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Folders that are named inside are deleted at the end, but for those that are taken off the list."""
    names: list[str] = []
    _NAMED.append(names)
    try:
        yield names
    finally:
        _NAMED.remove(names)
        for path in names:
            delete_path(spark, path)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    delete_path(stored.sparkSession, stored.stored_at)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES, measure: Callable[[pa.Array], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``, or one row.

    A single longer text stays whole in a step of its own. ``measure`` gives other sizes than lengths.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = measure(values) if measure else pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step_of = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(step_of)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of distinct strings or binaries; ``to_pylist`` would take longer than the hashes."""
    words = words.cast(pa.binary()) if pa.types.is_string(words.type) else words
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), dtype=_U, count=len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the multiply-xorshift of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (20 and 09 to 0D), A-Z in lower case, for each text.

    Returns (doc, word, dictionary): for every word occurrence the row of its text and the index of
    the word in the dictionary. Null and empty texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    word = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    blank = np.flatnonzero(np.asarray(pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)))
    if len(blank):
        keep = word != blank[0]
        doc, word = doc[keep], word[keep]
    return doc, word, flat.dictionary


def ascii_lower_column(c):
    """A-Z to a-z and nothing else, as a native expression."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value, fn):
    """``fn(value)`` as an expression that computes ``value`` once; a lambda would do so for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def planes(a: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of ``width`` bytes by byte planes, which compress well where most are small and not negative."""
    return a.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unplanes(b: bytes, width: int = 4) -> np.ndarray:
    """What ``planes`` packed."""
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel().astype(np.int64)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, also with dots and backticks, which it can't name itself."""
    names = df.columns
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])
    return safe.mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def append_struct(df: DataFrame, column: str, out: str, schema, kernel_factory, limit: int | None = None, measure=None) -> DataFrame:
    """Append a struct column ``out`` that a vectorised kernel computes from text ``column``.

    ``kernel_factory()`` runs once a task and returns a function from an Arrow text array to an
    Arrow struct array of equal length. All other columns pass through untouched; a column that
    is already named ``out`` is replaced. Column names match as Spark matches them, without case.
    A call of the kernel gets about ``limit`` bytes of text (``STEP_BYTES`` if none is given), as ``measure`` measures it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.drop(out)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_type = to_arrow_type(schema)

    def run(batches):
        kernel = kernel_factory()
        for step in steps(batches, column, limit or STEP_BYTES, measure):
            got = kernel(step.column(column))
            made = got if isinstance(got, pa.Array) else pa.array(got, type=arrow_type)
            yield pa.RecordBatch.from_arrays([*step.columns, made], names=[*step.schema.names, out])

    return map_batches(df, run, StructType([*df.schema.fields, StructField(out, schema)]))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
