"""Typed tables in Parquet: a data table of tensors, and the annotations of its rows beside it.

A store is a folder with one folder for each table. ``<name>`` holds rows with an ``id``,
``<name>_annot`` their annotations, many for each ``data_index``, and ``<name>_labels`` the distinct labels of each write. What
holds for a whole table (column shapes, the representation's parameters) is metadata of its columns.

What a table consists of is said by a log of commits (``_log``), each a small file with the next number. Its name is taken by a
link or rename that fails if the name is there, so of two writers one comes first and the other tries the next number. A
write first reserves its ids by a commit, then writes its files, then lists the files of all three tables in one commit: readers see
all of it or nothing, and ids never meet. A write that fails leaves unlisted files and a gap of ids. The list
has the least and greatest id of every file, so looking up ids opens only files that may hold them.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.batching import strong_labels, with_ordinal
from tidemark.schema import SchemaError
from tidemark import storage

ATTRS = "representation"
CODEC = "zstd"
#: Commits after which the log is summed up in one file.
SUMMARY = 20
#: Columns whose least and greatest values are kept for each file.
KEYS = ("id", "data_index")


class Conflict(RuntimeError):
    """Another writer took the number of a commit."""


class Log:
    """The commits of a store, in order, and the tables that they make."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_log"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        """A whole file under a name that must be free."""
        own = f".{uuid.uuid4().hex}"
        out = self.fs.create(self._path(own), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                import os

                os.link(*(self.spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(self._path(n)).toString() for n in (own, name)))
            elif self.fs.exists(self._path(name)) or not self.fs.rename(self._path(own), self._path(name)):
                raise FileExistsError(name)
        except FileExistsError as e:
            raise Conflict(name) from e
        finally:
            self.fs.delete(self._path(own), False)

    def state(self) -> dict:
        """{version, tables: {name: {schema, files, next, root}}}: the last summary and the commits after it."""
        if not self.fs.exists(self._path("")):
            return {"version": 0, "tables": {}}
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("")))
        sums = [n for n in names if n.endswith(".sum")]
        out = self._read(sums[-1]) if sums else {"version": 0, "tables": {}}
        for n in names:
            if n.endswith(".commit") and int(n[:-7]) > out["version"]:
                _apply(out["tables"], self._read(n))
                out["version"] = int(n[:-7])
        return out

    def commit(self, make, tries: int = 100) -> dict:
        """Write ``make(tables)`` as the next commit; if another writer was first, make it again from the newer state."""
        for _ in range(tries):
            state = self.state()
            entry = make(state["tables"])
            number = state["version"] + 1
            try:
                self._write(f"{number:020d}.commit", entry)
            except Conflict:
                continue
            if number % SUMMARY == 0:
                _apply(state["tables"], entry)
                try:
                    self._write(f"{number:020d}.sum", {"version": number, "tables": state["tables"]})
                except Conflict:
                    pass
            return entry
        raise Conflict(f"no number of {self.root} was free")


def _apply(tables: dict, entry: dict) -> None:
    for name, change in entry.items():
        table = tables.setdefault(name, {"schema": None, "files": [], "next": 0})
        if change.get("replace"):
            table["files"] = []
        if change.get("schema"):
            table["schema"] = change["schema"]
        table["files"] = table["files"] + change.get("files", [])
        table["next"] = max(table["next"], change.get("next", 0))


def _merged(old: dict | None, new: T.StructType) -> dict:
    """The fields of both; those of the newer schema count where both have them, but not their lack of metadata."""
    if old is None:
        return new.jsonValue()
    fields = {f.name: f for f in T.StructType.fromJson(old).fields}
    for f in new.fields:
        kept = fields[f.name].metadata if f.name in fields else {}
        fields[f.name] = T.StructField(f.name, f.dataType, True, f.metadata or kept)
    return T.StructType(list(fields.values())).jsonValue()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name.strip('/')}"

    def exists(self, name: str) -> bool:
        return name.strip("/") in self.log.state()["tables"]

    def open(self, name: str, ids: list[int] | None = None) -> DataFrame:
        """A table as its commits have it; KeyError if there is none. With ``ids`` only files that may hold them."""
        table = self.log.state()["tables"].get(name.strip("/"))
        if table is None or table["schema"] is None:
            raise KeyError(f"no table {name!r} in {self.root}")
        schema = T.StructType.fromJson(table["schema"])
        wanted = None if ids is None else sorted(ids)
        files = [f for f in table["files"] if f["n"] and (wanted is None or f["low"] is None or _within(f["low"], f["high"], wanted))]
        if not files:
            return self.spark.createDataFrame([], schema)
        base = self.path(name)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f['file']}" for f in files]).select(*schema.names)

    def create(self, name: str, schema: T.StructType) -> None:
        """An empty table of the schema, unless the table is there."""
        if not self.exists(name):
            self.log.commit(lambda tables: {} if name in tables else {name.strip("/"): {"schema": schema.jsonValue()}})

    def write(self, name: str, data: DataFrame, annotations: DataFrame | None = None, mode: str = "append", order: list | None = None, attrs: dict | None = None, resize: int = 0, shape: tuple[int, ...] | None = None, discard: bool = False, partition_by: list[str] | None = None, max_records: int = 0) -> None:
        """Rows, and annotations by their rows' ``id``; new rows without an id are numbered on.

        With ``shape`` rows of another length within ``resize`` are cut or padded; others go if
        ``discard``, else they are an error. ``max_records`` rolls files. All or nothing of it is seen.
        """
        name = name.strip("/")
        if mode == "r+" and not self.exists(name):
            raise KeyError(f"no table {name!r} in {self.root}")
        mode = {"a": "append", "w": "overwrite", "r+": "append"}.get(mode, mode)
        if shape is not None:
            data = fit_shape(data, shape, resize, discard)
        numbered = None
        if "id" not in data.columns:
            numbered = storage.stored(with_ordinal(data, order or [c for c, t in data.dtypes if not t.startswith("array")], "id"), "numbered")
            first = 0 if mode == "overwrite" else self._reserve(name, numbered.count())
            data = numbered.withColumn("id", (F.col("id") + first).cast("long"))
        if attrs:
            data = data.withMetadata("id", {ATTRS: json.dumps(attrs, sort_keys=True)})
        parts = {name: (data, partition_by or [])}
        if "label" in data.columns:
            parts[f"{name}_labels"] = (data.select("label").where("label IS NOT NULL").distinct(), [])
        if annotations is not None:
            parts[f"{name}_annot"] = (annotations, [])
        written = {table: self._files(table, df, by, max_records if table == name else 0) for table, (df, by) in parts.items()}
        if numbered is not None:
            storage.discard(numbered)

        def entry(tables: dict) -> dict:
            out = {}
            for table, (df, _) in parts.items():
                old = None if mode == "overwrite" else tables.get(table, {}).get("schema")
                top = max((f["high"] + 1 for f in written[table] if f["high"] is not None), default=0)
                out[table] = {"replace": mode == "overwrite", "schema": _merged(old, df.schema), "files": written[table], "next": top}
            return out

        self.log.commit(entry)

    def _reserve(self, name: str, n: int) -> int:
        """The first of ``n`` ids that no other write gets."""
        first = 0

        def entry(tables: dict) -> dict:
            nonlocal first
            first = tables.get(name, {}).get("next", 0)
            return {name: {"next": first + n}}

        self.log.commit(entry)
        return first

    def _files(self, table: str, df: DataFrame, partition_by: list[str], max_records: int) -> list[dict]:
        """Write rows to a folder of their own; (file, rows, least and greatest id) of its files."""
        folder = f"commit={uuid.uuid4().hex}"
        out = df.write.option("compression", CODEC)
        out = out.option("maxRecordsPerFile", max_records) if max_records else out
        target = f"{self.path(table)}/{folder}"
        (out.partitionBy(*partition_by) if partition_by else out).parquet(target)
        key = next((k for k in KEYS if k in df.columns), None)
        back = self.spark.read.schema(df.schema).parquet(target).withColumn("__file", F.regexp_extract(F.input_file_name(), f"({folder}/.*)$", 1))
        bounds = [F.min(key).alias("low"), F.max(key).alias("high")] if key else [F.lit(None).alias("low"), F.lit(None).alias("high")]
        found = back.groupBy("__file").agg(F.count("*").alias("n"), *bounds).collect()
        return [{"file": r["__file"], "n": r["n"], "low": r["low"], "high": r["high"]} for r in found]

    def load(self, name: str, ids: list[int] | None = None, annotated: bool = True) -> DataFrame:
        """Rows by id (all if none given) with the list of their annotations."""
        data = self.open(name, ids)
        if ids is not None:
            data = data.where(F.col("id").isin(ids))
        if not annotated or not self.exists(f"{name}_annot"):
            return data
        annot = self.open(f"{name}_annot", ids)
        return strong_labels(data, annot if ids is None else annot.where(F.col("data_index").isin(ids)))

    def ids_with_label(self, name: str, labels: int | list[int]) -> DataFrame:
        """Distinct ids with a row or an annotation of these labels, in order."""
        wanted = [labels] if isinstance(labels, int) else list(labels)
        if not all(isinstance(x, int) and not isinstance(x, bool) for x in wanted):
            raise TypeError("labels must be integers")
        strong = self.exists(f"{name}_annot")
        table = self.open(f"{name}_annot" if strong else name)
        return table.where(F.col("label").isin(wanted)).select(F.col("data_index" if strong else "id").alias("id")).distinct().orderBy("id")

    def attributes(self, name: str) -> dict:
        return json.loads(self.open(name).schema["id"].metadata.get(ATTRS, "{}"))

    def unique_labels(self, name: str) -> list:
        """The distinct labels of all writes; codes of classes, so few."""
        kept = f"{name}_labels"
        table = self.open(kept if self.exists(kept) else name)
        return [r[0] for r in table.select("label").where("label IS NOT NULL").distinct().orderBy("label").collect()]


def _within(low: int, high: int, ids: list[int]) -> bool:
    """Whether one of the ids, which are in order, lies between."""
    at = bisect_left(ids, low)
    return at < len(ids) and ids[at] <= high


def fit_shape(data: DataFrame, shape: tuple[int, ...], resize: int = 0, discard: bool = False, column: str = "data") -> DataFrame:
    """Rows whose tensor has the shape, or is brought to it if each dimension is off by ``resize`` at most."""
    dims = [F.size(column)]
    if len(shape) > 1:
        dims.append(F.size(F.get(F.col(column), F.lit(0))))
    near = F.lit(True)
    for have, want in zip(dims, shape, strict=True):
        near = near & (F.abs(have - want) <= resize)
    edge = lambda a, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, F.least(i, F.size(a) - 1)))
    fitted = edge(F.col(column), shape[0])
    if len(shape) > 1:
        fitted = F.transform(fitted, lambda row: edge(row, shape[1]))
    if discard:
        return data.where(near).withColumn(column, fitted)
    wrong = F.raise_error(F.lit(f"a tensor is not of shape {shape}")).cast(data.schema[column].dataType)
    return data.withColumn(column, F.when(near, fitted).otherwise(wrong))


def create_database(store: Store, name: str, selections: DataFrame, files: DataFrame, annotations: DataFrame | None = None, rate: float | None = None, represent=None, **options) -> DataFrame:
    """Load selections, turn them into a representation, store them; returns the rows that failed.

    ``represent`` is a function of a DataFrame with ``data`` and ``rate`` columns to one of the same rows.
    """
    from tidemark.sources.audio import load_waveforms

    loaded = load_waveforms(selections, files, rate)
    good = loaded.where("wave.error IS NULL").select(*selections.columns, F.col("wave.rate").alias("rate"), F.col("wave.data").alias("data"))
    if represent is not None:
        good = represent(good)
    rows = good.withColumnRenamed("start", "offset").drop("end")
    if "data" not in rows.columns:
        raise SchemaError("a representation must have a data column")
    store.write(name, rows, annotations, order=["filename", "offset", *[c for c in ("sel_id",) if c in rows.columns]], **options)
    return loaded.where("wave.error IS NOT NULL").select("filename", "start", "end", F.col("wave.error").alias("error"))
