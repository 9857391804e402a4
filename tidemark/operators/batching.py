"""Batches as columns: ordinals, batch numbers, label codes, joint and multimodal batches.

A global ordinal is needed to cut a table into batches. ``with_ordinal`` gets it without sorting in
one task: rows are cut into ranges of their order and stored, counted by range, and numbered inside it.
"""

from __future__ import annotations

import os
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.storage import fresh_folder, running, stored


def label_codes(table: DataFrame, label: str = "label") -> DataFrame:
    """(label, code): sorted distinct labels from 0; distinct labels are few by nature."""
    return table.select(label).distinct().withColumn("code", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))


def map_labels(table: DataFrame, codes: DataFrame | dict, label: str = "label") -> DataFrame:
    if isinstance(codes, dict):
        return table.withColumn(label, F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])[F.col(label)])
    small = codes.select(F.col(label).alias("__raw"), "code")
    joined = table.join(small, F.col(label) == F.col("__raw"), "left")
    return joined.withColumn(label, F.col("code")).drop("__raw", "code")


def unique_labels(*tables: DataFrame, label: str = "label") -> DataFrame:
    out = tables[0].select(label)
    for t in tables[1:]:
        out = out.union(t.select(label))
    return out.distinct().orderBy(label)


def with_ordinal(table: DataFrame, order: list, name: str = "ord", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the given total order."""
    counted = running(table.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}, partitions)
    return counted.withColumn(name, F.col(name) - 1).drop("__one")


def shuffled(seed: int, *keys: str) -> list[Column]:
    """An order that looks random, is the same on every run, and changes with the seed (an epoch, say)."""
    return [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)]


def batches(table: DataFrame, batch_size: int, order: list, extend: int = 0, where: str | None = None, drop_ordinal: bool = False) -> DataFrame:
    """Rows with ``batch_id``; what is left over joins the last batch.

    With ``extend`` each batch also has so many rows of its neighbours, within the full batches.
    """
    rows = table.where(where) if where else table
    numbered = with_ordinal(rows, order)
    total = rows.agg(F.count("*").alias("__total"))
    joined = numbered.join(F.broadcast(total))
    n = F.greatest(F.floor(F.col("__total") / batch_size), F.lit(1))
    own = F.least(F.floor(F.col("ord") / batch_size), n - 1)
    if extend == 0:
        out = joined.withColumn("batch_id", own.cast("int"))
    else:
        full = n * batch_size
        first = F.greatest(F.lit(0), F.floor((F.col("ord") - extend) / batch_size))
        last = F.least(n - 1, F.floor((F.col("ord") + extend) / batch_size))
        ids = F.when(F.col("ord") >= full, F.array(n - 1)).otherwise(F.sequence(F.least(first, own), F.greatest(last, own)))
        out = joined.withColumn("batch_id", F.explode(ids.cast("array<int>")))
    return out.drop("__total", *["ord"] * drop_ordinal)


def strong_labels(data: DataFrame, annotations: DataFrame, id_column: str = "id") -> DataFrame:
    """Data rows with ``annotations``, the list of their labels and times; empty if there are none."""
    one = F.struct("start", "end", "label")
    grouped = annotations.groupBy("data_index").agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    joined = data.join(grouped, data[id_column] == grouped["data_index"], "left").drop("data_index")
    kind = grouped.schema["annotations"].dataType
    return joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(kind)))


def joint(tables: list[DataFrame], n_batches: str | int = "min", map_codes: bool = False, label: str = "label") -> DataFrame:
    """Batch i of each batched table together, rows tagged by ``gen_id``.

    ``n_batches`` is the least or most that any table has, or a number; shorter tables start over.
    """
    sizes = [int(t.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0))).first()[0]) for t in tables]
    n = min(sizes) if n_batches == "min" else max(sizes) if n_batches == "max" else int(n_batches)
    out = None
    for gen, (t, size) in enumerate(zip(tables, sizes, strict=True)):
        if size >= n:
            part = t.where(F.col("batch_id") < n)
        elif size == 0:
            part = t
        else:
            own = F.col("batch_id")
            rounds = F.sequence(F.lit(0), F.floor((F.lit(n - 1) - own) / size).cast("int"))
            part = t.withColumn("__r", F.explode(rounds)).withColumn("batch_id", (own + F.col("__r") * size).cast("int")).drop("__r")
        part = part.withColumn("gen_id", F.lit(gen))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return map_labels(out, label_codes(out, label), label) if map_codes else out


def multimodal(tables: dict[str, DataFrame], on: str = "id") -> DataFrame:
    """One row for each key that all tables have, with a struct of the other columns for each mode."""
    out = None
    for name, t in tables.items():
        part = t.select(on, F.struct(*[c for c in t.columns if c != on]).alias(name))
        out = part if out is None else out.join(part, on)
    return out


def feed(batched: DataFrame, transform: Callable | None = None) -> Iterator[tuple[int, list]]:
    """Batches in order as (batch_id, rows), streamed to the driver one partition at a time."""
    current, rows = None, []
    for r in batched.repartitionByRange("batch_id").sortWithinPartitions("batch_id").toLocalIterator(prefetchPartitions=True):
        if current is not None and r["batch_id"] != current:
            yield current, transform(rows) if transform else rows
            rows = []
        current = r["batch_id"]
        rows.append(r)
    if rows:
        yield current, transform(rows) if transform else rows


def in_turns(batched: DataFrame, workers: int, seed: int | None = None) -> DataFrame:
    """Rows with ``turn``: the place of their batch in an epoch's order (that of the batch numbers without a seed).

    Turns are numbered over the distinct batches, in ranges; rows lie in the partition ``turn % workers``, by turn.
    """
    ids = batched.select("batch_id").distinct()
    order = [F.col("batch_id")] if seed is None else shuffled(seed, "batch_id")
    turns = with_ordinal(ids, order, "turn").withColumnRenamed("batch_id", "__id")
    joined = batched.join(turns, F.col("batch_id") == F.col("__id")).drop("__id")
    return joined.repartitionById(workers, (F.col("turn") % workers).cast("int"))


def meeting(folder: str | None) -> Callable[[], None]:
    """What a task of a barrier stage calls to wait until all tasks have called it as often.

    Spark's own ``barrier`` sleeps for a second whenever it is called. It is called twice to find out whether all tasks see ``folder``;
    if so each has a file there that grows by a byte with every call, and waits for those of the others. If not, Spark's is all there is.
    The files' names are new ones in every attempt of a stage.
    """
    from pyspark import BarrierTaskContext

    context = BarrierTaskContext.get()
    own = f"{folder}/{uuid.uuid4().hex}" if folder else ""
    try:
        if own:
            open(own, "xb").close()
    except OSError:
        own = ""
    names = context.allGather(own)
    seen = all(n and os.path.exists(n) for n in names)
    if "no" in context.allGather("yes" if seen else "no"):
        return context.barrier
    others, calls = [n for n in names if n != own], 0

    def length(name: str) -> int:
        with open(name, "rb") as f:  # opened anew each time, for which a network's file system asks its server
            return os.fstat(f.fileno()).st_size

    def meet() -> None:
        nonlocal calls
        calls += 1
        with open(own, "ab") as f:
            f.write(b".")
        for name in others:
            pause = 1e-4
            while length(name) < calls:
                time.sleep(pause)
                pause = min(2 * pause, 0.02)

    return meet


def feed_tasks(batched: DataFrame, fn: Callable, schema: str | T.StructType, workers: int, seed: int | None = None, order: tuple[str, ...] = (), lockstep: bool = False) -> DataFrame:
    """One epoch on the executors: task k gets batches k, k + workers, ... of the epoch's order, each once.

    ``fn(turn, batch_id, rows)`` gets an Arrow table of one batch and returns one of ``schema``; no row passes through the
    driver. The tasks run together in a barrier stage, as data-parallel training needs; with ``lockstep`` they also wait for each other
    after every batch (see ``meeting``), and those without a last one wait along. A task holds one batch. The rows are stored
    by turn first, so that a stage that is tried again reads the same ones.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = stored(in_turns(batched, workers, seed).sortWithinPartitions("turn", *order), "epoch")
    steps = int(rows.agg(F.coalesce(F.floor(F.max("turn") / workers) + 1, F.lit(0))).first()[0])
    dealt = rows.repartitionById(workers, (F.col("turn") % workers).cast("int")).sortWithinPartitions("turn", *order)
    names = batched.columns
    folder = fresh_folder(batched.sparkSession, "meeting") if lockstep else None
    kind = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet, done = meeting(folder) if lockstep else None, 0

        def one(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            nonlocal done
            table = pa.Table.from_batches(held)
            got = fn(table.column("turn")[0].as_py(), table.column("batch_id")[0].as_py(), table.select(names))
            done += 1
            if lockstep:
                meet()
            return got.select(kind.names).cast(kind).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for part in parts:
            turns = part.column("turn").to_pylist()
            at = 0
            while at < len(turns):
                end = bisect_right(turns, turns[at], at)
                if held and held[0].column("turn")[0].as_py() != turns[at]:
                    yield from one(held)
                    held = []
                held.append(part.slice(at, end - at))
                at = end
        if held:
            yield from one(held)
        while lockstep and done < steps:
            meet()
            done += 1

    return dealt.mapInArrow(run, schema, barrier=True)


def map_batches(batched: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` (a pandas frame of one batch to another) on the executors."""
    return batched.groupBy("batch_id").applyInPandas(fn, schema)


def require_same_shape(table: DataFrame, data: str = "data", label: str = "label") -> DataFrame:
    """(rows, shapes, missing_labels): more than one shape or a missing label is an inconsistent set."""
    return table.agg(F.count("*").alias("rows"), F.count_distinct(F.size(data)).alias("shapes"), F.count_if(F.col(label).isNull() | F.isnan(F.col(label).cast("double"))).alias("missing_labels"))
