"""Annotation tables: standardise, key, label, filter, crop, shift, segment, stack and append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema
from tidemark.functions.scalar import parse_datetime, to_hertz, to_seconds
from tidemark.operators.batching import with_ordinal
from tidemark.operators.scans import PART, Parts

LABEL_MAP = "label_map"


def rename_columns(table: DataFrame, mapper: dict[str, str]) -> DataFrame:
    """Rename by {old: new}."""
    return table.withColumnsRenamed(mapper)


def unfold(table: DataFrame, sep: str = ",") -> DataFrame:
    """A row for each value of a label cell that holds several."""
    return table.withColumn("label", F.explode(F.split(F.col("label").cast("string"), f"[{sep}]" if len(sep) == 1 and sep not in "\\^]" else sep)))


def trim(table: DataFrame, extra: list[str] | None = None) -> DataFrame:
    keep = {*schema.STANDARD, *(extra or ())}
    return table.select([c for c in table.columns if c in keep])


def ordinal(table: DataFrame, name: str, order: list | None = None, by: str = "filename", spread: bool | None = None) -> DataFrame:
    """Key rows within a file by their place, from 0, in the given total order; long files are numbered in ranges."""
    parts = Parts.of(table, [by], order or [c for c in ("start", "end", "label") if c in table.columns], spread)
    numbered = parts.scan(__place=("count", F.lit(1))).df
    return numbered.withColumn(name, (F.col("__place") - 1).cast("int")).drop(PART, "__place")


def label_codes(labels: list | None, found: list[str], start_at_1: bool = False) -> dict[str, int]:
    """Codes by raw label (as text): listed labels, or lists of them, count up; others found are -1.

    Without a list all labels found count, in the order of their texts.
    """
    groups = [[str(x) for x in g] if isinstance(g, (list, tuple)) else [str(g)] for g in (sorted(found) if labels is None else labels)]
    flat = [x for g in groups for x in g]
    if unknown := [x for x in flat if x not in found]:
        raise ValueError(f"labels not in the table: {', '.join(unknown)}")
    return {x: -1 for x in found if x not in flat} | {x: i + start_at_1 for i, g in enumerate(groups) for x in g}


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV table with a header; every column text, so that nothing is inferred from the data."""
    return spark.read.csv(path, header=True, sep=sep)


def standardize(
    table: DataFrame,
    mapper: dict[str, str] | None = None,
    labels: list | None = None,
    start_labels_at_1: bool = False,
    unfold_labels: bool = False,
    label_sep: str = ",",
    trim_table: bool = False,
    datetime_format: str | None = None,
    order: list[str] | None = None,
    codes: dict[str, int] | None = None,
) -> DataFrame:
    """Annotations in standard form: filename, annot_id, label code, start, end and other columns.

    ``mapper`` is {standard name: source column or SQL expression}. Expressions are computed first; a
    renamed column that meets an existing one moves that to ``<name>_orig``. Label codes follow
    ``labels`` (see ``label_codes``); the distinct labels, few by nature, are collected for that unless
    ``codes`` are given. The code table is stored in the metadata of the label column. Rows are keyed by
    (filename, start, then ``order``, then the remaining columns).
    """
    df = table
    for name, source in (mapper or {}).items():
        if source not in df.columns:
            df = df.withColumn(name, F.expr(source))
    for name, source in (mapper or {}).items():
        if source in table.columns:
            if name in df.columns and name != source:
                df = df.withColumnRenamed(name, f"{name}_orig")
            df = df.withColumnRenamed(source, name)
    if "end" not in df.columns and {"start", "duration"} <= set(df.columns):
        df = df.withColumn("end", F.col("start").cast("double") + F.col("duration").cast("double"))
    if trim_table:
        df = trim(df, list(mapper or ()))
    if lacking := schema.missing(df):
        raise schema.SchemaError(f"missing columns: {', '.join(lacking)}")
    if unfold_labels:
        df = unfold(df, label_sep)
    df = df.withColumn("label", F.col("label").cast("string"))
    if codes is None:
        codes = label_codes(labels, [r[0] for r in df.select("label").where("label IS NOT NULL").distinct().collect()], start_labels_at_1)
    coded = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])[F.col("label")] if codes else F.lit(None).cast("int")
    df = df.withColumns({c: F.col(c).cast("double") for c in schema.FLOATS if c in df.columns})
    df = df.withColumn("filename", F.translate("filename", "\\", "/"))
    rest = [c for c in df.columns if c not in ("filename", "start") and c not in (order or ())]
    df = ordinal(df, "annot_id", [*(["start"] if "start" in df.columns else []), *(order or []), *[F.col(c).cast("string") for c in rest]])
    df = df.withColumn("label", coded.cast("int"))
    if datetime_format:
        source = F.col("datetime") if "datetime" in df.columns else F.regexp_extract("filename", r"([^/]*)$", 1)
        df = df.withColumn("datetime", parse_datetime(source, datetime_format))
    df = df.withMetadata("label", {LABEL_MAP: {str(k): v for k, v in codes.items()}})
    first = ["filename", "annot_id", "label"]
    return df.select(*first, *[c for c in df.columns if c not in first])


def label_map(table: DataFrame) -> dict[str, int]:
    """The code table that ``standardize`` left on the label column."""
    return dict(table.schema["label"].metadata.get(LABEL_MAP, {}))


def label_occurrence(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.count("*").alias("n"))


def query(table: DataFrame, filename: str | list[str] | None = None, label=None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows of the files and labels given that overlap the open interval (start, end)."""
    for name, value in (("filename", filename), ("label", label)):
        if value is not None:
            table = table.where(F.col(name).isin(list(value) if isinstance(value, (list, tuple)) else [value]))
    if start is not None:
        table = table.where(F.col("end") > start)
    return table if end is None else table.where(F.col("start") < end)


def query_annotated(selections: DataFrame, annotations: DataFrame, **conditions) -> tuple[DataFrame, DataFrame]:
    """Selections with at least one annotation that meets the conditions, and those annotations."""
    found = query(annotations, **conditions)
    return selections.join(found.select("filename", "sel_id").distinct(), ["filename", "sel_id"], "left_semi"), found


def shift(annotations: DataFrame, delta: float) -> DataFrame:
    """Move in time; what falls before 0 is cut, what is then empty goes."""
    moved = annotations.withColumns({c: F.greatest(F.lit(0.0), F.col(c) + delta) for c in ("start", "end")})
    return moved.where("end > start")


def crop(annotations: DataFrame, start: float = 0.0, end: float | None = None, freq_min: float | None = None, freq_max: float | None = None) -> DataFrame:
    """Clip to a window and measure time from its start; a frequency window also clips and filters."""
    out = annotations
    if end is not None:
        out = out.withColumn("end", F.least("end", F.lit(float(end))))
    out = shift(out, -start)
    if freq_min is not None or freq_max is not None:
        out = out.where("freq_min IS NOT NULL AND freq_max IS NOT NULL")  # greatest and least skip nulls
    if freq_min is not None:
        out = out.withColumn("freq_min", F.greatest("freq_min", F.lit(float(freq_min))))
    if freq_max is not None:
        out = out.withColumn("freq_max", F.least("freq_max", F.lit(float(freq_max))))
    if freq_min is not None or freq_max is not None:
        out = out.where("freq_max > freq_min")
    return out


def segment(annotations: DataFrame, num_segs: int, window: float, step: float | None = None, offset: float = 0.0) -> DataFrame:
    """A clipped copy of each annotation for every window it overlaps, keyed by ``segment_id``.

    Windows start at offset + i * step. Candidate windows follow from the annotation, so the work is
    in proportion to the result and not to the number of windows.
    """
    hop = window if step is None else step
    first = F.greatest(F.lit(0), F.floor((F.col("start") - offset - window) / hop)).cast("long")
    last = F.least(F.lit(num_segs - 1), F.ceil((F.col("end") - offset) / hop)).cast("long")
    spread = annotations.where(first <= last).withColumn("segment_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = offset + F.col("segment_id") * hop
    clipped = spread.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - at), "end": F.greatest(F.lit(0.0), F.least(F.col("end"), at + window) - at)})
    return clipped.where("end > start")


def add_set(table: DataFrame, key: int, name: str = "set_id") -> DataFrame:
    return table.select(F.lit(key).alias(name), *[c for c in table.columns if c != name])


def stack(tables: list[DataFrame], keys: list[int] | None = None, name: str = "set_id") -> DataFrame:
    """All tables under a set key; missing columns are null."""
    out = None
    for key, table in zip(keys or range(len(tables)), tables, strict=True):
        part = add_set(table, key, name)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def append(annotations: DataFrame, more: DataFrame, set_column: str | None = None) -> DataFrame:
    """More annotations with the next free annot_id of their set; unit texts become numbers."""
    conv = {c: (to_seconds if c in ("start", "end") else to_hertz)(F.col(c)) for c in schema.FLOATS if c in more.columns and isinstance(more.schema[c].dataType, T.StringType)}
    more = more.withColumns(conv).withColumn("label", F.col("label").cast("int"))
    order = [c for c in ("start", "end", "label") if c in more.columns]
    if set_column:
        numbered = ordinal(more, "annot_id", order, set_column)
        joined = numbered.join(annotations.groupBy(set_column).agg((F.max("annot_id") + 1).alias("__next")), set_column, "left")
    else:
        top = annotations.agg(F.max("annot_id") + 1).first()[0]
        joined = with_ordinal(more, order, "annot_id").withColumn("__next", F.lit(top))
    placed = joined.withColumn("annot_id", (F.col("annot_id") + F.coalesce("__next", F.lit(0))).cast("int")).drop("__next")
    return annotations.unionByName(placed, allowMissingColumns=True)


def counts_by_set(annotations: DataFrame, name: str = "set_id") -> DataFrame:
    return annotations.groupBy(name).agg(F.count("*").alias("num_annotations"))


def get(annotations: DataFrame, label=None, set_id: int | None = None, drop_freq: bool = False, set_column: str = "set_id") -> DataFrame:
    """Annotations of a set and of labels, standard columns first; empty if there is no such set."""
    out = query(annotations, label=label)
    if set_id is not None:
        out = out.where(F.col(set_column) == set_id)
    if drop_freq:
        out = out.drop("freq_min", "freq_max")
    first = [c for c in ("label", "start", "end", "freq_min", "freq_max") if c in out.columns]
    keys = [c for c in (set_column, "annot_id") if c in out.columns]
    return out.select(*keys, *first, *[c for c in out.columns if c not in first + keys])


def label_array(annotations: DataFrame, label: int, bins: int, time_res: float, by: str = "filename") -> DataFrame:
    """For each object, 0 or 1 for every time bin: whether an annotation with the label covers part of it."""
    of = annotations.where(F.col("label") == label)
    first = F.greatest(F.lit(0), F.floor(F.col("start") / time_res)).cast("int")
    last = F.least(F.lit(bins - 1), F.ceil(F.col("end") / time_res) - 1).cast("int")
    hit = of.where(first <= last).select(by, F.explode(F.sequence(first, last)).alias("b")).distinct().withColumn("present", F.lit(1))
    every = annotations.select(by).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    # A row for each bin and one join: no bin looks through the others.
    flags = every.join(hit, [by, "b"], "left").select(by, "b", F.coalesce("present", F.lit(0)).alias("present"))
    return flags.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "present"))), lambda x: x["present"]).alias("presence"))


def presence(c: Column) -> Column:
    return F.exists(c, lambda x: x == 1)
