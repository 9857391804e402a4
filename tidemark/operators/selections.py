"""Fixed-length selections from annotations and files: aligned, stepped, segmented, random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import ceil_tolerant, floor_tolerant, fractional_overlap
from tidemark.operators.annotations import ordinal
from tidemark.operators.intervals import nested_join, touching
from tidemark.operators.scans import Parts
from tidemark.storage import running, stored


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def uniform(seed: int, *key) -> Column:
    """A reproducible number in [0, 1) from the columns of a row, the same on every run and layout."""
    h = F.xxhash64(F.lit(seed), *key)
    return F.shiftrightunsigned(h, 11) / F.lit(2.0**53)


def time_shift(table: DataFrame, length: float, step: float, min_overlap: float, ref: str = "start_new") -> DataFrame:
    """A row for each window shifted by a multiple of ``step`` that still overlaps enough.

    The overlap is concave in the shift, so the allowed shifts are one run around the reference; its
    bounds follow in closed form, are widened by one and tested exactly. The reference itself stays.
    """
    s, e, t = F.col("start"), F.col("end"), F.col(ref)
    need = F.least(F.lit(float(length)), e - s) * float(min_overlap)
    low, high = s + need - length, e - need
    first = F.least(F.lit(0), F.ceil((low - t) / step) - 1).cast("long")
    last = F.greatest(F.lit(0), F.floor((high - t) / step) + 1).cast("long")
    empty = e <= s
    shifts = F.when(empty, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    spread = table.withColumn("__k", F.explode(shifts)).withColumn("__t", F.col(ref) + F.col("__k") * F.lit(float(step)))

    def enough(at: Column) -> Column:
        return fractional_overlap(at, at + length, s, e) >= min_overlap

    # Shifts go outwards from the reference and stop at the first that fails.
    side = t + F.signum("__k") * F.lit(float(step))
    return spread.where((F.col("__k") == 0) | (enough(side) & enough(F.col("__t")))).withColumn(ref, F.col("__t")).drop("__k", "__t")


def select(
    annotations: DataFrame,
    length: float,
    step: float = 0.0,
    min_overlap: float = 0.0,
    center: bool = False,
    discard_long: bool = False,
    keep_id: bool = False,
    keep_freq: bool = False,
    label=None,
    avoid_label=None,
    files: DataFrame | None = None,
    seed: int = 1,
) -> DataFrame:
    """Windows of ``length`` that show the annotations.

    A window is centred on its annotation or placed at random (by seed) so that it holds, or lies in,
    the annotation; with ``step`` shifted copies follow. Annotations with label -1 or negative length
    give none. Windows that touch an annotation with ``avoid_label`` go (closed intervals; 'all' with
    ``label`` means every other label), and, with ``files``, those that leave their file. Without
    ``step`` windows keep the annotation's number as sel_id; with it they are numbered anew.
    """
    df = annotations.where("label <> -1 AND end >= start")
    if label is not None:
        df = df.where(F.col("label").isin(_list(label)))
    span = F.col("end") - F.col("start")
    if discard_long:
        df = df.where(span <= length)
    shift = 0.5 if center else uniform(seed, "filename", "annot_id")
    df = df.withColumn("start_new", F.col("start") + shift * (span - length))
    if step > 0:
        df = time_shift(df, length, step, min_overlap)
        df = ordinal(df, "sel_id", ["start_new", "annot_id"])
    else:
        df = df.withColumn("sel_id", F.col("annot_id"))
    drop = {"start", "end", "start_new", "annot_id", "filename", "sel_id"} | (set() if keep_freq else {"freq_min", "freq_max"})
    rest = [c for c in df.columns if c not in drop]
    out = df.select("filename", "sel_id", *rest, F.col("start_new").alias("start"), (F.col("start_new") + length).alias("end"), *["annot_id"] * keep_id)
    if avoid_label is not None:
        if isinstance(avoid_label, str) and avoid_label.lower() == "all":
            unwanted = annotations.where(~F.col("label").isin(_list(label))) if label is not None else None
        else:
            unwanted = annotations.where(F.col("label").isin(_list(avoid_label)))
        if unwanted is not None:
            # Windows and annotations meet in nested bins of time, so a file with very many of both is no product.
            out = out.join(touching(out, unwanted, ["filename", "sel_id"], closed=True, lengths=(length, None)), ["filename", "sel_id"], "left_anti").select(*out.columns)
    if files is not None:
        inside = out.join(files.select("filename", "duration"), "filename").where("start >= 0 AND end <= duration")
        out = inside.select(*out.columns)
    return out


def segment_files(files: DataFrame, length: float, step: float | None = None, pad: bool = True) -> DataFrame:
    """Consecutive windows over each file; the last one may pass its end if ``pad``."""
    hop = length if step is None else step
    n = F.greatest((F.col("duration") - length) / hop + 1, F.lit(0.0))
    n = (F.ceil(n) if pad else F.floor(n)).cast("int")
    spread = files.where(n > 0).withColumn("sel_id", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("sel_id") * F.lit(float(hop))
    rest = [c for c in files.columns if c not in ("filename", "duration")]
    return spread.select("filename", "sel_id", *rest, start.alias("start"), (start + length).alias("end"))


def frames(files: DataFrame, length: float, step: float | None = None, pad: bool = True) -> DataFrame:
    """Uniform frames over files of positive duration, at least one for each; counts tolerate 1e-6."""
    hop = length if step is None else step
    n = F.greatest((F.col("duration") - length) / hop + 1, F.lit(1.0))
    n = (ceil_tolerant(n) if pad else floor_tolerant(n)).cast("int")
    spread = files.where("duration > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), n - 1)))
    return spread.select("filename", "frame", (F.col("frame") * F.lit(float(hop))).alias("offset"), F.lit(float(length)).alias("duration"))


def segment_annotations(annotations: DataFrame, num: int | Column, length: float, step: float | None = None, compute_overlap: bool = False) -> DataFrame:
    """A row for each window n * step, n < num, that an annotation overlaps, with window-relative times.

    Windows come from each annotation's own range, so no window meets an annotation it can't overlap.
    """
    hop = length if step is None else step
    first = F.greatest(F.lit(0), F.floor((F.col("start") - length) / hop)).cast("long")
    top = num - 1 if isinstance(num, Column) else F.lit(num - 1)
    last = F.least(top, F.ceil(F.col("end") / hop)).cast("long")
    spread = annotations.where(first <= last).withColumn("sel_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.col("sel_id") * F.lit(float(hop))
    hit = spread.where((F.col("start") < at + length) & (F.col("end") > at))
    out = hit
    if compute_overlap:
        out = out.withColumn("overlap", fractional_overlap(at, at + length, F.col("start"), F.col("end")))
    out = out.withColumns({"start": F.col("start") - at, "end": F.col("end") - at})
    keys = ["filename", "sel_id", "annot_id"]
    return out.select(*[c for c in keys if c in out.columns], *[c for c in out.columns if c not in keys])


def select_by_segmenting(files: DataFrame, length: float, annotations: DataFrame | None = None, step: float | None = None, pad: bool = True, discard_empty: bool = False, keep_only_empty: bool = False, label_empty: int = 0, avoid_label=None) -> tuple[DataFrame, DataFrame | None]:
    """Windows over files and the annotations in them.

    ``keep_only_empty`` leaves the windows without any (with ``label_empty``), ``discard_empty`` those
    with some, ``avoid_label`` those without any of these labels. Annotations with label -1 don't count.
    """
    sel = segment_files(files, length, step, pad)
    if annotations is None:
        return sel, None
    hop = length if step is None else step
    n = F.greatest((F.max("duration") - length) / hop + 1, F.lit(0.0))
    most = int(files.agg((F.ceil(n) if pad else F.floor(n)).cast("int")).first()[0] or 0)
    annot = segment_annotations(annotations.where("label <> -1"), most, length, step)
    keys = ["filename", "sel_id"]
    # The side of a semi or anti join needs no distinct: a match is enough.
    if keep_only_empty:
        return sel.join(annot.select(*keys), keys, "left_anti").withColumn("label", F.lit(label_empty)), None
    if discard_empty:
        sel = sel.join(annot.select(*keys), keys, "left_semi")
    if avoid_label is not None:
        sel = sel.join(annot.where(F.col("label").isin(_list(avoid_label))).select(*keys), keys, "left_anti")
    return sel, annot


def random_choice(table: DataFrame, n: int, seed: int = 1, keys: list[str] | None = None, few: int = 100_000) -> DataFrame:
    """``n`` rows without replacement (all if fewer), by key; the draw depends on keys and seed alone.

    They are the rows with the least hashes. More than ``few`` are not sorted in one place: rows are counted by leading
    bits of their hash, those below the bits in which the last one lies are taken as they are, and only
    the rest is looked at more closely.
    """
    keys = keys or [c for c in ("filename", "sel_id", "annot_id") if c in table.columns]
    rows = table.withColumn("__u", F.xxhash64(F.lit(seed), *keys))
    taken, shift, left = [], 48, n
    while left > few and shift >= 0:
        digit = F.shiftright("__u", shift)
        counts = sorted(tuple(r) for r in rows.groupBy(digit.alias("d")).count().collect())  # 65,536 at most
        last, below = None, 0
        for d, count in counts:
            if below + count > left:
                last = d
                break
            below += count
        if last is None:
            taken.append(rows)
            left = 0
            break
        taken.append(rows.where(digit < last))
        rows, left, shift = rows.where(digit == last), left - below, shift - 16
    drawn = rows.orderBy("__u", *keys).limit(left) if left else rows.limit(0)
    for part in taken:
        drawn = drawn.unionByName(part)
    return drawn.drop("__u").orderBy(*keys)


def free_gaps(files: DataFrame, length: float, annotations: DataFrame | None = None, buffer: float = 0.0) -> DataFrame:
    """Stretches of each file, from ``gap_start`` to ``gap_end``, that no annotation (widened by ``buffer``) covers and that hold a window of ``length``."""
    room = files.where(F.col("duration") >= length)
    edge = room.select(*room.columns, F.col("duration").alias("__a"), F.col("duration").alias("__b"))
    if annotations is not None:
        wide = annotations.where("end >= start").select("filename", (F.col("start") - buffer).alias("__a"), (F.col("end") + buffer).alias("__b"))
        edge = edge.unionByName(room.join(wide, "filename"))
    covered = Parts.of(edge, ["filename"], ["__a", "__b"]).scan(inclusive=False, __seen=("max", F.col("__b")))
    gaps = covered.df.withColumns({"gap_start": F.greatest(F.coalesce("__seen", F.lit(0.0)), F.lit(0.0)), "gap_end": F.least("__a", "duration")})
    return gaps.where(F.col("gap_end") - F.col("gap_start") >= length).select(*room.columns, "gap_start", "gap_end")


def random_selections(files: DataFrame, length: float, num: int, label: int = 0, annotations: DataFrame | None = None, no_overlap: bool = False, buffer: float = 0.0, seed: int = 1) -> DataFrame:
    """Exactly ``num`` windows at random places, clear of annotations and, if asked, of each other.

    The free gaps of all files get whole-number shares, which are summed along an order, and each draw
    looks up the gap that its number falls into. A file's chance follows its duration, and places within it are alike:
    what drawing places and rejecting those that meet an annotation would give. Without overlap a gap has a share for
    each window that fits into it; draws are numbers from ``num`` disjoint ranges, so no gap gets
    more windows than it holds. Its ``n`` windows then lie at the order statistics of ``n`` uniform numbers over
    the room that remains beside them. Draws are hashes of their numbers and the seed. A ``ValueError`` says that there is no room.
    """
    gaps = free_gaps(files, length, annotations, buffer)
    size = F.col("gap_end") - F.col("gap_start")
    if no_overlap:
        share = F.floor(size / length + 1e-9).cast("long")
    else:
        tiny = 1e-9  # gaps and files that hold just one window have a place, too
        part = F.col("duration") * (size - length + tiny) / (F.col("duration") - length + tiny)
        most = files.where(F.col("duration") >= length).agg(F.sum("duration")).first()[0] or 1.0
        share = F.greatest(F.lit(1), F.floor(part / F.lit(float(most)) * F.lit(2.0**50))).cast("long")
    summed = stored(running(gaps.withColumn("__share", share), ["filename", "gap_start"], {"__upto": "__share"}), "gaps")
    total = summed.agg(F.max("__upto")).first()[0] or 0
    if num and total < (num if no_overlap else 1):
        raise ValueError(f"there is room for {total if no_overlap else 0} windows of {length}, not for {num}")
    draws = files.sparkSession.range(num).withColumns({"__u": uniform(seed, "id"), "__v": uniform(seed + 1, "id")})
    if no_overlap:
        low, high = (F.expr(f"cast(cast(id + {k} AS decimal(38, 0)) * {total} DIV {max(1, num)} AS bigint)") for k in (0, 1))
        at = low + F.floor(F.col("__u") * (high - low))
    else:
        at = F.floor(F.col("__u") * F.lit(float(total)))
    points = draws.select("id", "__v", F.lit(0).alias("__all"), at.cast("double").alias("start"), at.cast("double").alias("end"))
    ranges = summed.select(*[F.col(c).alias(f"__file_{c}") for c in files.columns], "gap_start", "gap_end", F.lit(0).alias("__all"), (F.col("__upto") - F.col("__share")).cast("double").alias("start"), (F.col("__upto") - 1).cast("double").alias("end"))
    found = nested_join(points, ranges, "__all", closed=True, lengths=(0.0, None)).drop("start", "end", "start_right", "end_right")
    found = found.withColumnsRenamed({f"__file_{c}": c for c in files.columns})
    if no_overlap:
        placed = Parts.of(found, ["filename", "gap_start"], ["__v", "id"]).scan(__j=("count", F.lit(1))).totals(__n=("count", F.lit(1)))
        found, slack, before = placed.df, size - F.col("__n") * length, (F.col("__j") - 1) * length
    else:
        slack, before = size - length, F.lit(0.0)
    rest = [c for c in files.columns if c not in ("filename", "duration")]
    start = F.col("gap_start") + F.col("__v") * F.greatest(slack, F.lit(0.0)) + before
    windows = found.select("filename", *rest, start.alias("start"), (start + length).alias("end"), F.lit(label).alias("label"), "id")
    numbered = ordinal(windows, "sel_id", ["start", "id"])
    return numbered.select("filename", "sel_id", *rest, "start", "end", "label")


def outside_status(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Selections with ``status``: ok, before, after, empty or mostly_outside their file."""
    s = selections.join(files.select("filename", F.col("duration").alias("__d")), "filename", "left")
    over = F.greatest(F.lit(0.0), -F.col("start")) + F.greatest(F.lit(0.0), F.col("end") - F.col("__d"))
    status = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("end") <= 0, "before").when(F.col("start") > F.col("__d"), "after").when(over > 0.5 * (F.col("end") - F.col("start")), "mostly_outside").otherwise("ok")
    return s.withColumn("status", status).drop("__d")


def attach_annotations(selections: DataFrame, annotations: DataFrame, length: float | None = None) -> DataFrame:
    """Each selection with the annotations that overlap it, in time relative to it.

    A selection may consist of parts of several files (rows with one sel_id, in order of ``part``); the
    lengths of the parts before an annotation's own part are added to its times. Both sides meet in
    nested bins of time; ``length`` is that of all selections, if they have one.
    """
    in_parts = "part" in selections.columns
    key = ["sel_id", "part"] if in_parts else ["filename", "sel_id"]
    w = Window.partitionBy("sel_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)) if in_parts else F.lit(0.0)
    placed = selections.select(*dict.fromkeys([*key, "filename", "start", "end"]), before.alias("__before"))
    met = nested_join(placed, annotations.select("filename", "label", "start", "end"), lengths=(length, None))
    at = lambda t: (F.col(t) - F.col("start") + F.col("__before")).alias(t.removesuffix("_right"))
    one = F.struct(at("start_right"), at("end_right"), F.col("label"))
    found = met.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    kind = found.schema["annotations"].dataType
    kept = selections.select(*[c for c in selections.columns if c in key or c in ("filename", "start", "end", "label")])
    return kept.join(found, key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(kind)))
