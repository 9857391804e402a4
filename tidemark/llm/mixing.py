"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a word budget. Whole epochs of the source come first; what remains of the budget is
filled by a weighted sample without replacement: document i has the exponential key
``-ln(u_i) / w_i`` with its quality weight ``w_i`` and a hash-derived uniform ``u_i``, the documents
of a source are taken in the order of their keys, and the running sum of their sizes decides. The
last document is taken if that brings the source nearer to its budget.

The order of keys is the order of ``1 - u ** (1 / w)``, a number in [0, 1), of which 48 bits are used.
A hot source is therefore never sorted in one task: sizes are summed by the first 12 bits, then, in
the one bucket of each source that the budget ends in, by the next 12 bits, and only what shares 24
bits with the end is put in order. The result is a threshold for each source, and every document is
judged against it where it is. Documents with equal keys (repeated rows) are taken together.

Defined results: a null text has size 0; sources are ordered by code point, null last, and a null
source is a source; a document without words is taken as often as its epochs say; repeated rows share
a fate; a null or non-positive weight counts as ``LEAST_WEIGHT``; an empty table gives no rows; a
source without words has target 0; other columns pass through, columns named like the results are
replaced. Reruns agree, for keys come from the row and the seed alone.

Scale: scans and map-side combined sums only. The table of sources is never collected: shares are found
by rounds of sums over it (``unit`` is the words for each unit of weight), and a source joins its
documents by ``lookup``, which spreads sources that hold very many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import column, columns, free_name, lookup, materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2
#: Most sources (of about 100 bytes) whose plans are broadcast.
BROADCAST_SOURCES = 200_000
LEAST_WEIGHT = 0.05
_BITS, _LEVEL = 48, 12

RESULT = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column) -> Column:
    """Words between ASCII white space; null has none.

    Each word, with the white space after it, becomes one character. (``regexp_count`` gathers all words in an array first.)
    """
    marks = F.regexp_replace(F.ltrim(text, F.lit(" \t\n\v\f\r")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit("x"))
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def default_weight(text: Column, size: Column) -> Column:
    """A cheap quality weight: near 1 for about six characters a word, less for runs and fragments."""
    per_word = F.greatest(F.length(text), F.lit(1)) / F.greatest(size, F.lit(1))
    return F.exp(-F.abs(F.ln(per_word / 6.0)))


def _ranked(sums: DataFrame) -> DataFrame:
    """Sources (s, n) with ``place``, their number by code point from 0, null last.

    Sources are cut into ranges, counted by range and numbered within each, so no task sees them all.
    """
    ranged = materialize(sums.withColumn("last", F.col("s").isNull()).repartitionByRange("last", "s").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("last", "s")
    return ranged.join(F.broadcast(counts), "part").withColumn("place", F.col("base") + F.row_number().over(inside) - 1).select("s", "n", "place")


def targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Sources (s, n) with target: the words wanted, shares by weight, none above ``most`` times n."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    open_ = materialize(_ranked(sums).withColumn("weight", weight), "sources")
    unit, full = 0.0, -1
    total = share * (open_.agg(F.sum("n")).first()[0] or 0)
    while True:
        capped = F.col("weight") * F.lit(unit) > F.lit(float(most)) * F.col("n")
        held, weights_left, n = open_.agg(F.sum(F.when(capped, F.col("n")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.count_if(capped)).first()
        if n == full or not weights_left:
            break
        unit, full = (total - most * held) / weights_left, n
    return open_.withColumn("target", F.when(capped, F.lit(float(most)) * F.col("n")).otherwise(F.col("weight") * F.lit(unit)))


def _keyed(docs: DataFrame, id_column: str, text: str, source: str, weight: Column | None, seed: int) -> Column:
    """A struct of source key, size and place in the sample for each row."""
    size = size_of(column(text))
    w = F.least(F.greatest(F.coalesce(weight if weight is not None else default_weight(column(text), size), F.lit(0.0)), F.lit(LEAST_WEIGHT)), F.lit(1e6))
    whole = (column(id_column).cast("string"), column(text))
    h = F.xxhash64(F.lit(seed), *whole)
    u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(2.0**53)
    place = F.lit(1.0) - F.pow(u, F.lit(1.0) / w)
    return F.struct(
        F.coalesce(F.concat(F.lit("="), column(source).cast("string")), F.lit("")).alias("s"), size.alias("size"),
        F.least(F.floor(place * F.lit(2.0**_BITS)), F.lit(2**_BITS - 1)).cast("long").alias("key"), F.xxhash64(F.lit(seed + 1), *whole).alias("tie"),
    )


def _ends(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source, the bucket of the next bits that its budget ends in, and the words before it."""
    w = Window.partitionBy("s").orderBy("b")
    sums = sized.groupBy("s", "b").agg(F.sum("size").alias("n"))
    placed = sums.withColumn("upto", F.sum("n").over(w)).join(plan, "s")
    found = placed.where("base + upto > budget").groupBy("s").agg(F.min(F.struct("b", (F.col("base") + F.col("upto") - F.col("n")).alias("before"), "budget")).alias("e"))
    return found.select("s", F.col("e.b").alias("at"), F.col("e.before").alias("base"), F.col("e.budget").alias("budget"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(s, end): the last (key, tie) that each source's budget takes, of rows (s, size, key, tie)."""
    bits = lambda level: F.shiftright("key", _BITS - level * _LEVEL)
    first = materialize(_ends(rows.withColumn("b", bits(1)), plan.withColumn("base", F.lit(0).cast("long"))), "mix")
    inside = rows.withColumn("at", bits(1)).join(first, ["s", "at"]).select("s", "size", "key", "tie")
    second = materialize(_ends(inside.withColumn("b", bits(2)), first.select("s", "base", "budget")), "mix")
    last = rows.withColumn("at", bits(2)).join(second, ["s", "at"])
    units = last.groupBy("s", "at", "base", "budget", "key", "tie").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("s").orderBy("key", "tie")
    placed = units.withColumn("upto", F.col("base") + F.sum("n").over(w))
    taken = placed.where("upto - n / 2 <= budget").groupBy("s").agg(F.max(F.struct("key", "tie")).alias("e"))
    none = F.struct((F.shiftleft("at", _BITS - 2 * _LEVEL) - 1).alias("key"), F.lit(2**63 - 1).alias("tie"))
    return second.join(taken, "s", "left").select("s", F.coalesce("e", none).alias("end"))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = 17) -> DataFrame:
    """Documents with size, source_size, target, copies (how often the mix takes them) and taken words."""
    kept = docs.drop(*RESULT)
    mine = free_name(docs, "__mix")
    keyed = docs.withColumn(mine, _keyed(docs, id_column, text, source, weight, seed))
    narrow = materialize(keyed.select(f"{mine}.*"), "mix")
    by_source = narrow.groupBy("s").agg(F.sum("size").alias("n"))
    # The first sign of a key only tells null and empty apart.
    wanted = targets(by_source.select(F.when(F.col("s") != "", F.substring("s", 2, 2**31 - 1)).alias("s"), "n"), weights, share, most)
    epochs = F.when(F.col("n") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("n")).cast("int"))).otherwise(0)
    plan = wanted.withColumn("s", F.coalesce(F.concat(F.lit("="), "s"), F.lit(""))).withColumn("epochs", epochs)
    plan = materialize(plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("n"))), "mix")
    ends = thresholds(narrow, plan.select("s", "budget"))
    known = materialize(plan.join(ends, "s", "left").select("s", F.struct("n", "target", "epochs", "end").alias("plan")), "mix")
    key, theirs = free_name(docs, "__source"), free_name(docs, "__plan")
    known = known.select(F.col("s").alias(key), F.col("plan").alias(theirs))
    judged = _with_plan(keyed.withColumn(key, F.col(f"{mine}.s")), known, key)
    own, their = F.col(mine), F.col(theirs)
    within = F.coalesce((own["key"] < their["end"]["key"]) | ((own["key"] == their["end"]["key"]) & (own["tie"] <= their["end"]["tie"])), F.lit(False))
    copies = (their["epochs"] + F.when((their["epochs"] < most) & within, 1).otherwise(0)).cast("int")
    return judged.select(*columns(kept), own["size"].alias("size"), their["n"].alias("source_size"), their["target"].alias("target"), copies.alias("copies"), (own["size"] * copies).alias("taken"))


def _with_plan(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each document with its source's plan: by broadcast of at most ``BROADCAST_SOURCES`` plans, else by ``lookup``."""
    if known.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(known), key, "left")
    return lookup(rows, known, key)
