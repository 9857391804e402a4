"""Views over the driver tables that the catalogue's queries share, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import annotations as A
from tidemark.operators.batching import with_ordinal
from tidemark.operators.selections import segment_files

#: Microseconds from 1970 to the start of the event tables; seconds in their 30 days.
START_US = 1_704_067_200_000_000
DAYS_30 = 2_592_000.0
LABELS = ("click", "error", "purchase", "signup", "view")
CODES = {x: i for i, x in enumerate(LABELS)}
LENGTH, STEP = 21_600.0, 10_800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each user and an interval of ``value`` minutes for each event."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - START_US) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("filename"), seconds.alias("start"), (seconds + F.col("value") * 60).alias("end"), F.col("event_type").alias("label"), "event_id")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.standardize(raw_annotations(spark, sf_dir), order=["event_id"], codes=CODES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("filename")).distinct().withColumn("duration", F.lit(DAYS_30))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_files(files(spark, sf_dir), LENGTH, STEP)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a detector: the events of a user in order, half a second apart."""
    a = annotations(spark, sf_dir)
    return a.select("filename", (F.col("annot_id") * 0.5).alias("offset"), ((F.col("end") - F.col("start")) / 60 / 500).alias("score")).withColumn("score", F.round("score", 6))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("data"), "label")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as images of 8 x 8, in long form."""
    s = signals(spark, sf_dir).select(F.col("id").alias("filename"), F.posexplode("data").alias("pos", "value"))
    return s.select("filename", F.floor(F.col("pos") / 8).cast("int").alias("t_bin"), (F.col("pos") % 8).alias("f_bin"), "value")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinal(signals(spark, sf_dir), ["id"])


SQL = {
    "annot": f"""annot AS (SELECT 'u' || user_id AS filename, (row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) - {START_US}) / 1e6, event_id) - 1)::INT AS annot_id,
  CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items())} END AS label,
  (epoch_us(ts) - {START_US}) / 1e6 AS start, (epoch_us(ts) - {START_US}) / 1e6 + value * 60 AS "end", event_id FROM events)""",
    "files": f"files AS (SELECT DISTINCT 'u' || user_id AS filename, {DAYS_30}::DOUBLE AS duration FROM events)",
    "seg": f"seg AS (SELECT filename, n::INT AS sel_id, n * {STEP} AS start, n * {STEP} + {LENGTH} AS \"end\" FROM files, (SELECT unnest(range(0, {int((DAYS_30 - LENGTH) / STEP + 1)})) AS n))",
    "segannot": f"segannot AS (SELECT a.filename, s.sel_id, a.annot_id, a.label, a.start - s.start AS start, a.\"end\" - s.start AS \"end\" FROM annot a JOIN seg s ON a.filename = s.filename AND a.start < s.\"end\" AND a.\"end\" > s.start)",
    "frames": "frames AS (SELECT filename, annot_id * 0.5 AS \"offset\", round((\"end\" - start) / 60 / 500, 6) AS score FROM annot)",
    "signal": "signal AS (SELECT vec_id AS id, label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)",
    "image": "image AS (SELECT id AS filename, (pos // 8)::INT AS t_bin, (pos % 8)::INT AS f_bin, x AS value FROM signal)",
}
NEEDS = {"annot": (), "files": (), "seg": ("files",), "segannot": ("annot", "seg"), "frames": ("annot",), "signal": (), "image": ("signal",)}


def sql(body: str, *views: str) -> str:
    """A query over the named views, with what those need before them."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS[v]:
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = "WITH " + ",\n".join(SQL[v] for v in order) if order else ""
    if body.lstrip().upper().startswith("WITH "):
        return head + ",\n" + body.lstrip()[5:] if head else body
    return f"{head}\n{body}"
