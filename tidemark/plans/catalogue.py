"""Named queries over the driver tables, and the SQL that gives the same rows.

Each query runs over its whole tables. Results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays, metrics, scalar
from tidemark.functions.axis import LinearAxis, Log2Axis, MelAxis
from tidemark.operators import annotations as A
from tidemark.operators import batching as B
from tidemark.operators import detections as D
from tidemark.operators import intervals as I
from tidemark.operators import selections as S
from tidemark.operators import signals as X
from tidemark.plans import views as V
from tidemark.plans.views import LENGTH, STEP, sql

FLAGSHIP = "segments_label_count"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


# Annotations ---------------------------------------------------------------------------------


@query(sql("SELECT label, count(*) AS n FROM segannot GROUP BY label", "segannot"))
def segments_label_count(spark, d):
    _, annot = S.select_by_segmenting(V.files(spark, d), LENGTH, V.annotations(spark, d), STEP)
    return annot.groupBy("label").agg(F.count("*").alias("n"))


@query(sql(f'SELECT filename, annot_id, label, {rounded_sql("start", "end")}, event_id FROM annot', "annot"))
def standardize_labels(spark, d):
    return A.standardize(V.raw_annotations(spark, d), order=["event_id"]).select("filename", "annot_id", "label", *rounded("start", "end"), "event_id")


@query(
    """SELECT source AS filename, label, doc_id FROM (SELECT source, doc_id, unnest(string_split(lang || ',' || source, ',')) AS label FROM documents)"""
)
def unfold_labels(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("source").alias("filename"), F.concat_ws(",", "lang", "source").alias("label"), "doc_id")
    return A.unfold(docs)


@query(sql("SELECT label, count(*) AS n FROM annot GROUP BY label", "annot"))
def label_occurrence(spark, d):
    return A.label_occurrence(V.annotations(spark, d))


_CENTER = f'SELECT filename, annot_id AS sel_id, label, round(start + 0.5 * ("end" - start - {LENGTH}), 6) AS start, round(start + 0.5 * ("end" - start - {LENGTH}) + {LENGTH}, 6) AS "end" FROM annot'


@query(sql(_CENTER, "annot"))
def select_center(spark, d):
    return S.select(V.annotations(spark, d), LENGTH, center=True).select("filename", "sel_id", "label", *rounded("start", "end"))


_SHIFT_L, _SHIFT_STEP, _SHIFT_MIN = 3600.0, 900.0, 0.5


@query(
    sql(
        f"""WITH a AS (SELECT *, start + 0.5 * ("end" - start - {_SHIFT_L}) AS t FROM annot),
k AS (SELECT unnest(range(-64, 65)) AS k),
w AS (SELECT filename, annot_id, label, k, t + k * {_SHIFT_STEP} AS s, start, "end" FROM a, k),
o AS (SELECT *, CASE WHEN "end" = start THEN 0 ELSE (least("end", s + {_SHIFT_L}) - greatest(start, s)) / least("end" - start, s + {_SHIFT_L} - s) END AS o FROM w)
SELECT filename, (row_number() OVER (PARTITION BY filename ORDER BY s, annot_id) - 1)::INT AS sel_id, label, round(s, 6) AS start, round(s + {_SHIFT_L}, 6) AS "end"
FROM o WHERE k = 0 OR o >= {_SHIFT_MIN}""",
        "annot",
    )
)
def select_stepped(spark, d):
    return S.select(V.annotations(spark, d), _SHIFT_L, step=_SHIFT_STEP, min_overlap=_SHIFT_MIN, center=True).select("filename", "sel_id", "label", *rounded("start", "end"))


@query(
    sql(
        f"""WITH c AS (SELECT filename, annot_id AS sel_id, label, start + 0.5 * ("end" - start - 600.0) AS s FROM annot WHERE label IN (0, 2))
SELECT filename, sel_id, label, round(s, 6) AS start, round(s + 600.0, 6) AS "end" FROM c
WHERE NOT EXISTS (SELECT 1 FROM annot a WHERE a.filename = c.filename AND a.label = 1 AND a."end" >= c.s AND a.start <= c.s + 600.0)""",
        "annot",
    )
)
def select_avoid_label(spark, d):
    return S.select(V.annotations(spark, d), 600.0, center=True, label=[0, 2], avoid_label=1).select("filename", "sel_id", "label", *rounded("start", "end"))


@query(sql(f"SELECT * FROM ({_CENTER}) JOIN files USING (filename) WHERE start >= 0 AND \"end\" <= duration", "annot", "files").replace("SELECT * FROM", 'SELECT filename, sel_id, label, start, "end" FROM'))
def select_inside_file(spark, d):
    return S.select(V.annotations(spark, d), LENGTH, center=True, files=V.files(spark, d)).select("filename", "sel_id", "label", *rounded("start", "end"))


@query(sql('SELECT * FROM seg', "seg"))
def segment_files(spark, d):
    return V.segments(spark, d)


@query(sql(f'SELECT filename, sel_id, annot_id, label, {rounded_sql("start", "end")} FROM segannot', "segannot"))
def segment_annotations(spark, d):
    n = int((V.DAYS_30 - LENGTH) / STEP + 1)
    return S.segment_annotations(V.annotations(spark, d), n, LENGTH, STEP).select("filename", "sel_id", "annot_id", "label", *rounded("start", "end"))


@query(sql("SELECT filename, sel_id, start, \"end\", 9 AS label FROM seg WHERE NOT EXISTS (SELECT 1 FROM segannot x WHERE x.filename = seg.filename AND x.sel_id = seg.sel_id)", "seg", "segannot"))
def segments_empty(spark, d):
    return S.select_by_segmenting(V.files(spark, d), LENGTH, V.annotations(spark, d), STEP, keep_only_empty=True, label_empty=9)[0]


@query(sql("SELECT * FROM seg WHERE EXISTS (SELECT 1 FROM segannot x WHERE x.filename = seg.filename AND x.sel_id = seg.sel_id)", "seg", "segannot"))
def segments_nonempty(spark, d):
    return S.select_by_segmenting(V.files(spark, d), LENGTH, V.annotations(spark, d), STEP, discard_empty=True)[0]


@query(sql(f"SELECT filename, annot_id, label, {rounded_sql('start', 'end')} FROM annot WHERE label IN (1, 3) AND \"end\" > 100000 AND start < 900000", "annot"))
def query_interval(spark, d):
    return A.query(V.annotations(spark, d), label=[1, 3], start=100_000, end=900_000).select("filename", "annot_id", "label", *rounded("start", "end"))


@query(
    sql(
        """WITH o AS (SELECT filename, start, "end", max("end") OVER (PARTITION BY filename ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM annot)
SELECT filename, round(sum(greatest(0, "end" - greatest(start, coalesce(pm, start)))), 4) AS duration FROM o GROUP BY filename""",
        "annot",
    )
)
def union_duration(spark, d):
    return I.union_duration(V.annotations(spark, d), by=["filename"]).withColumn("duration", F.round("duration", 4))


@query(
    sql(
        """WITH c AS (SELECT filename, annot_id, label, greatest(0, start - 86400) AS start, greatest(0, least("end", 864000) - 86400) AS "end" FROM annot)
SELECT filename, annot_id, label, round(greatest(0, start + 500), 6) AS start, round(greatest(0, "end" + 500), 6) AS "end" FROM c WHERE "end" > start""",
        "annot",
    )
)
def crop_shift(spark, d):
    return A.shift(A.crop(V.annotations(spark, d), 86400.0, 864000.0), 500.0).select("filename", "annot_id", "label", *rounded("start", "end"))


@query(
    sql(
        """SELECT filename, segment_id, annot_id, label, round(greatest(0, start - t0), 6) AS start, round(greatest(0, least("end", t0 + 43200) - t0), 6) AS "end"
FROM annot, (SELECT n::INT AS segment_id, 1000 + n * 40000.0 AS t0 FROM (SELECT unnest(range(0, 60)) AS n))
WHERE greatest(0, least("end", t0 + 43200) - t0) > greatest(0, start - t0)""",
        "annot",
    )
)
def annotation_segments(spark, d):
    return A.segment(V.annotations(spark, d), 60, 43200.0, 40000.0, 1000.0).select("filename", "segment_id", "annot_id", "label", *rounded("start", "end"))


@query(sql("SELECT filename, count(*) AS num_annotations FROM annot GROUP BY filename", "annot"))
def annotation_sets(spark, d):
    return A.counts_by_set(V.annotations(spark, d), "filename")


_BINS = 60


@query(
    sql(
        f"""WITH b AS (SELECT unnest(range(0, {_BINS})) AS b), f AS (SELECT DISTINCT filename FROM annot)
SELECT f.filename, b.b::INT AS b, (EXISTS (SELECT 1 FROM annot a WHERE a.filename = f.filename AND a.label = 1 AND b.b >= floor(a.start / 43200.0) AND b.b <= ceil(a."end" / 43200.0) - 1))::INT AS present FROM f, b""",
        "annot",
    )
)
def label_presence(spark, d):
    return A.label_array(V.annotations(spark, d), 1, _BINS, 43200.0).select("filename", F.posexplode("presence").alias("b", "present"))


@query(
    sql(
        """SELECT s.filename, s.sel_id, count(a.annot_id) AS n, round(coalesce(sum(a.start - s.start), 0), 3) AS first FROM seg s
LEFT JOIN annot a ON a.filename = s.filename AND a."end" > s.start AND a.start < s."end" GROUP BY s.filename, s.sel_id""",
        "seg",
        "annot",
    )
)
def attached_annotations(spark, d):
    got = S.attach_annotations(V.segments(spark, d), V.annotations(spark, d), V.LENGTH)
    first = F.aggregate("annotations", F.lit(0.0), lambda s, a: s + a["start"])
    return got.select("filename", "sel_id", F.size("annotations").cast("long").alias("n"), F.round(first, 3).alias("first"))


@query(sql('SELECT a.filename, a.annot_id, b.annot_id AS other FROM annot a JOIN annot b ON a.filename = b.filename AND a.label = 1 AND b.label = 2 AND a."end" > b.start AND a.start < b."end"', "annot"))
def interval_self_join(spark, d):
    a = V.annotations(spark, d)
    joined = I.nested_join(a.where("label = 1").select("filename", "annot_id", "start", "end"), a.where("label = 2").select("filename", F.col("annot_id").alias("other"), "start", "end"))
    return joined.select("filename", "annot_id", "other")


# Detections ----------------------------------------------------------------------------------

_AVG = """avg_ AS (SELECT filename, "offset", CASE WHEN count(*) OVER w = 5 THEN avg(score) OVER w ELSE 0 END AS score FROM frames
  WINDOW w AS (PARTITION BY filename ORDER BY "offset" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""
_RUNS = """t AS (SELECT unnest([0.2, 0.5]) AS threshold),
i AS (SELECT filename, "offset", score, row_number() OVER (PARTITION BY filename ORDER BY "offset") - 1 AS i, min("offset") OVER (PARTITION BY filename) AS t0, max("offset") OVER (PARTITION BY filename) AS t1 FROM frames),
h AS (SELECT i.*, threshold, i - row_number() OVER (PARTITION BY filename, threshold ORDER BY i) AS g FROM i, t WHERE score >= threshold),
r AS (SELECT threshold::DOUBLE AS threshold, filename, greatest(min(t0), min(i) * 0.5 - 0.25 + min(t0)) AS start, least(max(t1), max(i) * 0.5 + 0.25 + min(t0)) + 0.5 AS e, avg(score) AS score FROM h GROUP BY threshold, filename, g)"""


@query(sql(f'WITH {_AVG} SELECT filename, "offset", round(score, 6) AS score FROM avg_', "frames"))
def moving_average(spark, d):
    return D.moving_average(V.frames(spark, d), 5).withColumn("score", F.round("score", 6))


@query(sql("SELECT t.threshold::DOUBLE AS threshold, filename, \"offset\" AS start, 3.0::DOUBLE AS duration, score FROM frames, (SELECT unnest([0.5, 0.9]) AS threshold) t WHERE score >= t.threshold", "frames"))
def threshold_frames(spark, d):
    return D.threshold_frames(V.frames(spark, d), [0.5, 0.9], 3.0)


@query(sql(f"WITH {_RUNS} SELECT threshold, filename, round(start, 6) AS start, round(e - start, 6) AS duration, round(score, 6) AS score FROM r", "frames"))
def group_detections(spark, d):
    return D.group(V.frames(spark, d), [0.2, 0.5], 0.5, 0.25).select("threshold", "filename", *rounded("start", "duration", "score"))


@query(
    sql(
        f"""WITH {_RUNS},
m AS (SELECT *, max(e) OVER (PARTITION BY threshold, filename ORDER BY start, e - start, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY threshold, filename ORDER BY start, e - start, score) AS run FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY threshold, filename, run ORDER BY start, e - start, score) AS k, count(*) OVER (PARTITION BY threshold, filename, run) AS c FROM n)
SELECT threshold, filename, round(min(start), 6) AS start, round(max(e) - min(start), 6) AS duration,
  round(sum(score * CASE WHEN k = 1 THEN power(2.0, 1 - c) ELSE power(2.0, k - c - 1) END), 6) AS score FROM p GROUP BY threshold, filename, run""",
        "frames",
    )
)
def merge_detections(spark, d):
    found = D.detect(V.frames(spark, d), [0.2, 0.5], grouped=True, merged=True, step=0.5, buffer=0.25)
    return found.select("threshold", "filename", *rounded("start", "duration", "score"))


# Batches and labels --------------------------------------------------------------------------

_N = "n AS (SELECT vec_id AS id, label, row_number() OVER (ORDER BY vec_id) - 1 AS ord, count(*) OVER () AS total FROM embeddings)"


@query(f"WITH {_N} SELECT id, label, least(ord // 32, greatest(total // 32, 1) - 1)::INT AS batch_id FROM n")
def batches(spark, d):
    return B.batches(V.signals(spark, d), 32, ["id"]).select("id", "label", "batch_id")


@query(
    f"""WITH {_N}, b AS (SELECT unnest(range(0, (SELECT greatest(max(total) // 32, 1) FROM n))) AS b)
SELECT id, b::INT AS batch_id FROM n, b WHERE CASE WHEN ord >= (total // 32) * 32 THEN b = total // 32 - 1 ELSE ord >= b * 32 - 3 AND ord < (b + 1) * 32 + 3 END"""
)
def extended_batches(spark, d):
    return B.batches(V.signals(spark, d), 32, ["id"], extend=3).select("id", "batch_id")


_JOINT = """n AS (SELECT vec_id AS id, label, label % 2 AS g, row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) - 1 AS ord, count(*) OVER (PARTITION BY label % 2) AS total FROM embeddings),
b AS (SELECT id, label, g, least(ord // CASE g WHEN 0 THEN 16 ELSE 32 END, greatest(total // CASE g WHEN 0 THEN 16 ELSE 32 END, 1) - 1) AS batch_id FROM n),
s AS (SELECT g, max(batch_id) + 1 AS size FROM b GROUP BY g)"""


@query(f"WITH {_JOINT}, r AS (SELECT unnest(range(0, 1 + (SELECT max(size) FROM s))) AS r) SELECT id, label, (batch_id + r.r * s.size)::INT AS batch_id, b.g AS gen_id FROM b JOIN s ON s.g = b.g, r WHERE batch_id + r.r * s.size < (SELECT max(size) FROM s)")
def joint_batches(spark, d):
    s = V.signals(spark, d).select("id", "label")
    return B.joint([B.batches(s.where("label % 2 = 0"), 16, ["id"], drop_ordinal=True), B.batches(s.where("label % 2 = 1"), 32, ["id"], drop_ordinal=True)], "max")


@query("SELECT e.vec_id AS id, round(e.embedding[1]::DOUBLE, 6) AS first, l.quality FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id")
def multimodal(spark, d):
    modes = {"signal": V.signals(spark, d), "weak": V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")}
    return B.multimodal(modes).select("id", F.round(F.get("signal.data", F.lit(0)), 6).alias("first"), "weak.quality")


@query(sql("SELECT e.vec_id AS id, count(a.event_id) AS n, coalesce(sum(a.label), 0)::BIGINT AS labels FROM embeddings e LEFT JOIN annot a ON a.filename = 'u' || e.vec_id GROUP BY e.vec_id", "annot"))
def strong_labels(spark, d):
    a = V.annotations(spark, d).select(F.substring("filename", 2, 20).cast("long").alias("data_index"), "start", "end", "label")
    got = B.strong_labels(V.signals(spark, d).select("id"), a)
    return got.select("id", F.size("annotations").cast("long").alias("n"), F.aggregate("annotations", F.lit(0).cast("long"), lambda s, x: s + x["label"]).alias("labels"))


@query("SELECT e.vec_id AS id, (SELECT count(DISTINCT label) FROM embeddings x WHERE x.label < e.label AND x.label <> 4)::INT AS label FROM embeddings e WHERE label <> 4")
def label_mapping(spark, d):
    s = V.signals(spark, d).where("label <> 4").select("id", "label")
    return B.map_labels(s, B.label_codes(s))


@query("SELECT DISTINCT label FROM (SELECT label FROM embeddings UNION ALL SELECT quality FROM labels)")
def unique_labels(spark, d):
    return B.unique_labels(V.signals(spark, d), V.table(spark, d, "labels").withColumnRenamed("quality", "label"))


@query("SELECT vec_id AS id, i::INT AS i, (label = i)::INT::DOUBLE AS v, label AS back FROM embeddings, (SELECT unnest(range(0, 10)) AS i)")
def one_hot(spark, d):
    hot = V.signals(spark, d).select("id", scalar.one_hot(F.col("label"), 10).alias("h"))
    return hot.select("id", F.posexplode("h").alias("i", "v"), scalar.arg_max(F.col("h")).alias("back"))


@query("SELECT vec_id AS id, list_position(embedding, list_max(embedding))::INT - 1 AS class_id, round(list_max(embedding)::DOUBLE, 6) AS confidence FROM embeddings")
def class_and_confidence(spark, d):
    return V.signals(spark, d).select("id", scalar.class_and_confidence(F.col("data")).alias("c")).select("id", "c.class_id", F.round("c.confidence", 6).alias("confidence"))


# Signals -------------------------------------------------------------------------------------


@query(sql("SELECT id, pos::INT AS pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w * 2.0 + 1.0, 6) AS x FROM signal WINDOW w AS (PARTITION BY id)", "signal"))
def normalize_signals(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.normalize("data", 1.0, 2.0)).alias("pos", "x")).select("id", "pos", *rounded("x"))


@query(sql("SELECT filename, t_bin, f_bin, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS value FROM image WINDOW w AS (PARTITION BY filename, f_bin)", "image"))
def adjust_range(spark, d):
    return X.adjust_range(V.images(spark, d)).withColumn("value", F.round("value", 6))


@query(sql("SELECT filename, f_bin, round(max(value), 6) AS max, round(min(value), 6) AS min, round(stddev_pop(value), 6) AS std, round(avg(value), 6) AS average, round(median(value), 6) AS median FROM image GROUP BY filename, f_bin", "image"))
def image_statistics(spark, d):
    return X.statistics(V.images(spark, d)).select("filename", "f_bin", *rounded("max", "min", "std", "average", "median"))


@query(sql("SELECT filename, t_bin, f_bin, round(value - median(value) OVER (PARTITION BY filename, f_bin), 6) AS value FROM image", "image"))
def reduce_tonal_noise(spark, d):
    return X.reduce_tonal_median(V.images(spark, d)).withColumn("value", F.round("value", 6))


@query(sql("SELECT filename, t_bin, f_bin, round(value / (exp(-((value - median(value) OVER w - stddev_pop(value) OVER w) / (stddev_pop(value) OVER w / 2.0))) + 1), 6) AS value FROM image WINDOW w AS (PARTITION BY filename)", "image"))
def enhance_signal(spark, d):
    return X.enhance(V.images(spark, d), 2.0).withColumn("value", F.round("value", 6))


@query(
    sql(
        """WITH m AS (SELECT *, median(value) OVER (PARTITION BY filename, t_bin) AS rm, median(value) OVER (PARTITION BY filename, f_bin) AS cm FROM image)
SELECT filename, t_bin, f_bin, CASE WHEN value > 1.5 * rm AND value > 1.5 * cm AND value > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM (SELECT filename, t_bin, f_bin, value, rm, median(CASE WHEN value > 1.5 * rm THEN value ELSE 0 END) OVER (PARTITION BY filename, f_bin) AS cm FROM m)""",
        "image",
    )
)
def median_filter(spark, d):
    return X.median_filter(V.images(spark, d), 1.5, 1.5)


@query(sql("SELECT a.filename, a.t_bin, a.f_bin, round(a.value + 0.5 * coalesce(b.value, 0), 6) AS value FROM image a LEFT JOIN image b ON a.filename = b.filename AND a.f_bin = b.f_bin AND a.t_bin = b.t_bin + 2", "image"))
def add_images(spark, d):
    i = V.images(spark, d)
    return X.add_images(i, i, 2, 0.5).withColumn("value", F.round("value", 6))


@query(
    sql(
        """SELECT id, (pos // 8)::INT AS frame, (pos % 8)::INT AS i, round(x, 6) AS x FROM signal UNION ALL SELECT id, (pos // 8)::INT - 1 AS frame, (pos % 8 + 8)::INT AS i, round(x, 6) AS x FROM signal WHERE pos >= 8
UNION ALL SELECT id, 7 AS frame, pos::INT + 8 AS i, 0.0 AS x FROM signal WHERE pos < 8""",
        "signal",
    )
)
def framing(spark, d):
    """Frames of 16 samples every 8; the last one is half padding."""
    f = V.signals(spark, d).select("id", F.posexplode(arrays.frames("data", 16, 8, num=8, pad="zero")).alias("frame", "w"))
    return f.select("id", "frame", F.posexplode("w").alias("i", "x")).select("id", "frame", "i", *rounded("x"))


DFT = """w AS (SELECT id, pos, x * (0.54 - 0.46 * cos(2 * pi() * pos / 63)) AS x FROM signal), k AS (SELECT unnest(range(0, 33)) AS k),
dft AS (SELECT id, k::INT AS k, sqrt(power(sum(x * cos(2 * pi() * k * pos / 64)), 2) + power(sum(x * sin(2 * pi() * k * pos / 64)), 2)) AS m FROM w, k GROUP BY id, k)"""


@query(sql(f"WITH {DFT} SELECT id, k, round(m, 5) AS m FROM dft", "signal"))
def dft_magnitude(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.dft_magnitude("data", 64)).alias("k", "m")).select("id", "k", F.round("m", 5).alias("m"))


@query(sql(f"WITH {DFT} SELECT id, k, round(20 * log10(m * m / 64), 3) AS db FROM dft WHERE m > 0", "signal"))
def power_decibel(spark, d):
    f = V.signals(spark, d).select("id", F.posexplode(arrays.dft_magnitude("data", 64)).alias("k", "m"))
    return f.select("id", "k", F.round(scalar.to_decibel(scalar.mag_to_power(F.col("m"), F.lit(64))), 3).alias("db")).where("db IS NOT NULL")


@query(sql("SELECT id, pos::INT AS pos, round(x - 0.97 * coalesce(lag(x) OVER (PARTITION BY id ORDER BY pos), 0), 6) AS x FROM signal", "signal"))
def preemphasis(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.preemphasis("data")).alias("pos", "x")).select("id", "pos", *rounded("x"))


# Scalars -------------------------------------------------------------------------------------

_MEL = 2595.0


@query(
    """WITH v AS (SELECT event_id, value AS x FROM events), p AS (SELECT event_id, x, 2595.0 * log10(1 + x / 700.0) / (2595.0 * log10(1 + 500.0 / 700.0)) * 41 - 0.5 AS m FROM v),
q AS (SELECT event_id, x, CASE WHEN m < -0.5 THEN m + 0.5 WHEN m < 1 THEN 1 - (1 - m) / 1.5 WHEN m > 40.5 THEN m - 0.5 WHEN m > 39 AND m < 40.5 THEN 39 + (m - 39) / 1.5 ELSE m END AS m, x / 2.5 AS l, 8 * log2(x / 0.5) AS g FROM p)
SELECT event_id, trunc(CASE WHEN l = 200 THEN 199 WHEN l < 0 THEN l - 1 ELSE l END)::INT AS linear, trunc(CASE WHEN g = 128 THEN 127 WHEN g < 0 THEN g - 1 ELSE g END)::INT AS octave,
trunc(CASE WHEN m = 40 THEN 39 WHEN m < 0 THEN m - 1 ELSE m END)::INT AS mel FROM q"""
)
def axis_bins(spark, d):
    x = F.col("value")
    return V.table(spark, d, "events").select("event_id", LinearAxis(200, 0.0, 500.0).bin(x).alias("linear"), Log2Axis(128, 8.0, 0.5).bin(x).alias("octave"), MelAxis.of(40, 500.0).bin(x).alias("mel"))


@query(
    """SELECT event_id, round(2595.0 * log10(1 + value / 700), 6) AS mel, round(700 * (power(10, value / 2595.0) - 1), 6) AS hz, round(20 * log10(value), 6) AS db,
ceil(value * 10) / 10 AS up, floor(value * 10) / 10 AS down, (floor(value * 1000) + CASE WHEN value * 1000 - floor(value * 1000) > 1.1920928955078125e-07 THEN 1 ELSE 0 END)::BIGINT AS samples,
round(1000.0 * power(2.0, user_id % 11 - 5), 6) AS centre FROM events WHERE value > 0"""
)
def scalar_functions(spark, d):
    v = F.col("value")
    e = V.table(spark, d, "events").where("value > 0")
    return e.select(
        "event_id", F.round(scalar.hz_to_mel(v), 6).alias("mel"), F.round(scalar.mel_to_hz(v), 6).alias("hz"), F.round(scalar.to_decibel(v), 6).alias("db"),
        scalar.ceil_to(v, 1).alias("up"), scalar.floor_to(v, 1).alias("down"), scalar.num_samples(v, F.lit(1000.0)).alias("samples"), F.round(scalar.octave_band(F.col("user_id") % 11)["centre"], 6).alias("centre"),
    )


@query("SELECT page_id, regexp_replace(url, '[^/]*$', '') AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[+-]?[0-9]+$') AS whole FROM pages")
def path_functions(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", scalar.relative_dir(F.col("url")).alias("dir"), F.regexp_extract("url", r"([^/]*)$", 1).alias("base"), scalar.is_int(F.regexp_extract("url", r"([^/]*)$", 1)).alias("whole"))


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS parsed FROM events")
def parse_datetimes(spark, d):
    name = F.concat(F.lit("rec_"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss"), F.lit(".wav"))
    return V.table(spark, d, "events").select("event_id", scalar.parse_datetime(name, "*_%Y%m%dT%H%M%S.wav").cast("timestamp_ntz").alias("parsed"))


# Metrics -------------------------------------------------------------------------------------

_YP = "yp AS (SELECT l.quality AS y, least(1.0, d.n_chars / 4000.0) AS p FROM labels l JOIN documents d USING (doc_id))"


def _truth(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return V.table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"))


@query(
    f"""WITH {_YP}, c AS (SELECT count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 0 AND p < 0.5) AS tn, count_if(y = 1 AND p < 0.5) AS fn,
avg(((y = 1) = (p >= 0.5))::INT) AS acc, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) AS bce,
sum(y * p) AS stp, sum((1 - y) * p) AS sfp, sum(y * (1 - p)) AS sfn FROM yp)
SELECT tp, fp, tn, fn, round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(mse, 6) AS mse, round(mae, 6) AS mae, round(bce, 6) AS bce,
round(1 - 2 * (stp / (stp + sfp + 1e-6)) * (stp / (stp + sfn + 1e-6)) / (stp / (stp + sfp + 1e-6) + stp / (stp + sfn + 1e-6) + 1e-6), 6) AS f_loss FROM c"""
)
def binary_metrics(spark, d):
    m = metrics
    return _truth(spark, d).agg(
        m.true_positives("y", "p").alias("tp"), m.false_positives("y", "p").alias("fp"), m.true_negatives("y", "p").alias("tn"), m.false_negatives("y", "p").alias("fn"),
        F.round(m.accuracy("y", "p"), 6).alias("accuracy"), F.round(m.precision("y", "p"), 6).alias("precision"), F.round(m.recall("y", "p"), 6).alias("recall"), F.round(m.mean_squared_error("y", "p"), 6).alias("mse"),
        F.round(m.mean_absolute_error("y", "p"), 6).alias("mae"), F.round(m.binary_crossentropy("y", "p"), 6).alias("bce"), F.round(m.f_score_loss("y", "p"), 6).alias("f_loss"),
    )


@query(f"WITH {_YP} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM yp a, yp b WHERE a.y = 1 AND b.y = 0")
def auc(spark, d):
    return metrics.auc(_truth(spark, d), "y", "p").select(F.round("auc", 6).alias("auc"))


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(V.table(spark, d, "labels"), "quality", "toxic")


# Samples: no SQL gives the same draw; the tests check their properties --------------------------


@query()
def random_choice(spark, d):
    return S.random_choice(V.annotations(spark, d), 100, seed=3)


@query()
def random_background(spark, d):
    return S.random_selections(V.files(spark, d), 3600.0, 200, label=9, annotations=V.annotations(spark, d), no_overlap=True, buffer=60.0, seed=3)


# Kernels and further operators ------------------------------------------------------------------


MEL_BANK = """c AS (SELECT i, floor(65 * 700 * (power(10, i * (2595 * log10(1 + 32.0 / 700)) / 9 / 2595) - 1) / 64) AS c FROM (SELECT unnest(range(0, 10)) AS i)),
bank AS (SELECT l.i AS m, k.k, CASE WHEN k.k >= l.c AND k.k < n.c THEN (k.k - l.c) / (n.c - l.c) WHEN k.k >= n.c AND k.k < h.c THEN (h.c - k.k) / (h.c - n.c) ELSE 0 END AS w
  FROM c l JOIN c n ON n.i = l.i + 1 JOIN c h ON h.i = l.i + 2, (SELECT unnest(range(0, 33)) AS k) k)"""


@query(sql(f"WITH {DFT} SELECT id, k, round(m, 5) AS m FROM dft", "signal"))
def stft_kernel(spark, d):
    """The vectorised transform, on one frame for each signal, against the plain sum."""
    from tidemark.functions import kernels as K

    one = K.kernel(lambda x: K.stft(x, 64, 64)[0])
    return V.signals(spark, d).select("id", F.posexplode(one("data")).alias("k", "m")).select("id", "k", F.round("m", 5).alias("m"))


@query(
    sql(
        f"""WITH {DFT}, {MEL_BANK}
SELECT id, bank.m::INT AS m, round(sum(dft.m * dft.m / 64 * w), 5) AS v FROM dft JOIN bank ON bank.k = dft.k GROUP BY id, bank.m""",
        "signal",
    )
)
def mel_bands(spark, d):
    from tidemark.functions import kernels as K

    bank = K.mel_bank(64, 64.0, 8)
    rows = [(m, k, float(bank[m, k])) for m in range(8) for k in range(33)]
    table = spark.createDataFrame(rows, "m int, f_bin int, weight double")
    power = V.signals(spark, d).select(F.col("id"), F.lit(0).alias("t_bin"), F.posexplode(arrays.dft_magnitude("data", 64)).alias("f_bin", "x")).select("id", "t_bin", "f_bin", scalar.mag_to_power(F.col("x"), F.lit(64)).alias("value"))
    return X.weighted_bands(power, table, "id").select("id", "m", F.round("value", 5).alias("v"))


@query("SELECT 'o' || o_orderkey AS filename, i::INT AS frame, i * 700.0 AS \"offset\", 1000.0::DOUBLE AS duration FROM (SELECT o_orderkey, unnest(range(0, greatest(ceil((o_totalprice / 10 - 1000.0) / 700.0 + 1), 1)::INT)) AS i FROM orders WHERE o_totalprice > 0)")
def frame_stepper(spark, d):
    files = V.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("filename"), (F.col("o_totalprice") / 10).alias("duration"))
    return S.frames(files, 1000.0, 700.0)


@query(
    sql(
        """SELECT filename, annot_id AS sel_id, CASE WHEN "end" <= start THEN 'empty' WHEN "end" <= 0 THEN 'before' WHEN start > 1000000 THEN 'after'
WHEN greatest(0, -start) + greatest(0, "end" - 1000000) > 0.5 * ("end" - start) THEN 'mostly_outside' ELSE 'ok' END AS status FROM annot""",
        "annot",
    )
)
def outside_status(spark, d):
    a = V.annotations(spark, d).withColumnRenamed("annot_id", "sel_id")
    return S.outside_status(a, V.files(spark, d).withColumn("duration", F.lit(1_000_000.0))).select("filename", "sel_id", "status")


@query(sql("SELECT 0 AS set_id, filename, annot_id, label FROM annot WHERE label = 0 UNION ALL SELECT 7, filename, annot_id, label FROM annot WHERE label <> 0", "annot"))
def stack_annotations(spark, d):
    a = V.annotations(spark, d).select("filename", "annot_id", "label")
    return A.stack([a.where("label = 0"), a.where("label <> 0")], [0, 7])


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    from tidemark.streaming.detector import windowed_counts as counts

    e = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return counts(e, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")


@query(sql("SELECT id, pos::INT + 3 AS pos, round(x, 6) AS x FROM signal UNION ALL SELECT id, 3 - pos::INT AS pos, round(x, 6) FROM signal WHERE pos BETWEEN 1 AND 3 UNION ALL SELECT id, 129 - pos::INT AS pos, round(x, 6) FROM signal WHERE pos BETWEEN 61 AND 62", "signal"))
def pad_reflect(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.pad_reflect("data", 3, 2)).alias("pos", "x")).select("id", "pos", *rounded("x"))


@query(sql("SELECT id, (pos - 28)::INT AS i, round(x, 6) AS x FROM signal WHERE pos BETWEEN 28 AND 32", "signal"))
def nearest_values(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.nearest_values("data", 30, 5)).alias("i", "x")).select("id", "i", *rounded("x"))


@query(sql("SELECT id, pos::INT AS pos, round(x + 0.5 * coalesce(lag(x, 10) OVER (PARTITION BY id ORDER BY pos), 0), 6) AS x FROM signal", "signal"))
def add_signals(spark, d):
    return V.signals(spark, d).select("id", F.posexplode(arrays.add("data", "data", 10, 0.5)).alias("pos", "x")).select("id", "pos", *rounded("x"))


@query(f"WITH {_YP}, s AS (SELECT DISTINCT p AS t FROM yp) SELECT round(max(CASE WHEN (SELECT count(*) FROM yp WHERE y = 0 AND p >= t) <= 0.1 * (SELECT count(*) FROM yp WHERE y = 0) + 1e-9 THEN (SELECT count(*) FROM yp WHERE y = 1 AND p >= t) / (SELECT count(*) FROM yp WHERE y = 1) ELSE 0 END), 6) AS sensitivity FROM s")
def sensitivity_at_specificity(spark, d):
    return metrics.sensitivity_at_specificity(_truth(spark, d), "y", "p", 0.9 - 1e-9).select(F.round("sensitivity", 6).alias("sensitivity"))


@query(f"WITH {_YP} SELECT round(avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END), 6) AS huber, round(avg(greatest(0, 1 - (2 * y - 1) * p)), 6) AS hinge, round(avg(p - y * ln(p + 1e-7)), 6) AS poisson, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM yp")
def regression_losses(spark, d):
    m = metrics
    return _truth(spark, d).agg(F.round(m.huber("y", "p"), 6).alias("huber"), F.round(m.hinge("y", "p"), 6).alias("hinge"), F.round(m.poisson("y", "p"), 6).alias("poisson"), F.round(m.root_mean_squared_error("y", "p"), 6).alias("rmse"))
