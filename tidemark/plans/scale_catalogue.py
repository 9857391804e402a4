"""Named queries over very long files, intervals of all lengths, WAV files by ranges and event-time streams, with their SQL."""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import functions as F

from tidemark.operators import annotations as A
from tidemark.operators import batching as B
from tidemark.operators import chunks
from tidemark.operators import detections as D
from tidemark.operators import intervals as I
from tidemark.operators import representations as R
from tidemark.operators import selections as S
from tidemark.operators import signals
from tidemark.plans import views as V
from tidemark.plans.catalogue import _RUNS, query, rounded
from tidemark.plans.tables_catalogue import _WAV, _wavs
from tidemark.plans.views import sql
from tidemark.sources import wav
from tidemark.sources.store import Store
from tidemark.storage import discard, fresh_path, stored

# One file of all events, cut into ranges -----------------------------------------------------------

_LONG = """frames AS (SELECT 'all' AS filename, (row_number() OVER (ORDER BY event_id) - 1) * 0.5 AS "offset", round(value / 500, 6) AS score FROM events)"""


def _long_frames(spark, d):
    e = V.table(spark, d, "events").select(F.lit("all").alias("filename"), "event_id", F.round(F.col("value") / 500, 6).alias("score"))
    return A.ordinal(e, "i", ["event_id"], spread=True).select("filename", (F.col("i") * 0.5).alias("offset"), "score")


@query(f'WITH {_LONG} SELECT "offset", round(CASE WHEN count(*) OVER w = 101 THEN avg(score) OVER w ELSE 0 END, 6) AS score FROM frames WINDOW w AS (ORDER BY "offset" ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)')
def long_file_average(spark, d):
    """A moving average of 101 frames along one file of all events, in blocks with a halo."""
    return D.moving_average(_long_frames(spark, d), 101, spread=True).select("offset", F.round("score", 6).alias("score"))


@query(f"WITH {_LONG}, {_RUNS} SELECT threshold, filename, round(start, 6) AS start, round(e - start, 6) AS duration, round(score, 6) AS score FROM r")
def long_file_groups(spark, d):
    """Runs of frames over ranges of one file; those that cross a border are one run."""
    found = D.group(_long_frames(spark, d), [0.2, 0.5], 0.5, 0.25, spread=True)
    return found.select("threshold", "filename", *rounded("start", "duration", "score"))


_SPANS = """s AS (SELECT filename, "offset" AS start, 0.25 + score * CASE WHEN CAST("offset" * 2 AS BIGINT) % 50 < 40 THEN 0.9 ELSE 0.1 END AS duration, score FROM frames)"""


def _long_spans(spark, d):
    near = F.when((F.col("offset") * 2).cast("long") % 50 < 40, 0.9).otherwise(0.1)
    return _long_frames(spark, d).select("filename", F.col("offset").alias("start"), (0.25 + F.col("score") * near).alias("duration"), "score")


@query(
    f"""WITH {_LONG}, {_SPANS},
m AS (SELECT *, start + duration AS e, max(start + duration) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER (ORDER BY start) AS run FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY start) AS k, count(*) OVER (PARTITION BY run) AS c FROM n)
SELECT round(min(start), 6) AS start, round(max(e) - min(start), 6) AS duration, round(sum(score * CASE WHEN k = 1 THEN power(2.0, 1 - c) ELSE power(2.0, k - c - 1) END), 6) AS score FROM p GROUP BY run"""
)
def long_file_merges(spark, d):
    """Detections of one file, merged over the borders of its ranges."""
    return D.merge(_long_spans(spark, d), spread=True).select(*rounded("start", "duration", "score"))


@query(f"""WITH {_LONG}, {_SPANS}, m AS (SELECT start, start + duration AS e, max(start + duration) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s) SELECT round(sum(greatest(0.0, e - greatest(start, coalesce(seen, start)))), 3) AS duration FROM m""")
def long_file_union(spark, d):
    spans = _long_spans(spark, d).withColumn("end", F.col("start") + F.col("duration"))
    return I.union_duration(spans, spread=True).select(F.round("duration", 3).alias("duration"))


# Intervals of all lengths, gaps --------------------------------------------------------------------


@query(sql("""WITH x AS (SELECT filename, annot_id, label, start, start + power(10.0, event_id % 13 - 3) AS "end" FROM annot)
SELECT a.filename, a.annot_id, b.annot_id AS other FROM x a JOIN x b ON a.filename = b.filename AND a.label = 1 AND b.label = 2 AND a."end" > b.start AND a.start < b."end" """, "annot"))
def overlaps_of_all_lengths(spark, d):
    """Intervals from a millisecond to thirty years in one table meet in nested bins."""
    x = V.annotations(spark, d).withColumn("end", F.col("start") + F.pow(F.lit(10.0), F.col("event_id") % 13 - 3))
    a, b = x.where("label = 1").select("filename", "annot_id", "start", "end"), x.where("label = 2").select("filename", F.col("annot_id").alias("other"), "start", "end")
    return I.nested_join(a, b).select("filename", "annot_id", "other")


@query(
    sql(
        f"""WITH w AS (SELECT filename, start - 60 AS a, "end" + 60 AS b FROM annot UNION ALL SELECT filename, duration, duration FROM files),
c AS (SELECT *, max(b) OVER (PARTITION BY filename ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w),
g AS (SELECT filename, greatest(coalesce(seen, 0), 0) AS gap_start, least(a, {V.DAYS_30}) AS gap_end FROM c)
SELECT filename, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end FROM g WHERE gap_end - gap_start >= 3600""",
        "annot",
        "files",
    )
)
def free_gaps(spark, d):
    """Where windows of an hour can be placed a minute from all annotations."""
    return S.free_gaps(V.files(spark, d), 3600.0, V.annotations(spark, d), 60.0).select("filename", *rounded("gap_start", "gap_end"))


# WAV files by ranges of bytes ---------------------------------------------------------------------


@query(sql(f"WITH {_WAV} SELECT 'w' || id || '.wav' AS filename, (pos // 20)::BIGINT AS chunk, pos % 20 AS place, round(x, 6) AS x FROM q WHERE pos >= 20 AND pos < 60", "signal"))
def wav_ranges(spark, d):
    """Chunks of 20 samples from ranges of 50 bytes; the filter on time is the reader's."""
    found = wav.chunks(spark, _wavs(spark, d), chunk=20, rangeBytes=50, taskBytes=1 << 16).where("start >= 0.3 AND start < 0.9")
    return found.select("filename", "chunk", F.posexplode("data").alias("place", "x")).select("filename", "chunk", "place", *rounded("x"))


@query("SELECT 'w' || vec_id || '.wav' AS filename, 64 AS rate, 1 AS channels, 2 AS width, 64::BIGINT AS frames, 1.0::DOUBLE AS duration FROM embeddings")
def wav_heads(spark, d):
    """Headers alone: no sample is read."""
    return wav.heads(spark, _wavs(spark, d)).select("filename", "rate", "channels", "width", "frames", "duration")


@query(sql(f"""WITH {_WAV} SELECT 'w' || f.id || '.wav' AS filename, f.frame::INT AS frame, round(sqrt(sum(x * x)), 6) AS strength
FROM (SELECT DISTINCT id, unnest(range(0, 4)) AS frame FROM signal) f JOIN q ON q.id = f.id AND q.pos >= 12 + 8 * frame AND q.pos < 28 + 8 * frame GROUP BY f.id, f.frame""", "signal"))
def efficient_frames(spark, d):
    """Frames of the middle half of each file, cut from one reading that is widened for them."""
    path = _wavs(spark, d)
    middle = wav.heads(spark, path).select("filename", F.lit(0.25).alias("start"), F.lit(0.75).alias("end"))
    cut = wav.frames_efficient(spark, path, middle, 64.0, 0.25, 0.125, chunk=24)
    return cut.select("filename", F.col("frame").cast("int").alias("frame"), F.round(F.sqrt(F.aggregate("data", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("strength"))


# Streams in event time ----------------------------------------------------------------------------


@query(sql(f"WITH {_RUNS} SELECT threshold, filename, round(start, 6) AS start, round(e - start, 6) AS duration, round(score, 6) AS score FROM r", "frames"))
def streamed_detections(spark, d):
    """Frames of all files in three unordered parts, grouped by a stateful stream; a last frame far ahead moves the watermark."""
    from tidemark.streaming import islands

    source, out, state = (fresh_path(spark, x) for x in ("frames", "found", "state"))
    kind = "filename string, offset double, score double, ts timestamp"
    frames = stored(islands.event_times(V.frames(spark, d)).withColumn("part", F.abs(F.xxhash64("filename", "offset")) % 3), "scored")
    written = [0]
    for part in range(3):
        frames.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        written.append(len(spark.read.schema(kind).parquet(source).inputFiles()))
    last = islands.event_times(frames.agg(F.lit("").alias("filename"), (F.max("offset") + 4e7).alias("offset"), F.lit(0.0).alias("score")))
    last.coalesce(1).write.mode("append").parquet(source)
    discard(frames)
    at_once = max(b - a for a, b in pairwise(written))  # the files of a part
    before = spark.conf.get(islands.PROVIDER, None)
    islands.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", at_once).parquet(source)
        found = islands.detections(stream, [0.2, 0.5], 0.5, 0.25, late="365 days", idle="60 seconds")
        run = found.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        run.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(islands.PROVIDER, before) if before else spark.conf.unset(islands.PROVIDER)
    return spark.read.schema(islands.FOUND).parquet(f"{out}/*").where("filename <> ''").select("threshold", "filename", *rounded("start", "duration", "score"))




# One signal of all embeddings, in chunks ------------------------------------------------------------

_ONE = """v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS chunk FROM embeddings),
one AS (SELECT chunk * 64 + pos AS i, x FROM (SELECT chunk, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM v))"""


def _one_signal(spark, d):
    return V.numbered(spark, d).select(F.lit(0).cast("long").alias("id"), F.col("ord").alias("chunk"), "data")


@query(f"""WITH {_ONE}, f AS (SELECT unnest(range(0, (SELECT (count(*) - 96) // 160 + 1 FROM one))) AS frame),
p AS (SELECT frame, x * (0.54 - 0.46 * cos(2 * pi() * (i - frame * 160) / 95)) AS x, i - frame * 160 AS n FROM f JOIN one ON i >= frame * 160 AND i < frame * 160 + 96)
SELECT frame, k, round(sqrt(power(sum(x * cos(2 * pi() * k * n / 96)), 2) + power(sum(x * sin(2 * pi() * k * n / 96)), 2)), 5) AS m FROM p, (SELECT unnest(range(0, 49)) AS k) GROUP BY frame, k""")
def chunked_spectra(spark, d):
    """Frames of 96 samples every 160 over chunks of 64: each lies in two or three."""
    found = chunks.spectra(_one_signal(spark, d), 64, 96, 160).select("frame", F.posexplode("data").alias("k", "m"))
    return found.select("frame", "k", F.round("m", 5).alias("m"))


_EPS = "(1 - exp(ln(0.15) / 4.0))"


@query(f"""WITH {_ONE}, m AS (SELECT avg(x) AS m FROM one),
s AS (SELECT a.i, sum({_EPS} * power(1 - {_EPS}, a.i - b.i - 1) * b.x) AS s FROM one a JOIN one b ON b.i < a.i AND b.i >= a.i - 100 GROUP BY a.i)
SELECT one.i, round(x - coalesce(s, 0) - m * power(1 - {_EPS}, one.i), 6) AS x FROM one CROSS JOIN m LEFT JOIN s ON s.i = one.i""")
def chunked_running_mean(spark, d):
    """Less a running mean along the whole signal, whose state is scanned over its chunks."""
    found = chunks.running_residual(_one_signal(spark, d), 64, 4.0).select("chunk", F.posexplode("data").alias("pos", "x"))
    return found.select((F.col("chunk") * 64 + F.col("pos")).alias("i"), *rounded("x"))


@query(f"""WITH {_ONE}, h AS (SELECT n, power(0.8, n) * sin((n + 1) * 0.7) / sin(0.7) AS h FROM (SELECT unnest(range(0, 160)) AS n))
SELECT a.i, round(sum(h.h * (b.x + 0.5 * coalesce(c.x, 0))), 6) AS y FROM one a JOIN h ON h.n <= a.i JOIN one b ON b.i = a.i - h.n LEFT JOIN one c ON c.i = b.i - 1 GROUP BY a.i""")
def chunked_filter(spark, d):
    """A resonance of the second order (poles 0.8 exp(+-0.7 i), one zero) along the whole signal; SQL sums its impulse response."""
    found = chunks.filter_signal(_one_signal(spark, d), 64, [1.0, 0.5], [-1.6 * math.cos(0.7), 0.64]).select("chunk", F.posexplode("data").alias("pos", "y"))
    return found.select((F.col("chunk") * 64 + F.col("pos")).alias("i"), F.round("y", 6).alias("y"))


# Medians of one long group --------------------------------------------------------------------------


@query("SELECT label, max(x) AS max, min(x) AS min, round(median(x), 9) AS median FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def long_group_medians(spark, d):
    """All samples of a label are one group; its middle values are selected by their bits."""
    long = V.signals(spark, d).select("label", F.explode("data").alias("value"))
    return signals.statistics(long, ("label",), spread=True).select("label", "max", "min", F.round("median", 9).alias("median"))


# An epoch on the executors ---------------------------------------------------------------------------


@query("""WITH n AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS ord, count(*) OVER () AS total FROM embeddings)
SELECT least(ord // 64, total // 64 - 1)::BIGINT AS batch, least(ord // 64, total // 64 - 1)::BIGINT AS turn, (least(ord // 64, total // 64 - 1) % 2)::INT AS worker, count(*) AS rows, round(sum(embedding[1]::DOUBLE), 5) AS total FROM n GROUP BY ALL""")
def epoch_on_executors(spark, d):
    """Batches of 64 signals, every other one for each of two tasks that run together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = V.signals(spark, d).select("id", F.get("data", F.lit(0)).alias("x"))

    def sums(turn, batch, table):
        return pa.table({"batch": [batch], "turn": [turn], "worker": pa.array([turn % 2], pa.int32()), "rows": [table.num_rows], "total": [pc.sum(table.column("x")).as_py()]})

    fed = B.feed_tasks(B.batches(rows, 64, ["id"], drop_ordinal=True), sums, "batch long, turn long, worker int, rows long, total double", 2, lockstep=True)
    return fed.select("batch", "turn", "worker", "rows", F.round("total", 5).alias("total"))


# Lineage ---------------------------------------------------------------------------------------------


@query(sql("SELECT id, (pos - 8)::INT AS place, round(x, 6) AS x FROM (SELECT id, pos, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM signal WINDOW w AS (PARTITION BY id)) WHERE pos BETWEEN 8 AND 40", "signal"))
def replayed_signals(spark, d):
    """Raw signals made again by the log that was stored beside transformed ones."""
    raw = V.signals(spark, d).select(F.col("id").alias("vec"), "data")
    store = Store(spark, fresh_path(spark, "logged"))
    store.write("t", R.apply_transforms(raw, [{"name": "normalize"}, {"name": "crop", "first": 8, "last": 40}], lineage="lineage"), order=["vec"])
    (log,) = R.lineages(store.open("t"))
    return R.replay(raw, log).select(F.col("vec").alias("id"), F.posexplode("data").alias("place", "x")).select("id", "place", *rounded("x"))
