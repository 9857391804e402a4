from pyspark.sql import functions as F

from tidemark.operators import detections as D
from tidemark.streaming import detector


def test_stream_agrees_with_batch(spark, tmp_path):
    scores = [0, 0.9, 0.9, 0.8, 0, 0, 0.7, 0.9, 0.9, 0, 0]
    rows = [(f, i * 0.5, float(s)) for f in ("a", "b") for i, s in enumerate(scores)]
    frames = spark.createDataFrame(rows, "filename string, offset double, score double")
    for part in (0, 1, 2):  # chunks in the order of offsets
        frames.where((F.col("offset") >= part * 2) & (F.col("offset") < part * 2 + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Processing-time timeouts run batches without data for ever; a run over what is there needs none.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = detector.detections(detector.frame_stream(spark, str(tmp_path / "in")), 0.5, 0.5, 3).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r["filename"], r["start"], r["duration"], round(r["score"], 6)) for r in spark.table("found").collect())
    batch = D.group(D.moving_average(frames, 3), 0.5, 0.5)
    want = sorted((r["filename"], r["start"], r["duration"], round(r["score"], 6)) for r in batch.collect())
    assert got and set(got) <= set(want) and len(got) >= 2


def test_windowed_counts(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch = events.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = detector.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert 0 < spark.table("counts").count() <= batch
