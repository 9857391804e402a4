import pytest
from pyspark.sql import functions as F

from tidemark.operators import batching as B


def plain(n, size, extend):
    """Batches by counting: what is left joins the last one; neighbours lend ``extend`` rows."""
    count = max(n // size, 1)
    full = count * size if n >= size else n
    out = []
    for b in range(count):
        own = range(max(0, b * size - extend), min(full, (b + 1) * size + extend))
        out += [(i, b) for i in own] + [(i, b) for i in range(full, n) if b == count - 1]
    return sorted(out)


@pytest.mark.parametrize(("n", "size", "extend"), [(11, 3, 0), (12, 4, 1), (11, 3, 2), (2, 5, 0)])
def test_batches(spark, n, size, extend):
    t = spark.range(n).withColumn("label", F.lit(0))
    got = sorted((r["id"], r["batch_id"]) for r in B.batches(t, size, ["id"], extend).collect())
    assert got == plain(n, size, extend)


def test_ordinals_over_partitions(spark):
    t = B.with_ordinal(spark.range(100).repartition(7), [F.desc("id")], partitions=5)
    assert all(r["ord"] == 99 - r["id"] for r in t.collect())
    assert sorted(r["ord"] for r in B.with_ordinal(spark.range(50), B.shuffled(3, "id")).collect()) == list(range(50))


def test_ordinals_of_many_rows(spark):
    """A million rows of several columns, a skewed first key and partitions in disorder: no gap and no number twice."""
    t = spark.range(1_000_000, numPartitions=9).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 1000).alias("k"), F.concat(F.lit("text "), "id").alias("a"), F.rand(3).alias("b"))
    for order in (["k", "id"], B.shuffled(5, "id")):
        got = B.with_ordinal(t, order, partitions=8).select("ord", "id", "a")
        n, different, low, high, same = got.agg(F.count("*"), F.count_distinct("ord"), F.min("ord"), F.max("ord"), F.count_if(F.col("a") == F.concat(F.lit("text "), "id"))).first()
        assert (n, different, low, high, same) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000)
    ordered = B.with_ordinal(t, ["k", "id"], partitions=8).select("ord", "k", "id")
    after = ordered.select((F.col("ord") - 1).alias("ord"), F.col("k").alias("k2"), F.col("id").alias("id2"))
    assert ordered.join(after, "ord").where("k > k2 OR (k = k2 AND id > id2)").count() == 0


def test_labels(spark):
    t = spark.createDataFrame([(1,), (3,), (5,), (3,)], "label int")
    assert sorted(r[0] for r in B.map_labels(t, B.label_codes(t)).collect()) == [0, 1, 1, 2]
    assert [r[0] for r in B.unique_labels(t, spark.createDataFrame([(2,), (4,)], "label int")).collect()] == [1, 2, 3, 4, 5]


def test_joint_and_multimodal(spark):
    make = lambda n: B.batches(spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")), 2, ["id"], drop_ordinal=True)
    least = B.joint([make(4), make(8)])
    assert {r["batch_id"] for r in least.collect()} == {0, 1}
    most = B.joint([make(4), make(8)], "max")
    assert most.where("gen_id = 0").count() == 8 and most.where("gen_id = 1").count() == 8
    assert B.multimodal({"a": make(4), "b": make(3)}).count() == 3


def test_strong_labels_and_feed(spark):
    data = spark.range(3)
    a = spark.createDataFrame([(0, 1, 0.0, 1.0), (0, 2, 0.5, 1.0), (2, 1, 0.0, 2.0)], "data_index long, label int, start double, end double")
    got = {r["id"]: len(r["annotations"]) for r in B.strong_labels(data, a).collect()}
    assert got == {0: 2, 1: 0, 2: 1}
    fed = list(B.feed(B.batches(spark.range(7), 3, ["id"]), lambda rows: [r["id"] for r in rows]))
    assert [(b, sorted(x)) for b, x in fed] == [(0, [0, 1, 2]), (1, [3, 4, 5, 6])]
    sums = B.map_batches(B.batches(spark.range(6), 3, ["id"]), lambda p: p.groupby("batch_id", as_index=False)["id"].sum(), "batch_id int, id long")
    assert sorted(r["id"] for r in sums.collect()) == [3, 12]


@pytest.mark.parametrize("lockstep", [False, True])
def test_an_epoch_on_the_executors(spark, lockstep):
    """Every batch is seen once, by one task, in the epoch's order; each task has every third one."""
    import pyarrow as pa

    rows = spark.range(106).select("id", (F.col("id") * 2.0).alias("x"))
    batched = B.batches(rows, 8, ["id"], drop_ordinal=True)

    def see(turn, batch, table):
        from pyspark import TaskContext

        ids = table.column("id").to_pylist()
        return pa.table({"turn": [turn], "batch": [batch], "task": [TaskContext.get().partitionId()], "rows": [len(ids)], "first": [ids[0]], "total": [sum(table.column("x").to_pylist())], "at": [__import__("time").time()]})

    seen = []
    for seed in (None, 1, 2):
        got = sorted(B.feed_tasks(batched, see, "turn long, batch long, task int, rows long, first long, total double, at double", 3, seed, ("id",), lockstep).collect())
        assert [r["turn"] for r in got] == list(range(13)) and sorted(r["batch"] for r in got) == list(range(13))
        assert all(r["task"] == r["turn"] % 3 for r in got) and sum(r["rows"] for r in got) == 106 and sum(r["total"] for r in got) == 2.0 * sum(range(106))
        assert all(r["first"] == 8 * r["batch"] for r in got)
        for task in range(3):
            times = [r["at"] for r in got if r["task"] == task]
            assert times == sorted(times)
        if lockstep:
            assert all(max(r["at"] for r in got[k : k + 3]) <= min(r["at"] for r in got[k + 3 : k + 6]) + 0.01 for k in range(0, 9, 3))
        seen.append([r["batch"] for r in got])
    assert seen[0] == list(range(13)) and len({tuple(s) for s in seen}) == 3
    assert B.feed_tasks(batched.limit(0), see, "turn long, batch long, task int, rows long, first long, total double, at double", 3).count() == 0


@pytest.mark.parametrize("shared", [True, False])
def test_tasks_meet_without_waiting_for_seconds(spark, monkeypatch, shared):
    """Where tasks see a common folder, 40 rounds take less than the 40 s of Spark's barrier; where they don't, the rounds are as strict."""
    import pyarrow as pa

    if not shared:
        monkeypatch.setattr(B, "fresh_folder", lambda *_: "/proc/no/such/folder")
    n = 121 if shared else 7
    batched = B.batches(spark.range(2 * n), 2, ["id"], drop_ordinal=True)
    see = lambda turn, batch, table: pa.table({"turn": [turn], "at": [__import__("time").time()]})
    at = [r["at"] for r in sorted(B.feed_tasks(batched, see, "turn long, at double", 3, lockstep=True).collect())]
    assert len(at) == n and all(max(at[k : k + 3]) <= min(at[k + 3 : k + 6]) + 0.01 for k in range(0, n - 3, 3))
    if shared:
        assert max(at) - min(at) < 20
