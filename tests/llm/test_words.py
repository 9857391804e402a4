"""Operators 11 to 13 against plain versions: repeated windows, periodic runs, aligned tokens."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, contracts, periodic, substrings
from tidemark.llm.common import scramble


@pytest.fixture(scope="module")
def texts():
    """Awkward texts: passages, copies, white space of all kinds, periods, special tokens, odd characters, very long ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["re", "la", "tion", "é", "ß", "un", "so", "’", "-"]) for _ in range(rng.randint(1, 3)))
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 90, 400)]
    out = [None, "", " ", " \n\t ", "one", "x" * 5000, "9" * 30_000, "a\x0bb\x0cc\x1cd e  f\r\n  g", " x 　y  z  \u0085 q", "▁a ▁ b", "<|endoftext|> <s> </s><0x41> <unk>", "日本語 のテキスト 😀 ‍", "\0 \x01 ﬁ"]
    for _ in range(90):
        w = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passage)
        if rng.random() < 0.3:
            p = rng.randint(1, 30)
            w += (w[-p:] or ["z"]) * rng.randint(2, 20)
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    out += [out[20], out[21] + " more", "same " * 400, " ".join(word() for _ in range(40_000)), " ".join(passage[4] * 3)]
    return out


@pytest.fixture(scope="module")
def words_dir(spark, tmp_path_factory, texts):
    d = tmp_path_factory.mktemp("words")
    rng = random.Random(8)
    ids = rng.sample(range(-50, 10 * len(texts)), len(texts))
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{d}/documents.parquet")
    return str(d), rows


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_periodic_runs", "op13_token_alignment"])
def test_query_equals_plain_version(spark, words_dir, name):
    d, rows = words_dir
    if name == "op12_periodic_runs":  # the plain version is quadratic; long texts have tests of their own
        d, rows = f"{d}/short", [(i, t) for i, t in rows if len(t or "") < 20_000]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    want = getattr(brute, name.split("_")[0])(rows)
    found = contracts.QUERIES[name](spark, d)
    columns = [c for c in found.columns if c != "doc_id"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in found.collect()} == want
    assert sum(1 for w in want.values() if w[1]) > 20


def test_small_steps_and_pieces_change_nothing(spark, words_dir, monkeypatch):
    """Documents in very small batches and texts cut into pieces that overlap: the same windows."""
    texts = [t for _, t in words_dir[1] if t]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "key": [1] * len(texts), "text": texts})
    seen = []
    for limit in (200, 6 << 20):
        mine = set()
        for ids, _, words, sizes, firsts in substrings.pieces(iter([batch]), 50, limit):
            hashes, piece, place = substrings.window_hashes(words, sizes, 50)
            mine |= set(zip(ids[piece].tolist(), (place + firsts[piece]).tolist(), hashes.tolist(), strict=True))
        seen.append(mine)
    assert seen[0] == seen[1] and len(seen[0]) == sum(max(0, len(t.encode().split()) - 49) for t in texts)


def test_removed_words_are_maximal_intervals(spark):
    a, b = [" ".join(f"{p}{i}" for i in range(60)) for p in "ab"]
    docs = spark.createDataFrame([(1, a, "kept"), (2, f"x {a} {b} y", None), (3, f"{b} {a}", "kept"), (None, a, None)], "id long, text string, n_words string")
    found = {r["id"]: r["repeats"] for r in substrings.remove_repeats(docs, id="id").collect()}
    assert [tuple(r) for r in found[2]["removed"]] == [(1, 61)] and found[2]["kept"] == f"x {b} y"
    assert [tuple(r) for r in found[3]["removed"]] == [(0, 120)] and found[3]["n_removed"] == 120 and found[3]["kept"] == ""
    assert found[1]["removed"] == [] == found[None]["removed"] and found[None]["kept"] == a
    short = substrings.remove_repeats(docs, id="id", window=5)
    assert set(short.columns) == {"id", "text", "n_words", "repeats"}


def test_rows_that_repeat_an_id(spark):
    """Texts under one id don't remove from each other, and each is cut by its own windows."""
    a, b, c = [" ".join(f"{p}{i}" for i in range(60)) for p in "abc"]
    docs = spark.createDataFrame([(1, a), (5, f"{b} {a}"), (5, f"{b} {a}"), (5, f"x {a} {b}"), (5, c), (7, b)], "id long, text string")
    got = sorted((r["id"], r["repeats"]["kept"]) for r in substrings.remove_repeats(docs, id="id").collect())
    assert got == sorted([(1, a), (5, b), (5, b), (5, f"x {b}"), (5, c), (7, "")])


def test_a_passage_that_all_share_is_sent_once_a_batch(spark):
    """Copies combine before the shuffle: only the least document of each batch asks."""
    import pyarrow as pa

    passage = " ".join(f"w{i}" for i in range(80))
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "key": list(range(3000)), "text": [passage] * 3000})
    rows = [r for b in substrings._requests(50, 4)(iter([batch])) for r in b.to_pylist()]
    assert sum(len(r["hashes"]) for r in rows if r["hashes"] is not None) == 7 * 31
    docs = spark.range(4000).selectExpr("id", f"'{passage}' AS text").repartition(7)
    assert substrings.remove_repeats(docs, id="id", keep_text=False).where("repeats.n_removed = 0").select("id").collect()[0]["id"] == 0
    assert substrings.remove_repeats(docs, id="id").where("repeats.n_removed = 80").count() == 3999


def test_runs_against_all_distances():
    rng = random.Random(1)
    found = 0
    for _ in range(1500):
        least, n, w = rng.choice([3, 4, 6, 9, 24]), rng.randint(0, 90), []
        while len(w) < n:
            if w and rng.random() < 0.3:
                p = rng.randint(1, min(9, len(w)))
                for _ in range(rng.randint(1, 40)):
                    w.append(w[-p])
            elif w and rng.random() < 0.3:
                a = rng.randrange(len(w))
                w += w[a : a + rng.randint(1, 40)]
            else:
                w += [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(1, 5))]
        w = w[:n]
        want = brute.runs(w, least)
        found += len(want)
        assert periodic.find_runs(w, least) == want
        starts, sizes = periodic.stretches(scramble(np.array(w, np.uint64) + np.uint64(1)), np.array([0, n, 0]), least, 3)
        inside = [(a + s, m, q) for a, k in zip(starts.tolist(), sizes.tolist(), strict=True) for s, m, q in periodic.find_runs(w[a : a + k], least)]
        assert sorted(inside) == want
    assert found > 1000


def test_factors_are_longest_earlier_occurrences():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 50))]
        parts = periodic.factors(w)
        assert [a for a, _, _ in parts] == np.cumsum([0, *(n for _, n, _ in parts)])[:-1].tolist() and sum(n for _, n, _ in parts) == len(w)
        for a, n, source in parts:
            earlier = lambda m: any(w[k : k + m] == w[a : a + m] for k in range(a))  # noqa: B023, E731
            assert (source < 0 and n == 1 and w[a] not in w[:a]) or (source < a and w[source : source + n] == w[a : a + n] and (a + n == len(w) or not earlier(n + 1)))


def test_long_periods_and_long_texts(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(400)}" for _ in range(60_000)]
    w = w[:9000] + [w[9000 + k % 7000] for k in range(51_000)]
    docs = spark.createDataFrame([(1, " ".join(w), 7), (2, " ".join(["a"] * 100_000), 8), (3, " ".join(["a", "b"] * 12), 9), (4, " ".join(["a", "b"] * 11 + ["a"]), 9)], "id long, text string, n_words long")
    found = {r["id"]: r["periodic"] for r in periodic.find_periodic(docs).collect()}
    best = found[1]["strongest"]
    assert best["period"] == 7000 and best["start"] <= 9000 and best["start"] + best["length"] == 60_000
    assert tuple(found[2]["strongest"]) == (0, 100_000, 1) and found[2]["collapsed"] == "a"
    assert [tuple(r) for r in found[3]["runs"]] == [(0, 24, 2)] and found[3]["collapsed"] == "a b" and found[4]["runs"] == []
    with pytest.raises(ValueError):
        periodic.find_periodic(docs, times=2)


def test_units_give_the_tokens_of_whole_texts(texts):
    """Nothing is joined across the places where texts are cut, for random mixtures of white space and signs."""
    rng = random.Random(4)
    signs = ["a", "é", "’", "日", " ", " ", "　", "\u0085", " ", "  ", "\n", "\t", ".", "1", "▁", "don't", "​", "﻿", "İ", "ǅ"]
    mixed = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    coders = alignment.Encoders(f"{alignment.FOLDER}/{alignment.VOCABULARY_A}", f"{alignment.FOLDER}/{alignment.VOCABULARY_B}")
    for t in [*filter(None, texts), *mixed]:
        units, many = alignment.split_units([t.encode()])
        assert b"".join(units.to_pylist()) == b" " + t.encode() and many.tolist() == [len(units)]
        units = units.to_pylist()
        alone = [coders.encode(u) for u in units]
        whole = coders.a.encode(" " + t, add_special_tokens=False).ids, coders.b.encode(t)
        assert tuple(sum((u[side] for u in alone), []) for side in (0, 1)) == whole
        a, size_a, b, size_b, ok = coders.encode_all(units)
        kept = [u if o else ([], []) for u, o in zip(alone, ok.tolist(), strict=True)]
        assert (a.tolist(), b.tolist()) == tuple(sum((u[side] for u in kept), []) for side in (0, 1)) and size_a.tolist() == [len(u[0]) for u in kept] and size_b.tolist() == [len(u[1]) for u in kept]
        if ok.all():
            assert b"".join(coders.bytes_a[i] for i in a) == b"".join(coders.bytes_b[i] for i in b) == " ".encode() + t.encode()


def test_alignment_keeps_other_columns_and_small_slices_change_nothing(spark, words_dir, monkeypatch):
    docs = spark.read.parquet(f"{words_dir[0]}/documents.parquet").withColumn("n_best", F.lit("x")).withColumn("a.b", F.lit(1))
    whole = alignment.align(docs)
    assert whole.columns == ["doc_id", "n_best", "a.b", "alignment"]
    monkeypatch.setattr(alignment, "SLICE", 700)  # many slices: common pieces span several, and their counts go to all of these
    monkeypatch.setattr(alignment, "REMEMBERED", (50, 1000))
    monkeypatch.setattr(alignment, "STEP", 3000)
    small = alignment.align(docs)
    assert sorted(map(str, whole.collect())) == sorted(map(str, small.collect()))


def test_a_common_piece_spans_slices():
    plan = alignment.Plan({0: 10, 3: 980, 4: 10}, 10)
    parts = np.linspace(0, 1, 101)[:-1]
    assert set(plan.of(np.full(100, 3), parts).tolist()) == set(range(10)) and plan.of(np.array([0, 4]), 0.5).tolist() == [0, 9]
