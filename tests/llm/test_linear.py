"""Long texts of one or two signs: no pattern takes more than linear time."""

import itertools
import re
import time

import pytest

from tidemark.llm import pii, secrets

SIGNS = ("A", "a", "1", ".", "@", " ", "'", "-", "+", "[at]", "(", "É", "_", "Ab'", "\n", "mr ", "Mr ", "://")


def _seconds(text):
    began = time.process_time()
    pii.more_spans(text, pii.base_spans(text))
    return time.process_time() - began


@pytest.mark.parametrize("first", SIGNS)
def test_personal_data(first):
    for second in ("", *SIGNS):
        sign = first + second
        times = [min(_seconds(sign * (n // len(sign))) for _ in range(2)) for n in (50_000, 100_000)]
        assert times[1] < 2 and times[1] <= 2.5 * times[0] + 0.05, (sign, times)


def test_names_begin_where_they_did():
    """Words are tried at their beginning alone, and names within them are still found."""
    plain = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'-]*\.?(?: [A-ZÀ-ÖØ-Þ][\w'-]+)+")
    for parts in itertools.product(("A", "b", "É", "'", "-", " ", ".", "Anna"), repeat=5):
        text = "".join(parts)
        assert [m.span() for m in plain.finditer(text)] == [m.span(1) for m in pii._CAPITALS.finditer(text)]


def test_a_long_run_passes_the_stage(spark):
    docs = spark.createDataFrame([(1, "A" * 200_000, 1), (2, "Ab'" * 60_000, 2), (3, "Mr. Adam Smith, a.b@c.de", 3)], "doc_id long, text string, n_chars long")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs, length="n_chars").collect()}
    assert got[1] == "A" * 200_000 and "@" not in got[3] and time.time() - began < 60


def test_secrets(spark):
    texts = [s * (100_000 // len(s)) for s in ("eyJ", "eyJa.", "A", "password", "token ", "0", "-----BEGIN A", "xoxa-", "ghp_", "bearer ", "a://b:")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    assert secrets.update_ledger(docs).count() == len(texts) * len(secrets.RULES) and time.time() - began < 60


def test_web_tokens_start_a_word(spark):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    docs = spark.createDataFrame([(1, f"x {jwt}"), (2, f"x{jwt}"), (3, f"={jwt}")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["findings"]] for r in secrets.findings(docs, secrets.update_ledger(docs), "doc_id").collect()}
    assert found[1] == [("jwt", 2)] and found[2] == [] and found[3] == [("jwt", 1)]
