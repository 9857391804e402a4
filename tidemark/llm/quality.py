"""Quality classifier: a weak-label model trains a hashed linear scorer.

Overlapping heuristic labellers look at a whole document and vote good, bad or abstain. Votes are
counted by pattern over all documents; there are at most ``3 ** labellers`` patterns, so the counts
fit the driver whatever the input. Expectation-maximisation for a two-class model with conditionally
independent labellers estimates the prior, each labeller's accuracy and each pattern's posterior.
The posteriors are the training labels of a logistic scorer over hashed features (word shapes
with their logarithmic counts, the measures of the labellers and the length, no vocabulary), fitted on ``TRAIN_ROWS`` distinct texts at
most, drawn by hash. The scorer alone decides: a document below ``THRESHOLD`` is rejected.

Defined results: a null, empty or blank text scores 0 and is rejected; texts are read whole, whatever
their length; repeated rows and equal texts have equal scores; an empty table gives no rows; if all
posteriors are on one side the scorer follows the prior; other columns pass through, a column with
the name of the result is replaced.

Scale: two scans, no shuffle but that of the pattern counts. Training touches a bounded sample; the
model is a vector of ``2 ** HASH_BITS`` weights, which is broadcast.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_struct, column, columns, free_name

HASH_BITS = 14
TRAIN_ROWS = 12_000
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "repeats", "separators", "sentences", "variety")

_MARKS = re.compile(r"[^\w\s.,;:'\"()?!-]")
_ENDS = tuple(mark + gap for mark in ".!?" for gap in (" ", "\n", "\r", "\t"))
_SEPARATORS = pa.array(["|", "-", "•", "*", "::", "/"])
#: Letters and digits as one sign each, over the Latin blocks; other characters stay as they are.
_SIGNS = {i: "X" if chr(i).isupper() else "x" if chr(i).isalpha() else "9" for i in range(0x250) if chr(i).isalnum()}


MEASURES = ("marks", "capitals", "repeats", "separators", "ends", "variety")


@dataclass
class Look:
    """What the labellers and the features are made of, for a batch of texts.

    Words are numbered once in a batch, so what concerns a word is computed for each different one; counts by
    text are sums over arrays.
    """

    n: np.ndarray  # words of each text
    measures: np.ndarray  # (texts, MEASURES)
    text: np.ndarray  # of each word, the text
    word: np.ndarray  # of each word, its number
    words: pa.Array  # by number


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def look(texts: pa.Array) -> Look:
    m = len(texts)
    split = pc.utf8_split_whitespace(texts)
    text = np.repeat(np.arange(m), np.diff(split.offsets.to_numpy()))
    word, words = _numbered(split.flatten())
    blank = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))  # before the first and after the last word
    if len(blank):
        text, word = text[word != blank[0]], word[word != blank[0]]
    n = np.bincount(text, minlength=m)
    low = _numbered(pc.utf8_lower(words))[0][word]
    of_word = lambda found: np.bincount(text, found.to_numpy(zero_copy_only=False)[word], m)
    inside = np.flatnonzero(text[1:] == text[:-1])
    first, after, own = low[inside], low[inside + 1], text[inside]
    size, plain = np.maximum(n, 1), texts.to_pylist()
    marks = np.fromiter((len(_MARKS.findall(t)) + t.count("!!") + t.count("??") for t in plain), float, m)
    ends = np.fromiter((sum(map(t.count, _ENDS)) + t.endswith((".", "!", "?")) for t in plain), float, m)
    return Look(
        n,
        np.stack([
            marks / size, of_word(pc.utf8_is_upper(words)) / size, np.bincount(own[first == after], minlength=m) / size, of_word(pc.is_in(words, _SEPARATORS)) / size,
            ends / size, _distinct_pairs(own, first, after, m, len(words)) / np.maximum(n - 1, 1),
        ], 1),
        text, word, words,
    )


def _distinct_pairs(text: np.ndarray, first: np.ndarray, after: np.ndarray, m: int, words: int) -> np.ndarray:
    """How many different pairs each text has."""
    bits = max(1, words - 1).bit_length()
    if max(1, m - 1).bit_length() + 2 * bits <= 63:
        key = np.unique(text << 2 * bits | first << bits | after)
        return np.bincount(key >> 2 * bits, minlength=m)
    order = np.lexsort((after, first, text))
    t, a, b = text[order], first[order], after[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(t) else np.empty(0, bool)
    return np.bincount(t[new], minlength=m)


def vote(x: Look) -> np.ndarray:
    """(texts, LABELLERS): -1 bad, 0 abstain, 1 good."""
    marks, capitals, repeats, separators, ends, variety = x.measures.T
    long = x.n >= 8
    votes = np.stack([
        -(marks >= 0.1).astype(int), -(capitals >= 0.25).astype(int), -(repeats >= 0.1).astype(int), -(separators >= 0.08).astype(int),
        np.where(long, np.where((ends >= 0.02) & (ends <= 0.5), 1, -1), 0), np.where(long, np.where(variety >= 0.8, 1, np.where(variety < 0.5, -1, 0)), 0),
    ], 1)
    votes[x.n == 0] = -1
    return votes


@lru_cache(maxsize=200_000)
def _slot(name: str) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h >> (32 - HASH_BITS), 1.0 if h & 1 else -1.0


def _shapes(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Of each word the number of its shape, and the shapes: the first and the last three characters, with one
    sign for all small letters, capitals and digits."""
    word, ends = _numbered(pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 1), pc.utf8_slice_codeunits(words, -3), ""))
    end, shapes = _numbered(pa.array([x.translate(_SIGNS) for x in ends.to_pylist()], pa.string()))
    return end[word], shapes.to_pylist()


def _slots(names) -> tuple[np.ndarray, np.ndarray]:
    found = [_slot(x) for x in names]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found])


def features(x: Look) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of the hashed features, by text and slot; the values of a text have norm 1."""
    m, size = len(x.n), np.maximum(x.n, 1)
    of_word, shapes = _shapes(x.words)
    key, count = np.unique(x.text * max(1, len(shapes)) + of_word[x.word], return_counts=True)
    at, which = np.divmod(key, max(1, len(shapes)))
    slot, sign = _slots(f"w {k}" for k in shapes)
    parts = [(at, slot[which], sign[which] * np.log2(1 + 64 * count / size[at]))] if len(shapes) else []
    every = np.arange(m)
    for i, name in enumerate(MEASURES):
        v = x.measures[:, i]
        slot, sign = _slots(f"s {name} {k}" for k in range(21))
        step = np.minimum(20, (v * 20).astype(int))
        parts.append((every, slot[step], sign[step]))
        (slot,), (sign,) = _slots([f"v {name}"])
        parts.append((every, np.full(m, slot), sign * np.log2(1 + 64 * np.minimum(v, 4.0))))
    slot, sign = _slots(f"n {k}" for k in range(64))
    length = np.log2(size).astype(int)
    parts.append((every, slot[length], sign[length]))
    text, slot, value = (np.concatenate(p) for p in zip(*parts, strict=True))
    key, which = np.unique(text << HASH_BITS | slot, return_inverse=True)
    value = np.bincount(which, value, len(key))
    text, slot = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
    return text, slot, value / np.maximum(1e-9, np.sqrt(np.bincount(text, value * value, m)))[text]


@dataclass(frozen=True)
class LabelModel:
    prior: float
    accuracy: tuple[float, ...]
    posterior: dict[tuple[int, ...], float]


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100) -> LabelModel:
    """EM with a separate hit rate of each labeller on good and on bad documents."""
    m = len(LABELLERS)
    if not counts:
        return LabelModel(0.5, (0.5,) * m, {})
    v = np.array(sorted(counts), dtype=float)
    n = np.array([counts[tuple(int(a) for a in row)] for row in v], dtype=float)
    prior = 0.8
    table = np.empty((2, m, 3))  # class, labeller, vote + 1
    table[1], table[0] = (0.05, 0.35, 0.6), (0.4, 0.3, 0.3)
    votes = v.astype(int) + 1
    silent = (v == 0).all(1)  # no labeller voted, so there is no evidence beyond the prior
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        score = [np.log(p) + np.log(table[c][np.arange(m), votes]).sum(1) for c, p in ((0, 1 - prior), (1, prior))]
        post = np.where(silent, prior, 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60))))
        prior = float(np.clip((post @ n + 8) / (n.sum() + 10), 0.02, 0.98))
        for c, weight in ((0, (1 - post) * n), (1, post * n)):
            for value in range(3):
                table[c, :, value] = (weight[:, None] * (votes == value)).sum(0) + (2.0 if value == 2 * c else 0.5)
            table[c] /= table[c].sum(1, keepdims=True)
    right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
    wrong = prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
    return LabelModel(prior, tuple(right / (right + wrong)), {tuple(int(a) for a in row): float(p) for row, p in zip(v, post, strict=True)})


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: Look) -> np.ndarray:
        text, slot, value = features(x)
        z = np.bincount(text, self.weights[slot] * value, len(x.n)) + self.bias
        return np.where(x.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], prior: float, epochs: int = 30) -> Scorer:
    """Logistic regression by AdaGrad over mini-batches in a fixed order; classes weigh the same."""
    w, b = np.zeros(1 << HASH_BITS), float(np.log(prior / (1 - prior))) if not rows else 0.0
    if not rows:
        return Scorer(w, b)
    y = np.array([r[2] for r in rows])
    lengths = np.array([len(r[0]) for r in rows])
    starts = np.cumsum(lengths) - lengths
    slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    bad = max(1e-9, float((1 - y).mean()))
    weight = np.where(y < 0.5, 0.5 / max(bad, 0.02), 0.5 / max(1 - bad, 0.02))
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            at = np.repeat(starts[part] - np.cumsum(lengths[part]) + lengths[part], lengths[part]) + np.arange(lengths[part].sum())
            doc = np.repeat(np.arange(len(part)), lengths[part])
            s, x = slots[at], values[at]
            z = np.bincount(doc, w[s] * x, len(part)) + b
            e = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part])
            g = np.bincount(s, x * e[doc], len(w)) / len(part) + 1e-5 * w
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
            gb = float(e.mean())
            gb2 += gb * gb
            b -= 0.5 * gb / np.sqrt(gb2)
    return Scorer(w, float(b))


VOTES = "votes array<int>, slots array<long>, values array<double>"
QUALITY = "score double, keep boolean, votes array<int>, posterior double"


def _texts(a: pa.Array) -> pa.Array:
    return pc.fill_null(a, "")


def train(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, Scorer]:
    """The label model from the votes of all documents and the scorer from a bounded sample of them."""
    docs = docs.select(column(text).alias("t"))
    text = "t"
    seen = append_struct(docs, text, "__q", "votes array<int>", lambda: lambda a: [{"votes": v} for v in vote(look(_texts(a))).tolist()])
    counts = {tuple(r["votes"]): r["count"] for r in seen.groupBy("__q.votes").count().collect()}
    labels = estimate(counts)
    total = sum(counts.values())
    # Twice the wanted share is drawn, since copies of a text share its hash and count once (a hot group of
    # copies can't fill the sample), and of these the first ``train_rows`` in the order of the hash.
    share = min(1.0, 2 * train_rows / max(1, total))
    h = F.xxhash64(text, F.lit(5))
    drawn = docs.where(F.length(F.trim(text)) > 0).select(text, h.alias("h")).where(F.col("h") / 2.0**64 + 0.5 <= share)

    def rows_of(a) -> list[dict]:
        x = look(_texts(a))
        at, slot, value = features(x)
        edges = np.searchsorted(at, np.arange(len(x.n) + 1)).tolist()
        return [{"votes": v, "slots": slot[i:j].tolist(), "values": value[i:j].tolist()} for v, i, j in zip(vote(x).tolist(), edges, edges[1:], strict=False)]

    sample = append_struct(drawn, text, "__q", VOTES, lambda: rows_of)
    sample = sample.groupBy("h").agg(F.first("__q").alias("q")).orderBy("h").limit(train_rows).select("q.*").collect()
    rows = sorted(((tuple(r["slots"]), tuple(r["values"]), labels.posterior[tuple(r["votes"])]) for r in sample))
    return labels, fit([(np.array(s, dtype=np.int64), np.array(v), p) for s, v, p in rows], labels.prior)


def score_quality(docs: DataFrame, text: str = "text", out: str = "quality", models: tuple[LabelModel, Scorer] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with ``out``: score, keep, the labellers' votes and the label model's posterior."""
    labels, scorer = models or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((labels.posterior, scorer))

    def kernel():
        posterior, model = shared.value

        def rows_of(a) -> list[dict]:
            x = look(_texts(a))
            return [{"score": s, "keep": s >= threshold, "votes": v, "posterior": posterior.get(tuple(v))} for v, s in zip(vote(x).tolist(), model.score(x).tolist(), strict=True)]

        return rows_of

    return append_struct(docs, text, out, QUALITY, kernel)


def keep_good(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that the scorer accepts, with their columns."""
    name = free_name(docs, "__quality")
    return score_quality(docs, text, name, **options).where(F.col(f"{name}.keep")).select(*columns(docs))
