"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped by workers.

Counting. A first pass counts words and gives each a number: words are cut into buckets by hash, and
frequent words of a bucket get small numbers. A second pass turns texts into these numbers and counts
n-grams of ``order`` words; a task combines what it has seen, cuts it into buckets by context and
shuffles it as packed columns. A bucket task sums its n-grams, stores them, stores for each context its
total and how many words followed it once, twice and more, and sends on the n-grams without their first
word, with the number of distinct first words: the continuation counts of the next shorter n-grams. So
each order follows from the one above, down to single words.

Storage. A model is a folder in the cluster's shared storage: for each order and bucket a file of sorted arrays
of the hashes of n-grams and of contexts beside arrays of their numbers. Workers memory-map them (a
store that is no file system is copied to the worker's own temporary folder first) and look hashes up
by binary search.

Model. With c(u w) the count of word w after context u (the continuation count below the highest
order), c(u) the context's total, u' the context without its first word, and D1, D2, D3 the modified
Kneser-Ney discounts of the order, from its counts of counts::

    P(w | u) = (c(u w) - D(c(u w))) / c(u) + g(u) * P(w | u')
    P(w)     = (N(w) - D(N(w))) / N + h / (V + 1)

where N(w) is the number of distinct words before w. P(w) is mixed with the uniform distribution over
the V training words and one unknown word, so that P sums to 1 over them. A context not seen in
training leaves the shorter one alone. Texts begin in ``order - 1`` start marks and end with an end
token, which is scored.

Defined results: a null text is empty and has the end token only; no token is dropped and texts are
read whole; repeated rows count and score repeatedly; without training rows every word is unknown,
P is uniform over one word and N and V are 0; extra columns pass through and columns with the names
of the results are replaced.

Scale: what is gathered grows with the distinct n-grams, as a model must. Buckets follow the size of
the text, about ``BUCKET_BYTES`` each, so that no task holds more than one of bounded size. A frequent
context costs no more than its distinct successors, since tasks combine n-grams before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.llm.common import MIX, ascii_words, column, delete_path, fresh_path, hash_words, map_batches, scramble, steps
from tidemark.llm.store import Bundle, HashArray, Recent, Sparse, Store

_U = np.uint64
ORDER = 3
END = _U(xxhash.xxh3_64_intdigest("</s> end of text"))
#: Numbers of the start mark, and of words that are not in the training texts.
START, UNKNOWN = _U(0), _U(0xFFFFFFFFFFFFFFFF)
#: Distinct n-grams (or words) that a counting task holds before it sends them on.
HELD = 1_500_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20

_CODEC = pa.Codec("zstd", compression_level=1)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(buckets)).astype(np.int64)


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams given by columns of word numbers, first word first."""
    h = scramble(words[0] + MIX)
    for w in words[1:]:
        h = longer_hash(h, w)
    return h


def longer_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of n-grams with hashes ``h`` and one more word ``w``."""
    return scramble(h * MIX + w)


def _pack(a: np.ndarray) -> bytes:
    """Non-negative numbers by their bytes, lowest first, compressed: small numbers cost little."""
    a = np.ascontiguousarray(a, _U)
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(a), width], np.int64).tobytes() + _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n, width = np.frombuffer(b, np.int64, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_CODEC.decompress(b[16:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    return out.view(_U).ravel()


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple:
    """(order, first of each distinct key in that order, summed counts)."""
    order = np.argsort(key)
    first = _runs(key[order])
    return (order, first, *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts))


def _one_by_one(batches):
    """Rows of record batches as dictionaries, one at a time."""
    return chain.from_iterable((b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)) for b in batches)


STATS_FIELDS = ("total", "kinds", "n1", "n2", "n3", "n4", "more")
STATS = ", ".join(["level int", *(f"{k} long" for k in STATS_FIELDS)])
BLOB = f"bucket int, data array<binary>, {STATS}"


def _blob(bucket: int, data: list[bytes]) -> pa.RecordBatch:
    return _batch(bucket, data, None, [None] * len(STATS_FIELDS))


def _statistics(level: int, counts: np.ndarray) -> pa.RecordBatch:
    """A row with what the discounts of a level need; it has no bucket and is passed on to the end."""
    numbers = [int(counts.sum()), len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 4).sum())]
    return _batch(-1, [], level, numbers)


def _batch(bucket: int, data: list[bytes], level: int | None, numbers: list) -> pa.RecordBatch:
    arrays = [pa.array([bucket], pa.int32()), pa.array([data], pa.list_(pa.binary())), pa.array([level], pa.int32()), *[pa.array([x], pa.int64()) for x in numbers]]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "data", "level", *STATS_FIELDS])


def _again(row: dict) -> pa.RecordBatch:
    return _batch(row["bucket"], row["data"], row["level"], [row[k] for k in STATS_FIELDS])


# Words


def _count_words(batches, text: str, buckets: int):
    """Blobs (hashes, counts) of a task's words, the end token among them."""
    held, size = [], 0

    def flush():
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, c = _summed(h, c)
        h = h[order][first]
        b = bucket_of(scramble(h), buckets)
        by = np.argsort(b, kind="stable")
        edges = np.flatnonzero(np.diff(b[by], prepend=-1, append=-2))
        for i, j in zip(edges, edges[1:], strict=False):
            at = by[i:j]
            yield _blob(int(b[at[0]]), [h[at].tobytes(), _pack(c[at])])

    for step in steps(batches, text):
        _, word, dictionary = ascii_words(step.column(text))
        h = np.append(hash_words(dictionary), END)
        c = np.append(np.bincount(word, minlength=len(dictionary)), step.num_rows)
        held.append((h[c > 0], c[c > 0]))
        size += len(held[-1][0])
        if size >= HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _store_words(path: str):
    """Store the words of each bucket with their counts and their ranks by count."""

    def run(batches):
        for bucket, rows in groupby(_one_by_one(batches), key=lambda r: r["bucket"]):
            parts = [(np.frombuffer(r["data"][0], _U), _unpack(r["data"][1]).astype(np.int64)) for r in rows]
            h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first, c = _summed(h, c)
            rank = np.empty(len(c), np.uint32)
            rank[np.lexsort((h[order][first], -c))] = np.arange(len(c))
            bundle = Bundle()
            bundle.put("words", h[order][first])
            bundle.put("ranks", rank)
            Sparse.put(bundle, "counts", c)
            bundle.save(Store(path), f"words-{bucket}")
            yield _statistics(0, c)

    return run


class Words:
    """Numbers and counts of words, by hash."""

    def __init__(self, path: str, buckets: int):
        self.store, self.buckets, self.maps = Store(path), buckets, Recent(self._bucket)

    def _bucket(self, b: int) -> tuple:
        found = Bundle.open(self.store, f"words-{b}")
        return found.get("words", _U), found.get("ranks", np.uint32), Sparse.get(found, "counts")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word; UNKNOWN and 0 if it is not in the training texts."""
        number, count = np.full(len(h), UNKNOWN), np.zeros(len(h), np.int64)
        for b, at in _by_bucket(bucket_of(scramble(h), self.buckets), h):
            words, ranks, counts = self.maps[b]
            if len(words):
                place = np.minimum(np.searchsorted(words, h[at]), len(words) - 1)
                hit = np.flatnonzero(words[place] == h[at])
                number[at[hit]] = ranks[place[hit]].astype(_U) * _U(self.buckets) + _U(b + 1)
                count[at[hit]] = counts[place[hit]]
        return number, count


def _by_bucket(bucket: np.ndarray, h: np.ndarray):
    """(bucket, positions of its hashes in ascending order) for each bucket."""
    order = np.argsort((bucket.astype(_U) << _U(44)) | (h >> _U(20)))
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
    for i, j in zip(edges, edges[1:], strict=False):
        yield int(bucket[order[i]]), order[i:j]


def _tokens(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word) of every token in order, an end token after the words of each row; (number, training count) of the words that occur."""
    row, word, dictionary = ascii_words(texts)
    number, count = words.find(np.append(hash_words(dictionary), END))
    n, end = len(texts), len(dictionary)
    sizes = np.bincount(row, minlength=n)
    token = np.full(len(row) + n, end)
    token[np.arange(len(row)) + row] = word
    return np.repeat(np.arange(n), sizes + 1), token, number, count


def _columns(row: np.ndarray, word: np.ndarray, order: int, start) -> list[np.ndarray]:
    """The words of the n-gram that ends in each token, first word first; start marks before a text."""
    out = [word]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(begins, np.diff(begins, append=len(row)))
    for k in range(1, order):
        w = np.full_like(word, start)
        inside = np.flatnonzero(place >= k)
        w[inside] = word[inside - k]
        out.insert(0, w)
    return out


# n-grams


def _grams(words: list[np.ndarray], counts: np.ndarray, buckets: int):
    """Blobs (sizes, context words, last words, counts) of n-grams, for each bucket by context."""
    context = gram_hash(words[:-1])
    bucket = bucket_of(context, buckets)
    order = np.argsort((bucket.astype(_U) << _U(44)) | (context >> _U(20)))
    b, h = bucket[order], context[order]
    edges = np.flatnonzero(np.diff(b, prepend=-1, append=-2))
    for i, j in zip(edges, edges[1:], strict=False):
        at, first = order[i:j], _runs(h[i:j])
        sizes = np.diff(first, append=j - i)
        yield _blob(int(b[i]), [_pack(sizes), *(_pack(w[at[first]]) for w in words[:-1]), _pack(words[-1][at]), _pack(counts[at])])


def _count_grams(batches, text: str, path: str, buckets: int, order: int):
    words = Words(path, buckets)
    held, size = [], 0

    def flush():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        at, first, c = _summed(gram_hash(cols[:-1]), cols[-1])
        yield from _grams([w[at[first]] for w in cols[:-1]], c, buckets)

    for step in steps(batches, text):
        row, word, number, _ = _tokens(step.column(text), words)
        cols = _columns(row, number[word], order, START)
        at, first, c = _summed(gram_hash(cols), np.ones(len(word), np.int64))
        held.append((*(w[at[first]] for w in cols), c))
        size += len(c)
        if size >= HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _put_contexts(bundle: Bundle, context: np.ndarray, numbers: np.ndarray) -> None:
    """Contexts (sorted hashes) and four numbers each: one byte for the most frequent sets of numbers, others listed."""
    HashArray.put(bundle, "contexts", context)
    small = (numbers < 1 << 16).all(1)
    packed = (numbers[small].astype(_U) << (_U(16) * np.arange(4, dtype=_U))).sum(1, dtype=_U)
    sets, which, times = np.unique(packed, return_inverse=True, return_counts=True)
    top = np.argsort(-times, kind="stable")[:255]
    code_of = np.full(len(sets), 255, np.uint8)
    code_of[top] = np.arange(len(top))
    code = np.full(len(numbers), 255, np.uint8)
    code[small] = code_of[which]
    rest = np.flatnonzero(code == 255)
    bundle.put("codes", code)
    bundle.put("sets", (sets[top][:, None] >> (_U(16) * np.arange(4, dtype=_U)) & _U(0xFFFF)).astype(np.int64).ravel())
    bundle.put("rest", np.concatenate([rest[:, None], numbers[rest]], 1).astype(np.int64).ravel())


def _merged(parts: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(sorted hashes, words, counts) of the distinct n-grams of all parts."""
    *words, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    h = gram_hash(words)
    order, first, c = _summed(h, c)
    at = order[first]
    return h[at], [w[at] for w in words], c


#: N-grams of one bucket that are held before equal ones are summed.
MERGE = 4_000_000


def _store_grams(path: str, level: int, buckets: int):
    """Store the n-grams of each bucket; send on their ends of one word less, with how many first words each has."""

    def run(batches):
        for bucket, rows in groupby(_one_by_one(batches), key=lambda r: r["bucket"]):
            if bucket < 0:
                yield from map(_again, rows)
                continue
            parts, held, limit = [], 0, MERGE
            for r in rows:
                sizes, *words, last, counts = (_unpack(d) for d in r["data"])
                sizes = sizes.astype(np.int64)
                parts.append((*(np.repeat(w, sizes) for w in words), last, counts.astype(np.int64)))
                held += len(last)
                if held > limit:  # what tasks sent alike is summed on the way, so no more than twice the distinct n-grams are held
                    h, words, c = _merged(parts)
                    parts, held, limit = [(*words, c)], len(c), max(MERGE, 2 * len(c))
            h, words, c = _merged(parts)
            del parts
            bundle = Bundle()
            HashArray.put(bundle, "grams", h)
            Sparse.put(bundle, "counts", c)
            yield _statistics(level, c)
            context = gram_hash(words[:-1])
            kinds = [c, *((c == k).astype(np.int64) for k in (1, 2)), (c > 2).astype(np.int64)]
            order, first, *numbers = _summed(context, *kinds)
            _put_contexts(bundle, context[order][first], np.stack(numbers, 1))
            bundle.save(Store(path), f"grams-{level}-{bucket}")
            del bundle, h, context, numbers
            ends = words[1:]
            order, first, k = _summed(gram_hash(ends), np.ones(len(c), np.int64))
            ends = [w[order[first]] for w in ends]
            if level > 2:
                yield from _grams(ends, k, buckets)
            else:
                owner = ((ends[0] - _U(1)) % _U(buckets)).astype(np.int64)
                by = np.argsort(owner, kind="stable")
                edges = np.flatnonzero(np.diff(owner[by], prepend=-1, append=-2))
                for i, j in zip(edges, edges[1:], strict=False):
                    yield _blob(int(owner[by[i]]), [_pack((ends[0][by[i:j]] - _U(1)) // _U(buckets)), _pack(k[by[i:j]])])

    return run


def _store_continuations(path: str):
    """Store, by rank, how many words come before each word."""

    def run(batches):
        for bucket, rows in groupby(_one_by_one(batches), key=lambda r: r["bucket"]):
            if bucket < 0:
                yield from map(_again, rows)
                continue
            rank, k = (np.concatenate(x) for x in zip(*((_unpack(r["data"][0]).astype(np.int64), _unpack(r["data"][1]).astype(np.int64)) for r in rows), strict=True))
            total = np.bincount(rank, k).astype(np.int64)
            bundle = Bundle()
            Sparse.put(bundle, "before", total)
            bundle.save(Store(path), f"continuations-{bucket}")
            yield _statistics(1, total[total > 0])

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that all buckets share; ``discounts`` and ``ones`` by level from 1."""

    path: str
    buckets: int
    order: int
    tokens: int
    types: int
    discounts: tuple[tuple[float, float, float], ...]
    lower_total: int
    lower_ones: tuple[int, int, int]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from n1 to n4, the numbers of things that occur once to four times.

    Where the counts of counts do not determine a discount between 0 and its count, half is used.
    """
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(d) if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


def train(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int | None = None) -> Model:
    """Count all texts of ``docs`` and store a model of n-grams of ``order`` words (2 or more)."""
    if order < 2:
        raise ValueError("a model has n-grams of two words or more")
    spark = docs.sparkSession
    docs = docs.select(column(text).alias("text"))
    path = fresh_path(spark, "lm")
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    n = buckets

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket")

    def numbers(df: DataFrame) -> dict[int, list[int]]:
        rows = df.where("level IS NOT NULL").groupBy("level").agg(*[F.sum(k) for k in STATS_FIELDS]).collect()
        return {r[0]: [int(x) for x in r[1:]] for r in rows}

    counted = docs.mapInArrow(lambda it: _count_words(it, "text", n), BLOB)
    tokens, types = numbers(by_bucket(counted).mapInArrow(_store_words(path), BLOB)).get(0, [0, 0])[:2]
    grams = docs.mapInArrow(lambda it: _count_grams(it, "text", path, n, order), BLOB)
    for level in range(order, 1, -1):
        grams = by_bucket(grams).mapInArrow(_store_grams(path, level, n), BLOB)
    by = numbers(by_bucket(grams).mapInArrow(_store_continuations(path), BLOB))
    of = lambda level: by.get(level, [0] * len(STATS_FIELDS))
    lowest = of(1)
    return Model(path, n, order, tokens, types, tuple(discounts(of(k)[2:]) for k in range(1, order + 1)), lowest[0], (lowest[2], lowest[3], sum(lowest[4:])))


class Reader:
    """Probabilities from the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m, self.store = model, Store(model.path)
        #: A mapped file, and what was made of its arrays so far.
        self.maps = Recent(lambda file: (Bundle.open(self.store, file), {}))
        self.words = Words(model.path, model.buckets)

    def _of(self, file: str, name: str, kind):
        bundle, made = self.maps[file]
        if name not in made:
            made[name] = kind.get(bundle, name)
        return made[name]

    def _contexts(self, level: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, what discounts take off in all) of each context; 0 where a context is not stored."""
        total, off, d = np.zeros(len(h), np.int64), np.zeros(len(h)), np.array(self.m.discounts[level - 1])
        for b, at in _by_bucket(bucket_of(h, self.m.buckets), h):
            file = f"grams-{level}-{b}"
            found = self._of(file, "contexts", HashArray).find(h[at])
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                (bundle, made), place = self.maps[file], found[hit]
                if "totals" not in made:
                    sets = bundle.get("sets", np.int64).reshape(-1, 4)
                    made["totals"], made["off"] = np.zeros(256, np.int64), np.zeros(256)
                    made["totals"][: len(sets)], made["off"][: len(sets)] = sets[:, 0], sets[:, 1:] @ d
                code = bundle.get("codes", np.uint8)[place]
                totals, offs, listed = made["totals"][code], made["off"][code], np.flatnonzero(code == 255)
                if len(listed):
                    rest = bundle.get("rest", np.int64).reshape(-1, 5)
                    numbers = rest[np.searchsorted(rest[:, 0], place[listed])]
                    totals[listed], offs[listed] = numbers[:, 1], numbers[:, 2:] @ d
                total[at[hit]], off[at[hit]] = totals, offs
        return total, off

    def _counts(self, level: int, context: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for b, at in _by_bucket(bucket_of(context, self.m.buckets), h):
            file = f"grams-{level}-{b}"
            found = self._of(file, "grams", HashArray).find(h[at])
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                out[at[hit]] = self._of(file, "counts", Sparse)[found[hit]]
        return out

    def _lowest(self, number: np.ndarray) -> np.ndarray:
        """P(w) without context, for words by number (no start mark)."""
        m = self.m
        if not m.lower_total:
            return np.ones(len(number))
        k = np.zeros(len(number), np.int64)
        known = np.flatnonzero(number != UNKNOWN)
        owner = ((number[known] - _U(1)) % _U(m.buckets)).astype(np.int64)
        rank = ((number[known] - _U(1)) // _U(m.buckets)).astype(np.int64)
        for b, at in _by_bucket(owner, number[known]):
            k[known[at]] = self._of(f"continuations-{b}", "before", Sparse)[rank[at]]
        d = np.array([0.0, *m.discounts[0]])
        rest = float(np.dot(d[1:], m.lower_ones)) / m.lower_total
        return (k - d[np.minimum(k, 3)]) / m.lower_total + rest / (m.types + 1)

    def probabilities(self, number: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(token | words before) for every token; ``word`` tells which of the words, given by ``number``, it is.

        What depends on one word alone is computed once for each word that occurs.
        """
        m, end = self.m, len(number)
        words = _columns(row, word, m.order, end)
        p = self._lowest(number)[word]
        number = np.append(number, START)
        known, first = number != UNKNOWN, gram_hash([number])
        for level in range(2, m.order + 1):
            before = words[-level:-1]
            if level == 2:
                total, off = self._contexts(level, first)
                total[~known] = 0
                context, total, off = (x[before[0]] for x in (first, total, off))
            else:
                context = first[before[0]]
                for w in before[1:]:
                    context = longer_hash(context, number[w])
                total, off = self._contexts(level, context)
                for w in before:
                    total[~known[w]] = 0
            seen = np.flatnonzero(total)
            total, count = total[seen], np.zeros(len(seen), np.int64)
            whole = np.flatnonzero(known[word[seen]])
            at = seen[whole]
            count[whole] = self._counts(level, context[at], longer_hash(context[at], number[word[at]]))
            d = np.array([0.0, *m.discounts[level - 1]])
            p[seen] = (count - d[np.minimum(count, 3)]) / total + off[seen] / total * p[seen]
        return p

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, model score) of each text."""
        m, n = self.m, len(texts)
        row, word, number, c = _tokens(texts, self.words)
        p = self.probabilities(number, row, word)
        base = np.log10((c + 1.0) / (m.tokens + 1.0 * (m.types + 1)))[word]
        return np.bincount(row, minlength=n), np.bincount(row, (c > 0)[word], n).astype(np.int64), np.bincount(row, base, n), np.bincount(row, np.log10(p), n)


RESULT = ("n_tokens", "n_known", "base_score", "score", "perplexity")


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with n_tokens, n_known, base_score, score (log10) and perplexity."""
    docs = docs.drop(*RESULT)
    schema = StructType([*docs.schema.fields, *[StructField(k, LongType() if k.startswith("n_") else DoubleType()) for k in RESULT]])

    def run(batches):
        reader = Reader(model)
        for step in steps(batches, text):
            size, known, base, score = reader.score(step.column(text))
            made = (size, known, base, score, 10.0 ** (-score / size))
            yield pa.RecordBatch.from_arrays([*step.columns, *[pa.array(x) for x in made]], names=[*step.schema.names, *RESULT])

    return map_batches(docs, run, schema)


def delete(spark: SparkSession, model: Model) -> None:
    delete_path(spark, model.path)
