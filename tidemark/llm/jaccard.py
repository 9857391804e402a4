"""N-gram Jaccard join: multiple-global-order filtering on sets of five-word shingles.

Documents with equal sets are one class. Two classes link when their sets' Jaccard similarity is at
least ``PERCENT`` / 100. If so, their prefixes (the first ``n - ceil(0.8 n) + 1`` tokens of a set)
share a token under *every* global token order. Several orders are used:

1. An index of prefix tokens under the first order, shuffled by token, joins classes into candidate
   neighbourhoods. For each token only its neighbours in size are joined, one edge for each class,
   never all pairs; connected components of these edges hold every possible link.
2. Within a neighbourhood, candidates must share prefix tokens under all orders (the filters are
   intersected) and have sizes that allow the link.
3. What remains is verified exactly on the whole sets, except for pairs that verified links already
   connect, which cannot change the components.

All orders put rare tokens first, so that near copies meet through what only they share and not through
passages that many documents share. How many sets hold a token is read from a table of counters (one
byte, up to 255) with about two for each token of the corpus. Tokens that share a counter look more
frequent than they are, which only moves them back in the orders and never changes the result. The
table is built in ranges, stored in the shared folder and memory-mapped. Tokens of a single set are
left out of the index, since nothing can be shared through them.
Neighbourhoods of more than ``BLOCK``
classes or ``BLOCK_TOKENS`` tokens are cut into blocks, every pair of blocks being a task of its own, so that no task holds more
than two blocks however large a group of copies is and however long they are. The index is cut into buckets by
the text's size, of which a task holds one at a time.

Defined results: a null, empty or blank text has no shingles, links with nothing and is its own
component; a text of fewer than five words has its word sequence as one shingle; repeated rows and
equal texts are in one class; texts are read whole; rows without an id link like all others but name no
component, and if no row of a component has an id its name is null; an empty table gives no rows; extra
columns are ignored.

Tokens are 64-bit hashes and classes 64-bit sums of hashes; two different sets of ``N`` classes agree
by chance with a probability of about ``N * N / 2 ** 65``.
"""

from __future__ import annotations

from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import MIX, append_struct, ascii_words, column, columns, delete_path, discard, free_name, fresh_path, hash_words, lookup, materialize, scramble, steps
from tidemark.llm.graph import components
from tidemark.llm.store import Recent, Store

WORDS = 5
PERCENT = 80
ORDERS = 3
BLOCK = 1024
#: Tokens of a block, which take some 40 bytes each in the task that verifies it.
BLOCK_TOKENS = 2 << 20
#: Characters of text for each bucket of the index.
BUCKET_CHARS = 32 << 20
#: The filter that says which documents' sets are wanted is cut into files of 2 ** FILTER_RANGE bits (1 MB).
FILTER_RANGE = 23
#: Most rows (of about 40 bytes) of the wanted classes that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Tokens that a task gathers before it sends them on.
CHUNK = 4_000_000
#: Characters of text for each counter of the table of token counts.
CHARS_PER_COUNTER = 4

_U = np.uint64
_SEEDS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0))
#: Keys from here on are of tokens that two sets or more may hold.
_SHARED = _U(2 << 56)
_PACKED = _U(0xFFFFFFFFFFFF0000)
#: Odd factors, one for each place of a word in a shingle.
_FACTORS = scramble(np.arange(1, WORDS + 1, dtype=_U)) | _U(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle occurrence, by row."""
    row, word, dictionary = ascii_words(texts)
    if not len(row):
        return row, np.empty(0, _U)
    h = hash_words(dictionary)[word]
    n = len(h)
    total = np.zeros(n, _U)
    for k, factor in enumerate(_FACTORS):
        total[: max(0, n - k)] += h[k:] * factor
    size = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(size)
    whole = np.arange(n) + WORDS <= ends[row]
    out_row, out = row[whole], scramble(total[whole])
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        made = []
        for r in short:
            x = np.array([size[r]], _U)
            for w in h[ends[r] - size[r] : ends[r]]:
                x = scramble(x * MIX + w)
            made.append(x[0])
        out_row, out = np.concatenate([out_row, short]), np.concatenate([out, np.array(made, _U)])
        order = np.argsort(out_row, kind="stable")
        out_row, out = out_row[order], out[order]
    return out_row, out


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted by both."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    if not len(row):
        return row, key
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    return row[first], key[first]


def _classes(row: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, size) of each of n texts from their distinct tokens; class 0 for none."""
    size = np.bincount(row, minlength=n)
    mixed = scramble(token ^ _SEEDS[2])
    ends = np.cumsum(size)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
    fp = scramble(sums[ends] - sums[ends - size] + size.astype(_U)) | _U(1)
    return np.where(size > 0, fp, _U(0)).view(np.int64), size


class Order:
    """Keys of tokens under several global orders: rare tokens first, then by a hash of each order."""

    def __init__(self, counts):
        """``counts``: a function from tokens to how many sets hold each, up to 255."""
        self.counts = counts

    def keys(self, token: np.ndarray, order: int) -> np.ndarray:
        return (scramble(token ^ _SEEDS[order]) >> _U(8)) | (self.counts(token).astype(_U) << _U(56))


def _position(token: np.ndarray, bits: int) -> np.ndarray:
    """The counter of a token, from the part of it that travels with sets."""
    return (scramble(token & _PACKED) >> _U(64 - bits)).astype(np.int64)


class Counts:
    """The table of token counts: ranges of positions, each a mapped file."""

    def __init__(self, path: str, bits: int, ranges: int):
        self.store, self.bits, self.ranges, self.maps = Store(path), bits, ranges, Recent(self._range)

    def _range(self, k: int) -> np.ndarray:
        there = self.store.fs.get_file_info(f"{self.store.root}/{k}").type == pafs.FileType.File
        return self.store.get(str(k), np.uint8) if there else np.zeros((1 << self.bits) // self.ranges, np.uint8)

    def __call__(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.uint8)
        p = _position(token, self.bits)
        width = (1 << self.bits) // self.ranges
        order = np.argsort(p)
        edges = np.searchsorted(p[order], np.arange(self.ranges + 1) * width)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[k] : edges[k + 1]]
            out[at] = self.maps[k][p[at] - k * width]
        return out


def _pack_steps(d: np.ndarray) -> bytes:
    """Differences of sorted numbers in 1, 2 or 4 bytes each, with the rare larger ones listed after."""
    kind = np.uint8 if d.mean() < 100 else np.uint16 if d.mean() < 20_000 else np.uint32
    top = np.iinfo(kind).max
    big = np.flatnonzero(d >= top)
    return b"".join([np.array([len(d), kind().itemsize], np.int64).tobytes(), np.minimum(d, top).astype(kind).tobytes(), big.astype(np.int64).tobytes(), d[big].astype(np.int64).tobytes()])


def _unpack_steps(b: bytes) -> np.ndarray:
    n, size = np.frombuffer(b, np.int64, 2).tolist()
    d = np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32}[size], n, 16).astype(np.int64)
    at, value = np.frombuffer(b[16 + n * size :], np.int64).reshape(2, -1)
    d[at] = value
    return d


def prefix(n):
    """How many of a set's n tokens are its prefix; works on arrays."""
    return n - (n * PERCENT + 99) // 100 + 1


def _profile(docs: DataFrame, id_column: str, text: str, bits: int, ranges: int) -> DataFrame:
    """A row (id, fp, n) for each document, and rows (range, blob) with sorted positions of tokens."""
    id_type = docs.schema[id_column].dataType
    schema = StructType([StructField("id", id_type), *StructType.fromDDL("fp long, n long, range int, blob binary").fields])

    def run(batches):
        held, size, seen = [], 0, set()
        width = (1 << bits) // ranges

        def positions(id_arrow):
            p = np.sort(np.concatenate(held))
            edges = np.searchsorted(p, np.arange(ranges + 1) * width)
            some = np.flatnonzero(np.diff(edges)).tolist()
            blobs = [_pack_steps(np.diff(p[edges[k] : edges[k + 1]], prepend=k * width)) for k in some]
            none = pa.nulls(len(some), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(some), id_arrow), none, none, pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=schema.names)

        kind = None
        for step in steps(batches, text):
            m = step.num_rows
            row, token = _distinct(*shingles(step.column(text)))
            fp, n = _classes(row, token, m)
            kind = step.column(id_column).type
            yield pa.RecordBatch.from_arrays([step.column(id_column), pa.array(fp), pa.array(n.astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=schema.names)
            new = np.zeros(m, bool)
            for i, x in enumerate(fp.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            held.append(_position(token[new[row]], bits))
            size += len(held[-1])
            if size >= CHUNK:
                yield positions(kind)
                held, size, seen = [], 0, set()
        if size:
            yield positions(kind)

    return docs.select(id_column, text).mapInArrow(run, schema)


def _store_counts(blobs: DataFrame, path: str, bits: int, ranges: int, parts: int) -> None:
    """Store the counters, range by range; a range is one task's work and has a bounded size."""
    width = (1 << bits) // ranges

    def run(batches):
        store, n = Store(path), 0
        rows = chain.from_iterable((b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)) for b in batches)
        for k, group in groupby(rows, key=lambda r: r["range"]):
            total = np.zeros(width, np.uint16)
            for r in group:
                p, c = np.unique(np.cumsum(_unpack_steps(r["blob"])), return_counts=True)
                total[p] = np.minimum(total[p] + np.minimum(c, 255), 255)
            store.put(str(k), total.astype(np.uint8))
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    blobs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _index(docs: DataFrame, text: str, counts: tuple, buckets: int) -> DataFrame:
    """Blobs of the prefix tokens under the first order: (bucket, keys, owner, fps, sizes)."""

    def run(batches):
        order = Order(Counts(*counts))
        held, count, seen = [], 0, set()

        def flush():
            key, fp, n = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (scramble(key) % _U(buckets)).astype(np.int64)
            at = np.lexsort((key, b))
            edges = np.flatnonzero(np.diff(b[at], prepend=-1, append=-2))
            rows = []
            for i, j in zip(edges, edges[1:], strict=False):
                part = at[i:j]
                owners, owner = np.unique(fp[part], return_inverse=True)
                sizes = np.zeros(len(owners), np.uint32)
                sizes[owner] = n[part]
                rows.append((int(b[part[0]]), key[part].tobytes(), owner.astype(np.uint32).tobytes(), owners.tobytes(), sizes.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "owner", "fps", "sizes"])

        for step in steps(batches, text):
            m = step.num_rows
            row, token = _distinct(*shingles(step.column(text)))
            fp, n = _classes(row, token, m)
            new = np.zeros(m, bool)
            for i, x in enumerate(fp.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    new[i] = True
            row, token = row[new[row]], token[new[row]]
            if not len(row):
                continue
            key = order.keys(token, 0)
            at = np.lexsort((key, row))
            row, key = row[at], key[at]
            starts = np.cumsum(n * new) - n * new
            # A single token in a prefix leads nowhere.
            early = (np.arange(len(row)) - starts[row] < prefix(n)[row]) & (key >= _SHARED)
            if not early.any():
                continue
            held.append((key[early], fp[row[early]], n[row[early]]))
            count += int(early.sum())
            if count >= CHUNK // 4:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "bucket int, keys binary, owner binary, fps binary, sizes binary")


def _neighbours(batches):
    """Edges between classes that follow each other in size among those with a common prefix token."""
    rows = chain.from_iterable((b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)) for b in batches)
    for _, group in groupby(rows, key=lambda r: r["bucket"]):
        parts = []
        for r in group:
            owner = np.frombuffer(r["owner"], np.uint32)
            parts.append((np.frombuffer(r["keys"], _U), np.frombuffer(r["fps"], np.int64)[owner], np.frombuffer(r["sizes"], np.uint32)[owner].astype(np.int64)))
        key, fp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((fp, n, key))
        key, fp, n = key[at], fp[at], n[at]
        near = (key[1:] == key[:-1]) & (fp[1:] != fp[:-1]) & (n[:-1] * 100 >= n[1:] * PERCENT)
        pairs = np.unique(np.stack([np.minimum(fp[1:][near], fp[:-1][near]), np.maximum(fp[1:][near], fp[:-1][near])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _links(sets: list[tuple[int, np.ndarray, int]], order: Order, crossing: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links among (class, tokens, block); only between blocks if ``crossing``."""
    sets = sorted(sets, key=lambda s: (len(s[1]), s[0]))
    m = len(sets)
    if m < 2:
        return []
    n = np.array([len(s[1]) for s in sets])
    token = np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(m), n)
    starts = np.cumsum(n) - n
    allowed = np.triu(n[:, None] * 100 >= n[None, :] * PERCENT, 1)
    if crossing:
        block = np.array([s[2] for s in sets])
        allowed &= block[:, None] != block[None, :]
    for k in range(ORDERS):
        key = order.keys(token, k)
        at = np.lexsort((key, owner))
        early = at[np.arange(len(at)) - starts[owner[at]] < prefix(n)[owner[at]]]
        by_key = early[np.argsort(key[early], kind="stable")]
        edges = np.flatnonzero(np.diff(key[by_key], prepend=~key[by_key[0]]))
        share = np.zeros((m, m), bool)
        for i, j in zip(edges, [*edges[1:], len(by_key)], strict=False):
            if j - i > 1:
                g = owner[by_key[i:j]]
                share[np.ix_(g, g)] = True
        allowed &= share
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for i, j in np.argwhere(allowed).tolist():
        a, b = find(i), find(j)
        if a != b:
            both = len(np.intersect1d(sets[i][1], sets[j][1], assume_unique=True))
            if both * 100 >= PERCENT * (int(n[i]) + int(n[j]) - both):
                root[max(a, b)] = min(a, b)
                found.append((sets[i][0], sets[j][0]))
    return found


def _verify(counts: tuple):
    def run(batches):
        order = Order(Counts(*counts))
        rows = chain.from_iterable((b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)) for b in batches)
        for (_, i, j), group in groupby(rows, key=lambda r: (r["root"], r["i"], r["j"])):
            sets = {r["fp"]: (r["fp"], _unpack(r["tokens"]), r["block"]) for r in group}
            found = _links(list(sets.values()), order, i != j)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _pack(token: np.ndarray) -> bytes:
    """The upper 48 bits of each token; two tokens of a pair of sets agree by chance once in 10^8 pairs."""
    return np.ascontiguousarray(token).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(_U).ravel()


class Filter:
    """A Bloom filter of two hashes in the shared folder: ranges of bits, each a mapped file."""

    def __init__(self, path: str, bits: int):
        self.store, self.bits, self.maps = Store(path), bits, Recent(lambda k: self.store.get(str(k), np.uint8))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        p = h.astype(np.int64) % self.bits
        out = np.zeros(len(p), bool)
        part = p >> FILTER_RANGE
        for k in np.unique(part).tolist():
            bits = self.maps[k]
            if len(bits):
                at = np.flatnonzero(part == k)
                inner = p[at] & ((1 << FILTER_RANGE) - 1)
                out[at] = (bits[inner >> 3] >> (inner & 7).astype(np.uint8)) & 1 > 0
        return out


def _store_filter(ids: DataFrame, parts: int) -> tuple[str, int, int]:
    """Store a filter of the rows' (h1, h2), 16 bits for each row: its path, how many bits it has, and the rows.

    Each range of bits is one task's work and a file; nothing of it passes through the driver.
    """
    path, n = fresh_path(ids.sparkSession, "filter"), ids.count()
    bits = 1 << max(10, (16 * n - 1).bit_length())

    def run(batches):
        store, now, held, n = Store(path), None, None, 0
        for batch in batches:
            part, p = (batch.column(k).to_numpy() for k in ("part", "p"))
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
            for i, j in zip(edges, edges[1:], strict=False):
                if part[i] != now:
                    if now is not None:
                        store.put(str(now), held)
                        n += 1
                    now, held = int(part[i]), np.zeros(1 << (FILTER_RANGE - 3), np.uint8)
                inner = p[i:j] & ((1 << FILTER_RANGE) - 1)
                np.bitwise_or.at(held, inner >> 3, np.left_shift(1, inner & 7).astype(np.uint8))
        if now is not None:
            store.put(str(now), held)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    place = F.explode(F.array(F.pmod("h1", F.lit(bits)), F.pmod("h2", F.lit(bits)))).alias("p")
    placed = ids.select(place).withColumn("part", F.shiftright("p", FILTER_RANGE).cast("int"))
    placed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return path, bits, n


def _hashed(df: DataFrame, id_column: str) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64(id_column, F.lit(1)), "h2": F.xxhash64(id_column, F.lit(2))})


def _token_sets(docs: DataFrame, id_column: str, text: str, path: str, bits: int) -> DataFrame:
    """(id, fp, tokens) of the documents whose id may be in the filter; tokens are sorted and packed.

    Rows without an id are held against the filter by their class, and each task sends a class of them once.
    """
    schema = StructType([StructField("id", docs.schema[id_column].dataType), *StructType.fromDDL("fp long, tokens binary").fields])

    def run(batches):
        inside, sent = Filter(path, bits), set()

        for batch in batches:
            keep = inside(batch.column("h1").to_numpy()) & inside(batch.column("h2").to_numpy())
            for step in steps([batch.filter(pa.array(keep))], text):
                row, token = _distinct(*shingles(step.column(text)))
                fp, n = _classes(row, token, step.num_rows)
                ends = np.cumsum(n)
                short = _pack(token)
                packed = [short[6 * (e - k) : 6 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                made = pa.RecordBatch.from_arrays([step.column(id_column), pa.array(fp), pa.array(packed, pa.binary())], names=["id", "fp", "tokens"])
                nameless = pc.is_null(step.column(id_column)).to_numpy(zero_copy_only=False)
                if nameless.any():
                    wanted = ~nameless | (inside(fp) & inside(fp >> 32))
                    for i in np.flatnonzero(nameless & wanted).tolist():
                        wanted[i] = int(fp[i]) not in sent
                        sent.add(int(fp[i]))
                    made = made.filter(pa.array(wanted))
                yield made

    return _hashed(docs.select(id_column, text), id_column).mapInArrow(run, schema)


def group_similar(docs: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, fp, n, component, root) for each row of ``docs``: class, set size, least id and least class that links reach."""
    spark = docs.sparkSession
    docs = docs.select(column(id_column).alias("id"), column(text).alias("text"))
    id_column, text = "id", "text"
    parts = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bits = max(16, (chars // CHARS_PER_COUNTER).bit_length())
    ranges = 1 << min(bits - 3, max(2, (parts - 1).bit_length()))
    counts = (fresh_path(spark, "counts"), bits, ranges)
    profile = materialize(_profile(docs, id_column, text, bits, ranges), "profile")
    _store_counts(profile.where("range IS NOT NULL").select("range", "blob"), *counts, parts)
    rows = profile.where("range IS NULL").select("id", "fp", "n")
    classes = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"))

    index = _index(docs, text, counts, max(parts, -(-chars // BUCKET_CHARS)))
    edges = index.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_neighbours, "a long, b long")
    near = components(edges)
    member = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    member = materialize(member.join(classes, member["node"] == classes["fp"]).select("root", "node", "least", "n"), "near")
    # How many blocks each neighbourhood is cut into, and each class's block.
    cut = member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = member.join(cut, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = materialize(placed.select("root", "node", "blocks", "block", "least"), "wanted")
    # Only the documents that stand for a wanted class send their sets; the join makes that exact.
    # A class of which no row has an id is in the filter twice: as rows without an id, and by its fp.
    nameless = wanted.where("least IS NULL").select("least", F.col("node").alias("h1"), F.shiftright("node", 32).alias("h2"))
    filter_path, filter_bits, n_wanted = _store_filter(_hashed(wanted.select("least"), "least").unionByName(nameless), parts)
    sets = _token_sets(docs, id_column, text, filter_path, filter_bits).alias("s")
    # Few wanted classes travel to the sets; beyond the bound both sides are shuffled.
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    sets = sets.join(side.alias("w"), (F.col("s.fp") == F.col("w.node")) & F.col("s.id").eqNullSafe(F.col("w.least")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = sets.select("root", "block", "fp", "tokens", other)
    tasks = spread.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "tokens")
    verified = tasks.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(counts), "a long, b long")
    linked = components(verified)
    for path in (counts[0], filter_path):
        delete_path(spark, path)  # the links are stored by now
    full = materialize(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    # A component of very many classes, and below a class of very many copies, get their names by broadcast.
    names = full.groupBy("root").agg(F.min("least").alias("component"))
    named = materialize(lookup(full.select("fp", "root"), names, "root").select("fp", "component", "root"), "named")
    for table in (member, wanted, full):
        discard(table)
    # Documents without shingles are in no class.
    out = lookup(rows.where("n > 0"), named, "fp").select("id", "fp", "n", "component", "root")
    alone = rows.where("n = 0").select("id", "fp", "n", F.col("id").alias("component"), F.lit(None).cast("long").alias("root"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that with the least id, or of the least class if none has an id; documents without shingles all stay."""
    groups = group_similar(docs, id_column, text)
    other = F.when(F.col("component").isNull(), F.col("fp") != F.col("root")).otherwise(F.col("id").isNull() | (F.col("id") != F.col("component")))
    gone = groups.where((F.col("n") > 0) & other).select("id", "fp").distinct()
    name, only = free_name(docs, "__class"), free_name(docs, "__only")
    worded = F.coalesce(column(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = _token_classes(docs.where(worded), text, name)
    own = F.col(f"{name}.fp")
    gone = gone.select(F.struct("fp", "id").alias("gone"))
    kept = marked.join(gone, (own == F.col("gone.fp")) & column(id_column).eqNullSafe(F.col("gone.id")), "left_anti")
    # Rows that repeat one id and one set are one document; those without a word, and so without shingles, all stay.
    single = kept.withColumn(only, F.struct(column(id_column), own)).dropDuplicates([only])
    return single.select(*columns(docs)).unionByName(docs.where(~worded))


def _token_classes(docs: DataFrame, text: str, name: str) -> DataFrame:
    def kernel():
        def one(texts):
            row, token = _distinct(*shingles(texts))
            fp, _ = _classes(row, token, len(texts))
            return pa.StructArray.from_arrays([pa.array(fp)], names=["fp"])

        return one

    return append_struct(docs, text, name, "fp long", kernel)
