"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Normalisation lower-cases A-Z and keeps words of digits, letters and all non-ASCII characters.
Every ``width`` consecutive words of an item form a window (an item with fewer words, but not none,
is one window). The automaton reads each document's words once; a match gives word positions, which
are mapped back to code point offsets of the original text.

Defined results: a null or empty text has no words and no hits, and so has a null or empty item; an
item without id marks words but is not listed; equal items or equal windows of several items are
one pattern that names all of them; repeated rows give repeated results; an empty benchmark hits
nothing; other columns pass through, a column with the name of the result is replaced.

Scale: documents are only scanned, nothing of them is shuffled. The automaton is built once, by a task, as flat
arrays in the shared folder (children by sorted words, failure and output links, items of a window), and every worker
maps it, so it costs a worker nothing however large the benchmark is, and the time of a text does not
depend on the benchmark's size. It has a state for each distinct beginning of a window, at 21 bytes; building it level
by level needs some 70 bytes for each: 10 MB of items make 17.8 million states, 379 MB of files, and took 1.3 GB of one task.

A batch is scanned in lanes: a state only depends on the last ``width`` words, so the words of a batch are cut into
lanes that start ``width`` words early, and all lanes take a step together in numpy. Words are looked up by
their hash and compared with the benchmark's word, so nothing is found by chance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_struct, column, columns, fresh_path, free_name, hash_words
from tidemark.llm.store import Store

WIDTH = 10
#: Words of one lane.
LANE = 128

_KEEP = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "n_words long, n_hit long, items array<string>, hits array<struct<item_id: string, start: int, end: int>>"


def words(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 text; every byte above 7F belongs to a word."""
    return text.translate(_KEEP).split()


def _numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, which of them each word is, how many words each text has)."""
    lists = pc.ascii_split_whitespace(pa.array([t.translate(_KEEP) for t in texts], pa.binary()).cast(pa.large_string(), safe=False))
    flat = lists.flatten().dictionary_encode()
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    blank = np.flatnonzero(np.asarray(pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)))
    if len(blank):
        keep = word != blank[0]
        word, owner = word[keep], owner[keep]
    return flat.dictionary.cast(pa.large_binary()), word, np.bincount(owner, minlength=len(lists))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Automaton:
    """Aho-Corasick over word numbers in flat arrays; state 0 is the root, word 0 any word outside the benchmark."""

    NAMES = {"hashes": np.uint64, "word_ends": np.int64, "word_bytes": np.uint8, "root": np.int32, "child": np.int32, "word": np.int32, "fail": np.int32, "out": np.int32, "slot": np.int32, "depth": np.uint8, "item_start": np.int64, "items": np.int32, "name_ends": np.int64, "name_bytes": np.uint8, "named": np.uint8}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def open(cls, path: str) -> Automaton:
        store = Store(path)
        return cls({n: store.get(n, k) for n, k in cls.NAMES.items()})

    def save(self, path: str) -> None:
        for n, k in self.NAMES.items():
            Store(path).put(n, np.asarray(getattr(self, n), k))

    @classmethod
    def build(cls, rows: list[tuple[str | None, bytes]], width: int) -> Automaton:
        """Of the windows of items (id, text); the ids may be null, and equal ones are one item."""
        distinct, word, sizes = _numbered([t for _, t in rows])
        hashes = hash_words(distinct)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        word = rank[word]
        texts = [distinct[int(i)].as_py() for i in order]
        names = sorted({i for i, _ in rows if i is not None})
        place = {n: k for k, n in enumerate(names)} | {None: len(names)}
        counts = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        start = _ranges(np.cumsum(sizes) - sizes, counts)
        length = np.repeat(np.minimum(sizes, width), counts)
        item = np.repeat(np.fromiter((place[i] for i, _ in rows), np.int64, len(rows)), counts)
        at = np.zeros(len(start), np.int64)
        parents, words_, base, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1, [0, 1]
        for d in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > d)
            key, which = np.unique(at[live] << 32 | word[start[live] + d], return_inverse=True)
            at[live] = base + which
            parents.append(key >> 32)
            words_.append(key & 0xFFFFFFFF)
            base += len(key)
            levels.append(base)
        parent, own = np.concatenate(parents), np.concatenate(words_).astype(np.int32)
        # Children of a state are states in a row, in the order of their words: parents only grow.
        child = np.append(np.searchsorted(parent[1:], np.arange(base)) + 1, base).astype(np.int32)
        depth = np.repeat(np.arange(len(levels) - 1), np.diff(levels)).astype(np.uint8)
        root = np.zeros(len(order) + 1, np.int32)
        if base > 1:
            root[own[1 : levels[2]]] = np.arange(1, levels[2])
        pair = np.unique(at * (len(names) + 1) + item) if len(at) else np.empty(0, np.int64)
        ends, items = pair // (len(names) + 1), pair % (len(names) + 1)
        final, item_start = np.unique(ends, return_index=True)
        slot = np.full(base, -1, np.int32)
        slot[final] = np.arange(len(final))
        fail, out = np.zeros(base, np.int32), np.zeros(base, np.int32)
        made = cls({"root": root, "child": child, "word": own, "fail": fail})
        for a, b in zip(levels[2:-1], levels[3:], strict=True):
            fail[a:b] = made.step(fail[parent[a:b]], own[a:b])
            f = fail[a:b]
            out[a:b] = np.where(slot[f] >= 0, f, out[f])
        pack = lambda parts: (np.cumsum([len(x) for x in parts], dtype=np.int64), np.frombuffer(b"".join(parts), np.uint8))
        word_ends, word_bytes = pack(texts)
        name_ends, name_bytes = pack([n.encode() for n in names])
        return cls({**made.__dict__, "hashes": hashes[order], "word_ends": word_ends, "word_bytes": word_bytes, "out": out, "slot": slot, "depth": depth, "item_start": np.append(item_start, len(items)), "items": items, "name_ends": name_ends, "name_bytes": name_bytes, "named": np.ones(len(names), np.uint8)})

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one word each: to a child, or to one of the nearest failure link that has it."""
        new = self.root[word]
        left = np.flatnonzero((state != 0) & (word != 0))
        s, w = state[left], word[left]
        while len(left):
            low, high = self.child[s], self.child[s + 1]
            stop = high
            while True:
                open_ = low < high
                if not open_.any():
                    break
                middle = (low + high) >> 1
                right = open_ & (self.word[np.minimum(middle, len(self.word) - 1)] < w)
                low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
            found = (low < stop) & (self.word[np.minimum(low, len(self.word) - 1)] == w)
            new[left[found]] = low[found]
            rest = ~found
            s = self.fail[s[rest]]
            left, w = left[rest], w[rest]
            going = s != 0
            left, s, w = left[going], s[going], w[going]
        return new

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each word, 0 for those outside the benchmark; what has the same hash is compared."""
        out = np.zeros(len(distinct), np.int32)
        if not len(self.hashes) or not len(distinct):
            return out
        hashes = hash_words(distinct)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        for k in np.flatnonzero(self.hashes[at] == hashes).tolist():
            i = int(at[k])
            first = int(self.word_ends[i - 1]) if i else 0
            if self.word_bytes[first : int(self.word_ends[i])].tobytes() == distinct[k].as_py():
                out[k] = i + 1
        return out

    def scan(self, words_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of its last word, state) of every occurrence of a window in a sequence of word numbers."""
        n = len(words_)
        if not n or len(self.word) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        lanes = -(-n // LANE)
        padded = np.zeros(width + lanes * LANE, np.int32)
        padded[width : width + n] = words_
        first = np.arange(lanes) * LANE
        state = np.zeros(lanes, np.int32)
        places, states = [], []
        for t in range(width + LANE):
            state = self.step(state, padded[first + t])
            if t >= width:
                ends = np.flatnonzero((self.slot[state] >= 0) | (self.out[state] > 0))
                places.append(first[ends] + t - width)
                states.append(state[ends])
        place, state = np.concatenate(places), np.concatenate(states)
        found = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        while len(place):
            final = self.slot[state] >= 0
            found[0].append(place[final])
            found[1].append(state[final])
            state = self.out[state]
            place, state = place[state > 0], state[state > 0]
        return np.concatenate(found[0]), np.concatenate(found[1])

    def names(self, state: int) -> list[str | None]:
        """The ids of the items that hold the window of a state; None for items without one."""
        k = int(self.slot[state])
        out: list[str | None] = []
        for i in self.items[int(self.item_start[k]) : int(self.item_start[k + 1])].tolist():
            first = int(self.name_ends[i - 1]) if 0 < i <= len(self.name_ends) else 0
            out.append(None if i == len(self.name_ends) else self.name_bytes[first : int(self.name_ends[i])].tobytes().decode())
        return out

    def find(self, texts: list[bytes], width: int) -> tuple[np.ndarray, list[list[tuple[int, int, list[str | None]]]]]:
        """(number of words of each text, (first word, end word, item ids) of every occurrence of a window in each)."""
        distinct, word, sizes = _numbered(texts)
        # A 0 after each text keeps the next one apart.
        starts = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        row = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        row[_ranges(starts, sizes)] = self.numbers(distinct)[word]
        place, state = self.scan(row, width)
        found: list[list] = [[] for _ in texts]
        order = np.argsort(place, kind="stable")
        known: dict[int, list] = {}
        for p, s in zip(place[order].tolist(), state[order].tolist(), strict=True):
            t = int(np.searchsorted(starts, p, "right")) - 1
            if s not in known:
                known[s] = self.names(s)
            end = p - int(starts[t]) + 1
            found[t].append((end - int(self.depth[s]), end, known[s]))
        return sizes, found


def _summary(text: bytes, n: int, found: list[tuple[int, int, list[str | None]]]) -> dict:
    if not found:
        return {"n_words": n, "n_hit": 0, "items": [], "hits": []}
    spans = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    hit, by_item = 0, {}
    upto = 0
    for a, b, _ in sorted(found, key=lambda x: x[:2]):
        hit += max(0, b - max(a, upto))
        upto = max(upto, b)
    for a, b, ids in sorted(found, key=lambda x: x[:2]):
        for item in ids:
            runs = by_item.setdefault(item, [])
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    hits = sorted(((spans[a][0], spans[b - 1][1], item) for item, runs in by_item.items() for a, b in runs), key=lambda h: (h[0], h[1], h[2] or ""))
    return {
        "n_words": n,
        "n_hit": hit,
        "items": sorted(i for i in by_item if i is not None),
        "hits": [{"item_id": i, "start": a, "end": b} for a, b, i in hits],
    }


def store_automaton(items: DataFrame, path: str, width: int = WIDTH) -> None:
    """Build the automaton of items (i, t) in a task and store its arrays."""

    def run(batches):
        rows = [(i, bytes(t)) for b in batches for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True)]
        Automaton.build(rows, width).save(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    items.select("i", "t").repartition(1).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Documents with a struct ``out``: n_words, n_hit, items, hits (item and code point offsets)."""
    items = benchmark.select(column(item_id).cast("string").alias("i"), F.encode(column(item_text), "utf-8").alias("t")).where("length(t) > 0").distinct()
    path = fresh_path(docs.sparkSession, "automaton")
    store_automaton(items, path, width)

    def kernel():
        automaton = Automaton.open(path)

        def run(texts):
            read = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            sizes, found = automaton.find(read, width)
            return [_summary(t, n, f) for t, n, f in zip(read, sizes.tolist(), found, strict=True)]

        return run

    return append_struct(docs, text, out, HITS, kernel)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a single word inside an occurrence of a benchmark window."""
    name = free_name(docs, "__contamination")
    return find_contamination(docs, benchmark, out=name, **options).where(F.col(f"{name}.n_hit") == 0).select(*columns(docs))
