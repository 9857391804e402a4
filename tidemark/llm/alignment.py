"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual each pair is.

Every text is encoded twice, by a byte-level BPE (A) and by a sentence-piece BPE (B), as a space and the text, without special
tokens. Two token occurrences are linked where their bytes overlap. Offsets at which tokens of both end
cut them into groups. A pair's count is how many links of the whole corpus hold it.

Texts are encoded by units: a unit begins at each space after a byte that cannot end white space. Neither
vocabulary joins anything across such a place (A splits words there before it merges, no piece of B has a space behind
another character), so a unit is encoded and aligned once in a worker however often it occurs, and tokens of a text are
those of its units. For the same reason new units are encoded many at a time, one after another in a single string;
where all letters are Latin a faster implementation of A's merges does it, with the vocabulary of the same file. Between two neighbouring ends of either side lies exactly one link, so
the links of a unit are the union of its ends.

The corpus-wide part is a cogroup of postings:

1. Alignments are written to the shared folder with each row's pairs and how often the row has them.
2. Weights of the B ids, one number for each id of the vocabulary, cut the ids into slices of equal weight.
   An id that is heavier than a slice spans several, and its postings are dealt among them by row.
3. Postings (B id, A id, row, multiplicity) are shuffled by slice, beside partial counts of the pairs,
   which are summed up before and go to every slice that their id spans. Spark sorts each partition (spilling as
   needed) so that a slice's counts come before its postings: counts and each B id's maximum are made
   locally, and postings stream by.
4. Each slice emits what it adds to a row's sums, packed by blocks of rows; they are summed by row.

Memory: the counts of one slice, which are no more than its postings, or the A vocabulary for an id
that spans several. The driver sees the weights, as many numbers as the B vocabulary has ids.

Defined results: null and empty texts, and texts of which the joined tokens of a side are not the text's
bytes, have no tokens: zeros and an empty string; repeated rows count as often as they are there; an empty
table gives an empty table; texts may have any length; other columns than the text pass through, one with the
result's name is replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import column, discard, free_name, map_batches, materialize, planes, scramble, steps, unplanes

FOLDER = "/opt/tokenizers"
VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Bytes of text that are aligned in one go, and bytes of packed pairs (4 each) that are dealt in one go.
STEP = 512 << 10
DEALT_STEP = 1 << 20
#: Postings of one slice on average, and entries of partial counts that a task holds before it sends them.
SLICE, HELD = 2 << 20, 1 << 20
#: Units and bytes of their results that a worker remembers.
REMEMBERED = (200_000, 48 << 20)

_U = np.uint64
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: How byte-level vocabularies split text before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and signs of which all versions of Unicode that matter here agree what they are.
_NOT_LATIN = re.compile("[^\x00-\u024f]")


class Encoders:
    """Both vocabularies: ids of texts and the bytes of ids."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        special = set(self.a.get_added_tokens_decoder())
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if i not in special}, special_tokens={})
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(self.b.id_to_piece(i) for i in range(self.b.vocab_size()))
        ]
        self.length_a, self.length_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))

    def encode(self, unit: bytes) -> tuple[list[int], list[int]]:
        """Ids of one unit, which begins with a space; B adds that one itself, but not to nothing (a space that ends a text)."""
        text = unit.decode()
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id("▁")]

    def encode_all(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, how many of each unit, B ids, how many, whether the tokens are the unit's bytes), in the order of the units.

        Units whose tokens are not their bytes have none.
        """
        kinds: list[list[int]] = [[], [], []]
        for k, u in enumerate(units):
            kinds[2 if _may_end_space(u) else 1 if _NOT_LATIN.search(u.decode()) else 0].append(k)
        order = [k for kind in kinds for k in kind]
        parts = []
        for kind, fast in ((0, True), (1, False)):
            for members in _portions(kinds[kind], units):
                parts += self._together([units[k] for k in members], fast)
        parts += [self._alone(units[k]) for k in kinds[2]]
        (ids_a, size_a), (ids_b, size_b) = ((np.concatenate([p[k] for p in parts]), np.concatenate([p[k + 1] for p in parts])) for k in (0, 2))
        ok = np.concatenate([p[4] for p in parts])
        back = np.argsort(order, kind="stable")
        turn = lambda ids, size: (ids[_gather((np.cumsum(size) - size)[back], size[back])], size[back])
        return (*turn(ids_a, size_a), *turn(ids_b, size_b), ok[back])

    def _together(self, units: list[bytes], fast: bool) -> list[tuple]:
        joined = b"".join(units)
        text = joined.decode()
        a = self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64) if fast else np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:], num_threads=1), np.int64)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        sizes = []
        for ids, length, table in ((a, self.length_a, self.bytes_a), (b, self.length_b, self.bytes_b)):
            if b"".join([table[i] for i in ids.tolist()]) != joined:
                return [self._alone(u) for u in units]
            sizes.append(np.diff(np.searchsorted(np.cumsum(length[ids]), ends, "right"), prepend=0))
        return [(a, sizes[0], b, sizes[1], np.ones(len(units), bool))]

    def _alone(self, unit: bytes) -> tuple:
        a, b = self.encode(unit)
        ok = b"".join([self.bytes_a[i] for i in a]) == unit == b"".join([self.bytes_b[i] for i in b])
        a, b = (a, b) if ok else ([], [])
        return np.array(a, np.int64), np.array([len(a)]), np.array(b, np.int64), np.array([len(b)]), np.array([ok])


def _may_end_space(unit: bytes) -> bool:
    """Whether the last byte may end white space, as in ``split_units``: such a unit can only end a text."""
    last = unit[-1]
    return last <= 32 or (last >= 0x80 and (unit[-2] == 0xC2 or (len(unit) > 2 and 0xE1 <= unit[-3] <= 0xE3)))


def _portions(members: list[int], units: list[bytes], size: int = 128 << 10):
    """Units of about ``size`` bytes together."""
    held, n = [], 0
    for k in members:
        held.append(k)
        n += len(units[k])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ragged rows that begin at ``starts``, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Units:
    """Alignments of the units met so far, by number."""

    def __init__(self, a: str, b: str):
        self.encoders = Encoders(a, b)
        self.names = [np.array([f"{i}{end}" for i in range(len(t))], object) for t, ends in ((self.encoders.bytes_a, ",|"), (self.encoders.bytes_b, ",;")) for end in ends]
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ok, self.groups = np.empty(0, bool), []
        self.counts = np.empty((0, 4), np.int64)
        self.keys, self.start, self.stored = np.empty(0, np.uint32), np.empty(0, np.int64), 0

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """Numbers of distinct units; those not met before are encoded and aligned."""
        if len(self.number) > REMEMBERED[0] or self.stored > REMEMBERED[1]:
            self.forget()
        new = [u for u in units if u not in self.number]
        if new:
            self._learn(new)
        return np.fromiter((self.number[u] for u in units), np.int64, len(units))

    def _learn(self, units: list[bytes]) -> None:
        e = self.encoders
        a, size_a, b, size_b, ok = e.encode_all(units)
        end_a, end_b = np.cumsum(e.length_a[a]), np.cumsum(e.length_b[b])
        links, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, links), np.searchsorted(end_b, links)
        ends = np.cumsum(np.where(ok, np.fromiter(map(len, units), np.int64, len(units)), 0))
        count = lambda x: np.diff(np.searchsorted(x, ends, "right"), prepend=0)
        counts = np.stack([size_a, size_b, count(both), count(links)], axis=1)
        # Tokens in the order of the groups, A before B in each, with the sign that follows.
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        named = np.empty(len(a) + len(b), object)
        place_a, place_b = np.arange(len(a)) + np.searchsorted(group_b, group_a), np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        named[place_a] = np.where(last(group_a), self.names[1][a], self.names[0][a])
        named[place_b] = np.where(last(group_b), self.names[3][b], self.names[2][b])
        upto = [0, *np.cumsum(size_a + size_b).tolist()]
        parts = named.tolist()
        texts = ["".join(parts[x:y]) for x, y in zip(upto, upto[1:], strict=False)]
        for u in units:
            self.number[u] = len(self.number)
        self.ok = np.concatenate([self.ok, ok])
        self.groups += texts
        self.counts = np.concatenate([self.counts, counts])
        self.start = np.concatenate([self.start, len(self.keys) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.keys = np.concatenate([self.keys, (b[at_b] << 16 | a[at_a]).astype(np.uint32)])
        self.stored += sum(map(len, units)) + sum(map(len, texts)) + 4 * len(links)


def split_units(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(units of all texts in order, how many each text has); a text is preceded by a space."""
    joined = b"".join(b" " + t for t in texts)
    data = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begins = data == 32
    before = np.zeros((3, len(data)), np.uint8)
    for k in range(3):
        before[k, k + 1 :] = data[: len(data) - k - 1]
    # White space is up to 0x20 or 0x85 and 0xA0 after 0xC2 or a sign of three bytes from 0xE1 to 0xE3; those before a space don't split.
    begins &= (before[0] > 32) & ~((before[0] >= 0x80) & ((before[1] == 0xC2) | ((before[2] >= 0xE1) & (before[2] <= 0xE3))))
    begins[starts[:-1]] = True
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]), np.diff(np.searchsorted(at, starts))


def _aligner(a: str, b: str, digest: bool):
    """Arrow texts to columns: counts, groups, keys and multiplicities of pairs."""
    units = Units(a, b)

    def run(texts: pa.Array) -> list[pa.Array]:
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        parts, many = split_units(raw)
        coded = parts.dictionary_encode()
        number = units.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(raw)), many)
        bad = np.zeros(len(raw), bool)
        bad[doc[~units.ok[number]]] = True
        bad |= np.fromiter((not t for t in raw), bool, len(raw))
        number, doc = number[~bad[doc]], doc[~bad[doc]]
        sizes = units.counts[number]
        counts = [np.bincount(doc, sizes[:, k], len(raw)).astype(np.int64) for k in range(4)]
        edges = np.searchsorted(doc, np.arange(len(raw) + 1)).tolist()
        names, at = units.groups, number.tolist()
        groups = ["".join([names[i] for i in at[x:y]])[:-1] for x, y in zip(edges, edges[1:], strict=False)]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        keys = units.keys[_gather(units.start[number], sizes[:, 3])]
        pair, n = np.unique(np.repeat(doc, sizes[:, 3]).astype(_U) << _U(32) | keys, return_counts=True)
        edges = np.searchsorted(pair, np.arange(len(raw) + 1).astype(_U) << _U(32)).tolist()
        pair = pair.astype(np.uint32).astype(np.int64)
        packed = [(planes(np.diff(pair[x:y], prepend=0)), planes(n[x:y])) for x, y in zip(edges, edges[1:], strict=False)]
        return [*map(pa.array, counts), pa.array(groups, pa.string()), pa.array([k for k, _ in packed], pa.binary()), pa.array([m for _, m in packed], pa.binary())]

    return run


def _postings(step: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, multiplicity) of all postings of a batch, by row."""
    keys = [np.cumsum(unplanes(k)) for k in step.column("keys").to_pylist()]
    rows = np.repeat(step.column("row").to_numpy(), [len(k) for k in keys])
    return rows, np.concatenate(keys), np.concatenate([unplanes(m) for m in step.column("counts").to_pylist()])


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for step in steps(batches, "keys", 4 * DEALT_STEP):
        total += np.bincount(_postings(step)[1] >> 16, minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["side", "n"])


class Plan:
    """Slices of equal weight over the B ids: an id has the range from ``low`` to ``high`` of them."""

    def __init__(self, weights: dict[int, int], slices: int):
        total = np.zeros(max(weights, default=0) + 1)
        for side, n in weights.items():
            total[side] = n
        upto = np.cumsum(total) / max(1.0, total.sum()) * slices
        self.low, self.high, self.slices = upto - total / max(1.0, total.sum()) * slices, upto, slices

    def of(self, side: np.ndarray, part) -> np.ndarray:
        """The slice for a ``part`` from 0 to 1 of each id's range."""
        low = self.low[side]
        return np.clip((low + part * (self.high[side] - low)).astype(np.int64), 0, self.slices - 1)


_DEALT = "slice int, kind int, block bigint, rows binary, keys binary, counts binary"
_DEALT_ARROW = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _deal(plan: Plan):
    """Rows of pairs to postings by slice (kind 1), and to partial counts for every slice of their B id (kind 0)."""

    def partial(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        side = keys >> 16
        low, high = plan.of(side, 0.0), plan.of(side, np.nextafter(1.0, 0.0))
        which = np.repeat(np.arange(len(keys)), high - low + 1)
        slice_of = low[which] + np.arange(len(which)) - np.searchsorted(which, which)
        order = np.argsort(slice_of, kind="stable")
        slices, first = np.unique(slice_of[order], return_index=True)
        cut = [order[x:y] for x, y in zip(first, [*first[1:], len(order)], strict=True)]
        packed = [(planes(np.diff(keys[which[o]], prepend=0)), counts[which[o]].astype("<i8").tobytes()) for o in cut]
        n = len(slices)
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], schema=_DEALT_ARROW)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for step in steps(batches, "keys", DEALT_STEP):
            rows, keys, counts = _postings(step)
            if not len(rows):
                continue
            held.append(_summed([(keys, counts)]))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield partial(*held[0])
                    held = []
            part = (scramble(rows.astype(_U)) >> _U(11)).astype(float) * 2.0**-53
            slice_of = plan.of(keys >> 16, part)
            order = np.argsort(slice_of, kind="stable")
            slices, first = np.unique(slice_of[order], return_index=True)
            cut = [order[x:y] for x, y in zip(first, [*first[1:], len(order)], strict=True)]
            packed = [(planes(np.diff(rows[o], prepend=rows[0]), 8), planes(keys[o]), planes(counts[o])) for o in cut]
            n = len(slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([int(rows[0])] * n, pa.int64()), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(3))], schema=_DEALT_ARROW
            )
        if held:
            yield partial(*_summed(held))

    return run


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stream of slices, counts before postings, to what each slice adds to the sums of rows, by block."""
    now, held = None, []
    known = total = best = np.empty(0, np.int64)
    for batch in batches:
        out = []
        for number, kind, block, rows, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now:
                now, held, known = number, [], None
            if kind == 0:
                held.append((np.cumsum(unplanes(keys)), np.frombuffer(counts, "<i8")))
                if len(held) > 1 and sum(len(k) for k, _ in held) > HELD:
                    held = [_summed(held)]
                continue
            if known is None:
                known, total = _summed(held)
                held = []
                side = known >> 16
                first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
                best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(side))))
            row = np.cumsum(unplanes(rows, 8)) + block
            at, many = np.searchsorted(known, unplanes(keys)), unplanes(counts)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sums = np.add.reduceat(many * total[at], first)
            out.append((block, planes(np.diff(row[first], prepend=block), 8), planes(np.add.reduceat(many * best[at], first), 8), planes(sums, 8)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3))], names=["block", "rows", "best", "sums"])


def _merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the slices add to the rows of one block, summed by row."""
    rows, best, sums = [], [], []
    for batch in group:
        for block, r, b, s in zip(*(batch.column(n).to_pylist() for n in ("block", "rows", "best", "sums")), strict=True):
            rows.append(np.cumsum(unplanes(r, 8)) + block)
            best.append(unplanes(b, 8))
            sums.append(unplanes(s, 8))
    row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    total = [np.zeros(len(row), np.int64) for _ in range(2)]
    for t, x in zip(total, (best, sums), strict=True):
        np.add.at(t, inverse, np.concatenate(x))
    yield pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, total)], names=["row", "n_best", "count_sum"])


def align(docs: DataFrame, text: str = "text", out: str = "alignment", folder: str = FOLDER, a: str = VOCABULARY_A, b: str = VOCABULARY_B, digest: bool = False) -> DataFrame:
    """``docs`` without its text and with a struct column ``out``.

    n_a, n_b, n_groups, n_links; n_best: links whose count is the greatest of their B id; count_sum: the counts of all links;
    groups: A and B ids of each group as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` that string's SHA-256.
    """
    docs = docs.drop(out)
    spark = docs.sparkSession
    names = [n for n in docs.columns if n != text]
    own = [free_name(docs, f"__{n}") for n in (*_COUNTS, "groups", "keys", "counts")]
    row = free_name(docs, "__row")
    path_a, path_b = f"{folder}/{a}", f"{folder}/{b}"

    def encode(batches):
        run = _aligner(path_a, path_b, digest)
        for step in steps(batches, text, STEP):
            yield pa.RecordBatch.from_arrays([*(step.column(n) for n in names), *run(step.column(text))], names=[*names, *own])

    kinds = [LongType()] * 4 + [StringType(), BinaryType(), BinaryType()]
    encoded = map_batches(docs, encode, StructType([*(docs.schema[n] for n in names), *(StructField(n, k) for n, k in zip(own, kinds, strict=True))]))
    stored = materialize(encoded.withColumn(row, F.monotonically_increasing_id()), "alignments")
    pairs = stored.select(F.col(row).alias("row"), F.col(own[5]).alias("keys"), F.col(own[6]).alias("counts")).where(F.length("keys") > 0)

    weights = {r["side"]: r["n"] for r in pairs.mapInArrow(_weights, "side bigint, n bigint").groupBy("side").agg(F.sum("n").alias("n")).collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = Plan(weights, max(partitions, -(-sum(weights.values()) // SLICE)))
    dealt = pairs.mapInArrow(_deal(plan), _DEALT).repartitionById(partitions, F.col("slice") % partitions).sortWithinPartitions("slice", "kind")
    added = dealt.mapInArrow(_contribute, "block bigint, rows binary, best binary, sums binary")
    merged = added.groupBy("block").applyInArrow(_merge, "row bigint, n_best bigint, count_sum bigint")
    best, total = free_name(docs, "__best"), free_name(docs, "__sum")
    sums = merged.groupBy(F.col("row").alias(row)).agg(F.sum("n_best").alias(best), F.sum("count_sum").alias(total))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name)
    made = [F.col(n).alias(c) for n, c in zip(own[:4], _COUNTS, strict=True)]
    joined = stored.drop(own[5], own[6]).join(sums, row, "left")
    result = joined.select(*map(column, names), F.struct(*made, zero(best, "n_best"), zero(total, "count_sum"), F.col(own[4]).alias("groups")).alias(out))
    # The result is small beside the postings: it is stored, and they go.
    kept = materialize(result, "aligned")
    discard(stored)
    return kept
