"""Substring dedup: windows of tokens that an earlier document already has are cut out.

Tokens are words between ASCII white space, unchanged. Every window of ``window`` consecutive words of
a document gets a Rabin-Karp hash: with ``H[i]`` the sum of ``hash(word j) * B ** j`` over ``j < i``
modulo 2 ** 64, a window's hash is ``(H[i + window] - H[i]) * B ** -i``, so all windows of a batch cost
two running sums and one product. A window is removed where its hash also starts in a document with
a smaller id; the removed windows of a document merge into maximal intervals of words.

How the count is distributed:

1. Documents are hashed in batches of bounded size; a very long text is cut into pieces that overlap
   by ``window - 1`` words. Within a batch only the occurrences in the least document of each hash go
   on; those in its other documents are removed already (the combiner, which also bounds what a
   passage that everybody has can send: one document for each batch).
2. The hashes are dealt by their upper bits into slices, packed at 7 bytes a hash and about two for document and place.
   Slices follow the text's size, so a slice is bounded however much text there is.
3. A slice sorts its hashes, takes each one's least document, and answers with the places to remove, packed for
   groups of documents.
4. A group of documents merges the answers of all slices; each document meets its own by id.

Nothing is broadcast, stored or collected but the table's size in bytes, and whether ids repeat (then
the hash of the text travels along with the id). Hashes have 64 bits (56 stored and the
slice's own), so that two different windows among n are taken for equal with a chance of about
n * n / 2 ** 64: none to speak of up to a terabyte, about one window in a million at 100 terabytes.

Defined results: null and empty texts and texts with fewer words than a window keep all words; documents with a
null id keep all words and remove none (a null is not smaller than anything); rows that repeat an id
and a text get equal results, and rows with equal ids don't remove from each other; an empty table
gives an empty table; other columns pass through, one with the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import STEP_BYTES, column, free_name, hash_words, map_batches, planes, scramble, steps, unplanes

WINDOW = 50
#: Bytes of text whose windows one slice gets on average.
SLICE_BYTES = 24 << 20
REMOVAL = "struct<n_words: bigint, n_removed: bigint, removed: array<struct<start: bigint, end: bigint>>, kept: string>"

_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: Requests have hashes; rows without any tell what a batch itself removes. Answers go to groups of documents in the same form.
_PACKED = "slice int, hashes binary, ids binary, keys binary, many binary, places binary"
_ARROW = pa.schema([("slice", pa.int32()), *((n, pa.binary()) for n in ("hashes", "ids", "keys", "many", "places"))])


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten().dictionary_encode()
    known = hash_words(flat.dictionary.cast(pa.binary())) if len(flat.dictionary) else np.empty(0, _U)
    word = flat.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    blank = np.flatnonzero(np.asarray(pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)))
    if len(blank):
        keep = word != blank[0]
        word, owner = word[keep], owner[keep]
    return known[word], np.bincount(owner, minlength=len(lists))


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


def pieces(batches: Iterator[pa.RecordBatch], window: int, limit: int = STEP_BYTES) -> Iterator[tuple]:
    """(ids, keys, hashes of words, words of each piece, place of each piece's first word) by steps of bounded size."""
    for step in steps(batches, "text", limit):
        ids, keys = (step.column(n).to_numpy(zero_copy_only=False) for n in ("id", "key"))
        texts = step.column("text")
        if step.num_rows > 1 or pc.binary_length(texts)[0].as_py() <= 2 * limit:
            words, sizes = _word_hashes(texts)
            yield ids, keys, words, sizes, np.zeros(len(ids), np.int64)
            continue
        tail, first = np.empty(0, _U), 0
        for piece in _cut(texts[0].as_buffer().to_pybytes(), limit):
            words, _ = _word_hashes(pa.array([piece]).cast(pa.string()))
            words = np.concatenate([tail, words])
            yield ids, keys, words, np.array([len(words)]), np.array([first])
            tail = words[max(0, len(words) - window + 1) :]
            first += len(words) - len(tail)


def window_hashes(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, piece, place in the piece) of every window that lies in one piece."""
    powers = np.full(len(words) + 1, _BASE, _U)
    powers[0] = 1
    sums = np.concatenate([[_U(0)], np.cumsum(words * np.cumprod(powers)[:-1], dtype=_U)])
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[piece] + place
    powers[1:] = _INVERSE
    return scramble((sums[at + window] - sums[at]) * np.cumprod(powers)[at]), piece, place


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(slices) >> _U(32)).astype(np.int64)


def _packed(number: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row for each ``number``: hashes if any, and places by runs of equal (id, key). All arrays are sorted by number."""
    rows = []
    first, length = _runs(number)
    for a, n in zip(first.tolist(), length.tolist(), strict=True):
        i, k = ids[a : a + n], keys[a : a + n]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
        own = None if hashes is None else np.ascontiguousarray(hashes[a : a + n]).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
        rows.append((int(number[a]), own, planes(np.diff(i[new], prepend=0), 8), planes(k[new], 8), planes(np.diff(np.append(new, n))), planes(np.diff(places[a : a + n], prepend=0))))
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(number, hashes or None, ids, keys, many, places) of each row."""
    for number, hashes, ids, keys, many, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if hashes is not None:
            wide = np.zeros((len(hashes) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(hashes, np.uint8).reshape(-1, 7)
            hashes = wide.view(_U).ravel()
        yield number, hashes, np.cumsum(unplanes(ids, 8)), unplanes(keys, 8), unplanes(many), np.cumsum(unplanes(places))


def _requests(window: int, slices: int):
    """Batches of documents to requests by slice, and to what the batch itself already removes."""

    def run(batches):
        for ids, keys, words, sizes, firsts in pieces(batches, window):
            hashes, piece, place = window_hashes(words, sizes, window)
            if not len(hashes):
                continue
            doc, place = ids[piece], place + firsts[piece]
            order = np.lexsort((doc, hashes))
            first, length = _runs(hashes[order])
            goes = np.zeros(len(hashes), bool)
            goes[order] = doc[order] == np.repeat(doc[order][first], length)
            gone = np.flatnonzero(~goes)
            if len(gone):  # any slice can pass this on
                at = int(scramble(hashes[:1])[0] % _U(slices))
                yield _packed(np.full(len(gone), at), None, doc[gone], keys[piece[gone]], place[gone])
            sent = np.flatnonzero(goes)
            slice_of = _slice_of(hashes[sent], slices)
            by_slice = np.argsort(slice_of, kind="stable")  # by document and place within a slice
            mine = sent[by_slice]
            yield _packed(slice_of[by_slice], hashes[mine], doc[mine], keys[piece[mine]], place[mine])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each number in a stream that is sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in _unpacked(batch):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answers(slices: int):
    """Slices to the places of windows that a document with a smaller id also has, for groups of documents."""

    def run(batches):
        for rows in _grouped(batches):
            asked, told = [r for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
            found = [(np.repeat(r[2], r[4]), np.repeat(r[3], r[4]), r[5]) for r in told]
            if asked:
                hashes, ids, keys, many, places = (np.concatenate([r[k] for r in asked]) for k in (1, 2, 3, 4, 5))
                del asked
                owner = np.repeat(np.arange(len(ids), dtype=np.int32), many)
                order = np.argsort(hashes)
                hashes = hashes[order]
                _, length = _runs(hashes)
                several = np.repeat(length > 1, length)
                order, hashes = order[several], hashes[several]
                doc = ids[owner[order]]
                first, length = _runs(hashes)
                if len(first):
                    hit = order[doc > np.repeat(np.minimum.reduceat(doc, first), length)]
                    found.append((ids[owner[hit]], keys[owner[hit]], places[hit]))
            if found:
                ids, keys, places = (np.concatenate(x) for x in zip(*found, strict=True))
                group = (scramble(ids.astype(_U)) % _U(slices)).astype(np.int64)
                order = np.lexsort((places, keys, ids, group))
                yield _packed(group[order], None, ids[order], keys[order], places[order])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of documents to one row for each document: its places, distinct and in order."""
    for rows in _grouped(batches):
        ids, keys, places = (np.concatenate(x) for x in zip(*((np.repeat(r[2], r[4]), np.repeat(r[3], r[4]), r[5]) for r in rows), strict=True))
        order = np.lexsort((places, keys, ids))
        ids, keys, places = ids[order], keys[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
        told = [planes(np.diff(np.unique(places[a:b]), prepend=0)) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(keys[new]), pa.array(told, pa.binary())], names=["id", "key", "places"])


def covered(places: bytes | None, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of the words that the windows at these packed places cover."""
    if not places:
        return []
    at = np.cumsum(unplanes(places))
    new = np.concatenate([[True], at[1:] > at[:-1] + window])
    return list(zip(at[new].tolist(), (at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + window).tolist(), strict=True))


def _removal(text: str, places: bytes | None, window: int) -> dict:
    words = text.encode("utf-8", "surrogatepass").split()
    gaps = covered(places, window)
    kept, at = [], 0
    for a, b in gaps:
        kept += words[at:a]
        at = b
    kept = kept + words[at:] if gaps else words
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "removed": [{"start": a, "end": b} for a, b in gaps], "kept": b" ".join(kept).decode("utf-8", "surrogatepass")}


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", out: str = "repeats", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``out``: number of words, how many are removed and where, the text that is left."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.drop(out)
    ids = docs.select(column(id).cast("long").alias("id")).where("id IS NOT NULL")
    repeated = bool(ids.groupBy("id").count().where("count > 1").take(1))
    key = F.xxhash64(column(text)) if repeated else F.lit(0).cast("long")
    keyed = docs.select(column(id).cast("long").alias("id"), key.alias("key"), column(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(partitions, -(-size // SLICE_BYTES))
    dealt = lambda df: df.repartitionById(partitions, F.col("slice") % partitions).sortWithinPartitions("slice")
    answers = dealt(map_batches(keyed, _requests(window, slices), StructType.fromDDL(_PACKED))).mapInArrow(_answers(slices), _PACKED)
    own_id, own_key, marks = (free_name(docs, f"__{n}") for n in ("id", "key", "places"))
    by_doc = dealt(answers).mapInArrow(_marks, "id bigint, key bigint, places binary").toDF(own_id, own_key, marks)
    joined = docs.withColumns({own_id: column(id).cast("long"), own_key: key}).join(by_doc, [own_id, own_key], "left").drop(own_id, own_key)
    names = [n for n in docs.columns if keep_text or n != text]
    made = StructType.fromDDL(f"r {REMOVAL}")[0].dataType
    arrow = to_arrow_type(made)

    def finish(batches):
        for step in steps(batches, text):
            told = [_removal(t or "", p, window) for t, p in zip(step.column(text).to_pylist(), step.column(marks).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(step.column(n) for n in names), pa.array(told, arrow)], names=[*names, out])

    return map_batches(joined, finish, StructType([*(docs.schema[n] for n in names), StructField(out, made)]))
