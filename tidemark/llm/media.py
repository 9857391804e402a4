"""Media columns: payloads stored as PNG, read back with checksum tests, hashed by cosine transform.

``encode`` writes an 8-bit grey PNG: signature, IHDR, IDAT chunks of a zlib stream, IEND, each chunk
with its CRC-32. For every image row it chooses among the five filters of the format the one with the
least sum of absolute differences. ``decode`` checks the signature, every chunk's CRC-32, the zlib
Adler-32 and the sizes, and reverses the filters with numpy, for many images at once: a filtered
sample depends on its left, upper and upper left neighbours, so samples on one anti-diagonal of all
images are restored together. ``feature`` is a 64-bit perceptual hash: area means on a 32 x 32 grid,
the 8 x 8 lowest frequencies of its DCT-II, one bit each for those above their median, and 4 more
bytes with the mean and spread.

Defined results: a null text is the empty text; the payload is the UTF-8 text followed by bytes 255
up to the next positive multiple of ``UNIT``, so an empty text is one unit of 255; texts may have any
length (image height grows); equal texts give equal bytes and hashes; repeated rows repeat; other
columns pass through, a column with the name of the result is replaced. A stored form that is null
reads as null; one that is corrupt, or that unpacks to more than its header says, fails the job.

Scale: each row is encoded where it is and there is no shuffle. A step holds a few MB of payload, when
writing and when reading: the size once unpacked is taken from the headers before anything is unpacked.
A longer text is filtered, restored and hashed in bands of rows, so it needs a few times its own size.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import append_struct, utf8

UNIT = 576
WIDTH = 96
#: zlib level and chunk size of the stored form; with zlib they fix its bytes.
LEVEL = 6
CHUNK = 1 << 16
#: Bytes of rows that are filtered in one go, at about 28 bytes of memory each.
BAND = 1 << 20

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"

_GRID, _LOW = 32, 8
#: Rows that are summed in one go.
_ROWS = 4096


def payload(text: bytes) -> bytes:
    """The text padded with bytes 255 to a positive multiple of UNIT."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (size - len(text))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The PNG predictor: whichever of left, up, corner is nearest to left + up - corner."""
    da, db = np.abs(b - c), np.abs(a - c)
    dc = np.abs(a + b - 2 * c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _differences(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """(5, height, width): the rows under each filter; ``above`` is the row before the first."""
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.empty_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], up[0] = x[:, :-1], x[:-1], above
    corner[:, 1:] = up[:, :-1]
    guesses = (0, left, up, (left + up) >> 1, _paeth(left, up, corner))
    return np.stack([(x - g).astype(np.uint8) for g in guesses])


def encode(data: bytes, width: int = WIDTH, filters: bytes | None = None, level: int = LEVEL) -> bytes:
    """Samples as PNG. ``filters`` names a filter type (0 to 4) for each row; without it each row gets the best.

    A row's filters only need the row above, so rows are filtered and packed in bands of ``BAND`` bytes, however tall the image is.
    """
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    step = max(1, BAND // width)
    packer, packed, above = zlib.compressobj(level), [], np.zeros(width, np.uint8)
    for at in range(0, len(rows), step):
        band = rows[at : at + step]
        under = _differences(band, above)
        if filters is None:
            # Differences count as signed bytes; of equal sums the first filter wins.
            kinds = np.abs(under.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
        else:
            kinds = np.frombuffer(filters[at : at + step], np.uint8).astype(np.int64)
        body = np.empty((len(band), width + 1), np.uint8)
        body[:, 0] = kinds
        body[:, 1:] = under[kinds, np.arange(len(band))]
        packed.append(packer.compress(body.tobytes()))
        above = band[-1]
    packed.append(packer.flush())
    whole = b"".join(packed)
    del packed
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    parts = (_chunk(b"IDAT", whole[i : i + CHUNK]) for i in range(0, len(whole), CHUNK))
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


class Corrupt(ValueError):
    """Stored bytes that fail a test."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _size(png: bytes) -> tuple[int, int]:
    """(width, height) of the header, which must come first."""
    if png[:8] != SIGNATURE:
        raise Corrupt("signature")
    if png[8:16] != b"\x00\x00\x00\x0dIHDR" or len(png) < 33:
        raise Corrupt("header")
    width, height, *rest = struct.unpack_from(">IIBBBBB", png, 16)
    if rest != [8, 0, 0, 0, 0] or not width:
        raise Corrupt("not 8-bit grey without interlace")
    return width, height


def _filtered(png: bytes) -> np.ndarray:
    """The filtered rows (height, 1 + width) after all tests; never unpacks more than the header says."""
    width, height = _size(png)
    at, data, kind = 8, [], b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise Corrupt("truncated")
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != int.from_bytes(png[at + 8 + size : at + 12 + size], "big"):
            raise Corrupt(f"chunk {kind!r}")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    want = height * (width + 1)
    unpacker = zlib.decompressobj()
    try:
        raw = unpacker.decompress(b"".join(data), want + 1)
        if len(raw) == want and not unpacker.eof:  # the checksum at the end may be still to come
            raw += unpacker.decompress(unpacker.unconsumed_tail, 1)
    except zlib.error as e:
        raise Corrupt(f"zlib: {e}") from e
    if len(raw) != want or not unpacker.eof:
        raise Corrupt("size")
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)


def decode_all(pngs: list[bytes]) -> list[np.ndarray]:
    """The samples of 8-bit grey PNGs as (height, width) each, or Corrupt; images of one width go together."""
    found = [_filtered(p) for p in pngs]
    out: list[np.ndarray] = [np.empty(0)] * len(found)
    tall = [f.size > BAND for f in found]
    for i in np.flatnonzero(tall).tolist():
        out[i] = _unfilter_tall(found[i])
    for width in sorted({f.shape[1] for f, t in zip(found, tall, strict=True) if not t}):
        own = [i for i, f in enumerate(found) if f.shape[1] == width and not tall[i]]
        for i, rows in zip(own, _unfilter([found[i] for i in own]), strict=True):
            out[i] = rows
    return out


def decode(png: bytes) -> np.ndarray:
    return decode_all([png])[0]


def _unfilter_tall(rows: np.ndarray) -> np.ndarray:
    """One image in bands, each below the last row of the one before it, which comes as an unfiltered row."""
    step = max(1, BAND // rows.shape[1])
    out = np.empty((len(rows), rows.shape[1] - 1), np.uint8)
    out[:step] = _unfilter([rows[:step]])[0]
    for at in range(step, len(rows), step):
        band = np.concatenate([np.append(np.uint8(0), out[at - 1])[None], rows[at : at + step]])
        out[at : at + step] = _unfilter([band])[0][1:]
    return out


def _unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """Undo the row filters of images of equal width.

    The images lie under each other in one array, each below a row of zeros and right of a column of
    zeros, which stand for what is outside. Step t restores sample t - y of every row y that has it.
    """
    width = images[0].shape[1]  # of a row with its filter type, or with a zero before it
    heights = np.array([len(f) for f in images])
    kinds = np.concatenate([f[:, 0] for f in images])
    if kinds.max(initial=0) > 4:
        raise Corrupt("filter type")
    first = np.cumsum(heights + 1) - heights  # of each image, below its row of zeros
    y = np.arange(len(kinds)) - np.repeat(np.cumsum(heights) - heights, heights)
    line = np.repeat(first, heights) + y
    flat = np.zeros((len(kinds) + len(images), width), np.int16)
    flat[line, 1:] = np.concatenate([f[:, 1:] for f in images])
    x = flat.ravel()
    order = np.argsort(y, kind="stable")
    starts, kind = line[order] * width, kinds[order]
    upto = np.searchsorted(y[order], np.arange(heights.max(initial=0) + 1))
    sub, up, mean, paeth = (kind == k for k in (1, 2, 3, 4))
    for t in range(1, int(heights.max(initial=0)) + width - 1):
        low, high = upto[max(0, t - width + 1)], upto[min(len(upto) - 1, t)]
        if low == high:
            continue
        s = slice(low, high)
        at = starts[s] + (t - y[order[s]])
        a, b, c = x[at - 1], x[at - width], x[at - width - 1]
        guess = sub[s] * a + up[s] * b + mean[s] * ((a + b) >> 1) + paeth[s] * _paeth(a, b, c)
        x[at] = (x[at] + guess) & 255
    done = flat[:, 1:].astype(np.uint8)
    return [done[f : f + h] for f, h in zip(first.tolist(), heights.tolist(), strict=True)]


def _areas(n: int, grid: int) -> np.ndarray:
    """(grid, n) weights: the share of each sample in each of ``grid`` equal parts of its line."""
    edges = np.arange(grid + 1) * (n / grid)
    low, high = np.arange(n), np.arange(1, n + 1)
    share = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.clip(share, 0, None) * (grid / n)


_COS = np.cos(np.pi / _GRID * np.outer(np.arange(_LOW), np.arange(_GRID) + 0.5))
_ACROSS = _areas(WIDTH, _GRID).T


def feature(image: np.ndarray) -> str:
    """24 hex digits: 64 bits of low-frequency signs, then mean and spread as 16-bit numbers."""
    n, width = image.shape
    side = _ACROSS if width == WIDTH else _areas(width, _GRID).T
    if n > 4 * _GRID:  # tall images: the rows of each part, whole and partial, are summed on their own
        edges = np.arange(_GRID + 1) * (n / _GRID)
        small = np.empty((_GRID, _GRID))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            first, last = int(a), min(n, int(np.ceil(b)))
            weight = np.minimum(np.arange(first + 1, last + 1), b) - np.maximum(np.arange(first, last), a)
            total = np.zeros(width)
            for at in range(first, last, _ROWS):
                total += weight[at - first : at - first + _ROWS] @ image[at : min(last, at + _ROWS)].astype(np.float64)
            small[k] = (total @ side) * (_GRID / n)
    else:
        small = _areas(n, _GRID) @ (image.astype(np.float64) @ side)
    counts = sum(np.bincount(image[at : at + _ROWS].ravel(), minlength=256) for at in range(0, n, _ROWS))
    mean = float((counts * np.arange(256)).sum() / counts.sum())
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / counts.sum()))
    low = (_COS @ small @ _COS.T).ravel()
    low = np.round(low, 6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex() + f"{round(mean * 256) & 0xFFFF:04x}{round(spread * 256) & 0xFFFF:04x}"


MEDIA = "n_bytes long, png binary"


def store_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Documents with ``out``: n_bytes (of the text) and png (stored form of its payload)."""
    return append_struct(docs, text, out, MEDIA, lambda: lambda texts: [{"n_bytes": len(t), "png": encode(payload(t))} for t in utf8(texts)])


READ_BACK = "payload_bytes long, payload binary, hash binary"


def _unpacked(pngs: pa.Array) -> np.ndarray:
    """How many bytes each stored form unpacks to, by its header."""
    sizes = [_size(p) if p is not None else (0, 0) for p in pngs.to_pylist()]
    return np.array([(width + 1) * height for width, height in sizes], np.int64)


def _read(pngs: list[bytes | None]) -> list[dict | None]:
    images = iter(decode_all([p for p in pngs if p is not None]))
    out = []
    for png in pngs:
        image = None if png is None else next(images)
        out.append(None if image is None else {"payload_bytes": image.size, "payload": image.tobytes(), "hash": bytes.fromhex(feature(image))})
    return out


def read_media(stored: DataFrame, png: str = "png", out: str = "samples") -> DataFrame:
    """Rows with ``out``: the samples of each stored PNG, after all tests, and their hash; null for null."""
    return append_struct(stored, png, out, READ_BACK, lambda: lambda forms: _read(forms.to_pylist()), measure=_unpacked)
