"""Periodic runs of words: every maximal stretch that repeats a period, and texts without the repetition.

A run is a stretch of consecutive words with least period q (words q apart are equal) that no neighbouring
word extends, of at least ``least`` words and ``times`` periods. They are found as Kolpakov and Kucherov do:

1. A suffix automaton with first end positions gives the Lempel-Ziv factors: each is a new word or the
   longest prefix of the rest that begins earlier as well (overlaps allowed).
2. Main's algorithm finds the runs that cross or touch the border between two factors. With P(q) the
   common prefix of the text from the border and from q later, and S(q) the common suffix before them,
   there is a stretch of period q around the border if P(q) + S(q) covers it; Z functions give both for all q.
   A run that ends in factor u begins less than |previous| + q before it and has q < (|previous| + |u|) / (times - 1),
   which bounds the text looked at, and shows most borders to have no run long enough at all.
3. A run inside a factor is a copy of one in the factor's earlier occurrence, shifted.

Before that, a vectorised pass over whole batches finds where runs can be: in a run of at least ``least`` words every gram of
``least - 2 * least / times`` words has an equal one a period away, so grams that don't return within a
third of the stretch around them (``1 / times``) are in no run, again until nothing changes. Only stretches that remain, which hold each
run as a whole, go through the algorithm; hashes that agree by chance only make a stretch longer.

All work on a text is inside the task that reads it: no shuffle. A text's words are needed as a whole, so
memory grows with the longest text (its words at some 80 bytes each), not with the table.

Defined results: null and empty texts have no words and no runs; repeated rows give equal results; an empty
table gives an empty table; texts may have any length; of two runs with equal exponents the earlier is the
strongest, then that with the smaller period; other columns pass through, one with the result's name is replaced.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.llm.common import append_struct, hash_words, scramble

LEAST = 24
TIMES = 3
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RUNS = f"struct<n_words: bigint, runs: array<{RUN}>, strongest: {RUN}, collapsed: string>"

_U = np.uint64
_BASE = _U(0x9FB21C651E98DF25)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


class Automaton:
    """Suffix automaton with the first end position of each state.

    Nearly all states have one way out, which is kept in two arrays; the others are in a dictionary.
    """

    def __init__(self, words: list[int]):
        n = len(words)
        size = 2 * n + 2
        self.length, self.link, self.first = (array("i", bytes(4 * size)) for _ in range(3))
        self.word, self.to = array("i", b"\xff" * (4 * size)), array("i", bytes(4 * size))
        self.more: dict[int, dict[int, int]] = {}
        self.link[0] = -1
        self._build(words)

    def go(self, state: int, word: int) -> int:
        """The state after ``word``, or -1."""
        if self.word[state] == word:
            return self.to[state]
        ways = self.more.get(state)
        return ways.get(word, -1) if ways else -1

    def _put(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _build(self, words: list[int]) -> None:
        length, link, first, go, put = self.length, self.link, self.first, self.go, self._put
        last, states = 0, 1
        for i, w in enumerate(words):
            new = states
            states += 1
            length[new], first[new] = length[last] + 1, i
            p = last
            while p >= 0 and go(p, w) < 0:
                put(p, w, new)
                p = link[p]
            if p >= 0:
                q = go(p, w)
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = states
                    states += 1
                    length[clone], link[clone], first[clone] = length[p] + 1, link[q], first[q]
                    self.word[clone], self.to[clone] = self.word[q], self.to[q]
                    if q in self.more:
                        self.more[clone] = dict(self.more[q])
                    while p >= 0 and go(p, w) == q:
                        put(p, w, clone)
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the earlier occurrence or -1) of the Lempel-Ziv factors."""
    auto = Automaton(words)
    go, first, n = auto.go, auto.first, len(words)
    out, i = [], 0
    while i < n:
        state, j = 0, i
        while j < n:
            to = go(state, words[j])
            if first[to] >= j:
                break
            state = to
            j += 1
        out.append((i, j - i, first[state] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole; 0 for place 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _around(words: list[int], border: int, before: int, end: int, most: int, long_enough) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches around ``border`` inside ``[border - before, end)``, periods up to ``most``."""
    left, right = words[border - before : border], words[border:end]
    back = left[::-1]
    found = []
    reach = min(most, len(right))
    if reach:  # the first period of the pair lies after the border
        ahead = z_function(right)
        behind = z_function([*back, -1, *right[reach - 1 :: -1], *back])
        for q in range(1, reach + 1):
            p = ahead[q] if q < len(right) else 0
            s = min(behind[len(back) + 1 + reach - q], len(back)) if back else 0
            if long_enough(s + q + p, q):
                found.append((border - s, border + q + p, q))
    reach = min(most, len(left))
    if reach:  # it lies before the border
        ahead = z_function([*right, -1, *left[len(left) - reach :], *right])
        behind = z_function(back)
        for q in range(1, reach + 1):
            p = min(ahead[len(right) + 1 + reach - q], len(right)) if right else 0
            s = behind[q] if q < len(back) else 0
            if long_enough(s + q + p, q):
                found.append((border - q - s, border + p, q))
    return found


def find_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence, by start and then period. ``times`` is 3 or more."""
    long_enough = lambda length, q: length >= least and length >= times * q
    n = len(words)
    parts = factors(words)
    period: dict[tuple[int, int], int] = {}
    starting: dict[int, list[int]] = {}
    starts: list[int] = []

    def add(start: int, end: int, q: int) -> None:
        if (start, end) not in period:
            if start not in starting:
                insort(starts, start)
            starting.setdefault(start, []).append(end)
        period[start, end] = min(q, period.get((start, end), q))

    previous = 0
    for start, length, source in [*parts, (n, 0, -1)]:
        both = previous + length
        if both * times > least * (times - 1):
            most = both // (times - 1) + 1
            for a, b, q in _around(words, start, min(start, previous + most), start + length, most, long_enough):
                # One that goes on after this factor is found at the border that it ends behind.
                if (a == 0 or words[a - 1] != words[a - 1 + q]) and (b == n or words[b] != words[b - q]):
                    add(a, b, q)
        if source >= 0 and length > least:
            shift = start - source
            k = bisect_right(starts, source)
            while k < len(starts) and starts[k] < source + length:
                a = starts[k]
                for b in list(starting[a]):
                    if b < source + length:
                        add(a + shift, b + shift, period[a, b])
                k += 1
        previous = length
    return sorted((a, b - a, q) for (a, b), q in period.items())


def stretches(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the stretches, in one text each, outside which there is no run.

    ``words`` are the hashes of all texts' words one after another, ``sizes`` the numbers of words.
    """
    gram = max(1, int(least - 2 * least / times))
    counts = np.maximum(sizes - gram + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    powers = np.full(len(words) + 1, _BASE, _U)
    powers[0] = 1
    sums = np.concatenate([[_U(0)], np.cumsum(words * np.cumprod(powers)[:-1], dtype=_U)])
    powers[1:] = _INVERSE
    hashes = scramble((sums[at + gram] - sums[at]) * np.cumprod(powers)[at] + scramble(text.astype(_U)))
    del sums, powers
    order = np.argsort(hashes, kind="stable")
    twice = hashes[order][1:] == hashes[order][:-1]
    gap = np.full(len(at), np.iinfo(np.int64).max)
    a, b = order[:-1][twice], order[1:][twice]
    apart = at[b] - at[a]
    gap[a] = apart
    gap[b] = np.minimum(gap[b], apart)
    on = np.flatnonzero(gap < np.iinfo(np.int64).max)
    while True:
        if not len(on):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        new = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (text[on[1:]] != text[on[:-1]])])
        first = np.flatnonzero(new)
        long = np.diff(np.append(first, len(on))) + gram - 1
        stay = (gap[on] <= np.repeat(long // times, np.diff(np.append(first, len(on))))) & np.repeat(long >= least, np.diff(np.append(first, len(on))))
        if stay.all():
            return at[on[first]], long
        on = on[stay]


def _describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    strongest, dropped = None, []
    for a, length, q in runs:
        if strongest is None or length * strongest[2] > strongest[1] * q:
            strongest = (a, length, q)
        dropped.append((a + q, a + length))
    kept, at = [], 0
    for a, b in sorted(dropped):
        if b > at:
            kept += words[at : max(a, at)]
            at = b
    kept = kept + words[at:] if dropped else words
    as_run = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
    return {"n_words": len(words), "runs": [as_run(r) for r in runs], "strongest": strongest and as_run(strongest), "collapsed": b" ".join(kept).decode("utf-8", "surrogatepass")}


def _kernel(least: int, times: int):
    def run(texts: pa.Array) -> list[dict]:
        split = [t.split() for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        known = hash_words(flat.dictionary) if len(flat.dictionary) else np.empty(0, _U)
        number = flat.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        found: list[list] = [[] for _ in split]
        for a, n in zip(*(x.tolist() for x in stretches(known[number], sizes, least, times)), strict=True):
            text = int(np.searchsorted(starts + sizes, a, "right"))
            off = a - int(starts[text])
            found[text] += [(s + off, length, q) for s, length, q in find_runs(number[a : a + n].tolist(), least, times)]
        return [_describe(words, runs) for words, runs in zip(split, found, strict=True)]

    return run


def find_periodic(docs: DataFrame, text: str = "text", out: str = "periodic", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with a struct column ``out``: number of words, all runs, the strongest, the text with each run cut to one period."""
    if times < 3 or least < times:
        raise ValueError("runs need at least three periods, and at least as many words")
    return append_struct(docs, text, out, StructType.fromDDL(f"r {RUNS}")[0].dataType, lambda: _kernel(least, times))
