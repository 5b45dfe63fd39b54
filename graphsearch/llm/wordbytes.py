"""Words of whole texts as arrays: spans and 64-bit hashes computed on the UTF-8 bytes.

Every delimiter of the word classes used here is one ASCII byte and every byte of a longer UTF-8
sequence is above 0x7F, so splitting bytes equals splitting characters.  Work arrays are sized by
CHUNK, not by the text: a text of any length is read in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_U = np.uint64
#: Odd, and 3 mod 8, so that powers differ in as many bits as an odd base allows.
_BASE = _U(0x9E3779B97F4A7C13)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IDENTITY = np.arange(256, dtype=np.uint8)
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


class WordClass:
    """Which bytes make words, and whether A-Z count as a-z."""

    def __init__(self, member: np.ndarray, fold: bool):
        self.member = member
        self.values = _BYTE_VALUES[_FOLD if fold else _IDENTITY]


ALNUM_FOLDED = WordClass(_ALNUM, True)
SPACED_FOLDED = WordClass(_NOT_SPACE, True)
SPACED = WordClass(_NOT_SPACE, False)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _piece(data: np.ndarray, breaks: np.ndarray, kind: WordClass, at: int, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    member = kind.member[data]
    before = np.empty(len(member) + 1, dtype=bool)
    before[0] = False
    before[1:] = member
    cut = np.zeros(len(member) + 1, dtype=bool)
    cut[breaks] = True
    after = np.append(member, False)
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(kind.values[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    parts = []
    for n in prefixes:
        part = mix((sums[np.minimum(starts + n, len(data))] - sums[starts]) * inverse[starts] + _U(n))
        part[ends - starts <= n] = 0
        parts.append(part)
    return starts + at, ends + at, hashes, *parts


class Words:
    """Words of a run of texts: doc[i] is the text that holds word i, at bytes start[i]:end[i] of data.

    prefixes[k][i] is a hash of the first so many bytes of word i, 0 if it has no more than these.
    """

    def __init__(self, texts: pa.Array, kind: WordClass, prefixes: tuple[int, ...] = ()):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        self.n_docs = len(texts)
        _, offsets, raw = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.data = data[low:high]
        self.offsets = offsets - low
        if texts.null_count:  # a null may own bytes; no word may start there
            null = np.asarray(texts.is_null())
            if (np.diff(self.offsets)[null] > 0).any():
                self.__init__(pc.fill_null(texts, ""), kind, prefixes)
                return
        pieces = []
        at, size = 0, len(self.data)
        while at < size:
            to = min(at + CHUNK, size)
            while to < size and kind.member[self.data[to]] and kind.member[self.data[to - 1]]:
                ahead = np.flatnonzero(~kind.member[self.data[to : to + CHUNK]])
                to = to + int(ahead[0]) if len(ahead) else min(to + CHUNK, size)
            first, last = np.searchsorted(self.offsets, [at, to])
            breaks = self.offsets[first : last + (last < len(self.offsets) and self.offsets[last] == to)] - at
            pieces.append(_piece(self.data[at:to], breaks, kind, at, prefixes))
            at = to
        join = lambda k, t: np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, t)
        self.start, self.end, self.hash = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        self.prefixes = [join(3 + k, np.uint64) for k in range(len(prefixes))]
        #: Word numbers where each text begins, and their number at the end.
        self.first = np.searchsorted(self.start, self.offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def __len__(self) -> int:
        return len(self.start)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, also of those that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out + _U(n))


def inside(words: Words, n: int) -> np.ndarray:
    """Which of grams(…, n) lie within one text."""
    return words.doc[: max(0, len(words) - n + 1)] == words.doc[n - 1 :] if len(words) >= n else np.zeros(0, bool)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most so many bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of values [begin, end)."""
    power, inverse = _power_tables(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
