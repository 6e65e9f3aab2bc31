"""Words of UTF-8 texts as arrays: places, hashes and k-word shingles, many texts at a time.

A word is a run of the bytes 0-9, A-Z, a-z and 0x80 up; A-Z count as a-z. Every other byte separates.
Hashes are the same in every process, so they can be compared across tasks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to so many bytes; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

_FOLD = np.zeros(256, np.uint8)
for _lo, _hi, _by in ((0x30, 0x3A, 0), (0x41, 0x5B, 32), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi) + _by

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK_BYTES) + 1
        tables = []
        for base in (_BASE, _UNBASE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a text column into (first row, bytes, row offsets in these bytes); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(rows, max(row + 1, end))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """The words of some texts: `starts` and `ends` in `folded`, `hashes`, and `first`, each text's first word.

    `folded` may be given: each byte's value in a word, 0 for the bytes that separate words. A word also
    begins wherever `cuts` is true.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, folded: np.ndarray | None = None,
                 cuts: np.ndarray | None = None):
        self.folded = _FOLD[data] if folded is None else folded
        inside = self.folded != 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        first = offsets[offsets < len(data)]
        begins[first] = inside[first]
        last = offsets[offsets > 0] - 1
        stops[last] = inside[last]
        if cuts is not None:
            begins |= cuts & inside
            stops[:-1] |= begins[1:] & inside[:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        powers, inverses = _power_tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.folded * powers[:len(data)], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverses[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.folded[self.starts[i]:self.ends[i]].tobytes()

    def phrase(self, i: int, k: int) -> bytes:
        """The words i..i+k-1, joined by one space."""
        return b" ".join(self.word(j) for j in range(i, i + k))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words within a text, and the windows' hashes."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hashes[j:j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
        whole = np.ones(n, bool)
        for bound in range(1, k):  # a window may not run over the end of a text
            cut = self.first[1:-1] - bound
            whole[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(whole)
        return at, mix(total[at])
