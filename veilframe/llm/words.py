"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes of one class. Both classes in use treat every byte of a
non-ASCII character as part of a word, so byte runs and code-point runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Freed batches go back to the system: workers live long, beside a JVM that needs the memory.
pa.set_memory_pool(pa.system_memory_pool())
#: Bytes that one step looks at; a longer text is a step of its own.
STEP = 1 << 20

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x20\x09-\x0D]+
SPACED = _NOT_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256).astype(_U) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        run = np.full(max(n, STEP), base, _U)
        run[0] = 1
        _powers[name] = have = np.cumprod(run, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows within them) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


class Words:
    """starts, ends: bytes of each word; first: number of the first word of each row, and of all words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = kind[data]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = inside[:-1]
        edge[offsets] = False
        self.starts = np.flatnonzero(inside & ~edge[:n])
        edge[:] = False
        edge[: max(n - 1, 0)] = inside[1:]
        edge[offsets[1:][offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~edge[:n]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        out = np.empty(len(self.starts), _U)
        i = 0
        while i < len(out):
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.starts, a + STEP)))
            b = self.ends[j - 1]
            run = np.zeros(b - a + 1, _U)
            np.cumsum(_CODES[self.data[a:b]] * _power("up", _BASE, b - a), out=run[1:])
            s, e = self.starts[i:j] - a, self.ends[i:j] - a
            out[i:j] = mix((run[e] - run[s]) * _power("down", _INVERSE, b - a)[s] + (e - s).astype(_U))
            i = j
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window of size consecutive words of one row, row). Shorter rows have none."""
        n = np.maximum(self.counts - size + 1, 0)
        rows = np.repeat(np.arange(len(n)), n)
        return spread(self.first[:-1], n), rows


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def rolled(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of size consecutive word hashes from each position in at."""
    out = np.zeros(len(at), _U)
    for k in range(size):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[at + k]
    return mix(out)


def short_rows(words: Words, size: int) -> np.ndarray:
    """Rows that have words, but fewer than a window."""
    return np.flatnonzero((words.counts > 0) & (words.counts < size))


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions in first."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def match_all(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether length bytes of a from a_at equal those of b from b_at, for each i."""
    bad = a[spread(a_at, length)] != b[spread(b_at, length)]
    return summed(bad, np.concatenate([[0], np.cumsum(length)])) == 0
