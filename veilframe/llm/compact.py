"""Integers on their way through a shuffle: sorted runs, delta-coded and compressed, one payload for each bucket.

A task gathers a run of (code, other columns), sorts it by code and cuts it into buckets of equal
ranges of codes. Sorted codes of a range lie close together, so their differences need few bytes;
bytes of equal weight stand together, and zstd takes what is left. A bucket's payloads from all
tasks are read together by one group, which holds a bounded share of all codes.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
#: The most bits of a code that travel, and how many there are beyond those that number the codes: of 2**SPARE
#: unequal codes about one meets another by chance, which costs a comparison and changes no result.
BITS, SPARE = 48, 10
#: Bytes of input that one bucket stands for.
BUCKET = 4 << 20
#: Rows that a task gathers before it sorts and sends them.
RUN = 1 << 20
SENT = "bucket int, kind int, payload binary"


class Deal(NamedTuple):
    """Into how many buckets codes are dealt, and how many bits of them travel."""

    n: int
    bits: int

    def cut(self, codes: np.ndarray) -> np.ndarray:
        return codes >> _U(64 - self.bits)


def deal(df: DataFrame, codes_per_byte: float) -> Deal:
    """By the size of the files (or rows) that df reads, which Spark knows without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = min(max(size, 1), 1 << 50)
    return Deal(min(100_000, max(8, -(-size // BUCKET))), min(BITS, max(24, math.ceil(math.log2(size * codes_per_byte + 1)) + SPARE)))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first ascends."""
    parts = [struct.pack("<IB", len(columns[0]), len(columns))]
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(np.diff(c, prepend=c[:1] * 0) if i == 0 else c)
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()
        body = pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)
        parts.append(struct.pack("<2sI", c.dtype.str[1:].encode(), len(body)))
        parts.append(body)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<IB", data)
    at, out = 5, []
    for i in range(k):
        kind, size = struct.unpack_from("<2sI", data, at)
        kind = np.dtype("<" + kind.decode())
        planes = pa.Codec("zstd").decompress(data[at + 6 : at + 6 + size], decompressed_size=n * kind.itemsize, asbytes=True)
        c = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
        out.append(np.cumsum(c, dtype=kind) if i == 0 else c)
        at += 6 + size
    return out


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])


def dealt(to: Deal, kind: int, code: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload) of rows in ascending order of code (cut to its bits)."""
    edge = np.searchsorted(code, ((np.arange(to.n + 1, dtype=object) << to.bits) // to.n).astype(_U))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        s, e = edge[b : b + 2]
        yield b, kind, pack(code[s:e], *(c[s:e] for c in columns))


def gathered(table: pa.Table, kind: int) -> list[np.ndarray] | None:
    """The columns of all payloads of a kind in a group, one after the other; null if there are none."""
    kinds = table.column("kind").to_numpy()
    parts = [unpack(p.as_py()) for p, k in zip(table.column("payload"), kinds, strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None
