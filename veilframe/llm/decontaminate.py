"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive item words. Tables are built in blocks of items of a
bounded size; each block is one pass over the texts, in the same row, so no text is shuffled.
Within a pass the scan looks at the last two words under a window, takes the shift that their
block allows, and only where the shift is zero looks into the bucket of their hash and compares
the words of each pattern there with those of the text, byte by byte. Many stretches of text are
scanned side by side as numpy arrays.

Defined results: a null text has no words; rows without an item id or without words give no
pattern; repeated items count once by id; a window that two items share counts for both; an item
with fewer words than a window is one window of its own; other columns, null ids and repeated rows
pass through unchanged, and clashing names are refused with a ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import Scratch, small_batches
from .words import ALNUM, Words, match_all, mix, spread, steps, summed

#: Bytes of item text in the tables of one pass, which bounds what is broadcast.
BLOCK_BYTES = 4 << 20
#: Words of text that one lane of the scan covers.
LANE = 256
SLOT_BITS = 18
SPAN = "array<struct<first:int,last:int>>"
ADDED = {"n_words": "bigint", "hits": SPAN, "items": "array<string>"}


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


class Patterns:
    """The shift table, the suffix buckets and the words of the windows of one length."""

    def __init__(self, windows: list[tuple[bytes, ...]]):
        self.length = len(windows[0])
        self.block = min(2, self.length)
        flat = b" ".join(w for x in windows for w in x)
        words = Words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]), ALNUM, False)
        self.data, hashes = words.data, words.hashes().reshape(-1, self.length)
        self.starts = words.starts.reshape(-1, self.length)
        self.sizes = (words.ends - words.starts).reshape(-1, self.length)
        most = self.length - self.block + 1
        self.shift = np.full(1 << SLOT_BITS, most, np.uint8 if most < 256 else np.int32)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.slots(hashes, end), self.length - 1 - end)
        slot = self.slots(hashes, self.length - 1)
        self.order = np.argsort(slot, kind="stable")
        self.bucket = np.searchsorted(slot[self.order], np.arange((1 << SLOT_BITS) + 1))
        self.hashes = hashes

    def slots(self, hashes: np.ndarray, end: int) -> np.ndarray:
        code = hashes[:, end]
        if self.block == 2:
            code = mix(hashes[:, end - 1]) + code
        return (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def scan(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        m, n = self.length, len(hashes)
        starts = np.arange(m - 1, n, LANE)
        at, stop = starts, np.minimum(starts + LANE, n)
        found = []
        while len(at):
            code = hashes[at]
            if self.block == 2:
                code = mix(hashes[at - 1]) + code
            slot = (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            shift = self.shift[slot].astype(np.int64)
            here = shift == 0
            if here.any():
                found.append(np.stack([at[here], slot[here]]))
                shift[here] = 1
            at = at + shift
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, slot = np.concatenate(found, axis=1)
        counts = self.bucket[slot + 1] - self.bucket[slot]
        pattern = self.order[spread(self.bucket[slot], counts)]
        first = np.repeat(ends - m + 1, counts)
        rows = np.searchsorted(words.first, np.stack([first, first + m - 1]), "right")
        keep = rows[0] == rows[1]
        first, pattern = first[keep], pattern[keep]
        for k in range(m):
            keep = hashes[first + k] == self.hashes[pattern, k]
            first, pattern = first[keep], pattern[keep]
        for k in range(m):
            a = words.starts[first + k]
            size = self.sizes[pattern, k]
            keep = words.ends[first + k] - a == size
            keep[keep] = match_all(words.data, a[keep], self.data, self.starts[pattern[keep], k], size[keep])
            first, pattern = first[keep], pattern[keep]
        return first, pattern


class Tables:
    """Everything that one pass needs: Patterns by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                ids = owners.setdefault(tuple(words[i : i + window]), [])
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.passes = []
        for length in sorted({len(x) for x in owners}, reverse=True):
            windows = [x for x in owners if len(x) == length]
            self.passes.append((Patterns(windows), [owners[x] for x in windows]))

    def search(self, column: pa.Array) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        counts, spans, items = [], [], []
        for a, b, data, offsets in steps(column):
            words = Words(data, offsets, ALNUM, True)
            hashes = words.hashes()
            hit = np.zeros(len(hashes) + 1, np.int64)
            ids: list[set[str]] = [set() for _ in range(b - a)]
            for patterns, owners in self.passes:
                first, pattern = patterns.scan(words, hashes)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + patterns.length, -1)
                row = np.searchsorted(words.first, first, "right") - 1
                for pair in np.unique(row * len(owners) + pattern).tolist() if len(row) else ():
                    ids[pair // len(owners)].update(owners[pair % len(owners)])
            covered = np.cumsum(hit)[:-1] > 0
            any_hit = summed(covered, words.first) > 0
            counts += words.counts.tolist()
            items += [sorted(x) for x in ids]
            for i in range(b - a):
                s, e = words.first[i : i + 2]
                if not any_hit[i]:
                    spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(covered[s:e].astype(np.int8), prepend=0, append=0))
                spans.append([{"first": x, "last": y} for x, y in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)])
        return counts, spans, items


def joined_spans(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(a + b, key=lambda s: s["first"]):
        if out and x["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], x["last"])
        else:
            out.append(dict(x))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most size bytes of text (or one longer item), fetched a partition at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string"), F.col(text_col)).distinct()
    block, room = [], size
    for item, text in rows.toLocalIterator():
        cost = len(text.encode()) + 64
        if block and cost > room:
            yield block
            block, room = [], size
        block.append((item, text))
        room -= cost
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (disjoint word spans inside occurrences, ends included) and items (sorted ids)."""
    if clash := {c.lower() for c in docs.columns} & set(ADDED):
        raise ValueError(f"docs already has {sorted(clash)}")
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields])
    at = names.index(text)
    out, later = docs, False
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())]
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    block, number, scratch = next(blocks, []), 0, None
    while True:
        following = next(blocks, None)
        tables = spark.sparkContext.broadcast(Tables(block, window))

        def run(batches, tables=tables, later=later):
            for batch in batches:
                counts, spans, items = tables.value.search(batch.column(at))
                old = batch.columns[: len(names)]
                if later:
                    before = batch.columns[len(names) :]
                    spans = [joined_spans(x, y) if y else x for x, y in zip(before[1].to_pylist(), spans, strict=True)]
                    items = [sorted({*x, *y}) if y else x for x, y in zip(before[2].to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(x, k) for x, k in zip((counts, spans, items), kinds, strict=True))], [*names, *ADDED])

        out, later = out.mapInArrow(run, schema), True
        if following is None:
            return out
        # one block of items at a time is on the driver and the executors: what it found is written before the next is read
        scratch = scratch or Scratch(spark, "items")
        out = scratch.table(out, f"pass-{number}")
        scratch.drop(f"pass-{number - 1}")
        tables.unpersist()
        block, number = following, number + 1


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of a benchmark item."""
    return find_contamination(docs, benchmark, **options).where(F.size("hits") == 0).select(*docs.columns)
