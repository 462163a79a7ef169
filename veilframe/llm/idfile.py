"""Token-id files: adaptive context mixing and a range coder, in blocks that stand alone.

A block is up to BLOCK ids of consecutive documents. Its model starts from nothing:

- order 2 and order 1 each predict the id that last followed the two ids, or the id, before;
- whether either prediction holds is one symbol of three (order-2 hit, order-1 hit, neither). Its
  frequencies are the sum of two adaptive models, one under the last two such symbols and whether
  the predictions agree, one under the previous id;
- if neither holds, the id is coded by order 0: every id has frequency 1, and WEIGHT more for each
  time that it stands in the part of the block coded before the last power of two. With that part
  sorted, an id's cumulative frequency is id + WEIGHT * rank, and decoding is one binary search.

A carry-less range coder of 60 bits writes 16-bit words, once for each id. Blocks are coded side by side, one numpy
lane each. A record holds a magic number, the vocabulary size, and for each block its ids, bytes
and the CRC-32 of its ids; a block whose checksum does not match is a ValueError.

Records lie in a Parquet table, with the documents that they hold, in ascending doc_id: reading
them needs no shuffle, and executors need no file system of their own.

Defined results: a null or empty text has the end id alone; a null doc_id sorts first; rows that
repeat an id lie side by side, ordered by text; an id outside the vocabulary is a ValueError; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .compact import deal
from .scratch import small_batches
from .tokens import encoder, text_steps
from .words import spread

BLOCK = 4096
#: Blocks that are coded side by side.
LANES = 768
WEIGHT = 64
MAGIC = b"VIDS"
_SLOTS = 4096
_TOP, _LOW, _MASK = 1 << 44, 1 << 40, (1 << 60) - 1
_FLAG_STEP, _FLAG_MOST = 24, 1 << 13


class _Model:
    """The adaptive state of n lanes, the same for coding and decoding. Lane i owns row i of every table, laid out flat."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.after1, self.after2 = np.full(n * _SLOTS, -1, np.int32), np.full(n * _SLOTS, -1, np.int32)
        self.flag_a = np.tile(np.array([2, 2, 12], np.int64), (n * 18, 1))
        self.flag_b = np.tile(np.array([1, 1, 6], np.int64), (n * 64, 1))
        self.slots, self.row_a, self.row_b, self.row3 = lane * _SLOTS, lane * 18, lane * 64, lane * 3
        self.last, self.before, self.flags = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 8, np.int64)

    def predict(self, m: int) -> None:
        last = self.last[:m]
        self.at1 = self.slots[:m] + (last & (_SLOTS - 1))
        self.at2 = self.slots[:m] + ((last * 40503 + self.before[:m] * 30011) & (_SLOTS - 1))
        self.p1, self.p2 = self.after1[self.at1], self.after2[self.at2]
        self.a = self.row_a[:m] + self.flags[:m] * 2 + (self.p1 == self.p2)
        self.b = self.row_b[:m] + (last & 63)
        self.sums = np.cumsum(self.flag_a[self.a] + self.flag_b[self.b], axis=1)
        self.total = self.sums[:, 2]

    def span(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative frequency, frequency) of each lane's flag."""
        end = self.sums.ravel()[self.row3[: len(flag)] + flag]
        begin = np.where(flag > 0, self.sums.ravel()[self.row3[: len(flag)] + flag - 1], 0)
        return begin, end - begin

    def update(self, ids: np.ndarray, flag: np.ndarray) -> None:
        m = len(ids)
        for table, at in ((self.flag_a, self.a), (self.flag_b, self.b)):
            table.reshape(-1)[at * 3 + flag] += _FLAG_STEP
        big = np.flatnonzero(self.total > _FLAG_MOST)
        if len(big):
            for table, at in ((self.flag_a, self.a[big]), (self.flag_b, self.b[big])):
                table[at] = (table[at] + 1) >> 1
        self.after1[self.at1] = ids
        self.after2[self.at2] = ids
        self.before[:m], self.last[:m] = self.last[:m], ids
        self.flags[:m] = (self.flags[:m] * 3 + flag) % 9


def _epoch(t: int) -> int:
    """How many ids of the block the order-0 model knows when the id at t is coded."""
    return 0 if t < 32 else 1 << (t.bit_length() - 1)


def _settle(low: np.ndarray, rng: np.ndarray, m: int):
    """Shifts words out of the first m lanes until each range is wide again; yields (lanes, low before the shift)."""
    who, lo, r = None, low[:m], rng[:m]
    while True:
        same = (lo ^ (lo + r)) < _TOP
        move = np.flatnonzero(same | (r < _LOW))
        if not len(move):
            return
        who = move if who is None else who[move]
        lo = lo[move]
        r = np.where(same[move], r[move], -lo & (_LOW - 1))
        yield who, lo
        lo, r = (lo & (_TOP - 1)) << 16, r << 16
        low[who], rng[who] = lo, r


def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks by falling length, one lane each; lanes that have an id at t; place of each id in a grid of t by lane)."""
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max(initial=0))
    live = np.searchsorted(-counts[order], -np.arange(longest), "left")
    back = np.empty(len(counts), np.int64)
    back[order] = np.arange(len(counts))
    place = spread(np.zeros(len(counts), np.int64), counts) * len(counts) + np.repeat(back, counts)
    return order, live, place


def encode_blocks(ids: np.ndarray, counts: np.ndarray, vocab: int) -> list[bytes]:
    """The coded bytes of consecutive blocks of ids (counts[i] of them)."""
    if len(ids) and (int(ids.max()) >= vocab or int(ids.min()) < 0):
        raise ValueError("an id lies outside the vocabulary")
    order, live, place = _grid(counts)
    n, longest = len(counts), len(live)
    grid = np.zeros((longest, n), np.int64)
    grid.ravel()[place] = ids
    model = _Model(n)
    low, rng = np.zeros(n, np.int64), np.full(n, _MASK, np.int64)
    words, at = np.zeros((n, longest * 3 + 8), np.uint16), np.zeros(n, np.int64)
    known, base = -1, 0
    for t in range(longest):
        m = int(live[t])
        if _epoch(t) != known:
            known, base = _epoch(t), t
            part = grid[t : min(longest, max(32, 2 * known)), :m]
            offset, skip = np.arange(m) << 32, np.arange(m) * known
            past = (np.sort(grid[:known, :m].T, axis=1) + offset[:, None]).ravel()
            want = part + offset
            left = np.searchsorted(past, want) - skip
            start0, size0 = part + WEIGHT * left, 1 + WEIGHT * (np.searchsorted(past, want, "right") - skip - left)
            total0 = vocab + WEIGHT * known
        x = grid[t, :m]
        model.predict(m)
        flag = np.where(x == model.p2, 0, np.where(x == model.p1, 1, 2))
        begin, size = model.span(flag)
        unit = rng[:m] // model.total
        low[:m] += begin * unit
        rng[:m] = size * unit
        miss = np.flatnonzero(flag == 2)
        if len(miss):
            unit = rng[miss] // total0
            low[miss] += start0[t - base, miss] * unit
            rng[miss] = size0[t - base, miss] * unit
        for who, lo in _settle(low, rng, m):
            words[who, at[who]] = lo >> 44
            at[who] += 1
        model.update(x, flag)
    for shift in (44, 28, 12):
        words[np.arange(n), at] = (low >> shift) & 0xFFFF
        at += 1
    words[np.arange(n), at] = (low << 4) & 0xFFFF
    out: list[bytes] = [b""] * n
    for lane, block in enumerate(order.tolist()):
        out[block] = words[lane, : at[lane] + 1].astype("<u2").tobytes()
    return out


def decode_blocks(coded: list[bytes], counts: np.ndarray, vocab: int) -> np.ndarray:
    """The ids of the blocks, in their order."""
    order, live, place = _grid(counts)
    n, longest = len(counts), len(live)
    cap = max((len(x) for x in coded), default=0) // 2 + 4
    words = np.zeros((n, cap), np.int64)
    for lane, block in enumerate(order.tolist()):
        w = np.frombuffer(coded[block], "<u2")
        words[lane, : len(w)] = w
    low, rng = np.zeros(n, np.int64), np.full(n, _MASK, np.int64)
    # The coder holds 60 bits, that is three words and twelve bits of the fourth, which the next shift completes.
    code = (words[:, 0] << 44) | (words[:, 1] << 28) | (words[:, 2] << 12) | (words[:, 3] >> 4)
    at = np.full(n, 3)
    model = _Model(n)
    grid = np.zeros((longest, n), np.int64)
    known = -1
    for t in range(longest):
        m = int(live[t])
        if _epoch(t) != known:
            known = _epoch(t)
            past = np.sort(grid[:known, :m].T, axis=1)
            run = np.arange(known)
            fresh = np.diff(past, axis=1, prepend=-1) > 0
            left_of = np.maximum.accumulate(np.where(fresh, run, 0), axis=1).ravel()
            final = np.roll(fresh, -1, axis=1)
            final[:, -1:] = True
            right_of = np.minimum.accumulate(np.where(final, run + 1, known)[:, ::-1], axis=1)[:, ::-1].ravel()
            steps = ((past + WEIGHT * run) + (np.arange(m) << 32)[:, None]).ravel()
            past = past.ravel()
            total0 = vocab + WEIGHT * known
        model.predict(m)
        unit = rng[:m] // model.total
        got = np.minimum((code[:m] - low[:m]) // unit, model.total - 1)
        flag = (got >= model.sums[:, 0]).astype(np.int64) + (got >= model.sums[:, 1])
        begin, size = model.span(flag)
        low[:m] += begin * unit
        rng[:m] = size * unit
        x = np.where(flag == 0, model.p2, model.p1).astype(np.int64)
        miss = np.flatnonzero(flag == 2)
        if len(miss):
            unit = rng[miss] // total0
            got = np.minimum((code[miss] - low[miss]) // unit, total0 - 1)
            value, left, count = got, 0, 0
            if known:
                rank = np.searchsorted(steps, got + (miss << 32), "right") - miss * known
                near = miss * known + np.maximum(rank - 1, 0)
                seen = (rank > 0) & (got < past[near] + WEIGHT * rank + 1)
                value = np.where(seen, past[near], got - WEIGHT * rank)
                left = np.where(seen, left_of[near], rank)
                count = np.where(seen, right_of[near] - left_of[near], 0)
            low[miss] += (value + WEIGHT * left) * unit
            rng[miss] = (1 + WEIGHT * count) * unit
            x[miss] = value
        for who, _ in _settle(low, rng, m):
            code[who] = ((code[who] & (_TOP - 1)) << 16) | ((words[who, np.minimum(at[who], cap - 2)] & 15) << 12) | (words[who, np.minimum(at[who] + 1, cap - 1)] >> 4)
            at[who] += 1
        model.update(x, flag)
        grid[t, :m] = x
    return grid.ravel()[place]


def pack_record(ids: np.ndarray, counts: np.ndarray, vocab: int) -> bytes:
    """One record of consecutive blocks."""
    ids = ids.astype(np.int64)
    coded = encode_blocks(ids, counts, vocab)
    ends = np.cumsum(counts)
    head = [struct.pack("<4sIQ", MAGIC, len(counts), vocab)]
    for data, end, n in zip(coded, ends.tolist(), counts.tolist(), strict=True):
        head.append(struct.pack("<III", n, len(data), zlib.crc32(ids[end - n : end].astype("<u4").tobytes())))
    return b"".join(head + coded)


def unpack_record(record: bytes) -> np.ndarray:
    """The ids of a record, with every block's checksum verified."""
    magic, n, vocab = struct.unpack_from("<4sIQ", record)
    if magic != MAGIC:
        raise ValueError("not a record of token ids")
    table = np.frombuffer(record, "<u4", 3 * n, 16).reshape(n, 3).astype(np.int64)
    ends = 16 + 12 * n + np.cumsum(table[:, 1])
    coded = [record[e - size : e] for e, size in zip(ends.tolist(), table[:, 1].tolist(), strict=True)]
    ids = decode_blocks(coded, table[:, 0], vocab)
    for end, (count, _, crc) in zip(np.cumsum(table[:, 0]).tolist(), table.tolist(), strict=True):
        if zlib.crc32(ids[end - count : end].astype("<u4").tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
    return ids


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Writes the ids of docs, each ended by end_id, in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # as many parts as the session has, and more where the input is larger than they should hold
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), deal(docs, 1.0).n // 4)
    docs = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        vocab = max(enc.library.get_vocab_size(), end_id + 1)
        number, n, held, owners, sizes = 0, 0, [], [], []

        def record():
            ids = np.concatenate(held)
            counts = np.full(-(-len(ids) // block), block)
            counts[-1] = len(ids) - block * (len(counts) - 1)
            columns = [[shard], [number], [len(ids)], [pack_record(ids, counts, vocab)]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
            own = pa.concat_arrays(owners)
            ends = np.array([0, len(own)], np.int32)
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, own), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sizes)))], ["shard", "record", "n_ids", "payload", "docs", "sizes"])

        for batch in batches:
            at = 0
            for texts in text_steps(batch.column(1).to_pylist()):
                ids, counts = enc.ids(texts)
                own = np.empty(len(ids) + len(counts), np.int64)
                ends = np.cumsum(counts + 1)
                own[ends - 1] = end_id
                rest = np.ones(len(own), bool)
                rest[ends - 1] = False
                own[rest] = ids
                held.append(own)
                sizes.append(counts + 1)
                owners.append(batch.column(0).slice(at, len(texts)))
                at, n = at + len(texts), n + len(own)
                if n >= LANES * block:
                    yield record()
                    number, n, held, owners, sizes = number + 1, 0, [], [], []
        if held:
            yield record()

    schema = f"shard int, record int, n_ids bigint, payload binary, docs array<{kind}>, sizes array<bigint>"
    docs.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) from the files at path."""
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType
    # A few records at a time: an Arrow batch holds what its payloads decode to.
    small_batches(spark)
    # Sums of shards first: one row for each shard is ordered as a whole, the records of a shard on their own.
    order = files.select("shard", "record", "n_ids")
    shards = order.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1))
    before = order.withColumn("own", F.coalesce(own, F.lit(0))).join(shards, "shard")
    before = before.select(F.col("shard").alias("s"), F.col("record").alias("r"), (F.col("base") + F.col("own")).alias("before"))
    files = files.join(before, (F.col("shard") == F.col("s")) & (F.col("record") == F.col("r"))).select("before", "payload", "docs", "sizes")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack_record(batch.column(1)[i].as_py()).astype("<u4")
                sizes = np.array(batch.column(3)[i].as_py(), np.int64)
                docs = batch.column(2)[i].values
                ends = np.cumsum(sizes)
                for a in range(0, len(sizes), 512):
                    b = min(len(sizes), a + 512)
                    part = [ids[e - n : e].tobytes() for e, n in zip(ends[a:b].tolist(), sizes[a:b].tolist(), strict=True)]
                    start = batch.column(0)[i].as_py() + ends[a:b] - sizes[a:b]
                    yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(start), pa.array(sizes[a:b]), pa.array(part, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, f"doc_id {kind.simpleString()}, start bigint, n_tokens bigint, ids binary")
