"""Best-fit packing of tokenized documents into sequences under several capacities at once.

Each text is tokenized, ended, and cut into pieces only where it is longer than a sequence. A bin
has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces come longest first; each goes into the open bin that has room in every dimension and whose
remaining capacity would have the smallest weighted norm (or, by choice, the largest weighted dot
product with the demand); if none has room a bin is opened.

Pieces are dealt by a hash into groups of about group_size, packed independently, so no task holds
more than a group however the input grows; bins that stay open are packed again together with
those of other groups, which leaves about one loose bin for each group_size loose pieces.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows and
repeated or null ids are packed as separate documents; other columns are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import Scratch, small_batches
from .tokens import encoder, text_steps


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. documents and cost default to what tokens allow anyway."""

    tokens: int = 4096
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    choice: str = "norm"  # or "dot"

    def limits(self) -> np.ndarray:
        out = np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], float)
        if self.tokens < 1 or out[2] < self.tokens**2:
            raise ValueError("a full piece must fit into a sequence")
        return out


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ties go to the earlier piece and the earlier bin."""
    limits, weights = capacity.limits(), np.array(capacity.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((len(lengths), 3))
    n_bins = 0
    live = np.zeros(0, np.int64)  # bins that may still take the shortest piece
    least = lengths.min() if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        d = demand[i]
        left = room[live]
        fits = np.flatnonzero((left >= d).all(axis=1))
        if len(fits):
            rest = (left[fits] - d) / limits if capacity.choice == "norm" else left[fits] / limits
            score = (weights * rest * rest).sum(axis=1) if capacity.choice == "norm" else -(weights * rest * (d / limits)).sum(axis=1)
            at = live[fits[np.argmin(score)]]
        else:
            at = n_bins
            room[at] = limits
            live = np.append(live, at)
            n_bins += 1
        where[i], offset[i] = at, limits[0] - room[at, 0]
        room[at] -= d
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least**2:
            live = live[live != at]
    return where, offset


_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>, salt bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", most: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids (null unless kept), salt."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_PIECE).fields])

    def run(batches):
        enc, n_seen = encoder(tokenizer), 0
        for batch in batches:
            row, out = 0, {k: [] for k in schema.names[1:]}
            owner = []
            for texts in text_steps(batch.column(1).to_pylist()):
                ids, counts = enc.ids(texts)
                at = 0
                for n in counts.tolist():
                    own = np.append(ids[at : at + n], np.uint32(end_id))
                    at += n
                    for piece, start in enumerate(range(0, n + 1, most)):
                        part = own[start : start + most]
                        for k, v in (("piece", piece), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.astype("<u4").tobytes())), ("ids", part.astype(np.int32) if keep_ids else None), ("salt", n_seen)):
                            out[k].append(v)
                        owner.append(row)
                        n_seen += 1
                    row += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], schema.names)

    return docs.mapInArrow(run, schema)


def _packed(rows: DataFrame, n: int, capacity: Capacity, group_size: int, salt: int) -> DataFrame:
    """rows with sequence_id, offset and fill; groups of about group_size by a hash."""
    groups = max(1, -(-n // group_size))
    names = [c for c in rows.columns if c not in ("sequence_id", "offset", "fill")]
    rows = rows.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(salt)), F.lit(groups)).alias("group"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "salt", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        where, offset = pack(lengths, capacity)
        fill = np.bincount(where, weights=lengths).astype(np.int64)
        return frame.assign(sequence_id=where + frame["group"].to_numpy() * (1 << 24), offset=offset, fill=fill[where])

    return rows.groupBy("group").applyInPandas(run, schema).drop("group")


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: Capacity = Capacity(), group_size: int = 2048, full: float = 0.99, keep_ids: bool = False, **columns: str) -> DataFrame:
    """The pieces of docs with sequence_id and offset (gapless from 0 within a sequence)."""
    scratch = Scratch(docs.sparkSession, "packing")
    found = scratch.table(pieces(docs, tokenizer, end_id, most=capacity.tokens, keep_ids=keep_ids, **columns), "pieces")
    first = scratch.table(_packed(found, found.count(), capacity, group_size, 1), "first")
    scratch.drop("pieces")
    closed = F.col("fill") >= full * capacity.tokens
    n_open = first.where(~closed).count()
    again = _packed(first.where(~closed), n_open, capacity, group_size, 2)
    again = again.withColumn("sequence_id", -1 - F.col("sequence_id"))
    return first.where(closed).unionByName(again).drop("salt", "fill")
