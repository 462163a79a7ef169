"""Exact Jaccard join of word-shingle sets by T-occurrence search, and the groups it links.

1. Each text becomes its set of shingles (64-bit hashes) once. Equal sets form a class, and only
   the first document of a class goes on.
2. A pair that meets the threshold differs in at most H shingles, so if the shingles are dealt by
   a hash into H + E + 1 parts, the two sets agree in E + 1 parts entirely, and in one that is not
   empty unless both sets have more than E empty parts. Parts that two classes share tie them
   together; the ties' connected components are the blocks to search in. H follows from the size
   band, so a pair can never be in different blocks. Shingles that very many documents hold are
   left out of the parts (what differs there only lessens what differs elsewhere). A set that has
   more than E empty parts without them shows the shingles of its prefix besides, the frequent
   ones last in order: of two such sets that meet the threshold, the prefixes share a shingle.
   Which shingles count as frequent changes the blocks, never the result.
3. Within a block, inverted lists map shingles to classes. A search with the shingles of one class
   must find the classes that occur at least T times (DivideSkip): the longest lists are set
   aside, the others are merged, and what occurs often enough there is looked up in the long
   lists by binary search, dropping candidates that can no longer reach T. The exact test follows.
4. Blocks of many classes are cut into slices, and each pair of slices is searched by a task of
   its own; tasks emit counts and a spanning forest of the links, never the pairs.

Defined results: a null text, or one without words, has an empty set, no links and is its own
component; fewer words than a shingle make one shingle of the whole; rows with a null id get null
as their component and link nothing; rows that repeat an id are documents of their own that share
the id; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from .graph import components
from .scratch import Scratch, small_batches
from .words import SPACED, Words, mix, rolled, short_rows, steps

#: Classes of a block that one task searches against as many.
SLICE = 512
#: Rows of about 100 bytes that may be broadcast.
MOST_BROADCAST = 500_000


class Sets:
    """The distinct shingle hashes of each row of a column, ascending, in one array."""

    def __init__(self, column: pa.Array, size: int):
        parts, counts = [], []
        for a, b, data, offsets in steps(column):
            words = Words(data, offsets, SPACED, True)
            hashes = words.hashes()
            at, row = words.windows(size)
            code = rolled(hashes, at, size)
            for r in short_rows(words, size).tolist():
                s, e = words.first[r : r + 2]
                row = np.append(row, r)
                code = np.append(code, rolled(hashes, np.array([s]), int(e - s)) ^ np.uint64(e - s))
            order = np.lexsort((code, row))
            code, row = code[order], row[order]
            fresh = np.ones(len(code), bool)
            fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            parts.append(code[fresh])
            counts.append(np.bincount(row[fresh], minlength=b - a))
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)


class Bands:
    """Size bands. The scheme of a band serves the pairs whose smaller set lies in it."""

    #: The largest size of a band over its smallest: wide bands make larger H, narrow ones more sets with two schemes.
    WIDTH = Fraction(5, 4)

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.top = [0]  # band k holds sizes in (top[k-1], top[k]]

    def of(self, n: int) -> int:
        while self.top[-1] < n:
            self.top.append(math.floor(self.WIDTH * (self.top[-1] + 1)))
        return int(np.searchsorted(self.top, n))

    def parts(self, band: int) -> tuple[int, int]:
        """(H + E + 1, E) for the pairs of a band; (0, 0) if only equal sets can meet the threshold."""
        top = self.top[band]
        h = math.floor((top + math.floor(top / self.t)) * (1 - self.t) / (1 + self.t))
        return (h + h // 4 + 2, h // 4 + 1) if h else (0, 0)

    def keys(self, codes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """The keys of the parts of a set, for its own band and, where it may be the larger set of a pair there, the one below."""
        out = [np.zeros(0, np.uint64)]
        own, crowded = self.of(len(codes)), False
        at = np.searchsorted(frequent, codes)
        at[at == len(frequent)] = 0
        rare = codes[frequent[at] != codes] if len(frequent) else codes
        for band in (own, own - 1):
            if band != own and len(codes) * self.t > self.top[band]:
                continue
            n, spare = self.parts(band)
            if not n:
                continue
            full, key = _parts(rare, n, band << 32)
            out.append(key)
            crowded |= n - len(full) > spare
        if crowded:
            rest = np.setdiff1d(codes, rare, assume_unique=True)
            order = np.concatenate([rare[np.argsort(mix(rare))], rest[np.argsort(mix(rest))]])
            out.append(mix(order[: len(codes) - math.ceil(self.t * len(codes)) + 1] ^ np.uint64(0x5DEECE66D)))
        return np.concatenate(out)


def _parts(codes: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(the parts that are not empty, their keys) of codes dealt into n parts."""
    part = (mix(codes ^ np.uint64(salt)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    full, at = np.unique(part[order], return_index=True)
    if not len(full):
        return full, np.zeros(0, np.uint64)
    total = np.add.reduceat(mix(codes ^ np.uint64(0xA5A5A5A5))[order], at)
    return full, mix(total + mix(full.astype(np.uint64) + np.uint64(salt)))


#: Shingles that count as frequent: the commonest, at most MOST_FREQUENT, and only from FREQUENT documents on.
FREQUENT, MOST_FREQUENT = 16, 200_000
#: A task counts so many of its shingles at a time, and reports those that stand there so often.
_COUNTED, _REPORTED = 2 << 20, 3


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The hashes of shingles that very many documents hold, ascending. Every document is counted."""
    small_batches(docs.sparkSession)

    def run(batches):
        tokens.release()
        held, n = np.empty(_COUNTED, np.uint64), 0

        def report(n):
            run = held[:n]
            run.sort()
            at = np.flatnonzero(np.diff(run, prepend=~run[:1]))
            count = np.diff(np.append(at, n))
            at, count = at[count >= _REPORTED], count[count >= _REPORTED]
            return pa.RecordBatch.from_arrays([pa.array(run[at].view(np.int64)), pa.array(count)], ["code", "n"])

        for batch in batches:
            codes = Sets(batch.column(1), size).codes
            while len(codes):
                part, codes = codes[: _COUNTED - n], codes[_COUNTED - n :]
                held[n : n + len(part)] = part
                n += len(part)
                if n == _COUNTED:
                    yield report(n)
                    n = 0
        if n:
            yield report(n)

    tally = docs.select("doc_id", "text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    top = tally.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "code").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["code"] for r in top], np.int64).view(np.uint64))


#: Classes that a task remembers, to write the keys of each once.
_SEEN = 500_000


def sketches(docs: DataFrame, threshold: Fraction, size: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set, null if empty) and the keys of its parts (null where the task met the class before)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        tokens.release()
        bands = Bands(threshold)
        seen: set[bytes] = set()
        for batch in batches:
            sets = Sets(batch.column(1), size)
            digests, keys = [], []
            for s, e in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True):
                if s == e:
                    digests.append(None)
                    keys.append(None)
                    continue
                codes = sets.codes[s:e]
                digests.append(digest(codes))
                keys.append(None if digests[-1] in seen else bands.keys(codes, shared.value).view(np.int64))
                if len(seen) < _SEEN:
                    seen.add(digests[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class binary, keys array<bigint>")


class Lists:
    """Inverted lists over the sets of some classes, and searches with DivideSkip."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.t = threshold
        self.sizes = np.array([len(x) for x in sets])
        codes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, codes))
        codes, self.owner = codes[order], owner[order]
        self.tokens, self.begin = np.unique(codes, return_index=True)
        self.length = np.diff(np.append(self.begin, len(codes)))
        token = np.repeat(np.arange(len(self.tokens)), self.length)
        self.n = len(sets)
        self.postings = token * self.n + self.owner  # ascending

    def search(self, codes: np.ndarray) -> np.ndarray:
        """The sets that meet the threshold with codes."""
        least = math.ceil(self.t * len(codes))  # the overlap that any partner needs
        at = np.searchsorted(self.tokens, codes)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == codes]
        if len(at) < least:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        longest = self.length[at[-1]]
        n_long = min(least - 1, int(least / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.sort(np.concatenate([self.owner[b : b + n] for b, n in zip(self.begin[short].tolist(), self.length[short].tolist(), strict=True)]))
        edge = np.flatnonzero(np.diff(merged, prepend=-1))
        found, count = merged[edge], np.diff(np.append(edge, len(merged)))
        up, down = self.t.numerator, self.t.denominator
        size = self.sizes[found]
        fits = (size * down >= up * len(codes)) & (size * up <= down * len(codes)) & (count >= least - n_long)
        found, count = found[fits], count[fits]
        step = 16
        for k in range(0, len(long), step):
            if not len(found):
                break
            probe = (long[k : k + step, None] * self.n + found[None, :]).ravel()
            place = np.searchsorted(self.postings, probe)
            place[place == len(self.postings)] = 0
            count = count + (self.postings[place] == probe).reshape(-1, len(found)).sum(axis=0)
            may = count + max(0, len(long) - k - step) >= least
            found, count = found[may], count[may]
        union = len(codes) + self.sizes[found] - count
        return found[count * down >= union * up]


def digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def _search_block(frame: pd.DataFrame, threshold: Fraction, size: int) -> tuple[list[tuple], list[tuple]]:
    """(links, edges) of rows (cls, copies, text, side): within one slice (side 0 only) or between sides 0 and 1."""
    sets = Sets(pa.array(frame["text"], pa.large_string()), size)
    codes = [sets.codes[s:e] for s, e in zip(sets.first[:-1], sets.first[1:], strict=True)]
    # a repeated id may have brought the text of another class
    frame = frame.assign(at=np.arange(len(frame)))[[digest(x) == c for x, c in zip(codes, frame["cls"], strict=True)]].drop_duplicates(["cls", "side"])
    codes = [codes[i] for i in frame["at"]]
    cls, copies, side = frame["cls"].to_numpy(), frame["copies"].to_numpy(), frame["side"].to_numpy()
    mine = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if (side == 1).any() else mine
    if not len(mine):
        return [], []
    lists = Lists([codes[i] for i in other], threshold)
    links = np.zeros(len(frame), np.int64)
    root = np.arange(len(frame))
    edges = []
    for q in mine.tolist():
        found = other[lists.search(codes[q])]
        found = found[found != q]
        if not len(found):
            continue
        links[q] += copies[found].sum()
        if other is not mine:
            links[found] += copies[q]
        for r in np.unique(root[found]).tolist():
            if r != root[q]:
                edges.append((cls[q], cls[int(found[root[found] == r][0])], 0))
                root[root == r] = root[q]
    return [(c, None, int(n)) for c, n in zip(cls, links, strict=True) if n], edges


def linked(docs: DataFrame, threshold: Fraction = Fraction(9, 10), size: int = 3, doc_id: str = "doc_id", text: str = "text", slice_size: int = SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), n_links (documents that it links with)."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = scratch.table(sketches(docs, threshold, size, frequent_shingles(docs, size)), "sketches")
    # Classes go by 64-bit codes here; should two share one, their blocks are searched together.
    keys = found.where("keys IS NOT NULL AND doc_id IS NOT NULL").select(F.xxhash64("class").alias("code"), F.explode("keys").alias("key"))
    # A class has a key for each of many parts, so even the keys of a large family of copies spread.
    ties = keys.withColumn("least", F.min("code").over(Window.partitionBy("key"))).where("code > least").select(F.col("code").alias("a"), F.col("least").alias("b"))
    blocks = components(ties, scratch, "ties").select(F.col("node").alias("code"), F.col("component").alias("block"))
    found = scratch.table(found.drop("keys"), "ids")
    members = found.where("class IS NOT NULL AND doc_id IS NOT NULL").withColumnRenamed("class", "cls")
    classes = scratch.table(members.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "classes")
    blocks = scratch.table(classes.withColumn("code", F.xxhash64("cls")).join(blocks, "code").drop("code"), "blocks")
    del keys, ties
    scratch.drop("sketches")
    scratch.release()

    slices = blocks.groupBy("block").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("slices"))
    rows = blocks.join(slices, "block").withColumn("slice", F.pmod(F.hash("cls"), F.col("slices")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select(
        "cls", "doc", "copies", "block", F.least("slice", "other").alias("x"), F.greatest("slice", "other").alias("y"),
        (F.col("slice") > F.col("other")).cast("int").alias("side"),
    )
    # Few rows go to the texts; beyond a bound both sides are shuffled.
    rows = scratch.table(rows, "rows")
    rows = F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows.hint("shuffle_merge")
    work = rows.join(docs, F.col("doc") == F.col("doc_id")).select("block", "x", "y", "side", "cls", "copies", "text")
    work = work.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")

    def run(batches):
        def batch_of(frames):
            links, edges = _search_block(pd.concat(frames, ignore_index=True), threshold, size)
            columns = [*zip(*links, *edges, strict=True)] or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "n"])

        # Blocks smaller than a slice are searched many at a time; what they share is as exact there.
        wait: list[pd.DataFrame] = []
        n, last = 0, None
        for batch in batches:
            for key, part in batch.to_pandas().groupby(["block", "x", "y"], sort=False):
                if wait and key != last and (n >= slice_size or key[1:] != (0, 0) or last[1:] != (0, 0)):
                    yield batch_of(wait)
                    wait, n = [], 0
                wait.append(part)
                n, last = n + len(part), key
        if wait:
            yield batch_of(wait)

    result = scratch.table(work.mapInArrow(run, "a binary, b binary, n bigint"), "result")
    groups = scratch.table(components(result.where("b IS NOT NULL"), scratch, "links").withColumnRenamed("node", "cls"), "groups")
    least = groups.join(classes.select("cls", "doc"), "cls").groupBy("component").agg(F.min("doc").alias("component_id"))
    groups = groups.join(least, "component").drop("component")
    links = result.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    by_class = classes.select("cls", "doc", "copies").join(groups, "cls", "left").join(links, "cls", "left").where("copies > 1 OR component_id IS NOT NULL")
    by_class = by_class.select("cls", F.coalesce("component_id", "doc").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = found.join(by_class, F.col("class") == F.col("cls"), "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that link with a document of a smaller id, directly or through others; rows without id stay."""
    groups = linked(docs, doc_id=doc_id, **options).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(groups, F.col(doc_id) == F.col("__gone"), "left_anti")
