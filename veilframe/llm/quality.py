"""Quality rules: text statistics, and decision lists learned from labelled rows by sequential covering.

fit() grows one conjunction of thresholds at a time on about two thirds of the labelled rows (by a
hash; the largest information gain first), prunes it on the others (the conditions whose loss raises precision
go), keeps it while it is precise there, removes the rows it covers, and starts again. The list is
emitted as one Spark CASE expression, first match first, so applying it needs no Python.

The fit sees at most max_rows labelled rows, taken in the order of a hash of doc_id; the
statistics themselves and the verdicts cover every row.

Defined results: a null or empty text has no words and all statistics 0 (base_failed is true, for
fewer than 50 words); labels that are null, repeated or of unknown documents are left out or count
once a row; with no usable labels the list is empty and only the base decides; other columns and
repeated rows pass through; clashing names are refused with a ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import small_batches
from .words import SPACED, Words, rolled, steps, summed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_digits", "n_marks", "n_stopped", "n_distinct", "n_long", "n_one")
#: What rules look at; each is one count over another.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"),
    "stopped_lines": ("n_stopped", "n_lines"), "distinct": ("n_distinct", "n_words"), "long_words": ("n_long", "n_words"), "single_characters": ("n_one", "n_words"),
}


def _flags(values: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values.encode())] = True
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?;:()[]{}\"'")
_STOP = _flags(".!?")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for a, b, data, offsets in steps(column):
        words = Words(data, offsets, SPACED, False)
        hashes, rows = words.hashes(), words.rows()
        n = b - a
        at, at_row = words.windows(3)
        salt = np.random.default_rng(7).integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64)
        code = rolled(hashes, at, 3) ^ salt[at_row]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        twice = np.zeros(len(code), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeat = np.zeros(len(hashes), bool)
        for k in range(3):
            repeat[at[twice] + k] = True
        code = hashes ^ salt[rows]
        order = np.argsort(code, kind="stable")
        fresh = np.ones(len(code), bool)
        fresh[1:] = code[order[1:]] != code[order[:-1]]
        distinct = np.bincount(rows[order[fresh]], minlength=n)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LEAD[data], out=lead[1:])
        length = lead[words.ends] - lead[words.starts]
        by_byte = lambda flags: summed(flags[data], offsets)  # noqa: B023, E731
        dup, lines, stopped = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = data.tobytes()
        for i in range(n):
            seen: set[bytes] = set()
            for line in raw[offsets[i] : offsets[i + 1]].split(b"\n"):
                bare = line.strip(b" \t\n\r\x0b\x0c")
                if not bare:
                    continue
                lines[i] += 1
                stopped[i] += bare[-1] in b".!?"
                if line in seen:
                    dup[i] += 1
                else:
                    seen.add(line)
        got = {
            "n_words": words.counts, "word_chars": summed(length, words.first), "n_symbols": by_byte(_SYMBOL), "n_dup_lines": dup, "n_repeat_words": summed(repeat, words.first),
            "n_lines": lines, "n_chars_all": lead[offsets[1:]] - lead[offsets[:-1]], "n_upper": by_byte(_UPPER), "n_digits": by_byte(_DIGIT), "n_marks": by_byte(_MARK),
            "n_stopped": stopped, "n_distinct": distinct, "n_long": summed(length > 20, words.first), "n_one": summed(length == 1, words.first),
        }
        for k, v in got.items():
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of COUNTS (bigint) over each whole text."""
    if clash := {c.lower() for c in docs.columns} & set(COUNTS):
        raise ValueError(f"docs already has {sorted(clash)}")
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, T.LongType()) for k in COUNTS)])

    def run(batches):
        for batch in batches:
            got = _measure(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[k].astype(np.int64)) for k in COUNTS)], [*names, *COUNTS])

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, below = RATIOS[name]
    return F.col(top).cast("double") if below is None else F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # true: value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return ratio(self.feature) > self.threshold if self.above else ratio(self.feature) <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction that rejects; what none of them covers is accepted."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejected(self) -> Column:
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    def rule(self) -> Column:
        """The number of the rule that fires, from 1; null for none."""
        out = F.lit(None).cast("int")
        for i, rule in reversed([*enumerate(self.rules, 1)]):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, F.lit(i)).otherwise(out)
        return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition of the largest gain on the live rows: covered bad rows times the gain in bits."""
    p, n = int(bad[live].sum()), int(live.sum())
    base = np.log2(p / n)
    best: tuple[float, Condition | None] = (0.0, None)
    for name, values in x.items():
        v, y = values[live], bad[live]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order].astype(np.int64)
        ends = np.flatnonzero(v[1:] > v[:-1])
        if len(ends) > cuts:
            ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
        if not len(ends):
            continue
        low = np.cumsum(y)[ends]
        for above, pos, size in ((False, low, ends + 1), (True, p - low, n - ends - 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
    return best


def _score(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    covered = np.ones(len(bad), bool)
    for c in rule:
        covered &= c.holds(x)
    n, p = int(covered.sum()), int(bad[covered].sum())
    return (p + 1) / (n + 2), n


def cover(x: dict[str, np.ndarray], bad: np.ndarray, hold: np.ndarray, precision: float = 0.9, max_rules: int = 24, max_conditions: int = 4, cuts: int = 256) -> DecisionList:
    """Learns the list from feature arrays; bad marks rows to reject, hold the rows that prune."""
    left, rules = np.ones(len(bad), bool), []
    for _ in range(max_rules):
        grow, prune = left & ~hold, left & hold
        if bad[grow].sum() < 5 or bad[grow].all():
            break
        live, rule = grow.copy(), []
        while len(rule) < max_conditions and not bad[live].all():
            gain, c = _best(x, bad, live, cuts)
            if c is None:
                break
            rule.append(c)
            live &= c.holds(x)
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}
        best = _score(rule, held, bad[prune])
        while len(rule) > 1:
            tries = [(_score(rule[:i] + rule[i + 1 :], held, bad[prune]), i) for i in range(len(rule))]
            top, i = max(tries)
            if top[0] < best[0]:
                break
            best, rule = top, rule[:i] + rule[i + 1 :]
        covered = np.ones(len(bad), bool)
        for c in rule:
            covered &= c.holds(x)
        seen = covered & left
        if best[1] == 0 or best[0] < precision * (best[1] + 1) / (best[1] + 2) or bad[seen].mean() < precision or not seen.any():
            break
        rules.append(tuple(rule))
        left &= ~covered
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **options) -> DecisionList:
    """Learns from the labelled rows of docs: label 0 is to be rejected, 1 kept."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    rows = with_statistics(rows, "__text").where(~base_failed())
    held = F.pmod(F.xxhash64("__id", F.lit("hold")), F.lit(3)) == 2
    frame = rows.select("__id", "__y", held.alias("__held"), *(ratio(k).alias(k) for k in RATIOS)).toPandas().sort_values(["__id", "__y"], kind="stable")
    x = {k: frame[k].to_numpy(float) for k in RATIOS}
    return cover(x, frame["__y"].to_numpy() == 0, frame["__held"].to_numpy(bool), **options)


def judged(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """docs with its statistics, base_failed, rule (the first that rejects, or null) and kept."""
    out = with_statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("rule", rules.rule())
    return out.withColumn("kept", ~F.col("base_failed") & ~rules.rejected())
