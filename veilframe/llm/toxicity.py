"""Toxicity of texts whose words may be disguised: a noisy channel restores them, then words are scored.

1. A character language model of order 4 (26 letters and the word boundary, accents folded) is
   counted over every document. Its table has at most 27**4 entries.
2. A chunk between spaces that mixes letters with look-alikes, puts marks between letters or
   stretches a letter, and a run of single characters, becomes a lattice: each character offers
   the letters that it may stand for, or nothing, at a channel cost; a mark, and the gap between two
   single characters, may also be a word boundary. Viterbi finds the cheapest path under the model,
   over the whole chunk or run, however long. Any other chunk is its own letters.
3. Words that tell toxic training rows from others (the n_words largest log-odds that are
   significant) enter a logistic regression, fitted on at most max_rows labelled rows in the order
   of a hash of doc_id. Whether a word is in the restored text is all that the score sees.

Defined results: a null or empty text has no words and gets the score of the intercept; repeated
rows score alike; labels that are null or repeated are left out or count once; without labels of
both classes the score is 0 for all; other columns pass through; clashes are a ValueError.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import Scratch, small_batches

ADDED = ("score", "predicted")
_N = 27
#: Look-alikes and the letters that they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
#: Channel costs (natural logarithms): a letter as it is, a look-alike, a dropped mark, a letter dropped from
#: two equal ones and from three or more.
KEEP, LIKE, DROP, TWICE, REPEAT = math.log(0.95), math.log(0.04), math.log(0.02), math.log(0.001), math.log(0.3)
#: A word boundary in place of a mark, and between two characters of a run of single ones.
BREAK, SPLIT = math.log(0.02), math.log(0.05)
_FOLD = {c: unicodedata.normalize("NFD", chr(c))[0].lower() for c in range(0xC0, 0x250)}
_FOLD = {c: x for c, x in _FOLD.items() if "a" <= x <= "z"} | {0xDF: "s"}
_SYMBOL = np.zeros(0x250, np.int64)
for _c in range(26):
    _SYMBOL[[0x41 + _c, 0x61 + _c]] = _c + 1
for _c, _x in _FOLD.items():
    _SYMBOL[_c] = ord(_x) - 0x60
_SINGLES = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ \t](?:[^\W_]|[@$!|+])(?!\S)){2,}")
_MIXED = re.compile(r"(?=.*[a-z])(?:.*[a-z][^a-z]+[a-z]|[^a-z\s]+[a-z]|.*[a-z][0-9@$!|+€£(]+|.*([a-z])\1\1)")
_STRETCHED = re.compile(r"(.)\1\1")
_MARKS = "\"'.,;:?)]}<>[{#*%&=~`^-_/\\"
#: What ends a chunk without being part of its word.
_TAIL = re.compile(r"(?:[\"'.,;:?!)\]}<>#*%&=~`^\-_/\\]|([$|+(])\1+)+$")
CACHE = 400_000


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of each four symbols in a row over all texts; what lies before a boundary counts as boundary."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(_N**4, np.int64)
        for batch in batches:
            column = batch.column(0).drop_null().to_pylist()
            for at in range(0, len(column), 200):
                points = np.frombuffer("\n".join(column[at : at + 200]).encode("utf-32-le"), np.uint32)
                s = np.zeros(len(points) + 4, np.int64)
                s[3:-1] = np.where(points < 0x250, _SYMBOL[np.minimum(points, 0x24F)], 0)
                x, c, b = s[3:], s[2:-1], s[1:-2]
                b = np.where(c > 0, b, 0)
                a = np.where(b > 0, s[:-3], 0)
                live = (x > 0) | (c > 0)
                total += np.bincount((((a * _N + b) * _N + c) * _N + x)[live], minlength=_N**4)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["gram", "n"])

    found = docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_N**4, np.int64)
    out[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Restorer:
    """Restores chunks under the language model of some counts."""

    def __init__(self, counts: np.ndarray):
        whole = counts.reshape(_N, _N, _N, _N).astype(float)
        p = np.full(_N, 1.0 / _N)
        for level in (whole.sum((0, 1, 2)), whole.sum((0, 1)), whole.sum(0), whole):
            kinds = (level > 0).sum(-1, keepdims=True) + 1.0  # Witten-Bell: unseen mass by how many follow
            p = (level + kinds * p) / (level.sum(-1, keepdims=True) + kinds)
        self.logp = np.log(p).reshape(_N**3, _N).astype(np.float32)
        self.known: dict[str, str] = {}

    def viterbi(self, chunk: str, spaced: bool = False) -> str:
        """The words of the cheapest path through the lattice of a lower-cased, folded chunk; spaced: each character stood alone."""
        beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # a path is (path before, symbol)
        logp, before = self.logp, ""
        for i, ch in enumerate(chunk):
            if spaced and i:
                # the boundary is its own step, so that a state keeps both ways
                ended = max(((score + SPLIT + float(logp[state, 0]), (path, " ")) for state, (score, path) in beam.items() if state), key=lambda x: x[0], default=None)
                if ended and (0 not in beam or ended[0] > beam[0][0]):
                    beam[0] = ended
            if "a" <= ch <= "z":
                stretched = chunk[max(0, i - 2) : i + 1] == ch * 3 or chunk[i - 1 : i + 2] == ch * 3
                options = [(ch, KEEP)] + ([("", REPEAT if stretched else TWICE)] if ch == before else [])
            else:
                letters = LOOKALIKES.get(ch, "")
                options = [(x, LIKE - math.log(len(letters))) for x in letters] + [("", DROP if ch != before else REPEAT)]
                if not spaced:
                    options.append((" ", BREAK))
            before = ch
            step: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in beam.items():
                for letter, cost in options:
                    if letter == " ":
                        if not state:
                            continue
                        to, total = 0, score + cost + float(logp[state, 0])
                    elif letter:
                        x = ord(letter) - 96
                        to, total = (state * _N + x) % _N**3, score + cost + float(logp[state, x])
                    else:
                        to, total = state, score + cost
                    if to not in step or total > step[to][0]:
                        step[to] = (total, (path, letter) if letter else path)
            beam = step
        path, out = max(((score + float(logp[state, 0]), path) for state, (score, path) in beam.items()), key=lambda x: x[0])[1], []
        while path is not None:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out)).strip()

    def run(self, singles: str) -> str:
        """The words of a run of single characters."""
        return self.viterbi("".join(_FOLD.get(ord(c), c) for c in singles if not c.isspace()).lower(), True)

    def word(self, chunk: str) -> str:
        """The restored word of a chunk (words, with spaces between, if it hid several); empty if it has no letters."""
        got = self.known.get(chunk)
        if got is not None:
            return got
        plain = "".join(_FOLD.get(ord(c), c) for c in chunk).lower()
        part = _TAIL.sub("", plain).lstrip(_MARKS)
        if (part.isascii() and part.isalpha() and not _STRETCHED.search(part)) or not _MIXED.match(part):
            got = part.strip(_MARKS + "@$!|+€£(")
        else:
            got = self.viterbi(part)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[chunk] = got
        return got

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        out = {w for x in set(text.split()) for w in self.word(x).split()}
        for run in _SINGLES.findall(text) if " " in text else ():
            out.update(self.run(run).split())
        return out

    def restored(self, text: str) -> str:
        """The whole text with its disguised words restored (and every other as it is)."""
        text = _SINGLES.sub(lambda m: self.run(m[0]), text)
        return re.sub(r"\S+", lambda m: self.word(m[0]) if _MIXED.match(m[0].lower()) else m[0], text)


@dataclass(frozen=True)
class Model:
    restorer: Restorer
    weights: dict[str, float]
    bias: float

    def score(self, texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            z = self.bias + sum(self.weights.get(w, 0.0) for w in self.restorer.words(t or ""))
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps with an L2 penalty on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", n_words: int = 192, max_rows: int = 20_000) -> Model:
    """Learns from rows for which train (an expression over doc_id) holds."""
    spark = docs.sparkSession
    restorer = Restorer(gram_counts(docs, text))
    shared = spark.sparkContext.broadcast(restorer)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).where(train).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).distinct()
    known = known.orderBy(F.xxhash64("__id"), "__id", "y").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id").select("__id", "y", "__text")

    def run(batches):
        for batch in batches:
            words = [sorted(shared.value.words(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["id", "y", "words"])

    schema = T.StructType([T.StructField("id", rows.schema["__id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    rows = Scratch(spark, "toxicity").table(rows.mapInArrow(run, schema), "rows")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(restorer, {}, -500.0)
    tally = rows.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (sizes[1] - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (sizes[0] - F.col("n") + 0.5))
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = tally.where("p + n >= 3").withColumn("z", F.abs(odds) / spread).where("z >= 3").orderBy(F.desc("z"), "w").limit(n_words)
    vocabulary = [r["w"] for r in best.collect()]
    if not vocabulary:
        return Model(restorer, {}, math.log(sizes[1] / sizes[0]))
    at = {w: i for i, w in enumerate(vocabulary)}
    seen = rows.select("id", "y", F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("words")).orderBy("id", "y").toLocalIterator()
    x, y = np.zeros((sum(sizes.values()), len(vocabulary)), np.float32), np.zeros(sum(sizes.values()))
    for i, r in enumerate(seen):
        y[i] = r["y"]
        x[i, [at[w] for w in r["words"]]] = 1
    w = logistic(x, y)
    return Model(restorer, dict(zip(vocabulary, w[:-1].tolist(), strict=True)), float(w[-1]))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on)."""
    if clash := {c.lower() for c in docs.columns} & set(ADDED):
        raise ValueError(f"docs already has {sorted(clash)}")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            score = np.array(shared.value.score(batch.column(at).to_pylist()), float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, *ADDED])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
