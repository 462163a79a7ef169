"""Each operator against a brute-force version, with nulls, empty and long texts, ties and repeated rows, extra columns and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, compact, decontaminate, idfile, jaccard, licenses, lines, packing, passages, quality, tokens, toxicity
from veilframe.llm.graph import components
from veilframe.llm.scratch import Scratch

DOC = "doc_id long, text string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def empty(spark):
    return spark.createDataFrame([], DOC)


def some_texts(seed, n, vocabulary=40, longest=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "naïve", "x.", "The"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(longest)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "w1 w2 w3 w4 w5"), (3, rows[3][1]), (n + 2, "long " * 20000)]


# -- 1 ----------------------------------------------------------------------


def brute_contamination(text, items, window=10):
    words, hit, ids = alnum(text), set(), set()
    for item, body in items:
        own = alnum(body)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            g = own[i : i + window]
            for k in range(len(words) - len(g) + 1):
                if words[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    ids.add(str(item))
    return len(words), sorted(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(rng.choice([1, 4, 10, 15])))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, "..."), (53, "One Two")]
    docs = []
    for i in range(60):
        words = [rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            words[5:5] = alnum(rng.choice(items)[1])
        docs.append((i, "-".join(words).upper() if i % 2 else " ".join(words), i))
    docs += [(60, None, 0), (61, "", 0), (None, items[1][1], 0), (0, docs[0][1], 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, extra int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(frame, bench, block_bytes=block).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, ids = brute_contamination(r.text, items)
        assert (r.n_words, [k for s in r.hits for k in range(s.first, s.last + 1)], r["items"]) == (n, hit, ids)
    clean = decontaminate.decontaminated(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not brute_contamination(t, items)[1] for _, t, _ in docs)
    assert decontaminate.find_contamination(frame, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_contamination(frame.withColumn("items", F.lit(1)), bench)


# -- 2 ----------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (2, 5, 20, 60, 300)]
    docs = [(i, "\n".join([rng.choice(base), f"own line number {i} alone here", rng.choice(base).upper() + "."])) for i in range(40)]
    near = base[3].split(" ")
    near[7] = "changed"
    docs += [(100, "start\n" + " ".join(near)), (101, None), (102, ""), (103, "\n\n"), (None, base[3]), (5, docs[5][1])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, extra int")
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None and x[1]), key=lambda x: x[0]):
        for n, line in enumerate(t.split("\n")):
            key = tuple(alnum(line))
            if len(key) >= 3 and key != tuple(near):
                first.setdefault(key, (d, n))
    for r in lines.deduped(frame).collect():
        if r.text is None or r.doc_id is None:
            assert not r.removed
            continue
        t = dict(docs)[r.doc_id]
        want = [n for n, x in enumerate(t.split("\n")) if len(alnum(x)) >= 3 and tuple(alnum(x)) in first and first[tuple(alnum(x))] != (r.doc_id, n)]
        assert [n for n in r.removed if r.doc_id != 100] == (want if r.doc_id != 100 else [])
        assert r.extra == 1 and r.text == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in r.removed)
    assert lines.deduped(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        lines.deduped(frame.withColumn("removed", F.lit(1)))


def test_fuzzy_lines_against_all_pairs(spark):
    """Lines that share a block and are alike enough form a group, whatever the pivots."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(900)}" for _ in range(80)] for _ in range(4)]
    docs = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 18])):
            w[rng.randrange(80)] = f"w{rng.randrange(900)}"
        docs.append((i, " ".join(w)))
    gone = {(r.doc_id, r.line) for r in lines.duplicate_lines(spark.createDataFrame(docs, DOC), block_bits=8).collect()}
    prints = lines.Fingerprints(8, 8)
    root = list(range(60))
    keys, own = [], []
    for _, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        h = lines.Words(data, np.array([0, len(data)]), lines.ALNUM, True).hashes()
        pair = lines.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
        keys.append(set(prints.keys(pair, np.array([0, len(pair)]))[0].tolist()))
        own.append(h)
    for a in range(60):
        for b in range(a):
            if keys[a] & keys[b] and passages._edits(own[a], own[b]) <= 16:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {r: min(i for i in range(60) if root[i] == r) for r in root}
    assert gone == {(i, 0) for i in range(60) if least[root[i]] != i} and 0 < len(gone) < 60


def test_fuzzy_lines_are_complete():
    """Every pair at the similarity shares a key, short lines too, at any order of the grams."""
    rng = random.Random(12)
    for trial in range(300):
        q, similarity = rng.choice([(2, 0.8), (2, 0.9), (1, 0.6)])
        a = [rng.randrange(rng.choice([6, 300])) for _ in range(rng.randrange(5, 70))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 3 + 1)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [rng.randrange(300)] * (kind != 2)
        if len(b) < 5 or a == b or passages._edits(np.array(a), np.array(b)) > lines.most_edits(max(len(a), len(b)), similarity):
            continue
        counts = np.array([rng.randrange(1, 50) for _ in range(lines._SYMBOLS)])
        row, key = lines.gram_keys(np.array(a + b), np.array([0, len(a), len(a) + len(b)]), counts, similarity, q)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("refine", [False, True])
def test_fuzzy_lines_under_a_key_of_very_many(spark, refine):
    """More lines than SMALL share one rare pair; some of them are alike, none is like the pivot of all."""
    rng = random.Random(14)
    docs = []
    for i in range(60):
        w = [f"u{rng.randrange(50000)}" for _ in range(20)]
        w[6:8] = ["rare", "pair"]
        x = list(w)
        x[rng.randrange(8, 20)] = "changed"
        docs += [(2 * i, " ".join(w)), *([(2 * i + 1, " ".join(x))] if i % 3 == 0 else [])]
    gone = lines.duplicate_lines(spark.createDataFrame(docs, DOC), fuzzy_words=5, refine=refine).collect()
    assert sorted(r.doc_id for r in gone) == [2 * i + 1 for i in range(0, 60, 3)]


def test_lines_at_the_similarity_share_a_key_of_three_words_or_two():
    """Pairs of any two lengths that may link, with as many edits as are allowed, meet under line_keys."""
    rng = random.Random(15)
    counts = np.array([rng.randrange(1, 50) for _ in range(lines._SYMBOLS)])
    qs = lines.grams_of(0.8)
    assert qs[0] == 3
    for n in [*range(3, 31), 60, 61] * 12:
        a = [rng.randrange(rng.choice([5, 300])) for _ in range(n)]
        b = list(a)
        most = lines.most_edits(n, 0.8)
        gone = rng.randrange(most + 1)
        for at in sorted(rng.sample(range(n), most), reverse=True):
            b[at : at + 1] = [] if gone > 0 and len(b) > 3 else [rng.randrange(300)]
            gone -= 1
        row, key = lines.line_keys(np.array(a + b), np.array([0, n, n + len(b)]), counts, 0.8, qs)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_near_copies_beside_another_pivot_are_not_all_compared(spark, monkeypatch):
    """Near copies under a key whose pivot is unlike them: the links by other keys join them, and no pair of theirs is compared again."""
    rng = random.Random(16)
    base = [f"u{rng.randrange(50000)}" for _ in range(40)]
    docs = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(20, 40)] = f"x{i}"
        docs.append((i, " ".join(w)))
    for i in range(80, 200):
        w = [f"v{rng.randrange(50000)}" for _ in range(40)]
        w[:3] = base[:3]
        docs.append((i, " ".join(w)))
    compared, linked = [], lines._linked
    monkeypatch.setattr(lines, "_linked", lambda pairs, *a: (compared.append(pairs.count()), linked(pairs, *a))[1])
    gone = lines.duplicate_lines(spark.createDataFrame(docs, DOC), fuzzy_words=5).collect()
    assert sorted(r.doc_id for r in gone) == list(range(1, 80)) and compared[-1] == 0


def test_lines_just_below_the_similarity_do_not_leave_the_join_as_pairs(spark, monkeypatch):
    """Lines of the same blocks of five words in another order share tens of keys and both signatures, but are two edits from linking."""
    base = [f"u{i}" for i in range(40)]
    blocks = [base[15 + 5 * b : 20 + 5 * b] for b in range(5)]
    docs = [(i, " ".join(base[:15] + [w for b in order for w in b])) for i, order in enumerate(itertools.permutations(blocks))]
    docs.append((500, docs[60][1].replace("u3 ", "x ")))
    compared, linked = [], lines._linked
    monkeypatch.setattr(lines, "_linked", lambda pairs, *a: (compared.append(pairs.count()), linked(pairs, *a))[1])
    gone = lines.duplicate_lines(spark.createDataFrame(docs, DOC), fuzzy_words=5).collect()
    assert [r.doc_id for r in gone] == [500] and compared[-1] <= 1


def test_signatures_bound_the_edits(spark):
    """An edit changes at most two bits of the one signature and four of the other; lines of few different words are told apart."""
    rng = random.Random(17)
    rows, far = [], 0
    for i in range(60):
        a = [rng.randrange(20) for _ in range(rng.choice([1, 2, 5, 30, 90]))]
        b = list(a)
        for _ in range(i % 5):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind != 1)] = [rng.randrange(20)] * (kind != 2) or [b[at]]
        rows += [(2 * i, 0, a), (2 * i + 1, 0, b)]
    coded = [(h, g, b"".join((lines._FIRST + w).to_bytes(2, "big") for w in ws)) for h, g, ws in rows]
    got = {r.h: r for r in lines.signed(spark.createDataFrame(coded, "h long, h2 long, symbols binary")).collect()}
    apart = lambda x, y, names: sum(((x[s] ^ y[s]) & (2**64 - 1)).bit_count() for s in names)
    for i in range(60):
        x, y = got[2 * i], got[2 * i + 1]
        edits = passages._edits(np.array(rows[2 * i][2]), np.array(rows[2 * i + 1][2]))
        assert x.n == len(rows[2 * i][2]) and apart(x, y, lines.SIGNED) <= 2 * edits and apart(x, y, lines.PAIRED) <= 4 * edits
    for x in got.values():
        for y in got.values():
            far += x.n == y.n == 30 and abs(x.h - y.h) > 1 and apart(x, y, lines.SIGNED) <= 12 and apart(x, y, lines.PAIRED) > 24
    assert far > 0


def test_fuzzy_lines_recall_over_all_pairs(spark):
    rng = random.Random(13)
    docs = []
    for i, n in enumerate([5, 6, 9, 10, 12, 20, 40, 60] * 6):
        w = [f"u{rng.randrange(50000)}" for _ in range(n)]
        x = list(w)
        for at in rng.sample(range(n), n // 5):
            x[at] = f"x{rng.randrange(50000)}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
    gone = lines.duplicate_lines(spark.createDataFrame(docs, DOC), fuzzy_words=5).collect()
    assert sorted(r.doc_id for r in gone) == list(range(1, len(docs), 2))


# -- 3 ----------------------------------------------------------------------


def test_passages(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(5000)}"
    shared = [[word() for _ in range(n)] for n in (52, 90)]
    docs, holds = [], set()
    for i in range(80):
        w = [word() for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            p = list(shared[i // 4 % 2])
            if len(p) > 80:
                p[rng.randrange(20, 60)] = word()
            w[10:10] = p
            holds.add(i)
        docs.append((i, " ".join(w)))
    half = [word() for _ in range(64)]
    docs += [(1000, " ".join(half[:32])), (1001, " ".join(half)), (1002, " ".join([word(), *half])), (2000, None), (2001, ""), (None, " ".join(half))]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame(docs, DOC)).collect()}
    assert {i for i, r in got.items() if r.later or r.earlier} == holds | {1001, 1002} and len(got) == len(docs)
    assert (got[1002].later[0].first, got[1002].later[0].last, got[1002].later[0].other) == (1, 64, 1001)
    assert passages.repeated(empty(spark)).count() == 0


def test_passage_recall(spark):
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(200000)}"
    docs, n = [], 0
    for size, edits in ((55, 5), (60, 9), (80, 12)):
        for _ in range(40):
            p = [word() for _ in range(size)]
            q = list(p)
            for at in rng.sample(range(4, size - 4), edits):
                q[at] = word()
            docs += [(2 * n + s, " ".join([word() for _ in range(30)] + x + [word() for _ in range(30)])) for s, x in enumerate((p, q))]
            n += 1
    frame = spark.createDataFrame(docs, DOC)
    found = {r.doc for r in passages.passages(frame).collect()}
    thinned = {r.doc for r in passages.passages(frame, window=16).collect()}
    print("recall", len(found), len(thinned), n)
    assert len(found) >= 0.97 * n > len(thinned) and all(d % 2 for d in found)


def test_chains_against_all_subsequences():
    """The Fenwick tree finds the best chain score."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        i, j, size = rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(5, 12, n)
        end = np.maximum(1, size - 4)
        best = [0.0] * n
        for m in sorted(range(n), key=lambda x: (i[x], j[x])):
            before = [best[p] - passages.GAP * (i[m] - i[p] - size[p] + j[m] - j[p] - size[p]) for p in range(n) if i[p] + end[p] <= i[m] and j[p] + end[p] <= j[m]]
            best[m] = size[m] + max([0.0, *before])
        got = passages.chains(i, j, size, 4)
        assert abs(got[0][0] - max(best)) < 1e-9
        assert sorted(m for _, path in got for m in path) == list(range(n))


def test_gap_edits_against_the_whole_matrix():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = rng.integers(0, 4, rng.integers(0, 14)), rng.integers(0, 4, rng.integers(0, 14))
        most = int(rng.integers(1, 9))
        want = passages._edits(a, b)
        got = passages.gap_edits(a, b, most)
        assert (got > most) if want > most else (want <= got <= most and (got == want or len(a) == len(b)))


def test_packed_columns_come_back():
    rng = np.random.default_rng(8)
    for n in (0, 1, 1000):
        code = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        columns = [code, rng.integers(-9, 1 << 40, n), rng.integers(0, 99, n).astype(np.int32)]
        assert all((x == y).all() for x, y in zip(compact.unpack(compact.pack(*columns)), columns, strict=True))
        back = [compact.unpack(p) for _, _, p in compact.dealt(compact.Deal(7, 48), 0, *columns)]
        assert sum(len(x[0]) for x in back) == n and (not n or (np.concatenate([x[1] for x in back]) == columns[1]).all())


def edited(rng, word, p, edits):
    q = list(p)
    for _ in range(edits):
        at, kind = rng.randrange(2, len(q) - 2), rng.randrange(3)
        q[at : at + (kind != 1)] = [word()] * (kind != 2)
    return q


@pytest.mark.parametrize("run_rows", [1 << 21, 700])
def test_passages_against_all_pairs(spark, run_rows):
    """Every 50 words of a document that an earlier one holds with 10 edits at most, by edit distance against all of it."""
    rng = random.Random(31)
    word = lambda: f"v{rng.randrange(3000)}"
    base = [[word() for _ in range(n)] for n in (55, 60, 90)]
    docs = []
    for i in range(18):
        w = [word() for _ in range(rng.randrange(10, 60))]
        if i % 3:
            w += edited(rng, word, base[i % 3 if i % 2 else 0], rng.choice([0, 2, 5, 8])) + [word() for _ in range(rng.randrange(40))]
        docs.append(w)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], DOC)
    found = passages.passages(frame, run_rows=run_rows).collect()
    for r in found:
        a, b = docs[r.doc][r.first : r.last + 1], docs[r.other][r.other_first : r.other_last + 1]
        assert r.other < r.doc and len(a) >= 50 and r.equal >= 0.8 * max(len(a), len(b))
        assert r.equal <= max(len(a), len(b)) - passages._edits(np.array(a), np.array(b))
    code = {w: n for n, w in enumerate(sorted({w for d in docs for w in d}))}
    codes = [np.array([code[w] for w in d]) for d in docs]
    got = {(r.doc, n) for r in found for n in range(r.first, r.last + 1)}
    want = [(x, s) for x in range(len(docs)) for s in range(max(0, len(codes[x]) - 49)) if any(held_within(codes[x][s : s + 50], codes[y]) <= 10 for y in range(x))]
    # a window may reach 10 words beyond what is shared
    hit = [(x, s) for x, s in want if sum((x, n) in got for n in range(s, s + 50)) >= 36]
    assert len(want) > 100 and len(hit) >= 0.9 * len(want)


def held_within(a, b):
    """The fewest edits between a and any run of words of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for n, x in enumerate(a.tolist(), 1):
        new = np.concatenate([[n], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_paths_are_not_broadcast(spark, monkeypatch):
    """What asks for words holds numbers only; the passages are the same however the sides are joined."""
    asked, slices = [], passages._slices
    monkeypatch.setattr(passages, "_slices", lambda requests, docs: (asked.append(requests.columns), slices(requests, docs))[1])
    rng = random.Random(18)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = some(70)
    frame = spark.createDataFrame([(1, " ".join(some(20) + shared)), (2, " ".join(shared + some(9))), (3, " ".join(some(90)))], DOC)
    want = sorted(map(tuple, passages.passages(frame).collect()))
    monkeypatch.setattr(passages, "MOST_STRETCHES", 0)
    assert sorted(map(tuple, passages.passages(frame).collect())) == want and [r[:3] for r in want] == [(2, 0, 69)]
    assert all(c == ["doc", "id", "lows", "highs"] for c in asked)


def test_passages_beside_other_words_and_repeated_ids(spark):
    rng = random.Random(32)
    word = lambda: f"v{rng.randrange(90000)}"
    some = lambda n: [word() for _ in range(n)]
    a, b = some(100), some(100)
    docs, n = [], 0
    for gap in (0, 3, 20, 60, 100, 150, 700):
        docs += [(n, " ".join(a + some(gap) + b)), (n + 1, " ".join(a + some(gap) + b))]
        n += 2
        a, b = some(100), some(100)
    docs += [(900, " ".join(some(300))), (900, "zz " + " ".join(a)), (901, " ".join(a)), (901, None), (902, " ".join(some(3000) + b)), (903, " ".join(some(30000) + b))]
    got = {r.doc_id: r for r in passages.repeated(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOC + ", later string, doc int")).collect() if r.later}
    for k, gap in enumerate((0, 3, 20, 60, 100, 150, 700)):
        spans = got[2 * k + 1].later
        assert sum(s.last - s.first + 1 for s in spans) >= 198 and (gap < 20 or len(spans) == 2)
    assert [(s.first, s.last, s.other) for s in got[901].later] == [(0, 99, 900)]
    assert [(s.first, s.last, s.other) for s in got[903].later] == [(30000, 30099, 902)]


def test_a_passage_of_frequent_phrases(spark):
    """Each third of the passage stands alone in other documents too; the pair that holds it whole is found."""
    rng = random.Random(33)
    some = lambda n: [f"v{rng.randrange(90000)}" for _ in range(n)]
    parts = [some(20) for _ in range(3)]
    docs = [(n, " ".join(some(20) + p + some(20))) for n, p in enumerate(parts * 2)]
    whole = [w for p in parts for w in p]
    docs.insert(3, (10, " ".join(some(9) + whole)))
    docs = [*docs[:3], (10, docs[3][1]), *[(20 + n, t) for n, (_, t) in enumerate(docs[4:])], (50, " ".join(whole + some(9)))]
    got = {r.doc_id: r.later for r in passages.repeated(spark.createDataFrame(docs, DOC)).collect()}
    assert [(s.first, s.last, s.other) for s in got[50]] == [(0, 59, 10)]


# -- 4 ----------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(3)
    words = ["GNU", "general", "public", "License", "apache", "cc", "by", "CC-BY", "mit", "MIT", "é", "K", "\n", ",", "licensed", "under", "the", "version", "2.0", "nc", "4.0", "released"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), "x") for i in range(150)]
    docs += [(200, None, "x"), (201, "", "x"), (None, "MIT License", "x"), (202, "w " * 20000 + "the Apache  License", "x"), (0, docs[0][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, extra string")
    for r in licenses.scan(frame).collect():
        w, places, base, more, score = alnum(r.text), [], set(), set(), 0.0
        for phrase, label in licenses.BASE:
            q = phrase.split()
            at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
            places += at
            base |= {label} if at else set()
        for line in (r.text or "").split("\n"):
            for label, notice in licenses.TEMPLATES:
                t = set(licenses.tokens_of(notice))
                share = len(t & set(alnum(line))) / len(t)
                if share >= 0.8:
                    more.add(label)
                    score = max(score, share)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | more))) and r.score == pytest.approx(1.0 if places else score)
    assert licenses.scan(empty(spark)).count() == 0


def test_license_tokens_are_counted_in_all_documents(spark):
    docs = [(0, "this software and its files"), (1, None), (2, "the Software is under the MIT license"), (3, "redistribution of software, software")]
    count = licenses.token_frequency(spark.createDataFrame(docs, DOC))
    assert (count["software"], count["files"], count["license"], count["mit"], count["redistribution"]) == (3, 1, 1, 1, 1)
    assert set(licenses.token_frequency(empty(spark)).values()) == {0}


def test_license_tokens_are_looked_up_once(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(["MIT license, the MIT License", "the license", None, ""])), DOC)
    # a look through all words of a text for each token takes as long as the scan itself
    monkeypatch.setattr(licenses.F, "array_contains", None)
    assert licenses.token_frequency(docs, "text", (("mit", "the mit license"), ("x", "nowhere"))) == {"the": 2, "mit": 1, "license": 2, "nowhere": 0}


def test_wrapped_notices(spark):
    import textwrap

    docs, want = [], []
    for label, notice in licenses.TEMPLATES:
        for width in (40, 70):
            body = "\n".join(f"# {x}" for x in textwrap.wrap(f"see here {notice} and so on", width))
            docs.append((len(docs), f"first line\n{body}\n\nlast line"))
            want.append(label)
    docs.append((999, "permission is hereby granted\n" + "other words\n" * 30 + "free of charge to any person obtaining a copy of this software"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, DOC)).collect()}
    assert all(want[i] in got[i].labels.split(",") and got[i].score == 1.0 for i in range(len(want))) and got[999].labels == ""


# -- 5 ----------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["a <|end|> b", "\\l \\b \\\\ <", "<|turn|>user<|text|>x", "", None, "é\n日本" * 3, r"\### Assistant: </turn> ok"]
    rows = [(i % 3, k, ("user", "assistant", None, "a<b")[k % 4], t) for i in range(3) for k, t in enumerate(hard)]
    rows += [(7, 0, "assistant", "same"), (7, 0, "assistant", "same"), (None, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(frame.withColumn("parts", chat.text_parts(F.col("text"))))
    read = out.select("conv_id", chat.read_chat(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert len(read) == 5
    for r in read:
        own = sorted(((k, role or "", t or "") for c, k, role, t in rows if c == r.conv_id))
        assert [(x.role, x.text) for x in r.t] == [(role, t) for _, role, t in own]
        assert r.l == "".join(t for _, role, t in own if role == "assistant")
    assert chat.format_chat(frame.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <b>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("Audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None), None]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(frame).first()
    assert r.formatted == "<|turn|>user<|text|>see \\lb><|image|><|audio|><|document|><|other|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 768), ("video", "v", 0)]


# -- 6 ----------------------------------------------------------------------


@pytest.mark.parametrize("top", [2, 300, 50257])
def test_coder_round_trip(top):
    rng = np.random.default_rng(top)
    counts = rng.integers(0, 700, 9)
    ids = rng.integers(0, top, counts.sum())
    record = idfile.pack_record(ids, counts, 50257)
    assert (idfile.unpack_record(record) == ids).all()
    if top == 2:
        assert len(record) < len(ids) / 2 + 12 * len(counts) + 64
    broken = bytearray(record)
    broken[16 + 12 * len(counts) + 1] ^= 1
    with pytest.raises(ValueError):
        idfile.unpack_record(bytes(broken))


def test_id_files(spark, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    docs = [(5, "Hello  wörld's\n\nx1²"), (1, None), (9, ""), (None, "null id"), (5, "same id"), (7, "ſ 日本 <|endoftext|> " * 50), (8, "word " * 9000)]
    out = str(tmp_path / "ids")
    idfile.write_ids(spark.createDataFrame(docs, DOC), out, path, 2, block=512)
    got = idfile.read_ids(spark, out).orderBy("start").collect()
    library = tokens.encoder(path).library
    start = 0
    for r, (doc, text) in zip(got, sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (doc, start, len(want), want)
        start += len(want)
    idfile.write_ids(empty(spark), out, path, 2)
    assert idfile.read_ids(spark, out).count() == 0


def test_encoder_is_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aÀ'sS tİ\x1c 日本ſ1½²\n\t!|<endoftext>é") for _ in range(rng.randrange(60))) for _ in range(400)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.encoder(tokens.public_path(name))
        ids, counts = enc.ids(texts)
        want = [x.ids for x in enc.library.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


# -- 7 ----------------------------------------------------------------------


def test_packing(spark):
    path = tokens.public_path("word_bpe_49k.json")
    docs = [*some_texts(5, 150), (3, "w1")]
    got = packing.packed(spark.createDataFrame(docs, DOC), path, 1, packing.Capacity(tokens=64), group_size=40).collect()
    library = tokens.encoder(path).library
    want = collections.Counter()
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[s : s + 64], "<u4")
            want[(d, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(n for _, n in b) <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 64 + 1
    assert packing.packed(empty(spark), path, 1).count() == 0


@pytest.mark.parametrize("choice", ["norm", "dot"])
def test_every_capacity_holds(choice):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 500)
    capacity = packing.Capacity(tokens=100, documents=4, cost=10_000, choice=choice)
    where, offset = packing.pack(lengths, capacity)
    for b in np.unique(where):
        own = np.flatnonzero(where == b)
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own] ** 2).sum() <= 10_000
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


# -- 8 ----------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("then", "inter", "station", "over") for b in ("ing", "ed", "ly", "ion")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        bad = i % 4 == 0
        if bad:
            w[2:2] = [rng.choice(["idiot", "moron", "1d10t", "m0r0n", "i d i o t"])]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(1, None), (None, 1), (9999, 1), (0, 1)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], DOC)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, truth, ~held)
    assert "idiot" in model.weights and not {"1d10t", "m0r0n"} & set(model.weights)
    out = toxicity.scored(docs, model).where(held & F.col("doc_id").isNotNull()).join(truth.where("toxic IS NOT NULL").distinct(), "doc_id").collect()
    assert len(out) > 40 and sum(r.predicted == r.toxic for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)
    r = model.restorer
    assert [r.word(x) for x in ("1d10t", "m0r0n", "idiiiot", "stationed,", "###")] == ["idiot", "moron", "idiot", "stationed", ""]
    assert r.restored("an 1d10t, m o r o n ok") == "an idiot moron ok"
    assert toxicity.fit(docs, truth.limit(0), ~held).score([None, "idiot"]) == [pytest.approx(0.0)] * 2
    assert toxicity.scored(empty(spark), model).count() == 0


def test_whole_runs_are_restored(spark):
    words = ["idiot", "moron", "a", "station", "then", "over"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 9))) for i in range(60)]
    r = toxicity.Restorer(toxicity.gram_counts(spark.createDataFrame(rows, DOC)))
    assert r.run("a i d i o t") == "a idiot" and r.run("i d i o t m o r o n") == "idiot moron"
    late = " ".join("station" * 10 + "moron")
    assert "moron" in r.words(f"then {late} ok") and r.restored(late) == "station " * 10 + "moron"
    assert "idiot" in r.words(".".join("station" * 8 + "idiot")) and r.word("id" + "i" * 60 + "ot") == "idiot"


# -- 9 ----------------------------------------------------------------------


def test_quality_statistics(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice(["a b c ", "x\n", "x\n", " \t\n", "#$", "É ", "a b c\n", "zz. "]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n "), (203, "w " * 30000)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(docs, DOC), quality.DecisionList(())).collect()}
    for d, t in docs:
        w = spaced(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        many = collections.Counter(grams)
        flag = {k + x for k, g in enumerate(grams) if many[g] > 1 for x in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(flag))
        assert r.n_distinct == len(set(w)) and r.base_failed == (len(w) < 50 or 100 * len(flag) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_quality_rules(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.93)
    rules = quality.cover(x, bad, np.arange(900) % 3 == 2)
    hit = np.zeros(900, bool)
    for rule in rules.rules:
        hit |= np.logical_and.reduce([c.holds(x) for c in rule])
    assert 1 <= len(rules.rules) <= 6 and (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.1 * bad.sum()
    good = " ".join(f"word{i}" for i in range(80))
    docs = [(i, good + f" n{i}" if i % 2 else " ".join(f"w{k}#%" for k in range(80 + i % 5))) for i in range(120)]
    frame = spark.createDataFrame(docs, DOC)
    labels = spark.createDataFrame([*((i, i % 2) for i in range(100)), (None, 0), (5, None), (9999, 0)], "doc_id long, quality int")
    learned = quality.fit(frame, labels)
    assert {r.doc_id for r in quality.judged(frame, learned).where("kept").collect()} == {i for i in range(120) if i % 2}
    assert quality.fit(frame, labels.limit(0)).rules == () and quality.judged(empty(spark), learned).count() == 0
    with pytest.raises(ValueError):
        quality.with_statistics(frame.withColumn("n_words", F.lit(1)))


# -- 10 ---------------------------------------------------------------------


def brute_links(rows, threshold, size):
    sets = []
    for _, t in rows:
        w = spaced(low(t))
        sets.append(({tuple(w)} if 0 < len(w) < size else set(zip(*(w[k:] for k in range(size)), strict=False))))
    ids = [i for i, _ in rows]
    root, links = list(range(len(rows))), collections.Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ids[a] is not None and ids[b] is not None and both and both * threshold.denominator >= len(sets[a] | sets[b]) * threshold.numerator:
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r) if i is not None else None, links[k]) for k, (i, s, r) in enumerate(zip(ids, sets, root, strict=True))), key=repr)


@pytest.mark.parametrize("threshold, size, slices", [(Fraction(9, 10), 3, 512), (Fraction(4, 5), 5, 8)])
def test_jaccard_links(spark, threshold, size, slices):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        w = [f"w{(k * 7) % 31}" for k in range(rng.choice([1, 2, 3, 9, 14, 25, 60]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(31)}"
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t"), (None, rows[0][1]), (7, rows[9][1]), (7, rows[9][1]), (303, "W0  w7\tW14"), (304, "x " * 9000)]
    frame = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, component_id int").repartition(3)
    got = jaccard.linked(frame, threshold, size, slice_size=slices).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_links(rows, threshold, size)
    assert jaccard.linked(empty(spark)).count() == 0


def test_partners_share_a_key():
    """Pigeonhole: sets that meet the threshold share a key, whatever is frequent."""
    rng = np.random.default_rng(5)
    for t in (Fraction(4, 5), Fraction(9, 10)):
        bands, frequent = jaccard.Bands(t), np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64))
        met = 0
        for _ in range(600):
            x = np.unique(np.concatenate([rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64), rng.choice(frequent, rng.integers(0, 150), replace=False)]))
            y = np.delete(x, rng.integers(0, len(x), rng.integers(0, 1 + len(x) // 8)))
            y = np.unique(np.concatenate([y, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(x) // 16)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and both * t.denominator >= (len(x) + len(y) - both) * t.numerator and both < max(len(x), len(y)):
                met += 1
                assert len(np.intersect1d(bands.keys(x, frequent), bands.keys(y, frequent)))
        assert met > 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)] + [(1000, 1000 + k) for k in range(1, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(frame, Scratch(spark, "test"), "c").collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300, **{1000 + k: 1000 for k in range(300)}}


def test_digest_is_of_the_set():
    assert jaccard.digest(np.array([1, 2], np.uint64)) == hashlib.blake2b(np.array([1, 2], np.uint64).tobytes(), digest_size=16).digest()
