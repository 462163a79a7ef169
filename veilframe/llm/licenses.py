"""License scan: an exact set-similarity join of text blocks with templates, by containment.

A block is a line, or consecutive lines over which a notice is wrapped (below); its tokens are the distinct lower-cased words. A template is found in a block
if at least threshold of the template's tokens are in it. Template tokens are ordered by how many
documents hold them, rarest first, so a block that meets the threshold must hold one of the first
n - ceil(threshold * n) + 1 tokens (prefix filter), must have ceil(threshold * n) tokens (length
filter), and the place of the first common token bounds what can still follow (positional filter).
An index leads from each prefix token to its templates, so a block is compared only with those that
it shares one with, however many templates there are. Everything runs as DataFrame functions.
The order counts the documents of the whole table.

A template of more than WRAPPED characters does not fit on a usual line, so it is also looked for in
every line together with the lines after it, up to as many words as the longest such template has.
Of the blocks that hold one notice the one that starts last is listed. A shorter template that runs
over a line break is found if all its words stand there in order.

The templates and their tokens are constants, so what is broadcast has the size of that list.

Defined results: a null text is empty (no words, no labels, score 0); repeated rows and null ids
are judged alike; other columns pass through; clashing names are refused with a ValueError.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices as they are commonly written, and the label of each.
TEMPLATES = (
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
#: Characters of a template from which on it is looked for over several lines.
WRAPPED = 64
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_EDGE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")


def tokens_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text)))


def _anywhere(words: list[str]) -> str:
    """A pattern for any of the words as a whole word; Java's (?i) folds ASCII letters only."""
    return f"(?i)(?<!{_EDGE})(?:{'|'.join(map(re.escape, words))})(?!{_EDGE})"


def _phrase(phrase: str) -> str:
    return f"(?i)(?<!{_EDGE}){_GAP.join(map(re.escape, phrase.split()))}(?!{_EDGE})"


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def token_frequency(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each template token stands; one row of each that does comes to the driver."""
    tokens = sorted({t for _, x in templates for t in tokens_of(x)})
    # the words of a text are looked up once in the set of tokens, not once for each token
    held = docs.select(F.explode(F.array_intersect(_words(_lower(F.col(text))), F.array(*map(F.lit, tokens)))).alias("t"))
    return dict.fromkeys(tokens, 0) | {r["t"]: r["count"] for r in held.groupBy("t").count().collect()}


def scan(docs: DataFrame, text: str = "text", threshold: Fraction = Fraction(4, 5), templates=TEMPLATES, frequency: dict[str, int] | None = None) -> DataFrame:
    """docs with the columns of ADDED; blocks lists (line, label, containment) of what was found, lines from 0."""
    if clash := {c.lower() for c in docs.columns} & set(ADDED):
        raise ValueError(f"docs already has {sorted(clash)}")
    count = token_frequency(docs, text, templates) if frequency is None else frequency
    index = []
    for label, notice in templates:
        order = sorted(tokens_of(notice), key=lambda t: (count.get(t, 0), t))
        need = math.ceil(threshold * len(order))
        index.append((label, order, need, order[: len(order) - need + 1]))
    long = [x for x, (_, notice) in zip(index, templates, strict=True) if len(notice) > WRAPPED]
    short = [(label, notice) for label, notice in templates if len(notice) <= WRAPPED]
    reach = max((len(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", notice)) for _, notice in templates if len(notice) > WRAPPED), default=0)
    prefix = sorted({t for *_, p in index for t in p})

    body = F.coalesce(F.col(text), F.lit(""))
    bases = [F.regexp_count(body, F.lit(_phrase(p))) for p, _ in BASE]
    n_base = sum(bases[1:], bases[0]).cast("long")
    # Words before a place are those of the text before it: its start is where the split leaves off.
    before = [F.split(body, _phrase(p)) for p, _ in BASE]
    n_words = lambda c: F.regexp_count(c, F.lit(WORD))

    def first(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, n_words(F.element_at(parts, 1)))

    def last(parts: Column, phrase: str) -> Column:
        inside = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), lambda n, x: n + n_words(x))
        return F.when(F.size(parts) > 1, inside + (F.size(parts) - 2) * len(phrase.split()))

    lines = F.split(body, "\n")
    live = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("line"), line.alias("s"))), lambda b: b["s"].rlike(_anywhere(prefix)))
    bags = F.transform(live, lambda b: F.struct(b["line"].alias("line"), F.array_distinct(_words(_lower(b["s"]))).alias("w")))

    kind = "array<struct<line:int,label:string,containment:double>>"
    none = F.array().cast(kind)
    # The templates, and which of them begin with a token: a block meets only those that share one of its tokens there.
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, order)).alias("order"), F.lit(need).alias("need"), F.lit(len(head)).alias("head")) for label, order, need, head in index))
    places = {t: [i for i, (*_, head) in enumerate(index) if t in head] for t in prefix}
    wide = {t: [i for i in at if len(templates[i][1]) > WRAPPED] for t, at in places.items()}

    def joined(bag: Column, places: dict[str, list[int]], keep=None) -> Column:
        """The matches of a block with the templates that its tokens lead to."""
        places = {t: at for t, at in places.items() if at}
        if not places:
            return none
        index_of = F.create_map(*(x for t, at in places.items() for x in (F.lit(t), F.array(*map(F.lit, at)))))
        held = F.array_intersect(bag["w"], F.array(*map(F.lit, places)))
        met = F.array_distinct(F.flatten(F.transform(held, lambda t: F.element_at(index_of, t))))
        found = F.transform(met, lambda i: match(bag, F.get(table, i), keep))
        return F.filter(found, lambda m: m["containment"] >= float(threshold) - 1e-12)

    def match(bag: Column, x: Column, keep) -> Column:
        """The block's containment of one template, null where a filter stops it."""
        n, words = F.size(x["order"]), bag["w"]
        place = F.array_position(F.transform(F.slice(x["order"], 1, x["head"]), lambda t: F.array_contains(words, t)), True)
        share = contained(words, x)
        open_ = (F.size(words) >= x["need"]) & (place > 0) & (n - place + 1 >= x["need"])
        open_ = open_ & keep(x, share) if keep else open_
        return F.struct(bag["line"].alias("line"), x["label"].alias("label"), F.when(open_, share).alias("containment"))

    def contained(words: Column, x: Column) -> Column:
        return F.size(F.array_intersect(words, x["order"])) / F.size(x["order"])

    # The words of each line with what follows it: at most reach words more, whole lines until they suffice.
    rows = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("line"), _words(_lower(line)).alias("w"))), lambda b: F.size(b["w"]) > 0)

    def over_lines(rows: Column) -> Column:
        """Blocks of several lines, seen from the last line on; a block is listed where the next start would lose words of it."""

        def step(acc: Column, row: Column) -> Column:
            tail = F.slice(F.concat(row["w"], acc["w"]), 1, F.size(row["w"]) + reach)
            bag = F.struct(row["line"].alias("line"), F.array_distinct(tail).alias("w"))
            alone, after = F.array_distinct(row["w"]), F.array_distinct(acc["w"])
            more = joined(bag, wide, lambda x, share: F.greatest(contained(alone, x), contained(after, x)) < share)
            return F.struct(F.slice(tail, 1, reach).alias("w"), F.concat(acc["out"], more).alias("out"))

        start = F.struct(F.array().cast("array<string>").alias("w"), none.alias("out"))
        return F.aggregate(F.reverse(rows), start, step, lambda acc: acc["out"])

    def broken(label: str, notice: str) -> Column:
        parts = F.split(body, _phrase(notice), 2)
        first_line = F.size(F.split(F.element_at(parts, 1), "\n")) - 1
        return F.when(F.size(parts) > 1, F.struct(first_line.alias("line"), F.lit(label).alias("label"), F.lit(1.0).alias("containment")))

    wrapped = F.array_compact(F.array(*(broken(*x) for x in short))).cast(kind)
    several = F.when(body.rlike(_anywhere(sorted({t for *_, p in long for t in p}))), over_lines(rows)).otherwise(none) if long else none
    alone = F.flatten(F.transform(bags, lambda b: joined(b, places)))
    # A phrase within one line is in alone already.
    found = F.when(body.rlike(_anywhere(prefix)), F.array_distinct(F.concat(alone, several, wrapped))).otherwise(none)
    base = F.filter(F.array(*(F.when(b > 0, F.lit(label)) for b, (_, label) in zip(bases, BASE, strict=True))), lambda x: x.isNotNull())
    hit = F.col("n_base") > 0
    out = docs.withColumns({"n_words": n_words(body).cast("long"), "n_base": n_base, "blocks": found})
    firsts, lasts = [first(x) for x in before], [last(x, p) for x, (p, _) in zip(before, BASE, strict=True)]
    return out.withColumns(
        {
            "first_word": F.when(hit, F.array_min(F.array(*firsts)).cast("long")),
            "last_word": F.when(hit, F.array_max(F.array(*lasts)).cast("long")),
            "base_labels": F.array_join(F.sort_array(F.when(hit, base).otherwise(F.array().cast("array<string>"))), ","),
            "score": F.greatest(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)), F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))),
        }
    ).withColumn("labels", F.array_join(F.array_sort(F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.transform("blocks", lambda b: b["label"]))), ","))
