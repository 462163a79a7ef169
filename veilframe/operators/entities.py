"""Organisations, projects, places and domains: learnt from sure signs, then found everywhere."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexicon import DEFAULT, Lexicon, folded
from ..functions.matches import matches
from ..functions.morphology import GIVEN_PARADIGMS, declined
from ..functions.scan import read
from ..functions.signs import PUBLIC_DOMAINS, SignReader, entity_key as key_of
from ..functions.text import fold

MAIL_DOMAIN = r"@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+)"
#: Categories whose names are looked for wherever they stand, with the priority of such a hit.
LEARNT = {"ORG": 940, "PROJECT": 940, "CITY": 680, "REGION": 680, "COUNTRY": 650, "TERM": 660}


def entity_key(name: Column) -> Column:
    """Quotes and punctuation stripped, spaces collapsed, folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(name), r"[«»\"“”„'‘’.,;:()]", " "), r"(?U)\s+", " "))


def explicit(units: DataFrame, keys: list[str], text: str = "text", kinds: tuple[str, ...] = ("ORG", "PROJECT", "CITY", "REGION"), lexicon: Lexicon = DEFAULT, places: tuple[str, ...] = (), countries: tuple[str, ...] = ()) -> DataFrame:
    """keys, start, end, original, category, key, priority, reason of what a sign beside it tells."""
    rows = read(units, keys, text, None, SignReader(lexicon, frozenset(kinds), places, countries), None)
    return rows.select(*keys, F.explode("signs").alias("__f")).select(*keys, "__f.*")


def root_domain(domain: Column) -> Column:
    parts = F.split(F.lower(domain), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def mail_domains(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Organisation domains that stand in e-mail addresses: keys, domain, original."""
    found = units.where(F.contains(F.col(text), F.lit("@"))).select(*keys, F.explode(F.regexp_extract_all(text, F.lit(MAIL_DOMAIN), F.lit(1))).alias("original"))
    return found.withColumn("domain", root_domain(F.col("original"))).where(~F.col("domain").isin(*PUBLIC_DOMAINS))


def domains(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sites in texts with their paths, shared ones left out: keys, start, end, original, domain."""
    return explicit(units, keys, text, ("DOMAIN",)).select(*keys, "start", "end", "original", F.col("key").alias("domain"))


def file_names(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return explicit(units, keys, text, ("FILE",)).select(*keys, "start", "end", "original", "key")


def _forms(names: pd.Series, categories: pd.Series) -> pd.Series:
    def one(name: str, category: str) -> list[str]:
        words = key_of(name).split()
        out = {" ".join(words)}
        if len(words) == 1 and not name.isascii() and (category in ("CITY", "REGION", "COUNTRY") or len(name) > 3 and not name.isupper()):
            out |= {folded(f) for f in declined(name, GIVEN_PARADIGMS)}
        if category == "CITY" and "-" in name:
            out |= {folded(f) for f in declined(name, GIVEN_PARADIGMS)}
        return sorted(x for x in out if len(x) > 1)

    return pd.Series([one(n, c) for n, c in zip(names, categories, strict=True)])


def register(found: DataFrame, keep: tuple[str, ...] = (), seeds: DataFrame | None = None) -> DataFrame:
    """category, key, form, first (its first word): every form under which the entities of explicit() may be met.

    seeds (category, key, original) are entities of earlier documents or of workbook columns. A key
    that is a case form of another one's name becomes that one (canonical).
    """
    rows = found.where(F.col("category").isin(*LEARNT)).where("decision = 'AUTO'").select("category", "key", "original").distinct()
    rows = rows.unionByName(seeds.select("category", "key", "original")).distinct() if seeds is not None else rows
    if keep:
        rows = rows.where(~F.col("key").isin(*(key_of(k) for k in keep)))
    forms = rows.select("category", "key", F.explode(F.pandas_udf(_forms, "array<string>")("original", "category")).alias("form"))
    own = rows.select("category", "key", F.col("key").alias("form"))
    forms = forms.unionByName(own).distinct()
    # an organisation goes before a place of the same name
    order = F.create_map(*(F.lit(x) for kv in LEARNT.items() for x in kv))
    best = forms.groupBy("form").agg(F.max_by(F.struct("category", "key"), F.struct(order[F.col("category")], -F.length("key"), "key")).alias("b"))
    return best.select("b.category", "b.key", "form", F.split("form", " ")[0].alias("first"))


def canonical(found: DataFrame, forms: DataFrame) -> DataFrame:
    """found with the key under which its name is registered."""
    names = forms.select(F.col("form").alias("__form"), F.col("category").alias("__c"), F.col("key").alias("__key"))
    out = found.join(names, (F.col("key") == F.col("__form")) & (F.col("category") == F.col("__c")), "left")
    return out.withColumn("key", F.coalesce("__key", "key")).drop("__form", "__c", "__key")


@lru_cache(maxsize=256)
def _pattern(forms: tuple[str, ...]) -> re.Pattern:
    one = lambda f: r"[\s«»\"“”„]+".join(re.escape(w).replace("е", "[её]") for w in f.split())
    return re.compile(rf"(?i)(?<![\w-])(?:{'|'.join(one(f) for f in forms)})(?![\w])")


def _located(texts: pd.Series, names: pd.Series) -> pd.Series:
    def one(text: str, known) -> list[dict]:
        by = {k["form"]: k for k in known}
        out = []
        for m in _pattern(tuple(sorted(by, key=lambda f: (-len(f), f)))).finditer(text):
            # an ordinary word is a name only where it is written like one
            if (m[0][0].isupper() or m[0][0].isdigit()) and (k := by.get(key_of(m[0]))):
                out.append({"start": m.start(), "end": m.end(), "original": m[0], "context": text[max(0, m.start() - 90) : m.end() + 90].replace("\n", " "), "category": k["category"], "key": k["key"]})
        return out

    return pd.Series([one(t, k) for t, k in zip(texts, names, strict=True)])


HIT = "array<struct<start:int,end:int,original:string,context:string,category:string,key:string>>"


def known(units: DataFrame, forms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every whole-word occurrence of a known name: keys, start, end, original, context, category, key; of several at one place the longest.

    Texts and names meet on the first word of the name, without the text; only the texts that hold such
    a word are fetched and searched for the names that begin with it.
    """
    capitals = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(?<![\w&])[\p{Lu}\d][\w&-]*"), F.lit(0))
    words = units.select(*keys, F.explode(F.array_distinct(F.transform(capitals, fold))).alias("first"))
    names = words.join(forms, "first").groupBy(*keys).agg(F.collect_set(F.struct("form", "category", "key")).alias("__names"))
    rows = units.select(*keys, F.col(text).alias("__t")).join(names, keys)
    return rows.select(*keys, F.explode(F.pandas_udf(_located, HIT)("__t", "__names")).alias("__f")).select(*keys, "__f.*")


def suggested(units: DataFrame, forms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Runs of Latin capitalised words and acronyms that no entity explains: for review."""
    pattern = r"(?U)(?<![\w-])(?:[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}|[A-ZА-ЯЁ]{3,8})(?![\w-])"
    rows = units.select(*keys, F.explode(matches(F.coalesce(F.col(text), F.lit("")), pattern)).alias("m")).select(*keys, "m.start", "m.end", F.col("m.value").alias("original"))
    rows = rows.withColumn("key", entity_key(F.col("original")))
    return rows.join(forms.select(F.col("form").alias("key")).distinct(), "key", "left_anti").withColumns({"category": F.lit("POSSIBLE_ENTITY"), "decision": F.lit("REVIEW"), "confidence": F.lit(0.5)})


def repeated_unknown(units: DataFrame, ordinary: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """Capitalised words that are never written in lower case and stand at least twice: key, n."""
    words = units.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?U)[\w-]{4,}"), F.lit(0))).alias("word"))
    tally = words.groupBy(fold(F.col("word")).alias("key")).agg(F.count_if(F.col("word").rlike("^[A-ZА-ЯЁ]")).alias("n"), F.count_if(~F.col("word").rlike("^[A-ZА-ЯЁ]")).alias("low"))
    return tally.where((F.col("n") >= least) & (F.col("low") == 0)).join(ordinary.select("key"), "key", "left_anti").select("key", "n")
