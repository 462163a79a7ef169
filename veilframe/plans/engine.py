"""The whole way of a table of texts: learn, detect, resolve, number, splice, verify, and back."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.patterns import BIRTH_CONTEXT, CONTAINERS, Rule, priority_of
from ..functions.scan import Scanner, read
from ..functions.signs import CITIES, COUNTRIES, SignReader
from ..functions.text import finding_id, fold, identity_key
from ..functions.tokens import base_of, has_token
from ..operators import entities, people
from ..operators.resolve import open_namesakes, override, resolved
from ..operators.restore import resolved_tokens, restore_stats
from ..operators.rules import chosen, residual_rules
from ..operators.splice import splice
from ..operators.vault import Vault, issue, touched
from ..operators.verify import many_amounts, residual_values
from .lineage import settled, spread

#: A candidate with everything that its finding needs.
_FIELDS = ["start", "end", "original", "context", "category", "decision", "confidence", "reason", "priority", "key", "emit_seq", "candidates"]
REPEATS = 2
#: More candidates than a unit has; the order of emission is below 1000.
_MOST = 2_000_000


@dataclass(frozen=True)
class Settings:
    """What is looked for. file is the column of keys that names a unit's file (default: the first key)."""

    secrets: bool = True
    personal: bool = True
    organizations: bool = True
    geo: bool = True
    countries: bool = False
    business: bool = False
    learn_names: bool = True
    fuzzy: bool = True
    suggest: bool = False
    strict: bool = False
    keep: tuple[str, ...] = ()
    hide: tuple[str, ...] = ()
    rules: tuple[Rule, ...] | None = None
    lexicon: Lexicon = DEFAULT
    places: tuple[str, ...] = tuple(CITIES)
    file: str | None = None

    def merged(self, options: dict) -> Settings:
        """With the options that are not None; unknown ones are an error."""
        return replace(self, **{k: v for k, v in options.items() if v is not None})


@dataclass(frozen=True)
class Learnt:
    """What the texts told about themselves: what each unit holds, people, and forms of entities."""

    read: DataFrame
    people: DataFrame | None
    forms: DataFrame | None
    births: DataFrame


@dataclass(frozen=True)
class Result:
    units: DataFrame
    findings: DataFrame
    vault: Vault


@dataclass(frozen=True)
class Restored:
    units: DataFrame
    tokens: DataFrame
    vault: Vault


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def learn(units: DataFrame, keys: list[str], text: str = "text", settings: Settings = Settings(), seeds: DataFrame | None = None, seed_people: DataFrame | None = None) -> Learnt:
    """One pass over the texts, and the people and entities that it names. What it wrote holds findings, not texts."""
    kinds = {"DOMAIN", "FILE", "POSSIBLE_ENTITY"} if settings.organizations else set()
    kinds |= {"ORG", "PROJECT"} if settings.organizations else set()
    kinds |= {"CITY", "REGION"} if settings.geo else set()
    kinds |= {"COUNTRY"} if settings.countries else set()
    if not settings.suggest and not settings.strict:
        kinds.discard("POSSIBLE_ENTITY")
    rules = chosen(settings.secrets, settings.personal, settings.business) if settings.rules is None else settings.rules
    signs = SignReader(settings.lexicon, frozenset(kinds), settings.places if settings.geo else (), tuple(COUNTRIES) if settings.countries else ()) if kinds else None
    found = read(units, keys, text, Scanner(rules, True, settings.hide, settings.personal), signs, settings.lexicon if settings.personal else None, BIRTH_CONTEXT)
    found = settled(found)
    births = found.where("birth").select(settings.file or keys[0]).distinct()
    forms = None
    told = found.select(*keys, F.explode("signs").alias("__f")).select(*keys, "__f.*")
    if kinds & set(entities.LEARNT) and (seeds is not None or _any(told)):
        forms = settled(entities.register(told, settings.keep, seeds))
    who = None
    if settings.personal and settings.learn_names:
        named = found.select(F.explode("names").alias("m")).select("m.*")
        if seed_people is not None or _any(named):
            who = settled(people.learn(named, seed_people))
    return Learnt(found, who, forms, births)


def seeds_of(vault: Vault) -> DataFrame:
    """category, key, original of the entities that earlier documents named, for learn()."""
    kinds = list(entities.LEARNT)
    names = vault.entities.where(F.col("kind").isin(*kinds)).select(F.col("kind").alias("category"), "key", "base")
    return names.join(vault.spellings.select("base", F.col("spelling").alias("original")), "base").select("category", "key", "original")


def candidates_of(units: DataFrame, learnt: Learnt, keys: list[str], text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """keys and _FIELDS: what rules, signs, known names and people claim, before any of it is resolved."""
    nobody, none = F.array().cast("array<string>"), []
    rules = learnt.read.select(*keys, F.explode("rules").alias("__f")).select(*keys, "__f.*").withColumn("candidates", nobody)
    file = settings.file or keys[0]
    late = rules.where("reason = 'lone_date'").join(learnt.births, file, "left_semi")
    none.append(rules.where("reason != 'lone_date'"))
    none.append(late.select(rules.columns))
    told = learnt.read.select(*keys, F.explode("signs").alias("__f")).select(*keys, "__f.*").withColumns({"emit_seq": F.lit(200), "candidates": nobody})
    if learnt.forms is not None:
        told = entities.canonical(told, learnt.forms)
        hits = entities.known(units.where(F.col(text).isNotNull()), learnt.forms, keys, text)
        rank = F.create_map(*(F.lit(x) for kv in entities.LEARNT.items() for x in kv))
        hits = hits.withColumns({"decision": F.lit("AUTO"), "confidence": F.lit(0.9), "reason": F.lit("a name known from elsewhere"), "priority": rank[F.col("category")], "emit_seq": F.lit(300), "candidates": nobody})
        none.append(hits)
    none.append(told)
    if settings.personal:
        named = learnt.read.select(*keys, F.explode("names").alias("__f")).select(*keys, "__f.*")
        place = named.select(*keys, "start", "end", "original", "context")
        if learnt.people is not None:
            found = people.findings(named, learnt.people, keys)
            if settings.fuzzy:
                found = found.unionByName(people.misspelt(named, learnt.people, keys))
        else:
            found = people.findings(named, units.sparkSession.createDataFrame([], people.PEOPLE), keys)
        found = found.join(place, [*keys, "start", "end"]).withColumnRenamed("person_key", "key")
        priority = F.when(F.col("reason") == people.TYPO, 550).otherwise(F.when(F.col("category") == "PERSON", priority_of("PERSON")).otherwise(priority_of("POSSIBLE_PERSON")))
        none.append(found.withColumns({"priority": priority, "emit_seq": F.lit(100)}))
    if settings.suggest or settings.strict:
        forms = learnt.forms if learnt.forms is not None else units.sparkSession.createDataFrame([], "category string, key string, form string, first string")
        more = entities.suggested(units.where(F.col(text).isNotNull()), forms, keys, text)
        none.append(more.withColumns({"context": F.lit(""), "reason": F.lit("looks like a name"), "priority": F.lit(400), "emit_seq": F.lit(400), "candidates": nobody}))
    out = none[0].select(*keys, *_FIELDS)
    for more in none[1:]:
        out = out.unionByName(more.select(*keys, *_FIELDS))
    return out


def findings_of(units: DataFrame, keys: list[str], text: str = "text", settings: Settings = Settings(), learnt: Learnt | None = None, extra: DataFrame | None = None) -> DataFrame:
    """keys, category, start, end, original, decision, confidence, reason, priority, key, finding_id, context: resolved, in raw coordinates.

    Only candidates are shuffled and grouped by unit, never texts. A namesake stays for review here; pseudonymize()
    hides it under a key of its own.
    """
    units = units if learnt else spread(units, keys)
    learnt = learnt or learn(units, keys, text, settings)
    rows = candidates_of(units, learnt, keys, text, settings)
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, *_FIELDS))
    if settings.keep:
        rows = rows.where(~fold(F.col("original")).isin(*(k.casefold().replace("ё", "е") for k in settings.keep)))
    rows = rows.groupBy(*keys).agg(F.collect_list(F.struct(*_FIELDS)).alias("__c"))
    # Resolution needs a few fields only; the place of a candidate in its list leads back to the others.
    narrow = F.transform("__c", lambda x, i: F.struct(*(x[f].alias(f) for f in ("category", "start", "end", "original", "decision", "confidence", "reason", "priority")), (x["emit_seq"] * F.lit(_MOST) + i).cast("int").alias("emit_seq")))
    whole = F.transform(resolved(narrow), lambda f: F.struct(*(f[x].alias(x) for x in ("category", "start", "end", "original", "decision", "confidence", "reason", "priority")), *(F.get("__c", f["emit_seq"] % _MOST)[x].alias(x) for x in ("key", "context", "candidates"))))
    rows = rows.select(*keys, whole.alias("__c")).select(*keys, F.explode("__c").alias("__f")).select(*keys, "__f.*")
    rows = rows.withColumn("key", F.when(F.col("category").isin(*CONTAINERS), identity_key(F.col("category"), F.col("original"))).otherwise(F.col("key")))
    if settings.strict:
        rows = rows.withColumn("reason", F.when(F.col("decision") == "REVIEW", F.concat("reason", F.lit(" (strict)"))).otherwise(F.col("reason"))).withColumn("decision", F.lit("AUTO"))
    return rows.withColumn("finding_id", finding_id(*map(F.col, keys), F.col("start"), F.col("end"), F.col("original")))


def _not_ours(found: DataFrame, vault: Vault) -> DataFrame:
    """found without the tokens of this vault: a text that is pseudonymised already stays as it is."""
    looks = F.col("reason").isin("literal_token", "email_1")
    rows = found.withColumn("__base", F.when(looks, base_of(F.col("original"))))
    ours = vault.entities.select(F.col("base").alias("__base"))
    return rows.join(ours, "__base", "left_anti").drop("__base")


def pseudonymize(units: DataFrame, vault: Vault, keys: list[str], text: str = "text", settings: Settings = Settings(), choices: DataFrame | None = None, now: float | None = None, seeds: DataFrame | None = None, seed_people: DataFrame | None = None, extra: DataFrame | None = None) -> Result:
    """units with every accepted finding replaced by its token, the findings, and the next vault.

    keys identify a unit and, in their order, place it: numbers are given in that order. now (seconds) is
    when the entities were used, by default the present. Entities of the vault are looked for in these texts
    too. extra holds candidates that the texts do not tell (keys and _FIELDS). In strict mode what still stands in the rewritten texts is hidden in up to two more passes.
    """
    now = time.time() if now is None else now
    units = spread(units, keys)
    known = seeds_of(vault)
    seeds = seeds.select("category", "key", "original").unionByName(known) if seeds is not None else known if _any(known) else None
    learnt = learn(units, keys, text, settings, seeds, seed_people)
    found = findings_of(units, keys, text, settings, learnt, extra)
    found = open_namesakes(found)
    if choices is not None:
        found = override(found, choices)
    found = settled(_not_ours(found, vault))
    vault, tokens = issue(vault, found.where("decision = 'AUTO'"), [*keys, "start"], now)
    vault = Vault(*(settled(t) for t in (vault.entities, vault.spellings, vault.counters)))
    tokens = settled(tokens)
    out = splice(units, tokens.select(*keys, "start", "end", "token"), keys, text)
    for _ in range(REPEATS if settings.strict else 0):
        out = settled(out)
        left = settled(residual_values(out.where(F.col(text).isNotNull()), tokens.where("category != 'SECRET' AND length(original) > 2").select("original"), keys, text))
        if not _any(left):
            break
        terms = left.select("original").distinct().join(tokens.select("category", "key", "original").distinct(), "original")
        forms = terms.groupBy(fold(F.col("original")).alias("form")).agg(F.min_by("category", "key").alias("category"), F.min("key").alias("key")).withColumn("first", F.split("form", r"[^\w&-]")[0])
        hits = entities.known(out.where(F.col(text).isNotNull()), forms, keys, text).withColumns({"decision": F.lit("AUTO"), "confidence": F.lit(0.9), "reason": F.lit("stood there again"), "priority": F.lit(660)})
        if not _any(hits):
            break
        vault, more = issue(vault, hits, [*keys, "start"], now)
        vault = Vault(*(settled(t) for t in (vault.entities, vault.spellings, vault.counters)))
        out = splice(out, settled(more).select(*keys, "start", "end", "token"), keys, text)
    return Result(out, tokens, vault)


def rerun(units: DataFrame, before: Vault, keys: list[str], choices: DataFrame, **options) -> Result:
    """The same texts once more with what the user decided, from the vault as it was before the run."""
    return pseudonymize(units, before, keys, choices=choices, **options)


def restored(units: DataFrame, vault: Vault, keys: list[str], text: str = "text") -> DataFrame:
    return restore_all(units, vault, keys, text).units


def restore_all(units: DataFrame, vault: Vault, keys: list[str], text: str = "text", now: float | None = None) -> Restored:
    """units with their originals, the tokens met, and the vault with those used now."""
    tokens = resolved_tokens(units, vault, keys, text)
    edits = tokens.where("replacement IS NOT NULL").select(*keys, "start", "end", F.col("replacement").alias("token"))
    out = splice(units, edits, keys, text, guard=False)
    return Restored(out, tokens, touched(vault, tokens.where("status != 'unknown'"), time.time() if now is None else now))


def inspect(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, tokenised, many_amounts of each unit; nothing is written."""
    return units.select(*keys, F.coalesce(has_token(F.col(text)), F.lit(False)).alias("tokenised"), F.coalesce(many_amounts(F.col(text)), F.lit(False)).alias("many_amounts"))


def verify(units: DataFrame, tokens: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, what, original: originals that still stand in rewritten units, and what the rules still find there."""
    gone = tokens.where("category != 'SECRET' AND length(original) > 0").select("original")
    left = residual_values(units.where(F.col(text).isNotNull()), gone, keys, text).select(*keys, F.lit("original").alias("what"), "original")
    return left.unionByName(residual_rules(units, keys, text).select(*keys, F.lit("rule").alias("what"), "original"))


def restore_report(units: DataFrame, vault: Vault, keys: list[str], by: list[str], text: str = "text") -> DataFrame:
    return restore_stats(resolved_tokens(units, vault, keys, text), by)
