"""The vault: which token stands for which entity and spelling, as tables.

entities(base, kind, key, number, secret, created, used), spellings(base, variant, spelling) and
counters(stem, last_number). A commit reads one version of them and derives the next, so running
it again after a failure gives the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.tokens import format_token, kind_of, stem_of
from .numbering import numbered

ENTITIES = "base string, kind string, key string, number bigint, secret boolean, created double, used double"
SPELLINGS = "base string, variant int, spelling string"
COUNTERS = "stem string, last_number bigint"


@dataclass(frozen=True)
class Vault:
    entities: DataFrame
    spellings: DataFrame
    counters: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Vault:
        return Vault(*(spark.createDataFrame([], s) for s in (ENTITIES, SPELLINGS, COUNTERS)))


def issue(vault: Vault, mentions: DataFrame, order: list[str], now: Column | float) -> tuple[Vault, DataFrame]:
    """The next vault, and mentions with base, variant and token.

    mentions has category, key, original; order are columns whose values place each mention (first
    the file, then the unit, then the start). New entities are numbered within their stem, new
    spellings within their entity, by first appearance. What is numbered are distinct entities and
    spellings, never mentions. The spelling of a secret is never stored. now (seconds) is when they
    were used: what purge() goes by.
    """
    now = F.lit(float(now)) if isinstance(now, (int, float)) else now
    rows = mentions.withColumn("kind", kind_of(F.col("category"))).withColumn("__at", F.struct(*order))
    seen = rows.groupBy("kind", "key", F.when(F.col("kind") != "SECRET", F.col("original")).alias("spelling")).agg(F.min("__at").alias("at"))
    met = seen.groupBy("kind", "key").agg(F.min("at").alias("at")).withColumn("stem", stem_of(F.col("kind")))
    old = vault.entities.select("kind", "key", "base", "number")
    fresh = met.join(old, ["kind", "key"], "left_anti")
    fresh = numbered(fresh, "stem", "at", "n").join(vault.counters, "stem", "left")
    fresh = fresh.withColumn("number", F.coalesce("last_number", F.lit(0)) + F.col("n"))
    fresh = fresh.select(format_token(F.col("kind"), F.col("number")).alias("base"), "kind", "key", "number", (F.col("kind") == "SECRET").alias("secret"), now.alias("created"), now.alias("used"))
    used = vault.entities.join(met.select("kind", "key", F.lit(True).alias("__met")), ["kind", "key"], "left")
    used = used.withColumn("used", F.when(F.col("__met"), now).otherwise(F.col("used"))).select(fresh.columns)
    entities = used.unionByName(fresh)

    words = seen.where("spelling IS NOT NULL").join(entities.select("kind", "key", "base"), ["kind", "key"]).select("base", "spelling", "at")
    new = words.join(vault.spellings.select("base", "spelling"), ["base", "spelling"], "left_anti")
    known = vault.spellings.groupBy("base").agg(F.max("variant").alias("__last"))
    new = new.join(known, "base", "left").withColumn("variant", (F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("base").orderBy("at"))).cast("int"))
    spellings = vault.spellings.unionByName(new.select("base", "variant", "spelling"))
    counters = fresh.groupBy(stem_of(F.col("kind")).alias("stem")).agg(F.max("number").alias("__n"))
    counters = vault.counters.join(counters, "stem", "full_outer").select("stem", F.greatest(F.coalesce("last_number", F.lit(0)), F.coalesce("__n", F.lit(0))).alias("last_number"))

    out = rows.drop("__at").join(entities.select("kind", "key", "base", "number"), ["kind", "key"])
    out = out.join(spellings.select("base", F.col("spelling").alias("original"), "variant"), ["base", "original"], "left").withColumn("variant", F.coalesce("variant", F.lit(1)))
    return Vault(entities, spellings, counters), out.withColumn("token", format_token(F.col("kind"), F.col("number"), F.col("variant"))).drop("number")


def lookup(vault: Vault, tokens: DataFrame) -> DataFrame:
    """tokens (base, variant) with status (ok, unknown, variant_missing, removed) and original."""
    first = vault.spellings.where("variant = 1").select("base", F.col("spelling").alias("__first"))
    rows = tokens.join(vault.entities.select("base", "secret"), "base", "left").join(first, "base", "left").join(vault.spellings, ["base", "variant"], "left")
    status = F.when(F.col("secret").isNull(), "unknown").when(F.col("secret") | F.col("__first").isNull(), "removed").when(F.col("spelling").isNull(), "variant_missing").otherwise("ok")
    rows = rows.withColumn("status", status)
    return rows.withColumn("original", F.when(F.col("status") == "ok", F.col("spelling")).when(F.col("status") == "variant_missing", F.col("__first"))).drop("secret", "__first", "spelling")


def touched(vault: Vault, tokens: DataFrame, now: Column | float) -> Vault:
    """The vault with the entities of tokens (base) used now: looking one up keeps it from being purged."""
    now = F.lit(float(now)) if isinstance(now, (int, float)) else now
    met = tokens.select("base").distinct().withColumn("__met", F.lit(True))
    rows = vault.entities.join(met, "base", "left").withColumn("used", F.when(F.col("__met"), F.greatest("used", now)).otherwise(F.col("used")))
    return Vault(rows.select(vault.entities.columns), vault.spellings, vault.counters)


def cleared(vault: Vault) -> Vault:
    """An empty vault: numbering starts anew, so it needs an id of its own (VaultStore.clear gives one)."""
    return Vault(*(t.limit(0) for t in (vault.entities, vault.spellings, vault.counters)))


def purge(vault: Vault, now: Column, days: int) -> Vault:
    """Without what was not used for so many days. Counters stay, so numbers are never given again."""
    if days <= 0:
        return vault
    live = vault.entities.where(F.col("used") >= now - F.lit(days * 86400.0))
    return Vault(live, vault.spellings.join(live.select("base"), "base", "left_semi"), vault.counters)


def conflicts(ours: Vault, theirs: Vault) -> DataFrame:
    """Bases that stand for different entities in two vaults."""
    a, b = ours.entities.select("base", "kind", "key"), theirs.entities.select("base", F.col("kind").alias("kind2"), F.col("key").alias("key2"))
    return a.join(b, "base").where("kind != kind2 OR key != key2")


def merged(ours: Vault, theirs: Vault) -> Vault:
    """Both vaults in one; a ValueError if a token would change its meaning."""
    if (n := conflicts(ours, theirs).count()) > 0:
        raise ValueError(f"{n} tokens stand for different values in the two vaults")
    entities = ours.entities.unionByName(theirs.entities.join(ours.entities.select("base"), "base", "left_anti"))
    new = theirs.spellings.join(ours.spellings.select("base", "spelling"), ["base", "spelling"], "left_anti")
    last = ours.spellings.groupBy("base").agg(F.max("variant").alias("__last"))
    new = new.join(last, "base", "left").withColumn("variant", (F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("base").orderBy("variant"))).cast("int"))
    counters = ours.counters.unionByName(theirs.counters).groupBy("stem").agg(F.max("last_number").alias("last_number"))
    return Vault(entities, ours.spellings.unionByName(new.select("base", "variant", "spelling")), counters)


def stats(vault: Vault) -> DataFrame:
    return vault.entities.groupBy("kind").agg(F.count("*").alias("entities"))


def file_numbers(names: DataFrame, known: DataFrame) -> DataFrame:
    """known (number, name) with new names numbered after the largest number, in the order of name."""
    fresh = names.select("name").distinct().join(known.select("name"), "name", "left_anti").withColumn("one", F.lit(1))
    top = known.agg(F.coalesce(F.max("number"), F.lit(0)).cast("bigint").alias("top"))
    fresh = numbered(fresh, "one", "name", "n").join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("number"), "name")
    return known.select(F.col("number").cast("bigint").alias("number"), "name").unionByName(fresh)
