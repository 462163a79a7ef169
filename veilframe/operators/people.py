"""People: learn them where the texts name them in full or by initials, then find their shorter forms everywhere.

Mentions come from one pass over the words of a text (functions/names.py). Learning takes those whose
shape is certain. Finding joins the surname of each mention with the forms of the people learnt, and
compares given name, patronymic and initials there; a mention that fits one person is theirs, one
that fits several is for review. A mention without a surname meets on its patronymic. Only distinct
people are declined, and a given name, which very many share, is never a key of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.morphology import name_forms
from ..functions.names import SHAPES, name_mentions
from ..functions.text import fold, initials_id, person_id

PEOPLE = "person_id string, surname string, given string, patronymic string, initials array<string>"
NAMESAKES, TYPO, KNOWN = "fits several people", "a typo of a known surname", "a person named elsewhere"


def mentions(units: DataFrame, keys: list[str], text: str = "text", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """keys and the fields of a mention, one row for each."""
    rows = units.select(*keys, F.explode(name_mentions(F.col(text), lexicon)).alias("__f"))
    return rows.select(*keys, "__f.*")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _masculine(surname: Column) -> Column:
    """One spelling for a surname of both genders."""
    return F.regexp_replace(F.regexp_replace(fold(surname), "(?<=(?:ов|ев|ин|ын))а$", ""), "(?<=(?:ск|цк))ая$", "ий")


def learn(named: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """PEOPLE of mentions(), and of seeds (PEOPLE) such as the people of earlier documents.

    Somebody named without a patronymic or by initials only is left out where a fuller name fits:
    the fuller one will be found for both.
    """
    names = named.select("shape", F.col("n_surname").alias("surname"), F.col("n_given").alias("given"), F.col("n_patronymic").alias("patronymic"), "letters").distinct()
    firsts = F.array_compact(F.array(F.when(F.col("given").isNotNull(), F.left("given", F.lit(1))), F.when(F.col("patronymic").isNotNull(), F.left("patronymic", F.lit(1)))))

    def people(rows: DataFrame, initials: Column = firsts) -> DataFrame:
        who = rows.select("surname", "given", "patronymic", initials.alias("initials")).where("surname IS NOT NULL")
        return who.withColumn("person_id", person_id(F.col("surname"), F.col("given"), F.col("patronymic"))).select("person_id", "surname", "given", "patronymic", "initials").dropDuplicates(["person_id"])

    full = people(names.where("shape = 'full'"))
    if seeds is not None:
        full = full.unionByName(seeds).dropDuplicates(["person_id"])
    pairs = people(names.where("shape IN ('pair', 'maybe_pair')"))
    same = full.select(_masculine(F.col("surname")).alias("__s"), fold(F.col("given")).alias("__g")).distinct()
    pairs = pairs.where(_text("given") != "").join(same, (_masculine(F.col("surname")) == F.col("__s")) & (fold(F.col("given")) == F.col("__g")), "left_anti")
    fuller = full.unionByName(pairs)

    brief = names.where("shape = 'initials' AND surname IS NOT NULL").select("surname", F.transform("letters", F.upper).alias("initials")).distinct()
    known = fuller.where("surname IS NOT NULL").select(_masculine(F.col("surname")).alias("__s"), F.col("initials").alias("__i")).distinct()
    fits = (_masculine(F.col("surname")) == F.col("__s")) & (F.col("initials")[0] == F.col("__i")[0]) & ((F.size("initials") < 2) | (F.size("__i") < 2) | (F.try_element_at("initials", F.lit(2)) == F.try_element_at("__i", F.lit(2))))
    brief = brief.join(known, fits, "left_anti")
    # "Петров И." is dropped beside "Петров И.С."
    longer = brief.where(F.size("initials") > 1).select(fold(F.col("surname")).alias("__s"), F.col("initials")[0].alias("__f")).distinct()
    one = brief.where(F.size("initials") < 2).join(longer, (fold(F.col("surname")) == F.col("__s")) & (F.col("initials")[0] == F.col("__f")), "left_anti")
    brief = brief.where(F.size("initials") > 1).unionByName(one)
    none = F.lit(None).cast("string")
    brief = brief.select(initials_id(F.col("surname"), F.col("initials")).alias("person_id"), "surname", none.alias("given"), none.alias("patronymic"), "initials")
    out = fuller.unionByName(brief)

    alone = people(names.where("shape IN ('honorific', 'role', 'list')"))
    alone = alone.where("given IS NULL").join(out.select(_masculine(F.col("surname")).alias("__s")).distinct(), _masculine(F.col("surname")) == F.col("__s"), "left_anti")
    return out.unionByName(alone).dropDuplicates(["person_id"])


def form_index(people: DataFrame) -> DataFrame:
    """form, slot, person_id: the inverted index of all forms."""
    return people.select("person_id", F.explode(name_forms(F.col("surname"), F.col("given"), F.col("patronymic"))).alias("f")).select("f.form", "f.slot", "person_id").distinct()


def _index(people: DataFrame) -> DataFrame:
    """person_id, initials, and the forms of each slot as arrays."""
    forms = name_forms(F.col("surname"), F.col("given"), F.col("patronymic"))
    rows = people.select("person_id", "initials", forms.alias("f"))
    of = lambda slot: F.array_distinct(F.transform(F.filter("f", lambda x: x["slot"] == slot), lambda x: x["form"]))
    return rows.select("person_id", "initials", *(of(s).alias(s) for s in ("surname", "given", "patronymic")))


def find(named: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, candidates: the people whom each mention fits."""
    index = _index(people)
    asked = named.select(*keys, "start", "end", fold(F.col("surname")).alias("s"), fold(F.col("given")).alias("g"), fold(F.col("patronymic")).alias("p"), F.transform("letters", F.upper).alias("letters"))
    by_surname = asked.where("s IS NOT NULL").join(index.select("*", F.explode("surname").alias("form")), F.col("s") == F.col("form"))
    by_patronymic = asked.where("s IS NULL AND p IS NOT NULL").join(index.select("*", F.explode("patronymic").alias("form")), F.col("p") == F.col("form"))
    near = by_surname.unionByName(by_patronymic)
    same = lambda mine, theirs: F.col(mine).isNull() | (F.size(theirs) == 0) | F.array_contains(theirs, F.col(mine))
    first, second = F.col("letters")[0], F.try_element_at("letters", F.lit(2))
    own, other = F.try_element_at("initials", F.lit(1)), F.try_element_at("initials", F.lit(2))
    # initials of an unknown given name match anything
    fits = (F.size("letters") == 0) | ((own.isNull() | (first == own)) & (second.isNull() | other.isNull() | (second == other)))
    told = F.col("g").isNull() | (F.size("given") > 0) | (F.size("initials") == 0) | (F.upper(F.left("g", F.lit(1))) == own)
    near = near.where(same("g", "given") & same("p", "patronymic") & fits & told)
    return near.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set("person_id")).alias("candidates"))


FOUND = ["start", "end", "category", "decision", "confidence", "reason", "candidates", "person_key"]


def findings(named: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """keys and FOUND: every mention that is somebody known, or that is a person by its shape."""
    hits = find(named, people, keys)
    rows = named.join(hits, [*keys, "start", "end"], "left")
    many, one = F.size("candidates") > 1, F.size("candidates") == 1
    shapes = F.create_map(*(F.lit(x) for name, (c, d, p) in SHAPES.items() for x in (name, f"{c},{d},{p}")))
    own = F.split(F.try_element_at(shapes, F.col("shape")), ",")
    unknown = fold(F.concat_ws(" ", "n_surname", "n_given", "n_patronymic", F.array_join("letters", "")))
    return rows.where((F.size("candidates") > 0) | (F.col("shape") != "word")).select(
        *keys, "start", "end",
        F.when(one | many, "PERSON").otherwise(own[0]).alias("category"),
        F.when(many, "REVIEW").when(one, "AUTO").otherwise(own[1]).alias("decision"),
        F.when(many, 0.55).when(one, 0.97).otherwise(own[2].cast("double")).alias("confidence"),
        F.when(many, NAMESAKES).when(one, KNOWN).otherwise(F.concat(F.lit("shape: "), "shape")).alias("reason"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
        F.when(one, F.col("candidates")[0]).otherwise(unknown).alias("person_key"),
    )


def misspelt(named: DataFrame, people: DataFrame, keys: list[str], least: float = 0.85, most: int = 120) -> DataFrame:
    """keys and FOUND: lone words like a known surname, blocked by their first three letters and a length that differs by one at most.

    At most `most` surnames are compared with a word (the nearest by length, then by name), as a rule
    of the product. Similarity is 1 - edits / length of the longer word.
    """
    words = named.where("shape = 'word' AND length(surname) >= 5").withColumn("form", fold(F.col("surname")))
    names = people.select(fold(F.col("surname")).alias("name"), "person_id").where("length(name) >= 5").distinct()
    near = words.select("form").distinct().withColumn("block", F.left("form", F.lit(3)))
    near = near.join(names.withColumn("block", F.left("name", F.lit(3))), "block").where("abs(length(form) - length(name)) <= 1 AND form != name")
    order = Window.partitionBy("form").orderBy(F.abs(F.length("form") - F.length("name")), "name", "person_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    near = near.withColumn("ratio", 1 - F.levenshtein("form", "name") / F.greatest(F.length("form"), F.length("name"))).where(F.col("ratio") >= least)
    best = near.groupBy("form").agg(F.array_sort(F.collect_set("person_id")).alias("candidates"), F.least(F.max("ratio"), F.lit(0.89)).alias("typo"))
    known = form_index(people).select("form").distinct()
    found = words.join(best, "form").join(known, "form", "left_anti")
    return found.select(*keys, "start", "end", F.lit("POSSIBLE_PERSON").alias("category"), F.lit("REVIEW").alias("decision"), F.col("typo").alias("confidence"), F.lit(TYPO).alias("reason"), "candidates", F.col("form").alias("person_key"))
