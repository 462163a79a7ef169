"""Putting tokens into texts, and what keeps them apart from their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GUARD = "​"


def guarded(text: Column, start: Column, end: Column, token: Column) -> Column:
    """token with an invisible separator on each side where it would run into a Latin letter, digit or underscore."""
    before = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    # The letter of a spreadsheet header code (&R) is not a letter of a word.
    code = before.isin("L", "C", "R") & (start > 1) & (F.substr(text, start - 1, F.lit(1)) == "&")
    after = F.substr(text, end + 1, F.lit(1))
    glue = "^[A-Za-z0-9_]$"
    return F.concat(F.when(before.rlike(glue) & ~code, F.lit(GUARD)).otherwise(""), token, F.when(after.rlike(glue), F.lit(GUARD)).otherwise(""))


def spliced(text: Column, edits: Column, guard: bool = True) -> Column:
    """text with edits (array<struct<start,end,token>>) applied in one pass; of overlapping ones the first stays."""
    order = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["token"].alias("token"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        token = guarded(text, e["start"], e["end"], e["token"]) if guard else e["token"]
        more = F.concat(s["out"], F.array(F.substr(text, s["at"] + 1, e["start"] - s["at"]), token))
        return F.when(e["start"] >= s["at"], F.struct(e["end"].alias("at"), more.alias("out"))).otherwise(s)

    done = F.aggregate(order, empty, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1)))
    return F.when(F.coalesce(F.size(edits), F.lit(0)) == 0, text).otherwise(done)


def splice(units: DataFrame, edits: DataFrame, keys: list[str], text: str = "text", guard: bool = True) -> DataFrame:
    """units with text rewritten by edits (keys, start, end, token)."""
    lists = edits.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "token")).alias("__edits"))
    rows = units.join(lists, keys, "left")
    return rows.withColumn(text, spliced(F.col(text), F.col("__edits"), guard)).drop("__edits")
