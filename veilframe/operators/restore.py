"""Restoring originals: tokens are found in any text, looked up in the vault, and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.matches import matches
from ..functions.tokens import EMAIL_TOKEN, KINDS, TOKEN, TOKEN_AFTER_UNDERSCORE, parse_token
from .splice import GUARD, splice
from .vault import Vault, lookup


def found_tokens(text: Column, after_underscore: bool = False) -> Column:
    """array<struct<start,end,value>> of tokens, wider by the separators beside them."""
    both = F.concat(matches(text, TOKEN_AFTER_UNDERSCORE if after_underscore else TOKEN), matches(text, EMAIL_TOKEN))
    return F.when(text.rlike("[0-9]"), both).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def token_rows(units: DataFrame, keys: list[str], text: str = "text", after_underscore: bool = False) -> DataFrame:
    """One row for each token: keys, start, end (separators included), raw, base, variant, suffix, ending."""
    body = F.col(text)
    rows = units.select(*keys, body.alias("__t"), F.explode(found_tokens(body, after_underscore)).alias("m"))
    read = parse_token(F.col("m.value"))
    rows = rows.withColumn("read", read)
    start, end = F.col("m.start"), F.col("m.end")
    wider = F.when((start > 0) & (F.substr("__t", start, F.lit(1)) == GUARD), start - 1).otherwise(start)
    longer = F.when(F.substr("__t", end + 1, F.lit(1)) == GUARD, end + 1).otherwise(end)
    ending = F.substr("__t", end + 1, F.lit(1)).rlike("^[а-я]$")
    return rows.select(*keys, wider.alias("start"), longer.alias("end"), F.col("m.value").alias("raw"), F.col("read.base").alias("base"), F.col("read.kind").alias("kind"), F.col("read.number").alias("number"), F.col("read.variant").alias("variant"), F.col("read.suffix").alias("suffix"), ending.alias("ending"))


def resolved_tokens(units: DataFrame, vault: Vault, keys: list[str], text: str = "text", after_underscore: bool = False) -> DataFrame:
    """token_rows with status and replacement (null where the token stays)."""
    rows = lookup(vault, token_rows(units, keys, text, after_underscore))
    # A suffix that is no known spelling was text: the first spelling and the suffix come back.
    back = F.when(F.col("status") == "ok", F.col("original")).when(F.col("status") == "variant_missing", F.concat("original", F.when(F.col("suffix") != "", F.concat(F.lit("_"), F.col("suffix"))).otherwise("")))
    return rows.withColumn("replacement", back)


def restore(units: DataFrame, vault: Vault, keys: list[str], text: str = "text") -> DataFrame:
    """units with every token that the vault knows replaced by its spelling; what it does not know stays."""
    edits = resolved_tokens(units, vault, keys, text).where("replacement IS NOT NULL")
    return splice(units, edits.select(*keys, "start", "end", F.col("replacement").alias("token")), keys, text, guard=False)


def restore_stats(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Sums over resolved tokens: found, restored, variant_fallback, endings, and the tokens that stayed."""
    gone = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("base"))))
    return tokens.groupBy(*by).agg(
        F.count("*").alias("found"), F.count("replacement").alias("restored"), F.count_if(F.col("status") == "variant_missing").alias("variant_fallback"),
        F.count_if("ending").alias("endings"), gone("unknown").alias("unknown"), gone("removed").alias("removed"),
    )


def broken_tokens(text: Column) -> Column:
    """Strings that look like damaged tokens: a space before the number, or two tokens run together."""
    stem = f"(?:{'|'.join(k.stem for k in KINDS if k.code != 'EMAIL')})"
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(rf"\b{stem} [0-9]{{1,7}}\b"), F.lit(0)), F.regexp_extract_all(text, F.lit(rf"\b{stem}[0-9]{{1,7}}{stem}[0-9]{{1,7}}\b"), F.lit(0))))


def sources(tokens: DataFrame, history: DataFrame, rounds: int = 20) -> list[str]:
    """Which earlier runs (history: id, time, tokens) the tokens of a text come from: greedy cover, newest first among equals.

    The history is a list of at most 200 runs, so the driver holds one row of it at a time.
    """
    left = tokens.select(F.col("base").alias("token")).distinct()
    runs = history.select("id", "time", F.explode("tokens").alias("token")).distinct()
    picked: list[str] = []
    for _ in range(rounds):
        best = runs.join(left, "token", "left_semi").groupBy("id", "time").count().orderBy(F.desc("count"), F.desc("time"), "id").first()
        if best is None:
            break
        picked.append(best["id"])
        left = left.join(runs.where(F.col("id") == best["id"]), "token", "left_anti")
    return picked
