"""Where a pattern matches, with code-point positions, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MATCH = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value>> of the matches of a Java pattern, which must not match empty.

    With group 1 the value is that group, which has to end where the match ends. Evaluated only
    where the text matches at all.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCH}>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))
        hit = F.struct((end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["size"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(hit))).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step)["found"]).otherwise(F.array().cast(f"array<{MATCH}>"))
