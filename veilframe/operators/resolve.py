"""Overlap resolution: which of the candidates of a text keep their spans.

Candidates are taken by priority, length, confidence and start (ties by the order of emission);
each keeps its span if nothing taken overlaps it. A container that lost part of its span is split
into the fragments that are still free and long enough. One fold over the sorted array, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import CONTAINERS, FRAGMENT
from .rules import FINDING


def resolved(candidates: Column, kind: str = FINDING) -> Column:
    """array<kind> of disjoint findings, ordered by start. kind is FINDING or a struct with its fields and more."""
    keyed = F.transform(
        candidates,
        lambda f: F.struct(
            (-f["priority"]).alias("a"), (f["start"] - f["end"]).alias("b"), (-f["confidence"]).alias("c"), f["start"].alias("d"), f["emit_seq"].alias("e"), f.alias("f")
        ),
    )
    order = F.transform(F.array_sort(keyed), lambda k: k["f"])
    none = F.array().cast(f"array<{kind}>")

    def free(done: Column, x: Column) -> Column:
        """The parts of x that nothing in done covers, as findings."""
        over = F.array_sort(F.transform(F.filter(done, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])), lambda y: F.struct(y["start"].alias("s"), y["end"].alias("t"))))
        gaps = F.aggregate(
            over,
            F.struct(x["start"].alias("at"), F.array().cast("array<struct<s:int,t:int>>").alias("out")),
            lambda g, y: F.struct(F.greatest(g["at"], y["t"]).alias("at"), F.when(y["s"] > g["at"], F.concat(g["out"], F.array(F.struct(g["at"].alias("s"), y["s"].alias("t"))))).otherwise(g["out"]).alias("out")),
            lambda g: F.when(g["at"] < x["end"], F.concat(g["out"], F.array(F.struct(g["at"].alias("s"), x["end"].alias("t"))))).otherwise(g["out"]),
        )
        parts = F.filter(gaps, lambda p: p["t"] - p["s"] >= FRAGMENT)
        return F.transform(parts, lambda p: x.withField("start", p["s"]).withField("end", p["t"]).withField("original", F.substr(x["original"], p["s"] - x["start"] + 1, p["t"] - p["s"])))

    def take(done: Column, x: Column) -> Column:
        clear = ~F.exists(done, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
        return F.when(clear, F.concat(done, F.array(x))).when(x["category"].isin(*CONTAINERS), F.concat(done, free(done, x))).otherwise(done)

    kept = F.aggregate(order, none, take)
    by_start = F.array_sort(F.transform(kept, lambda f: F.struct(f["start"].alias("s"), (f["start"] - f["end"]).alias("n"), f.alias("f"))))
    return F.when(F.size(candidates) == 0, none).otherwise(F.transform(by_start, lambda k: k["f"]))


def resolve(units: DataFrame) -> DataFrame:
    """units with findings in place of candidates."""
    return units.withColumn("findings", resolved(F.col("candidates"))).drop("candidates")


def open_namesakes(findings: DataFrame) -> DataFrame:
    """A person found but not told from a namesake is hidden under a key of its own, typos apart."""
    from ..functions.text import fold

    hit = (F.col("category") == "PERSON") & (F.col("decision") == "REVIEW") & (F.size("candidates") > 0) & ~F.contains("reason", F.lit("typo"))
    return findings.withColumns({"key": F.when(hit, fold(F.col("original"))).otherwise(F.col("key")), "decision": F.when(hit, "AUTO").otherwise(F.col("decision"))})


def override(findings: DataFrame, choices: DataFrame) -> DataFrame:
    """Applies what users decided: choices (folded, choice) with keep or hide, one row for each folded text."""
    from ..functions.text import fold

    rows = findings.join(choices.select(F.col("folded").alias("__folded"), F.col("choice").alias("__choice")), fold(F.col("original")) == F.col("__folded"), "left")
    keep, hide = F.col("__choice") == "keep", F.col("__choice") == "hide"
    return rows.withColumns(
        {
            "decision": F.when(keep, "REVIEW").when(hide, "AUTO").otherwise(F.col("decision")),
            "category": F.when(hide & (F.col("category") == "POSSIBLE_PERSON"), "PERSON").otherwise(F.col("category")),
            "confidence": F.when(hide, 1.0).otherwise(F.col("confidence")),
            "reason": F.when(keep, "kept by the user").when(hide, "hidden by the user").otherwise(F.col("reason")),
        }
    ).drop("__folded", "__choice")


def suggestions(findings: DataFrame, strong: float = 0.7, most_strong: int = 200, most_weak: int = 60) -> DataFrame:
    """What a user should decide on: open findings by folded text, the most frequent of the strong and of the weak."""
    from pyspark.sql import Window

    from ..functions.text import fold

    rows = findings.where("decision = 'REVIEW'").groupBy(fold(F.col("original")).alias("folded"))
    rows = rows.agg(F.count("*").alias("count"), F.min("original").alias("original"), F.max("confidence").alias("confidence")).withColumn("strong", F.col("confidence") >= strong)
    place = F.row_number().over(Window.partitionBy("strong").orderBy(F.desc("count"), F.desc("confidence"), "folded"))
    return rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("strong"), most_strong).otherwise(most_weak))
