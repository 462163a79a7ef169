"""Runs the structured rules over texts: one row of text in, an array of findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import VALIDATORS
from ..functions.matches import matches
from ..functions.patterns import BIRTH_CONTEXT, RULES, Rule, priority_of
from ..functions.scan import Scanner, read
from ..functions.text import finding_id, identity_key
from ..functions.tokens import EMAIL_TOKEN

FINDING = "struct<category:string,start:int,end:int,original:string,decision:string,confidence:double,reason:string,priority:int,emit_seq:int>"


def rule_findings(text: Column, rule: Rule, seq: int = 0) -> Column:
    """array<FINDING> of one rule, as functions of Spark only. detect() runs many rules in one pass."""
    found = matches(text, rule.java, rule.group)
    if rule.check:
        found = F.filter(found, lambda m: VALIDATORS[rule.check](m["value"]))
    fixed = {"decision": F.lit("AUTO"), "confidence": F.lit(rule.confidence), "reason": F.lit(rule.name), "priority": F.lit(priority_of(rule.category)), "emit_seq": F.lit(seq)}
    found = F.transform(found, lambda m: F.struct(F.lit(rule.category).alias("category"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("original"), *(v.alias(k) for k, v in fixed.items())))
    if rule.needs is None:
        return found
    may = text.rlike(r"(?U)\d") if rule.needs == "digit" else F.contains(text, F.lit(rule.needs))
    return F.when(may, found).otherwise(F.array().cast(f"array<{FINDING}>"))


def chosen(secrets: bool = True, personal: bool = True, business: bool = False) -> tuple[Rule, ...]:
    wanted = {"SECRET": secrets, "BUSINESS": business}
    return tuple(r for r in RULES if wanted.get(r.category, personal))


def detect(units: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] | None = None, literals: bool = True, lone_dates: bool = False, hide: tuple[str, ...] = ()) -> DataFrame:
    """keys and the fields of HIT: what all rules find, not yet resolved, in raw coordinates."""
    rows = read(units, keys, text, Scanner(chosen() if rules is None else rules, literals, hide, lone_dates), None, None)
    return rows.select(*keys, F.explode("rules").alias("__f")).select(*keys, "__f.*").withColumn("finding_id", finding_id(*map(F.col, keys), F.col("start"), F.col("end"), F.col("original")))


def birth_files(units: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The files whose texts speak of births."""
    return units.where(F.col(text).rlike(f"(?U){BIRTH_CONTEXT}")).select(file).distinct()


def residual_rules(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """What the rules still find after a rewrite, tokens apart: keys, category, start, end, original."""
    found = detect(units, keys, text, literals=False)
    return found.where(~F.col("original").rlike(f"^(?:{EMAIL_TOKEN})$")).select(*keys, "category", "start", "end", "original", "reason")
