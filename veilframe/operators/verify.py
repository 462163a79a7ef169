"""What is checked after a rewrite, and what is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import base_of, group_of, kind_of

WORD = r"(?U)[\w-]+"


def kind_counts(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Replacements and distinct entities by report group."""
    rows = tokens.withColumn("group", group_of(kind_of(F.col("category"))))
    return rows.groupBy(*by, "group").agg(F.count("*").alias("replaced"), F.count_distinct(base_of(F.col("token"))).alias("entities"))


def whole(text: Column, value: Column) -> Column:
    """Whether a value stands in a text with no letter, digit or underscore on either side."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.contains(text, value) & F.call_function("rlike", text, quoted)


def residual_values(units: DataFrame, originals: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Originals that still stand in the rewritten units as whole words: keys, original.

    Originals and texts meet on the first word of the original, without the text; only the units that
    hold that word are fetched and searched. So no original is compared with every text, and a text
    is not copied for each of its words.
    """
    first = lambda c: F.regexp_extract(c, WORD, 0)
    values = originals.select("original").where("original IS NOT NULL AND original != ''").distinct().withColumn("__first", first(F.col("original")))
    words = units.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))).alias("__first"))
    hits = words.join(values.where("__first != ''"), "__first").select(*keys, "original")
    # an original that has no word at all is searched for in every text; there are few such
    rest = values.where("__first = ''").select("original")
    body = units.select(*keys, F.col(text).alias("__text"))
    found = hits.join(body, keys).where(whole(F.col("__text"), F.col("original"))).select(*keys, "original")
    marks = [r["original"] for r in rest.limit(1000).collect()]
    if marks:
        more = body.select(*keys, "__text", F.explode(F.array(*map(F.lit, marks))).alias("original")).where(F.contains("__text", F.col("original")))
        found = found.unionByName(more.select(*keys, "original"))
    return found.distinct()


def word_difference(before: DataFrame, after: DataFrame, text: str = "text") -> DataFrame:
    """Words (with multiplicity) that the second table lost or gained: word, lost, gained."""
    tally = lambda df, name: df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias(name))
    both = tally(before, "a").join(tally(after, "b"), "word", "full_outer").na.fill(0)
    return both.where("a != b").select("word", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("gained"))


def same_structure(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of container structure (entries and their properties) that differ, with side."""
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def file_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """file, format, status, counts by category (a map) and total. A file with open findings is to be reviewed."""
    sums = findings.groupBy("file", "category").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("decision") == "REVIEW").alias("open"))
    each = sums.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("counts"), F.sum("n").cast("int").alias("total"), F.sum("open").alias("open"))
    rows = files.join(each, "file", "left")
    status = F.when(F.col("total").isNull(), "CLEAN").when(F.col("open") > 0, "REVIEW").otherwise("REPLACED")
    return rows.select("file", "format", status.alias("status"), F.coalesce("counts", F.create_map().cast("map<string,int>")).alias("counts"), F.coalesce("total", F.lit(0)).alias("total"))


def many_amounts(text: Column, least: int = 20) -> Column:
    """Whether a text holds so many amounts of money that a notice is due."""
    return F.regexp_count(text, F.lit(r"(?iU)[0-9][0-9 .,]*\s?(?:руб|₽|тыс|млн|usd|eur|\$|€)")) >= least
