"""Workbook tables: what a header says about the cells below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.names import name_mentions
from ..functions.text import person_id
from .entities import entity_key

PERSON_HEADER = r"(?iU)\b(?:фио|ф\.\s?и\.\s?о\.|сотрудник\w*|менеджер\w*|ответственн\w+|исполнител\w+|руководител\w+|имя|фамилия|name|employee|manager|owner)\b"
PLACE_HEADER = r"(?iU)\b(?:город\w?|регион\w?|област\w+|насел[её]нн\w+ пункт\w?|филиал\w?|площадк\w+|city|region|location)\b"
HEADER_ROWS, HEADER_WORDS = 15, 5


def under_headers(cells: DataFrame, pattern: str) -> DataFrame:
    """Cells (file, sheet, col, row, text) below the lowest matching header of their column."""
    header = (F.col("row") <= HEADER_ROWS) & F.col("text").rlike(pattern) & (F.size(F.split(F.trim("text"), r"\s+")) <= HEADER_WORDS)
    heads = cells.where(header).groupBy("file", "sheet", "col").agg(F.max("row").alias("__head"))
    return cells.join(heads, ["file", "sheet", "col"]).where(F.col("row") > F.col("__head")).drop("__head")


def listed(cells: DataFrame) -> DataFrame:
    """Cells that list several values, split at commas, semicolons and line breaks, without a label in front."""
    body = F.regexp_replace("text", r"^[^:\n]{1,30}:\s*", "")
    return cells.withColumn("item", F.explode(F.filter(F.transform(F.split(body, r"\s*[,;\n]\s*"), F.trim), lambda x: x != "")))


def person_columns(cells: DataFrame) -> DataFrame:
    return listed(under_headers(cells, PERSON_HEADER)).where(F.col("item").rlike(r"(?U)^[A-ZА-ЯЁ][\w'.-]*(?: [A-ZА-ЯЁ][\w'.-]*){0,2}$"))


def place_columns(cells: DataFrame) -> DataFrame:
    """Values of place columns that hold at least two different ones that look like places."""
    rows = listed(under_headers(cells, PLACE_HEADER)).where(F.col("item").rlike(r"(?U)^[A-ZА-ЯЁ][\w-]+(?: [A-ZА-ЯЁа-яё][\w-]+){0,2}$"))
    enough = rows.groupBy("file", "sheet", "col").agg(F.count_distinct("item").alias("n")).where("n >= 2").drop("n")
    return rows.join(enough, ["file", "sheet", "col"], "left_semi")


def seeds_of_columns(cells: DataFrame, lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(category, key, original) of the places and (PEOPLE of operators/people.py) of the people that columns tell.

    Under a header of people an item is somebody whatever its shape: the first word that is no given name is the surname.
    """
    places = place_columns(cells).select(F.lit("CITY").alias("category"), entity_key(F.col("item")).alias("key"), F.col("item").alias("original")).distinct()
    rows = person_columns(cells).select("item").distinct().withColumn("m", F.get(name_mentions(F.col("item"), lexicon), F.lit(0)))
    first = F.split("item", " ")[0]
    rows = rows.select(F.coalesce("m.n_surname", F.when(F.col("m.n_given").isNull(), first)).alias("surname"), F.col("m.n_given").alias("given"), F.col("m.n_patronymic").alias("patronymic"), F.col("m.letters").alias("letters"))
    letters = F.when(F.size("letters") > 0, F.col("letters")).otherwise(F.array_compact(F.array(F.left("given", F.lit(1)), F.left("patronymic", F.lit(1)))))
    people = rows.where("length(surname) > 1").select(person_id(F.col("surname"), F.col("given"), F.col("patronymic")).alias("person_id"), "surname", "given", "patronymic", F.coalesce(letters, F.array().cast("array<string>")).alias("initials"))
    return places, people.dropDuplicates(["person_id"])
