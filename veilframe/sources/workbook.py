"""Workbooks: cells as rows, numbers hidden and shown again, and sheet names that stay valid."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.numbers import canonical, canonical_number, should_replace, surrogates
from .ooxml import _local, _parse, _serialised, container_status, entries

CELL = "file string, sheet string, col int, row int, text string, kind string"
_REF = re.compile(r"([A-Z]+)([0-9]+)$")
# Number formats of dates and times that a workbook need not spell out.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
# End of fixed values.
_SHEET = re.compile(r"xl/worksheets/[^/]+\.xml$")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _date_styles(parts: dict[str, bytes]) -> set[int]:
    """The cell styles that show dates or times."""
    root = _parse(parts["xl/styles.xml"]) if "xl/styles.xml" in parts else None
    if root is None:
        return set()
    own = {int(f.get("numFmtId", -1)) for f in root.iter() if _local(f.tag) == "numFmt" and re.search(r"(?i)[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")))}
    styles = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}


def _texts(parts: dict[str, bytes]) -> list[str]:
    root = _parse(parts["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in parts else None
    return [] if root is None else ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root if _local(si.tag) == "si"]


def _value(cell: ElementTree.Element) -> ElementTree.Element | None:
    return next((v for v in cell if _local(v.tag) == "v"), None)


def _kind(cell: ElementTree.Element, dates: set[int]) -> str:
    """text, formula, date or number."""
    if any(_local(x.tag) == "f" for x in cell):
        return "formula"
    if cell.get("t") not in (None, "n"):
        return "text"
    return "date" if int(cell.get("s", 0)) in dates else "number"


def _cells(file: str, content: bytes) -> Iterator[tuple]:
    parts = {i.filename: d for i, d in entries(content)}
    shared, dates = _texts(parts), _date_styles(parts)
    for name, data in parts.items():
        if not _SHEET.match(name) or (root := _parse(data)) is None:
            continue
        for c in (x for x in root.iter() if _local(x.tag) == "c"):
            at, v = _REF.match(c.get("r", "")), _value(c)
            if at is None:
                continue
            if c.get("t") == "s" and v is not None and (v.text or "").isdigit() and int(v.text) < len(shared):
                text = shared[int(v.text)]
            elif c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
            else:
                text = v.text if v is not None else None
            if text:
                yield file, name, _column(at[1]), int(at[2]), text, _kind(c, dates)


def cells(files: DataFrame) -> DataFrame:
    """The cells of the workbooks among files (path, content, format): file, sheet, col, row, text, kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if not container_status(bytes(content)):
                    yield pd.DataFrame(_cells(path, bytes(content)), columns=["file", "sheet", "col", "row", "text", "kind"])

    return files.where("format = 'OOXML' AND lower(path) LIKE '%.xlsx'").select("path", "content").mapInPandas(run, CELL)


def numbers_of(files: DataFrame) -> DataFrame:
    """original (canonical): every number of the workbooks that is hidden; formulas, dates, texts, small numbers and years are not."""
    rows = cells(files).where("kind = 'number'").select(canonical_number(F.col("text")).alias("original"))
    return rows.where(F.col("original").isNotNull() & should_replace(F.col("original"))).distinct()


def _renumbered(content: bytes, mapping: dict[str, str]) -> bytes:
    """content with its numbers replaced, cached results of formulas and charts dropped, and a mark to calculate anew."""
    parts = {i.filename: d for i, d in entries(content)}
    dates = _date_styles(parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, data in entries(content):
            root = _parse(data) if _SHEET.match(info.filename) or info.filename == "xl/workbook.xml" or re.match(r"xl/charts/[^/]+\.xml$", info.filename) else None
            if root is not None:
                if info.filename == "xl/workbook.xml":
                    calc = next((x for x in root if _local(x.tag) == "calcPr"), None)
                    if calc is None:
                        calc = ElementTree.SubElement(root, root.tag.replace("workbook", "calcPr"))
                    calc.set("fullCalcOnLoad", "1")
                elif info.filename.startswith("xl/charts/"):
                    for point in (x for x in root.iter() if _local(x.tag) == "numCache"):
                        for v in (x for x in point.iter() if _local(x.tag) == "v"):
                            v.text = mapping.get(canonical(v.text) or "", v.text)
                else:
                    for c in (x for x in root.iter() if _local(x.tag) == "c"):
                        v = _value(c)
                        if v is None:
                            continue
                        if _kind(c, dates) == "formula":
                            c.remove(v)
                        elif _kind(c, dates) == "number":
                            v.text = mapping.get(canonical(v.text) or "", v.text)
                data = _serialised(root, data)
            z.writestr(info, data)
    return out.getvalue()


def _with_numbers(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """files (path, content) with the numbers of pairs (number, other) exchanged. Each workbook gets the pairs that it holds."""
    held = cells(files).where("kind IN ('number', 'formula')").select(F.col("file").alias("path"), canonical_number(F.col("text")).alias("number")).distinct()
    own = held.join(pairs, "number").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("number", "other"))).alias("pairs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [bytes(c) if not p else _renumbered(bytes(c), dict(p)) for c, p in zip(frame["content"], frame["pairs"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "content": out})

    return files.select("path", "content").join(own, "path", "left").select("path", "content", "pairs").mapInPandas(run, "path string, content binary")


def hide_numbers(files: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(files with surrogates for their numbers, the number map to keep)."""
    mapping = surrogates(numbers_of(files), known, key)
    return _with_numbers(files, mapping.select(F.col("original").alias("number"), F.col("surrogate").alias("other"))), mapping


def show_numbers(files: DataFrame, mapping: DataFrame) -> DataFrame:
    return _with_numbers(files, mapping.select(F.col("surrogate").alias("number"), F.col("original").alias("other")))


def valid_sheet_names(sheets: DataFrame, name: str = "name") -> DataFrame:
    """sheets (file, name) with fixed: without what a sheet name must not hold, at most 31 characters, unique in its file."""
    clean: Column = F.trim(F.regexp_replace(F.col(name), r"[\[\]:*?/\\]", " "))
    clean = F.regexp_replace(F.left(F.when(clean == "", F.lit("Sheet")).otherwise(clean), F.lit(31)), r"^'+|'+$", "")
    rows = sheets.withColumn("__clean", clean)
    place = F.row_number().over(Window.partitionBy("file", F.lower("__clean")).orderBy(name))
    rows = rows.withColumn("__n", place)
    tail = F.concat(F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))
    fixed = F.when(F.col("__n") > 1, F.concat(F.rtrim(F.left("__clean", 31 - F.length(tail))), tail)).otherwise(F.col("__clean"))
    return rows.withColumn("fixed", fixed).drop("__clean", "__n")


def renamed_references(formula: Column, old: Column, new: Column) -> Column:
    """A formula with the references to one sheet rewritten, quoted as the new name needs it."""
    quoted = F.concat(F.lit("'"), F.replace(new, F.lit("'"), F.lit("''")), F.lit("'!"))
    both = F.concat(F.lit(r"(?:'\Q"), F.replace(old, F.lit("'"), F.lit("''")), F.lit(r"\E'|(?<![\w'])\Q"), old, F.lit(r"\E)!"))
    return F.call_function("regexp_replace", formula, both, F.replace(quoted, F.lit("$"), F.lit(r"\$")))
