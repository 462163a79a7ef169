"""Files as rows: classification, encodings, guards, folders and safe names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Formats by extension, and limits.
FORMATS = {
    "TEXT": ("txt", "csv", "tsv", "md", "json", "xml", "log", "htm", "html", "ini", "yaml", "yml"),
    "OOXML": ("xlsx", "docx", "pptx"),
    "ODF": ("odt", "ods", "odp"),
    "MACRO_OFFICE": ("xlsm", "docm", "pptm"),
    "OLD_OFFICE": ("xls", "doc", "ppt"),
    "PDF": ("pdf",),
    "IMAGE": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp", "heic"),
}
MAX_FILES, MAX_TOTAL, MAX_FILE, MAX_UNPACKED = 5000, 4 << 30, 300 << 20, 1 << 30
SKIPPED = (".ds_store", "thumbs.db", "desktop.ini")
OLE_HEADER = "D0CF11E0A1B11AE1"
# End of fixed values.

SUPPORTED = ("TEXT", "OOXML")
REASONS = {
    "OLD_OFFICE": "An old Office format: save it in the current one.",
    "MACRO_OFFICE": "A file with macros: save a copy without them.",
    "ODF": "OpenDocument is not supported: save it as an Office file.",
    "IMAGE": "Text in images is not read.",
    "PDF": "PDF is not read here: there is no library for it.",
    "UNSUPPORTED": "This format is not supported.",
}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def classify(name: Column) -> Column:
    """TEXT, OOXML, ODF, MACRO_OFFICE, OLD_OFFICE, PDF, IMAGE or UNSUPPORTED, by the extension."""
    known = F.create_map(*(F.lit(x) for kind, all_ in FORMATS.items() for e in all_ for x in (e, kind)))
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("UNSUPPORTED"))


def unsupported_reason(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), kind)


def sniffed(raw: bytes) -> str:
    """The encoding of raw: a UTF-8 or UTF-16 mark, else UTF-8, else Windows-1251 where it decodes."""
    if raw[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for name in ("utf-8", "cp1251"):
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def _decoded(raws: pd.Series) -> pd.DataFrame:
    names = [sniffed(bytes(r or b"")) for r in raws]
    return pd.DataFrame({"encoding": names, "text": [bytes(r or b"").decode(n, "replace") for r, n in zip(raws, names, strict=True)]})


def _encoded(texts: pd.Series, names: pd.Series) -> pd.Series:
    def one(text: str, name: str) -> bytes:
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return text.encode("utf-8")

    return pd.Series([one(t or "", n) for t, n in zip(texts, names, strict=True)])


def decoded(content: Column) -> Column:
    """struct<encoding,text> of the bytes of a text file."""
    return F.pandas_udf(_decoded, "struct<encoding:string,text:string>")(content)


def encoded(text: Column, encoding: Column) -> Column:
    """The bytes of a text in the encoding that it came in, or in UTF-8 where that cannot hold it."""
    return F.pandas_udf(_encoded, "binary")(text, encoding)


def container_problem(name: Column, content: Column) -> Column:
    """Why an Office file cannot be opened; empty if nothing speaks against it."""
    kind, head = classify(name), F.hex(F.substring(content, 1, 8))
    return (
        F.when((kind == "OOXML") & F.startswith(head, F.lit(OLE_HEADER)), "The file is protected by a password or in an old format.")
        .when((kind == "OOXML") & ~F.startswith(head, F.lit("504B")), "The file is damaged: it is no Office document.")
        .when(F.length(content) > MAX_FILE, "The file is larger than 300 MB.")
        .otherwise("")
    )


def _safe(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFC", n or ""))


def safe_name(name: Column) -> Column:
    """A file name without folders and characters that systems refuse, of at most 150 characters."""
    base = F.element_at(F.split(F.pandas_udf(_safe, "string")(name), r"[\\/]"), -1)
    base = F.regexp_replace(F.trim(base), r"^\.+|\.+$", "")
    base = F.regexp_replace(F.when(base == "", F.lit("file")).otherwise(base), r'[<>:"|?*\x00-\x1f]', "_")
    ext = F.element_at(F.split(base, r"\."), -1)
    stem = F.left(base, F.length(base) - F.length(ext) - 1)
    short = (F.length(base) > 150) & F.contains(base, F.lit(".")) & (F.length(stem) > 0) & F.length(ext).between(1, 10)
    return F.when(short, F.concat(F.rtrim(F.left(stem, 149 - F.length(ext))), F.lit("."), ext)).otherwise(F.left(base, F.lit(150)))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, length, content, format of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("name"), "length", "content").withColumn("format", classify(F.col("name")))


def scan_folder(files: DataFrame) -> DataFrame:
    """files (path, name, length, format) with status (taken, skipped, hidden, limit) and reason.

    At most MAX_FILES files and MAX_TOTAL bytes are taken, in the order of their paths: the limit is
    a rule of the product, not of the engine, and a listing is small beside what it lists.
    """
    hidden = F.lower("name").isin(*SKIPPED) | F.col("name").rlike(r"^(?:~\$|\.)")
    rows = files.withColumn("__ok", ~hidden & F.col("format").isin(*SUPPORTED))
    order = Window.partitionBy("__ok").orderBy(F.lower("path"), "path")
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__sum", F.sum("length").over(order))
    status = F.when(hidden, "hidden").when(~F.col("__ok"), "skipped").when((F.col("__n") > MAX_FILES) | (F.col("__sum") > MAX_TOTAL), "limit").otherwise("taken")
    reason = F.when(status == "skipped", unsupported_reason(F.col("format"))).when(status == "limit", "The folder holds more than is taken at once.")
    return rows.withColumns({"status": status, "reason": reason}).drop("__ok", "__n", "__sum")


def text_units(files: DataFrame) -> DataFrame:
    """One unit for each text file: file, location, text, encoding."""
    rows = files.where("format = 'TEXT'").withColumn("__d", decoded(F.col("content")))
    return rows.select(F.col("path").alias("file"), F.lit("").alias("location"), F.col("__d.text").alias("text"), F.col("__d.encoding").alias("encoding"))


def mirror_names(files: DataFrame, numbers: DataFrame) -> DataFrame:
    """files (path, name) with the neutral name of each: File7.txt; numbers (number, name) come from the vault, by path."""
    named = files.join(numbers.select(F.col("name").alias("__name"), "number"), F.col("path") == F.col("__name"))
    return named.withColumn("neutral", F.concat(F.lit("File"), F.col("number"), F.lit("."), extension(F.col("name")))).drop("__name", "number")


def original_names(files: DataFrame, numbers: DataFrame) -> DataFrame:
    """files (name) with original: the path that a neutral name stands for, also where a copy got a suffix; null if none."""
    number = F.regexp_extract("name", r"(?i)^File([0-9]{1,9})(?:[ _(-].*)?\.[^.]+$", 1).try_cast("bigint")
    return files.withColumn("__n", number).join(numbers.select(F.col("number").alias("__n"), F.col("name").alias("original")), "__n", "left").drop("__n")


def free_names(files: DataFrame, name: str = "neutral") -> DataFrame:
    """files with names made unique: name.txt, name (2).txt, in the order of their paths."""
    place = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("path"))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.left(F.col(name), F.length(name) - F.length(ext))
    return files.withColumn("__n", place).withColumn(name, F.when(F.col("__n") > 1, F.concat(stem, F.lit(" ("), F.col("__n"), F.lit(")"), ext)).otherwise(F.col(name))).drop("__n")


def peek(files: DataFrame, tokenised: DataFrame) -> DataFrame:
    """path, format, problem, tokenised: whether each file can be taken, and whether it holds tokens already (tokenised: file)."""
    found = tokenised.select(F.col("file").alias("path"), F.lit(True).alias("tokenised")).distinct()
    problem = F.coalesce(unsupported_reason(F.col("format")), container_problem(F.col("name"), F.col("content")))
    return files.select("path", "format", problem.alias("problem")).join(found, "path", "left").na.fill({"tokenised": False})


def zipped(files: DataFrame, path: str) -> None:
    """Writes files (neutral, content) into one ZIP on the driver, a file at a time: what a user takes home, not a data set."""
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.select("neutral", "content").orderBy("neutral").toLocalIterator():
            z.writestr(row["neutral"], bytes(row["content"]))
