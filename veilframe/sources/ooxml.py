"""Office containers: their texts as units, and rewritten containers from edited units.

One row is one file; a task reads its entries with the standard library. A unit is a paragraph,
cell, header, comment or named attribute; its location is the entry, the kind and the place. The
writer copies every entry that has no edit byte for byte.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import luhn_ok, snils_ok
from ..functions.text import strip_header_codes
from ..operators.splice import splice
from ..plans.lineage import settled
from .files import MAX_UNPACKED

# Elements and attributes that hold text.
META_TAGS = ("creator", "lastModifiedBy", "company", "manager", "comments", "description", "subject", "keywords", "title", "category", "Company", "Manager", "contentStatus", "HyperlinkBase", "Template")
TEXT_TAGS = ("t", "text", "delText", "f", "definedName", "oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter", "author", "instrText", "lpwstr", "bstr", "lpstr", "formula1", "formula2", "formula", *META_TAGS)
GROUP_TAGS = ("p", "si", "c", "comment", "definedName", "oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter", "pt", "tx", "formula1", "formula2", "formula")
BREAKS = {"tab": " ", "br": "\n", "cr": "\n"}
PERSON_ATTRS = ("author", "initials", "userId", "lastModifiedBy", "creator", "displayName")
NAMED_ATTRS = (("sheet", "name"), ("cNvPr", "name"), ("cNvPr", "descr"), ("cNvPr", "title"), ("docPr", "name"), ("docPr", "descr"), ("docPr", "title"), ("table", "name"), ("table", "displayName"), ("tableColumn", "name"), ("hyperlink", "tooltip"), ("hyperlink", "display"), ("definedName", "name"), ("bookmarkStart", "name"), ("theme", "name"))
# End of fixed values.

UNIT = "file string, part_idx int, is_attr boolean, group_idx int, location string, text string"
_DOCTYPE = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parse(data: bytes) -> ElementTree.Element | None:
    """The tree of an XML entry; entries with a document type or entities are refused."""
    if _DOCTYPE.search(data):
        raise ValueError("document types and entities are not allowed in a container")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return None


def _literal(node: ElementTree.Element, parent: ElementTree.Element | None) -> bool:
    """Whether a <v> holds text and not an index into the shared strings."""
    if parent is None:
        return False
    if _local(parent.tag) == "c":
        return parent.get("t") in ("str", "inlineStr") or _numeric_text(parent)
    return _local(parent.tag) in ("pt", "tx", "v")


def groups(root: ElementTree.Element) -> Iterator[list[tuple[ElementTree.Element | None, str]]]:
    """The units of a tree: lists of (element to write to, or null for a break; text)."""
    parents = {c: p for p in root.iter() for c in p}
    found: dict[int, list] = {}
    for node in root.iter():
        name = _local(node.tag)
        text = node.text if name in TEXT_TAGS or (name == "v" and _literal(node, parents.get(node))) else None
        if not text and name not in BREAKS:
            continue
        top = node
        if name not in META_TAGS and name not in ("lpwstr", "bstr", "lpstr"):
            while top in parents and _local(top.tag) not in GROUP_TAGS:
                top = parents[top]
        if name in BREAKS and id(top) not in found:
            continue
        found.setdefault(id(top), []).append((None, BREAKS[name]) if name in BREAKS else (node, text))
    yield from found.values()


def attributes(root: ElementTree.Element) -> Iterator[tuple[ElementTree.Element, str, str]]:
    for node in root.iter():
        name = _local(node.tag)
        for key, value in node.attrib.items():
            if value and (_local(key) in PERSON_ATTRS or (name, _local(key)) in NAMED_ATTRS):
                yield node, key, value


def _numeric_text(cell: ElementTree.Element) -> bool:
    """A cell whose bare number is a card, a SNILS or an account: text in all but name."""
    value = next((v.text for v in cell if _local(v.tag) == "v"), None) or ""
    return _local(cell.tag) == "c" and cell.get("t") in (None, "n") and value.isdigit() and (luhn_ok(value) or snils_ok(value) or len(value) == 20)


def entries(content: bytes) -> list[tuple[zipfile.ZipInfo, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
            raise ValueError("the container is larger than 1 GB when unpacked")
        return [(i, z.read(i)) for i in z.infolist()]


def container_status(content: bytes) -> str:
    """Why a container cannot be read; empty if it can."""
    try:
        for info, data in entries(content):
            if info.filename.endswith((".xml", ".rels")):
                _parse(data)
    except (ValueError, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as problem:
        return str(problem) or type(problem).__name__
    return ""


def checked(files: DataFrame) -> DataFrame:
    """files with problem: empty, or why the file is left as it is."""

    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([container_status(bytes(c or b"")) for c in contents])

    return files.withColumn("problem", F.when(F.col("format") == "OOXML", F.pandas_udf(run, "string")("content")).otherwise(""))


def file_units(file: str, content: bytes, prefix: str = "", depth: int = 0) -> Iterator[tuple]:
    for number, (info, data) in enumerate(entries(content)):
        if depth < 2 and info.filename.lower().endswith((".xlsx", ".docx", ".pptx")):
            yield from file_units(file, data, f"{prefix}{info.filename}!", depth + 1)
        if not info.filename.endswith((".xml", ".rels")) or (root := _parse(data)) is None:
            continue
        for i, segments in enumerate(groups(root)):
            yield file, number, False, i, f"{prefix}{info.filename}", "".join(t for _, t in segments)
        for i, (_, _, value) in enumerate(attributes(root)):
            yield file, number, True, i, f"{prefix}{info.filename}", value


def units(files: DataFrame) -> DataFrame:
    """The units of the Office files among files (path, content, format)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                # a file that cannot be read has no units; checked() tells why
                if not container_status(bytes(content)):
                    yield pd.DataFrame(file_units(path, bytes(content)), columns=["file", "part_idx", "is_attr", "group_idx", "location", "text"])

    return files.where("format = 'OOXML'").select("path", "content").mapInPandas(run, UNIT)


def _write_group(segments: list, text: str) -> None:
    """Puts a text into the elements of a unit: each keeps what it had where the text did not change, the first of a changed stretch takes it."""
    old = "".join(t for _, t in segments)
    head = 0
    while head < min(len(old), len(text)) and old[head] == text[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(text)) - head and old[-1 - tail] == text[-1 - tail]:
        tail += 1
    middle, at, placed = text[head : len(text) - tail], 0, False
    for node, part in segments:
        a, b = at, at + len(part)
        at = b
        if node is None:
            continue
        keep_left = part[: max(0, min(len(part), head - a))]
        keep_right = part[max(0, min(len(part), len(old) - tail - a)) :] if b > len(old) - tail else ""
        put = ""
        if not placed and b >= head and (b > head or b == len(old)):
            put, placed = middle, True
        node.text = keep_left + put + (keep_right if len(keep_left) + len(keep_right) <= len(part) else "")
        if node.text != node.text.strip():
            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


_THUMBNAIL = re.compile(r"(?i)docProps/thumbnail\.\w+$")
_PAYLOAD = re.compile(r"(?i)(?:word|xl|ppt)/embeddings/[^/]+\.(?!xlsx$|docx$|pptx$)\w+$")


def _serialised(root: ElementTree.Element, data: bytes) -> bytes:
    """A tree as bytes, with the prefixes that it came with."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def rewritten(content: bytes, edits: dict[tuple[str, bool, int], str], prefix: str = "", depth: int = 0, scrub: bool = True) -> bytes:
    """content with the units in edits replaced; every other entry is copied.

    With scrub thumbnails go, and embedded payloads that cannot be read are emptied: both may show what was hidden.
    """
    by_entry: dict[str, dict[tuple[bool, int], str]] = {}
    for (entry, is_attr, number), text in edits.items():
        by_entry.setdefault(entry, {})[is_attr, number] = text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info, data in entries(content):
            here = f"{prefix}{info.filename}"
            if scrub and _THUMBNAIL.search(info.filename):
                continue
            if scrub and _PAYLOAD.search(info.filename):
                data = b""
            elif depth < 2 and info.filename.lower().endswith((".xlsx", ".docx", ".pptx")):
                data = rewritten(data, {k: v for k, v in edits.items() if k[0].startswith(f"{here}!")}, f"{here}!", depth + 1, scrub)
            elif info.filename.endswith("_rels/.rels") and scrub and (root := _parse(data)) is not None:
                for link in [x for x in root if _THUMBNAIL.search(x.get("Target", ""))]:
                    root.remove(link)
                    data = _serialised(root, data)
            elif (mine := by_entry.get(here)) and (root := _parse(data)) is not None:
                # attributes first: writing texts does not move them
                for i, (node, key, _) in enumerate(attributes(root)):
                    if (new := mine.get((True, i))) is not None:
                        node.set(key, new)
                numeric = [c for c in root.iter() if _numeric_text(c)]
                for i, segments in enumerate(groups(root)):
                    if (new := mine.get((False, i))) is not None:
                        _write_group(segments, new)
                for cell in numeric:
                    if not (next(v.text for v in cell if _local(v.tag) == "v") or "").isdigit():
                        cell.set("t", "str")
                data = _serialised(root, data)
            z.writestr(info, data)
    return out.getvalue()


def rewrite(files: DataFrame, new_units: DataFrame, scrub: bool = True) -> DataFrame:
    """files (path, content) with the content rewritten from units whose text changed (file, location, is_attr, group_idx, text)."""
    lists = new_units.groupBy("file").agg(F.collect_list(F.struct("location", "is_attr", "group_idx", "text")).alias("edits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [bytes(c) if e is None else rewritten(bytes(c), {(x["location"], x["is_attr"], x["group_idx"]): x["text"] for x in e}, scrub=scrub) for c, e in zip(frame["content"], frame["edits"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "content": out})

    rows = files.select("path", "content").join(lists, F.col("path") == F.col("file"), "left").select("path", "content", "edits")
    return rows.mapInPandas(run, "path string, content binary")


def structure(files: DataFrame) -> DataFrame:
    """path, entry, elements: how many elements each XML entry has, to compare a file before and after."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(path, i.filename, sum(1 for _ in root.iter()) if (root := _parse(d) if i.filename.endswith((".xml", ".rels")) else None) is not None else -1) for i, d in entries(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "entry", "elements"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, elements int")


KEYS = ["file", "part_idx", "is_attr", "group_idx", "location"]
#: Names of themes and templates that come with the programs.
_BUILT_IN = r"(?i)^(?:office(?: theme)?|тема office|normal(?:\.dotm)?|стандартная|microsoft .*)$"


def metadata_of(found: DataFrame) -> DataFrame:
    """KEYS and a finding for each whole value among the properties of a document, and each template or theme name that does not come with the programs."""
    inside = F.regexp_extract("location", r"([^!]*)$", 1)
    named = F.trim("text")
    rows = found.where(inside.rlike(r"^docProps/(?:core|app|custom)\.xml$") | (F.col("is_attr") & inside.rlike(r"/theme/[^/]+\.xml$")))
    rows = rows.where((named != "") & ~named.rlike(_BUILT_IN) & ~named.rlike(r"^[0-9T:.Z+-]+$"))
    return rows.select(
        *KEYS, F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("original"), F.lit("").alias("context"), F.lit("META").alias("category"), F.lit("AUTO").alias("decision"),
        F.lit(1.0).alias("confidence"), F.lit("a property of the document").alias("reason"), F.lit(1050).alias("priority"), F.lower(named).alias("key"), F.lit(500).alias("emit_seq"), F.array().cast("array<string>").alias("candidates"),
    )


def pseudonymize_files(files: DataFrame, vault, **options):
    """(files rewritten, result): every unit of the Office files goes through the engine, with what the columns of workbooks tell.

    Properties of the documents are hidden whole. Codes of headers (&L) are no letters of a word.
    """
    from ..operators.columns import seeds_of_columns
    from ..plans.engine import pseudonymize
    from .workbook import cells

    before = settled(units(files))
    header = F.col("location").rlike("worksheets/") & F.col("text").rlike("&[LCR]")
    seen = before.withColumn("seen", F.when(header, strip_header_codes(F.col("text"))).otherwise(F.col("text")))
    seeds, who = seeds_of_columns(cells(files))
    result = pseudonymize(seen.drop("text").withColumnRenamed("seen", "text"), vault, KEYS, extra=metadata_of(before), seeds=seeds, seed_people=who, **options)
    edits = result.findings.select(*KEYS, "start", "end", "token")
    out = splice(before, edits, KEYS)
    changed = out.join(before.withColumnRenamed("text", "old"), KEYS).where("NOT (text <=> old)")
    return rewrite(files, changed), result


def restore_files(files: DataFrame, vault, vault_id: str | None = None) -> DataFrame:
    """path, content, refused: the Office files with their originals; a file that another vault stamped is left as it is.

    In attributes a token may stand behind an underscore (a sheet or a table name).
    """
    from ..operators.restore import resolved_tokens

    marked = files.withColumn("mark", marker(F.col("content"))) if vault_id else files.withColumn("mark", F.lit(None).cast("string"))
    refused = F.col("mark").isNotNull() & (F.col("mark") != F.lit(vault_id or ""))
    ours = settled(units(files.join(marked.where(~refused | refused.isNull()).select("path"), "path", "left_semi")))
    texts = resolved_tokens(ours.where("NOT is_attr"), vault, KEYS)
    names = resolved_tokens(ours.where("is_attr"), vault, KEYS, after_underscore=True)
    edits = texts.unionByName(names).where("replacement IS NOT NULL").select(*KEYS, "start", "end", F.col("replacement").alias("token"))
    changed = splice(ours, edits, KEYS, guard=False).join(ours.withColumnRenamed("text", "old"), KEYS).where("NOT (text <=> old)")
    back = rewrite(files, changed, scrub=False)
    return back.join(marked.select("path", F.coalesce(refused, F.lit(False)).alias("refused")), "path")


_MARK = b"veilframe:"


def stamped(content: Column, vault_id: str) -> Column:
    """An Office file that names the vault of its tokens (in the comment of the container)."""

    def run(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> bytes:
            out = io.BytesIO(raw)
            with zipfile.ZipFile(out, "a") as z:
                z.comment = _MARK + vault_id.encode()
            return out.getvalue()

        return pd.Series([one(bytes(c)) for c in contents])

    return F.pandas_udf(run, "binary")(content)


def _marks(contents: pd.Series) -> pd.Series:
    def one(raw: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return z.comment[len(_MARK) :].decode() if z.comment.startswith(_MARK) else None
        except (zipfile.BadZipFile, UnicodeDecodeError):
            return None

    return pd.Series([one(bytes(c or b"")) for c in contents])


def marker(content: Column) -> Column:
    """The id of the vault that an Office file is stamped with, or null."""
    return F.pandas_udf(_marks, "string")(content)


def unstamped(content: Column) -> Column:
    def run(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> bytes:
            out = io.BytesIO(raw)
            with zipfile.ZipFile(out, "a") as z:
                z.comment = b""
            return out.getvalue()

        return pd.Series([one(bytes(c)) for c in contents])

    return F.pandas_udf(run, "binary")(content)


def census(files: DataFrame) -> DataFrame:
    """path, label, n: embedded payloads that cannot be read, by the end of their names, for a warning."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i.filename.rpartition(".")[2].lower()) for p, c in zip(frame["path"], frame["content"], strict=True) if not container_status(bytes(c)) for i, _ in entries(bytes(c)) if _PAYLOAD.search(i.filename)]
            yield pd.DataFrame(rows, columns=["path", "label"])

    return files.where("format = 'OOXML'").select("path", "content").mapInPandas(run, "path string, label string").groupBy("path", "label").agg(F.count("*").alias("n"))


def problems(files: DataFrame) -> DataFrame:
    """path, what, detail: entries that are no XML, links to parts that are not there, and tracked changes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if why := container_status(bytes(content)):
                    rows.append((path, "unreadable", why))
                    continue
                parts = dict((i.filename, d) for i, d in entries(bytes(content)))
                for name, data in parts.items():
                    if not name.endswith((".xml", ".rels")):
                        continue
                    if (root := _parse(data)) is None:
                        rows.append((path, "not XML", name))
                    elif name.endswith(".rels"):
                        rows += [(path, "dangling", target) for target in _targets(name, root) if target not in parts]
                    elif n := sum(_local(x.tag) in ("ins", "del", "moveFrom", "moveTo") for x in root.iter() if name.startswith("word/")):
                        rows.append((path, "tracked changes", str(n)))
            yield pd.DataFrame(rows, columns=["path", "what", "detail"])

    return files.where("format = 'OOXML'").select("path", "content").mapInPandas(run, "path string, what string, detail string")


def _targets(name: str, root: ElementTree.Element) -> Iterator[str]:
    """The parts that a relationship entry points to."""
    folder = name.replace("_rels/", "").rpartition("/")[0]
    for link in root:
        target = link.get("Target", "")
        if link.get("TargetMode") != "External" and target and not target.startswith("#"):
            yield posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
