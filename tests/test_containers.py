import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.operators.vault import Vault
from veilframe.plans.engine import inspect, pseudonymize, restore_all, verify
from veilframe.sources import files, ooxml, workbook
from veilframe.sources.store import VaultStore

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def book():
    strings = ["Сотрудник", "Лацис Юрий", "Город", "Тверь", "Казань", "Лацис получил"]
    shared = "".join(f"<si><t>{s}</t></si>" for s in strings)
    cell = lambda ref, n: f'<c r="{ref}" t="s"><v>{n}</v></c>'
    rows = [cell("A1", 0) + cell("B1", 2), cell("A2", 1) + cell("B2", 3), cell("B3", 4) + cell("C3", 5), '<c r="A4"><v>1234.5</v></c><c r="B4" s="1"><v>45000</v></c><c r="C4"><f>A4*2</f><v>2469</v></c><c r="D4"><v>7</v></c><c r="E4"><v>4111111111111111</v></c>']
    sheet = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}"><sheets><sheet name="Отчёт" sheetId="1"/></sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{shared}</sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>',
        "docProps/core.xml": '<cp:coreProperties xmlns:cp="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Машбюро</dc:creator></cp:coreProperties>',
        "docProps/thumbnail.jpeg": b"\xff\xd8picture", "xl/embeddings/oleObject1.bin": b"payload",
        "_rels/.rels": '<Relationships xmlns="r"><Relationship Id="1" Target="docProps/thumbnail.jpeg"/><Relationship Id="2" Target="xl/workbook.xml"/><Relationship Id="3" Target="xl/gone.xml"/></Relationships>',
    })


@pytest.fixture(scope="module")
def books(spark):
    rows = [("/d/a.xlsx", "a.xlsx", book(), "OOXML"), ("/d/b.xlsx", "b.xlsx", b"PK nothing", "OOXML"), ("/d/c.docx", "c.docx", zipped({"word/document.xml": "<!DOCTYPE x><a/>"}), "OOXML")]
    return spark.createDataFrame(rows, "path string, name string, content binary, format string")


def parts(row):
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        return {n: z.read(n).decode("utf-8", "replace") for n in z.namelist()}


def test_bad_containers_have_a_status(books):
    assert {r.path: bool(r.problem) for r in ooxml.checked(books).collect()} == {"/d/a.xlsx": False, "/d/b.xlsx": True, "/d/c.docx": True}
    assert {(r.path, r.what, r.detail if r.what == "dangling" else "") for r in ooxml.problems(books).collect()} >= {("/d/a.xlsx", "dangling", "xl/gone.xml"), ("/d/b.xlsx", "unreadable", ""), ("/d/c.docx", "unreadable", "")}
    assert [tuple(r) for r in ooxml.census(books).collect()] == [("/d/a.xlsx", "bin", 1)]


def test_workbook_is_hidden_and_restored(spark, books):
    cells = {(r.col, r.row): (r.text, r.kind) for r in workbook.cells(books).collect()}
    assert cells[(0, 2)] == ("Лацис Юрий", "text") and cells[(1, 4)] == ("45000", "date") and cells[(2, 4)] == ("2469", "formula") and cells[(0, 4)] == ("1234.5", "number")
    one = books.where("name = 'a.xlsx'")
    new, result = ooxml.pseudonymize_files(one, Vault.empty(spark), now=1.0)
    made = new.first()
    got = parts(made)
    text = " ".join(got.values())
    assert not any(x in text for x in ("Лацис", "Тверь", "Казань", "Машбюро", "4111111111111111")) and "Meta1" in got["docProps/core.xml"] and "Name1" in text and "City1" in text
    assert "docProps/thumbnail.jpeg" not in got and "thumbnail" not in got["_rels/.rels"] and got["xl/embeddings/oleObject1.bin"] == ""
    assert 't="str"' in got["xl/worksheets/sheet1.xml"] and "Card1" in got["xl/worksheets/sheet1.xml"]
    stamped = new.withColumn("content", ooxml.stamped(F.col("content"), "v1")).withColumn("format", F.lit("OOXML"))
    back = ooxml.restore_files(stamped, result.vault, "v1").first()
    assert not back.refused and all(x in " ".join(parts(back).values()) for x in ("Лацис Юрий", "Тверь", "Машбюро"))
    other = ooxml.restore_files(stamped, result.vault, "v2").first()
    assert other.refused and "Name1" in " ".join(parts(other).values())
    assert stamped.select(ooxml.marker(F.col("content"))).first()[0] == "v1" and stamped.select(ooxml.marker(ooxml.unstamped(F.col("content")))).first()[0] is None


def test_numbers_of_workbooks(spark, books):
    one = books.where("name = 'a.xlsx'")
    none = spark.createDataFrame([], "original string, surrogate string")
    hidden, mapping = workbook.hide_numbers(one, none, "k")
    assert {r.original for r in mapping.collect()} >= {"1234.5"} and not {r.original for r in mapping.collect()} & {"45000", "7", "2469"}
    sheet = parts(hidden.first())["xl/worksheets/sheet1.xml"]
    assert "1234.5" not in sheet and "45000" in sheet and "2469" not in sheet and "fullCalcOnLoad" in parts(hidden.first())["xl/workbook.xml"]
    back = workbook.show_numbers(hidden.withColumn("format", F.lit("OOXML")), mapping)
    assert "1234.5" in parts(back.first())["xl/worksheets/sheet1.xml"]


def test_sheet_names(spark):
    rows = spark.createDataFrame([("f", "a/b"), ("f", "a:b"), ("f", "x" * 40), ("g", "a/b"), ("g", "")], "file string, name string")
    fixed = {(r.file, r.name): r.fixed for r in workbook.valid_sheet_names(rows).collect()}
    assert fixed == {("f", "a/b"): "a b", ("f", "a:b"): "a b (2)", ("f", "x" * 40): "x" * 31, ("g", "a/b"): "a b", ("g", ""): "Sheet"}
    df = spark.createDataFrame([("'Old one'!A1+Old!B2", "Old one", "It's")], "f string, o string, n string")
    assert df.select(workbook.renamed_references(F.col("f"), F.col("o"), F.col("n"))).first()[0] == "'It''s'!A1+Old!B2"


def test_vault_at_rest(spark, tmp_path):
    df = spark.createDataFrame([(1, "EMAIL", "a@firma.ru", "a@firma.ru")], "at int, category string, key string, original string")
    done = pseudonymize(spark.createDataFrame([(1, "a@firma.ru")], "u int, text string"), Vault.empty(spark), ["u"], now=5.0)
    assert df.count() and done.vault.entities.first().used == 5.0
    store = VaultStore(spark, str(tmp_path / "v"), b"k" * 32)
    first = store.commit(done.vault, "")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "v").rglob("*.parquet"))
    assert b"firma" not in raw and store.read()[1].entities.first().key == "a@firma.ru"
    with pytest.raises(Exception, match="cannot be read"):
        VaultStore(spark, str(tmp_path / "v"), b"x" * 32).read()[1].entities.collect()
    # two writers that read the same version: the pointer is made once
    late = VaultStore(spark, str(tmp_path / "v"), b"k" * 32)
    late.versions = lambda: [first]
    store.commit(done.vault, first)
    with pytest.raises(RuntimeError):
        late.commit(done.vault, first)
    backup = store.export("pw").cache()
    assert store.load_backup(backup, "pw").entities.count() == 1
    with pytest.raises(ValueError, match="missing"):
        store.load_backup(backup.where("table != 'counters'"), "pw")
    with pytest.raises(ValueError, match="damaged"):
        store.load_backup(backup.withColumn("content", F.when(F.col("table") == "spellings", F.lit(b"x")).otherwise(F.col("content"))), "pw")
    old = store.id()
    assert store.clear() != old and store.read()[1].entities.count() == 0


def test_engine_surface(spark):
    df = spark.createDataFrame([(1, "Name3 и 5 руб."), (2, "ivan@firma.ru"), (3, None)], "u int, text string")
    assert {r.u: r.tokenised for r in inspect(df, ["u"]).collect()} == {1: True, 2: False, 3: False}
    done = pseudonymize(df, Vault.empty(spark), ["u"], now=1.0)
    assert verify(done.units, done.findings, ["u"]).count() == 0
    assert {r.what for r in verify(df, done.findings, ["u"]).collect()} == {"original", "rule"}
    back = restore_all(done.units, done.vault, ["u"], now=9.0)
    assert {r.u: r.text for r in back.units.collect()} == {r.u: r.text for r in df.collect()} and {r.used for r in back.vault.entities.collect()} == {9.0}


def test_names_of_files(spark):
    rows = spark.createDataFrame([("/x/a.txt", "a.txt"), ("/y/a.txt", "a.txt")], "path string, name string")
    numbers = spark.createDataFrame([(1, "/x/a.txt"), (2, "/y/a.txt")], "number bigint, name string")
    assert {(r.path, r.neutral) for r in files.mirror_names(rows, numbers).collect()} == {("/x/a.txt", "File1.txt"), ("/y/a.txt", "File2.txt")}
    back = spark.createDataFrame([("File2 (1).txt",), ("other.txt",)], "name string")
    assert {r.name: r.original for r in files.original_names(back, numbers).collect()} == {"File2 (1).txt": "/y/a.txt", "other.txt": None}
    assert {r.path: r.name for r in files.free_names(rows, "name").collect()} == {"/x/a.txt": "a.txt", "/y/a.txt": "a (2).txt"}
