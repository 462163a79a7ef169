import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.functions import lexicon, names
from veilframe.operators import entities, numbers, people, verify
from veilframe.operators.numbering import numbered
from veilframe.operators.resolve import override, resolved
from veilframe.operators.restore import broken_tokens, resolved_tokens, restore_stats, sources
from veilframe.operators.rules import FINDING
from veilframe.operators.splice import spliced
from veilframe.operators.vault import Vault, issue, lookup, merged, purge
from veilframe.plans import queries
from veilframe.plans.engine import Settings, findings_of, pseudonymize, restored
from veilframe.sources import files, ooxml
from veilframe.sources.store import VaultStore

ROWS = [(1, "Пишите: ivan@firma.ru. Тел. +7 (900) 111-22-33"), (2, "ivan@firma.ru и 8 900 1112233, Name7, IVAN@firma.ru1"), (3, None), (4, ""), (5, "a1b2 10.0.0.1 x")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def done(spark, units):
    return pseudonymize(units, Vault.empty(spark), ["doc_id"])


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_round_trip(units, done):
    assert texts(restored(done.units, done.vault, ["doc_id"])) == dict(ROWS)
    assert texts(done.units)[1] == "Пишите: email1@example.com. Тел. Phone1"
    assert texts(done.units)[2].startswith("email1@example.com и Phone1_2, Term1")


def test_same_tokens_again_and_on_other_partitions(spark, units, done):
    again = pseudonymize(units.repartition(3), done.vault, ["doc_id"])
    fresh = pseudonymize(units.repartition(3), Vault.empty(spark), ["doc_id"])
    assert texts(again.units) == texts(done.units) == texts(fresh.units)
    assert again.vault.entities.count() == done.vault.entities.count()


def test_texts_of_one_row_group_are_read_by_many_tasks(spark, units):
    one = units.coalesce(1)
    found = pseudonymize(one, Vault.empty(spark), ["doc_id"])
    assert one.rdd.getNumPartitions() == 1
    assert found.units.select("doc_id", F.spark_partition_id().alias("task")).distinct().count() == len(ROWS)
    assert found.units.select(F.spark_partition_id()).distinct().count() > 1


def test_words_are_judged_once(monkeypatch):
    asked = []
    judge = lexicon.Lexicon.shape
    monkeypatch.setattr(lexicon.Lexicon, "shape", lambda self, word: asked.append(word) or judge(self, word))
    known = lexicon.Lexicon(surname=frozenset({"тестов"}))
    text = "der Vertrag kam an und ging Иванову Петру Сергеевичу zu. " * 20
    assert [m["n_surname"] for m in names.mentions(text, known)] == ["Иванов"] * 20
    # words in which no reading of a name begins are not judged at all, and the others once
    assert len(asked) == len(set(asked)) <= 4


def test_keep_and_hide(spark, units):
    kept = pseudonymize(units, Vault.empty(spark), ["doc_id"], settings=Settings(keep=("ivan@firma.ru",)))
    assert "ivan@firma.ru" in texts(kept.units)[1]
    rows = spark.createDataFrame([("POSSIBLE_PERSON", "Анна", "REVIEW", 0.5, "x"), ("EMAIL", "a@b.ru", "AUTO", 0.9, "x")], "category string, original string, decision string, confidence double, reason string")
    choices = spark.createDataFrame([("анна", "hide"), ("a@b.ru", "keep")], "folded string, choice string")
    out = {r.original: (r.category, r.decision) for r in override(rows, choices).collect()}
    assert out == {"Анна": ("PERSON", "AUTO"), "a@b.ru": ("EMAIL", "REVIEW")}


def test_resolution_splits_containers(spark):
    text = "0123456789abcdefghij"
    rows = [("ADDRESS", 0, 20, text, "AUTO", 0.9, "", 700, 0), ("PHONE", 5, 9, text[5:9], "AUTO", 0.9, "", 800, 1), ("PHONE", 7, 12, text[7:12], "AUTO", 0.9, "", 800, 2), ("PHONE", 12, 14, "cd", "AUTO", 0.9, "", 900, 3)]
    df = spark.createDataFrame([(text, rows)], f"t string, c array<{FINDING}>")
    got = [(f.category, f.start, f.end, f.original) for f in df.select(resolved(F.col("c"))).first()[0]]
    # the longer phone comes first; the fragment [14, 20) and [0, 7) of the address stay hidden
    assert got == [("ADDRESS", 0, 7, "0123456"), ("PHONE", 7, 12, "789ab"), ("PHONE", 12, 14, "cd"), ("ADDRESS", 14, 20, "efghij")]


def test_splice_guards_tokens(spark):
    df = spark.createDataFrame([("ab@x1 &Rzz _q", [(2, 4, "Name1"), (3, 5, "Name2"), (8, 10, "Name3"), (12, 13, "Name4")])], "t string, e array<struct<start:int,end:int,token:string>>")
    assert df.select(spliced(F.col("t"), F.col("e"))).first()[0] == "ab​Name1​1 &RName3 _​Name4"


def test_vault_numbers_and_lookup(spark):
    rows = [(1, "PERSON", "a", "Анна"), (2, "ORG", "o", "О"), (3, "PERSON", "b", "Борис"), (4, "PERSON", "a", "Анне"), (5, "SECRET", "s", "x"), (6, "INN_ORG", "7", "7"), (7, "INN_PERSON", "7", "7 ")]
    df = spark.createDataFrame(rows, "at int, category string, key string, original string")
    vault, out = issue(Vault.empty(spark), df, ["at"], 0.0)
    assert [r.token for r in out.orderBy("at").collect()] == ["Name1", "Company1", "Name2", "Name1_2", "Secret1", "Inn1", "Inn1_2"]
    assert vault.spellings.where("spelling = 'x'").count() == 0
    asked = spark.createDataFrame([("Name1", 2), ("Name1", 9), ("Name9", 1), ("Secret1", 1)], "base string, variant int")
    assert {(r.base, r.variant): (r.status, r.original) for r in lookup(vault, asked).collect()} == {("Name1", 2): ("ok", "Анне"), ("Name1", 9): ("variant_missing", "Анна"), ("Name9", 1): ("unknown", None), ("Secret1", 1): ("removed", None)}
    old = purge(vault, F.lit(1e9), 1)
    assert old.entities.count() == 0
    _, later = issue(old, df.where("at = 1"), ["at"], 0.0)
    assert later.first().token == "Name3"
    assert merged(vault, vault).spellings.count() == vault.spellings.count()
    other, _ = issue(Vault.empty(spark), df.where("at = 3"), ["at"], 0.0)
    with pytest.raises(ValueError):
        merged(vault, other)


def test_numbering_in_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 100003).alias("o"))
    out = numbered(rows, "g", "o", "n").toPandas()
    want = out.sort_values(["g", "o"]).groupby("g").cumcount() + 1
    assert (out.loc[want.index, "n"] == want).all()


def test_restore_report(spark):
    vault = Vault(spark.createDataFrame([("Name1", "PERSON", "a", 1, False, 0.0, 0.0)], Vault.empty(spark).entities.schema), spark.createDataFrame([("Name1", 1, "Анна")], Vault.empty(spark).spellings.schema), Vault.empty(spark).counters)
    df = spark.createDataFrame([(1, "Name1у Name1_2 Name777 Name 5 Name1Name2")], "u int, text string")
    tokens = resolved_tokens(df, vault, ["u"])
    r = restore_stats(tokens, ["u"]).first()
    assert (r.found, r.restored, r.variant_fallback, r.endings, r.unknown) == (3, 2, 1, 1, ["Name777"])
    assert sorted(df.select(broken_tokens(F.col("text"))).first()[0]) == ["Name 5", "Name1Name2"]
    history = spark.createDataFrame([("r1", 1.0, ["Name1"]), ("r2", 2.0, ["Name2"])], "id string, time double, tokens array<string>")
    assert sources(tokens, history) == ["r1"]


def test_numbers(spark):
    df = spark.createDataFrame([("1200",), ("1200.0",), ("1.2E3",), ("-0",), ("007",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(numbers.canonical_number(F.col("v"))).collect()] == ["1200", "1200", "1200", "0", "7", None, None]
    df = spark.createDataFrame([("7",), ("12",), ("2026",), ("13",), ("120",), ("0.14",)], "v string")
    assert [r[0] for r in df.select(numbers.should_replace(F.col("v"))).collect()] == [False, False, False, True, True, True]
    many = spark.range(13, 400).select(F.col("id").cast("string").alias("original"))
    m = numbers.surrogates(many, spark.createDataFrame([], "original string, surrogate string"), "k").toPandas()
    assert set(m.original) == {str(i) for i in range(13, 400)} and m.surrogate.is_unique and not set(m.surrogate) & set(m.original)
    few = spark.createDataFrame([("1234.5",), ("-88",), ("70001",)], "original string")
    m = numbers.surrogates(few, spark.createDataFrame([], "original string, surrogate string"), "k").toPandas()
    assert (m.surrogate.astype(float) / m.original.astype(float)).between(0.5, 1.9).all()


def test_prices_like_years_and_counts_are_hidden(spark, tmp_path):
    prices = [2000.0, 1950.0, 12.0, 7.0, 0.0, 2000.0, 5.5, None]
    spark.createDataFrame([*enumerate(prices), (3, 7.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows = sorted(tuple(r) for r in queries.surrogate_round_trip(spark, str(tmp_path)).na.fill({"number": "-"}).collect())
    assert rows == [(0, "2000", True), (1, "1950", True), (2, "12", True), (3, "7", True), (3, "7", True), (4, "0", True), (5, "2000", True), (6, "5.5", True), (7, "-", True)]


def test_card_numbers_beside_digits(spark, tmp_path):
    texts = ["4111111111111111 123 words", "no 41111111111111111111 end", "x 4111-1111 1111-1111", None, "4111111111111112"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in queries.card_luhn(spark, str(tmp_path)).collect())
    assert rows == [(0, 0, "4111111111111111"), (1, 3, "4111111111111111"), (2, 2, "4111-1111 1111-1111")]


def test_verification(spark):
    after = spark.createDataFrame([(1, "Name1 met Anna Lee, annals"), (2, "firma.ru")], "u int, text string")
    originals = spark.createDataFrame([("Anna Lee",), ("Anna L",), ("firma",)], "original string")
    assert {tuple(r) for r in verify.residual_values(after, originals, ["u"]).collect()} == {(1, "Anna Lee"), (2, "firma")}
    edges = spark.createDataFrame([(1, "Anna Leek; xAnna Lee."), (2, "xAnna Lee, Anna Lee.")], "u int, text string")
    assert [r.u for r in verify.residual_values(edges, originals, ["u"]).collect()] == [2]
    a, b = spark.createDataFrame([("x y y",)], "text string"), spark.createDataFrame([("x y z",)], "text string")
    assert {tuple(r) for r in verify.word_difference(a, b).collect()} == {("y", 1, 0), ("z", 0, 1)}


def test_people(spark):
    df = spark.createDataFrame([(1, "Утвердил Иванов Пётр Сергеевич."), (2, "Передать Иванову П.С. и Ивановым."), (3, "Сидоров А.Б. и П. С. Иванов"), (4, "Иваниов пришёл"), (5, None), (6, "Ольга Ивановна и Excel Word")], "u int, text string")
    named = people.mentions(df, ["u"])
    known = people.learn(named)
    assert {(r.surname, r.given, r.patronymic) for r in known.collect()} == {("Иванов", "Пётр", "Сергеевич"), ("Сидоров", None, None)}
    found = {(r.u, r.start): (r.end, r.decision, r.category) for r in people.findings(named, known, ["u"]).collect()}
    assert found[(1, 9)] == (30, "AUTO", "PERSON") and found[(2, 9)][0] == 21 and found[(3, 15)][0] == 27 and found[(6, 0)] == (14, "AUTO", "PERSON") and (6, 17) not in found
    assert [(r.u, r.confidence >= 0.85) for r in people.misspelt(named, known, ["u"]).collect()] == [(4, True)]


def test_namesakes_are_for_review(spark):
    df = spark.createDataFrame([(1, "Кулешова Анна Андреевна. Кулешова Алиса Артёмовна."), (2, "Кулешова А.А. подписала")], "u int, text string")
    found = [r for r in findings_of(df, ["u"]).collect() if r.u == 2]
    assert [(r.decision, len(r.candidates)) for r in found] == [("REVIEW", 2)]
    hidden = {r.u: r.text for r in pseudonymize(df, Vault.empty(spark), ["u"]).units.collect()}
    assert hidden == {1: "Name1. Name2.", 2: "Name3 подписала"}


def test_names_companies_and_places_are_hidden(spark):
    df = spark.createDataFrame([(1, "Утвердил Иванов Пётр Сергеевич, ООО «Ромашка Плюс», г. Тверь, ivan@firma.ru"), (2, "Иванову П.С. в Ромашка Плюс, из Твери, сайт firma.ru/x"), (3, "иванов пётр сергеевич")], "u int, text string")
    done = pseudonymize(df, Vault.empty(spark), ["u"])
    got = {r.u: r.text for r in done.units.collect()}
    assert got == {1: "Утвердил Name1, ООО «Company1», г. City1, email1@example.com", 2: "Name1_2 в Company1, из City1_2, сайт Domain1", 3: "Name1_3"}
    assert {r.u: r.text for r in restored(done.units, done.vault, ["u"]).collect()} == {r.u: r.text for r in df.collect()}
    again = pseudonymize(done.units, done.vault, ["u"])
    assert {r.u: r.text for r in again.units.collect()} == got


def test_settings(spark):
    df = spark.createDataFrame([(1, "Тайфун и тайфун, Договор подписал Ким"), (2, "12.03.1985"), (3, "дата рождения ниже, АБВГД рядом")], "u int, text string")
    hidden = {r.u: r.text for r in pseudonymize(df, Vault.empty(spark), ["u"], settings=Settings(hide=("тайфун",))).units.collect()}
    assert hidden[1].startswith("Term1 и Term1_2") and hidden[2] == "12.03.1985"
    one = df.withColumn("f", F.lit("x"))
    found = findings_of(one, ["f", "u"], settings=Settings(file="f"))
    assert {(r.u, r.category, r.decision) for r in found.collect() if r.u == 2} == {(2, "BIRTH_DATE", "REVIEW")}
    strict = findings_of(one, ["f", "u"], settings=Settings(file="f", strict=True)).collect()
    assert {r.decision for r in strict} == {"AUTO"} and {"POSSIBLE_ENTITY"} <= {r.category for r in strict if r.u == 3}


def test_rules_in_both_engines(spark):
    """One pass of Python and the functions of Spark find the same."""
    from test_functions import TEXTS

    from veilframe.functions.patterns import RULES
    from veilframe.operators.rules import detect, rule_findings

    df = spark.createDataFrame(list(enumerate(TEXTS)), "u int, text string")
    mine = {(r.u, r.reason, r.start, r.end, r.category) for r in detect(df, ["u"], rules=RULES, literals=False).collect()}
    lists = df.select("u", F.explode(F.concat(*(rule_findings(F.col("text"), r, i) for i, r in enumerate(RULES)))).alias("f"))
    assert mine == {(r.u, r.f.reason, r.f.start, r.f.end, r.f.category) for r in lists.collect()} and len(mine) > 30


def test_entities(spark):
    df = spark.createDataFrame([(1, "ООО «Ромашка Плюс» и г. Тверь"), (2, "Звонили в Ромашка Плюс, потом из Твери и Тверь"), (3, "see mayak.ru, a@mayak.ru, mail.ru"), (4, None), (5, "Технологии Контроля Региона (ТеКоР), письмо «0.00» и «Всё будет хорошо.»")], "u int, text string")
    found = entities.explicit(df, ["u"])
    assert {(r.category, r.original) for r in found.collect()} == {("ORG", "Ромашка Плюс"), ("CITY", "Тверь"), ("ORG", "Технологии Контроля Региона"), ("ORG", "ТеКоР")}
    assert len({r.key for r in found.collect() if r.u == 5}) == 1
    again = entities.known(df, entities.register(found), ["u"])
    assert {(r.u, r.original) for r in again.collect() if r.u < 5} == {(1, "Ромашка Плюс"), (1, "Тверь"), (2, "Ромашка Плюс"), (2, "Тверь"), (2, "Твери")}
    assert {r.domain for r in entities.domains(df, ["u"]).collect()} == {"mayak.ru"} == {r.domain for r in entities.mail_domains(df, ["u"]).collect()}


def docx(paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        runs = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{runs}</w:body></w:document>')
        z.writestr("media/a.bin", b"\x00\x01")
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([["Mail ivan@", "firma.ru now"], ["nothing"]]))
    (tmp_path / "b.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "c.xls").write_bytes(b"old")
    rows = files.read_files(spark, str(tmp_path))
    assert {r.name: r.status for r in files.scan_folder(rows).collect()} == {"a.docx": "taken", "b.txt": "taken", "c.xls": "skipped"}
    assert files.text_units(rows).first()[2:] == ("Привет", "cp1251")
    new, result = ooxml.pseudonymize_files(rows.where("format = 'OOXML'"), Vault.empty(spark))
    with zipfile.ZipFile(io.BytesIO(bytes(new.first().content))) as z:
        assert b"Mail email1@example.com</w:t></w:r><w:r><w:t xml:space=\"preserve\"> now" in z.read("word/document.xml") and z.read("media/a.bin") == b"\x00\x01"
    back = ooxml.units(new.withColumn("format", F.lit("OOXML")))
    keys = ["file", "part_idx", "is_attr", "group_idx", "location"]
    assert [r.text for r in restored(back, result.vault, keys).orderBy("group_idx").collect()] == ["Mail ivan@firma.ru now", "nothing"]


def test_store(spark, tmp_path, done):
    store = VaultStore(spark, str(tmp_path / "vault"))
    version, empty = store.read()
    assert version == "" and empty.entities.count() == 0
    first = store.commit(done.vault, version)
    with pytest.raises(RuntimeError):
        store.commit(done.vault, "")
    assert store.read()[0] == first and store.read()[1].entities.count() == done.vault.entities.count()
    backup = store.export("pw")
    assert store.load_backup(backup, "pw").spellings.count() == done.vault.spellings.count()
    with pytest.raises(ValueError):
        store.load_backup(backup, "wrong")


def test_file_names(spark):
    df = spark.createDataFrame([("a/b:c?.txt",), ("..",), ("x" * 160 + ".docx",), ("README",)], "n string")
    assert [r[0] for r in df.select(files.safe_name(F.col("n"))).collect()] == ["b_c_.txt", "file", "x" * 145 + ".docx", "README"]
    assert [r[0] for r in df.select(files.classify(F.col("n"))).collect()] == ["TEXT", "UNSUPPORTED", "OOXML", "UNSUPPORTED"]
