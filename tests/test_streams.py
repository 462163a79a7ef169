from veilframe.operators import columns, entities
from veilframe.sources.store import VaultStore
from veilframe.streaming.streams import pseudonymized_batches, restored_batches


def test_batches_share_the_vault(spark, tmp_path):
    """Two micro-batches give one entity one token, and come back whole."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "ivan@firma.ru"), (2, "anna@firma.ru and ivan@firma.ru")]
    for r in rows:
        spark.createDataFrame([r], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    store = VaultStore(spark, str(tmp_path / "vault"))
    pseudonymized_batches(stream, store, ["doc_id"], lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    hidden = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    assert "@firma" not in str(hidden) and hidden[1] in hidden[2]
    _, vault = store.read()
    back = str(tmp_path / "back")
    again = spark.readStream.schema("doc_id long, text string").parquet(out)
    restored_batches(again, vault, ["doc_id"], lambda df, n: df.write.mode("append").parquet(back), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(back).collect()) == rows


def test_columns_and_suggestions(spark):
    cells = [("f", "s", 0, 1, "ФИО"), ("f", "s", 0, 2, "Иванов Пётр; Анна"), ("f", "s", 1, 1, "Город"), ("f", "s", 1, 2, "Тверь"), ("f", "s", 1, 3, "Казань"), ("f", "s", 2, 1, "Сумма"), ("f", "s", 2, 2, "Анна")]
    frame = spark.createDataFrame(cells, "file string, sheet string, col int, row int, text string")
    assert sorted(r["item"] for r in columns.person_columns(frame).collect()) == ["Анна", "Иванов Пётр"]
    assert sorted(r["item"] for r in columns.place_columns(frame).collect()) == ["Казань", "Тверь"]
    units = spark.createDataFrame([(1, "North Wind Group met ACME and ООО Ромашка; Gamma gamma Delta Delta")], "u int, text string")
    known = entities.register(entities.explicit(units, ["u"]))
    assert {r.original for r in entities.suggested(units, known, ["u"]).collect()} >= {"North Wind Group", "ACME"}
    assert [tuple(r) for r in entities.repeated_unknown(units, known).where("key = 'delta' OR key = 'gamma'").collect()] == [("delta", 2)]
