"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import deduped

    found = deduped(_read(spark, sf_dir, "documents").select("doc_id", "text"), fuzzy_words=5)
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated

    found = repeated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", words("later").alias("n_removable"), words("earlier").alias("n_repeated_later"), "later", "earlier")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs, _read(spark, sf_dir, "labels"), train=~held_out)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judged

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat, read_chat, read_loss, text_parts

    talks = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_chat(talks.unionByName(hard).withColumn("parts", text_parts(F.col("text"))))
    back = made.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfile import read_ids, write_ids
    from .scratch import Scratch
    from .tokens import public_path

    path = f"{Scratch(spark, 'ids').folder}/files"
    write_ids(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_path("byte_bpe_50k.json"), end_id=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed
    from .tokens import public_path

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs, public_path("word_bpe_49k.json"), end_id=1).drop("ids")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(_read(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT DISTINCT doc_id, item_id, i, t.m FROM t JOIN p ON t.m = p.m AND t.g = p.g),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(role, '\', '\b'), '<', '\l') AS r2, replace(replace(text, '\', '\b'), '<', '\l') AS t2 FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(r2) + 8 + length(t2) + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN g USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(m.n_links, 0) AS n_links
FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = n.doc_id LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY x) m ON m.x = n.doc_id
"""

QUERIES: dict[str, Query] = {"op1_decontaminate": op1_decontaminate, "op2_line_dedup": op2_line_dedup, "op3_passages": op3_passages, "op4_license_scan": op4_license_scan, "op5_chat_format": op5_chat_format, "op6_id_files": op6_id_files, "op7_best_fit_packing": op7_best_fit_packing, "op8_toxicity": op8_toxicity, "op9_quality_rules": op9_quality_rules, "op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op5_chat_format": OP5_SQL, "op10_ngram_jaccard": OP10_SQL}
