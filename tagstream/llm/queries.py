"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm import decontam, exact_dedup, kneser_ney, langid, line_dedup, ngram_join, packing, passages, quality, token_ledger
from tagstream.llm.common import materialize, third, work_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs.where(third() != 1), spark.read.parquet(f"{sf_dir}/labels.parquet").where(third() != 1))
    return quality.score(docs, model).select("doc_id", (third() == 1).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir), k=5, least_words=50, percent=80, hashes=4)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), length=1024)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive before their language is known, and are revised when it is; a draft of all of them comes
    and goes. A replay changes nothing, before and after compaction. What is left are the counts of all documents
    by source, language and tokenizer version."""
    versions = {"byte_bpe_50k": lambda: packing.ByteBpe("byte_bpe_50k").encode, "byte_bpe_multi_50k": lambda: packing.ByteBpe("byte_bpe_multi_50k", fast_only=True).encode}
    counts = materialize(token_ledger.count_tokens(documents(spark, sf_dir), versions), "counts")
    unknown = counts.withColumn("lang", F.lit(None).cast("string"))
    draft = unknown.withColumn("tokenizer", F.concat("tokenizer", F.lit("-draft")))
    ledger = token_ledger.Ledger(spark, work_path(spark, "ledger"))
    ledger.commit("arrive", token_ledger.insert(unknown))
    ledger.commit("draft", token_ledger.insert(draft))
    ledger.commit("arrive", token_ledger.insert(unknown))
    ledger.compact()
    ledger.commit("labelled", token_ledger.revise(unknown, counts))
    ledger.commit("withdrawn", token_ledger.delete(draft))
    ledger.commit("arrive", token_ledger.insert(unknown))
    ledger.compact()
    return ledger.rollup()


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = kneser_ney.train_model(docs.where(third(modulus=7) != 2), min_count=2)
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", (third(modulus=7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(third() != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (third() == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"), window=2, divisor=3)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


OP2_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, CAST(row_number() OVER () AS VARCHAR) AS k, doc_id, text FROM documents
  UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
split AS (SELECT kind, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
item_windows AS (
  SELECT DISTINCT k AS item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM split WHERE kind = 'i' AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
hits AS (
  SELECT d.k, d.i, d.n, x.item FROM (
    SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT s.k, s.w, l.n, unnest(range(1, len(s.w) - l.n + 2)) AS i FROM split s, lengths l WHERE s.kind = 'd' AND len(s.w) >= l.n)) d
  JOIN item_windows x ON x.n = d.n AND x.win = d.win),
hit_words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
hit_items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, h.k IS NOT NULL AS contaminated
FROM split s LEFT JOIN hit_words h ON h.k = s.k LEFT JOIN hit_items i ON i.k = s.k WHERE s.kind = 'd'
"""

OP4_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM split UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.r) AS component_id
FROM split s JOIN reach r ON r.a = s.doc_id LEFT JOIN sizes z ON z.doc_id = s.doc_id GROUP BY 1, 2
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d),
h AS (SELECT *, CAST(concat('0x', substr(md5(line), 1, 7)) AS BIGINT) AS h FROM l),
b AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0)) % 3 = 0 AS ends FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
chunks AS (SELECT r, doc_id, k, min(i) AS place, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY r, doc_id, k),
ranked AS (SELECT *, lines >= 2 AND length(chunk) >= 20 AND row_number() OVER (PARTITION BY chunk, lines >= 2 ORDER BY doc_id, r, place) > 1 AS gone FROM chunks),
out AS (SELECT r, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS clean FROM ranked GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(clean) END AS clean_sha256
FROM d LEFT JOIN out USING (r)
"""

OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_passages": op3_passages,
    "op4_ngram_join": op4_ngram_join,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_langid": op8_langid,
    "op9_line_dedup": op9_line_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op4_ngram_join": OP4_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
