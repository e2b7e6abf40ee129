"""The operators' registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import archives, html_text, language, near_join, packing, pii, sketches, subword, suffix_quality, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


def held_out(key: str, n: int, left: int):
    """Whether a key is held out; a null one is not."""
    return F.coalesce(remainder(key, n) == left, F.lit(False)).alias("held_out")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.toxicity(docs, net).select("doc_id", held_out("doc_id", 3, 1), "score", "predicted")


def op2_quality_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_quality.repetition_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words")


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(remainder("doc_id", 4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score")


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = archives.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op6_subword_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.sampled_segmentations(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.extract(docs, pii.learn(docs)).drop("text")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(table(spark, sf_dir, "documents"))


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_quality_suffix_array, op3_language_kernel, op4_arc_to_warc, op5_bottom_k, op6_subword_sampling, op7_best_fit_packing, op8_pii_bootstrap, op9_ngram_join, op10_html_consensus, pipeline)
    return {f.__name__: f for f in every}


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), b AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
         array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
  FROM p
), d AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (substr(bits, 5 * i + 1, 1)::INT * 16 + substr(bits, 5 * i + 2, 1)::INT * 8 + substr(bits, 5 * i + 3, 1)::INT * 4
            + substr(bits, 5 * i + 4, 1)::INT * 2 + substr(bits, 5 * i + 5, 1)::INT + 1)::INT, 1)), '') AS payload_digest
  FROM b
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""

OP2_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents
), f AS (
  SELECT doc_id, any_value(n) AS n, unnest(range(0, any_value(n))) AS p FROM (SELECT doc_id, len(ws) AS n FROM w WHERE len(ws) > 0) GROUP BY doc_id
), g5 AS (
  SELECT doc_id, p, ws[p + 1:p + 5] AS g FROM f JOIN w USING (doc_id) WHERE p + 5 <= n
), g4 AS (
  SELECT doc_id, p, ws[p + 1:p + 4] AS g FROM f JOIN w USING (doc_id) WHERE p + 4 <= n
), g51 AS (
  SELECT doc_id, md5(array_to_string(ws[p + 1:p + 51], ' ')) AS g FROM f JOIN w USING (doc_id) WHERE p + 51 <= n
), r5 AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g5) WHERE c > 1) GROUP BY doc_id
), r4 AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 4)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g4) WHERE c > 1) GROUP BY doc_id
), long AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id FROM g51 GROUP BY doc_id, g HAVING count(*) > 1)
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), d AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(r5.n, 0)::BIGINT AS n_repeat_words, coalesce(r4.n, 0)::BIGINT AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN r4 USING (doc_id) LEFT JOIN long USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_covered_words <= 0.3 * n_words AND NOT too_long AS kept, n_covered_words
FROM m
"""

OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g
  FROM w
), k AS (
  SELECT g, min(doc_id) AS rep, count(*) AS copies, len(g) AS n FROM s GROUP BY g
), e AS (
  SELECT rep, n, copies, unnest(g) AS x FROM k
), links AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies
  FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING 1.8 * count(*) >= 0.8 * (any_value(a.n) + any_value(b.n)) - 1e-6
), reach(a, b) AS (
  SELECT rep, rep FROM k UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), n AS (
  SELECT a, sum(copies) AS links FROM links GROUP BY a
)
SELECT s.doc_id, comp.class_id, k.rep AS copy_of, (coalesce(n.links, 0) + k.copies - 1)::BIGINT AS n_links
FROM s JOIN k ON s.g = k.g JOIN comp ON comp.a = k.rep LEFT JOIN n ON n.a = k.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_suffix_array": OP2_SQL, "op4_arc_to_warc": OP4_SQL, "op9_ngram_join": OP9_SQL}
