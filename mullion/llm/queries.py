"""The registered queries of this package, over whole tables, and the DuckDB twins of those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mullion.llm import decontaminate, exact, hardneg, html, langid, merkle, ngram_join, packing, pii, quality, tokenstore, toxicity, warc
from mullion.llm.common import folder

PII_KEY = "registered query; a user passes a secret"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives, index = folder(spark, "warc"), folder(spark, "captures")
    warc.write_archives(warc.with_types(pages), archives)
    warc.write_index(spark, archives, index)
    records = warc.read_ranges(warc.locate(warc.keys_of(pages), index), archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


def op3_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokenstore")
    tokenstore.write(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return tokenstore.read_all(spark, path, with_ids=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hardneg.whole_vectors(F.col("embedding")).alias("vector"))
    return hardneg.mine(vectors, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE
doc AS (
  SELECT doc_id, coalesce('=' || source, '-') AS k,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaf),
tree AS (
  SELECT 0 AS lv, k, pos, n, h FROM placed
  UNION ALL
  SELECT lv + 1, k, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lv, k, pos // 16, n),
sub AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
forest AS (
  SELECT 0 AS lv, pos, n, h FROM sub
  UNION ALL
  SELECT lv + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lv, pos // 16, n),
side AS (
  SELECT a.lv, a.k, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM (SELECT lv, k, pos, n, h FROM tree UNION ALL SELECT lv, NULL, pos, n, h FROM forest) a
  JOIN (SELECT lv, k, pos, n, h FROM tree UNION ALL SELECT lv, NULL, pos, n, h FROM forest) b
    ON a.lv = b.lv AND a.k IS NOT DISTINCT FROM b.k AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY a.lv, a.k, a.pos),
walk AS (
  SELECT 0 AS step, 0 AS lv, p.k AS tree_of, p.pos AS spot, p.k, p.pos, doc_id, p.h AS leaf, '' AS proof, coalesce(changed, p.h) AS fold, s.h AS subroot, s.pos AS place
  FROM placed p JOIN sub s ON s.k = p.k
  UNION ALL
  SELECT step + 1, CASE WHEN side.lv IS NULL THEN 0 ELSE walk.lv + 1 END, CASE WHEN side.lv IS NULL THEN NULL ELSE tree_of END, CASE WHEN side.lv IS NULL THEN place ELSE spot // 16 END,
         walk.k, walk.pos, doc_id, leaf, CASE WHEN side.lv IS NULL THEN proof ELSE proof || l || r END, CASE WHEN side.lv IS NULL THEN fold ELSE sha256(l || fold || r) END, subroot, place
  FROM walk LEFT JOIN side ON side.lv = walk.lv AND side.k IS NOT DISTINCT FROM tree_of AND side.pos = spot
  WHERE side.lv IS NOT NULL OR tree_of IS NOT NULL),
done AS (SELECT DISTINCT ON (k, pos) * FROM walk ORDER BY k, pos, step DESC)
SELECT doc_id, leaf, subroot, (SELECT h FROM forest WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM forest WHERE n = 1) AS verified
FROM done
"""


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_warc_index": op2_warc_index,
    "op3_tag_path_text": op3_tag_path_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_token_store": op10_token_store,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language": op13_language,
}
SQL = {
    "op2_warc_index": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
