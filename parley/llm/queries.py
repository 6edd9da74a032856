"""The operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_codec, embedding_dedup, importance, language_id, license_scan, packing, simhash, substring_dedup, token_alignment, token_store, topk, toxicity, url_filter
from .common import Workspace, read


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.encode_decode(read(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("ids")
    token_store.write_tokens(read(spark, sf_dir, "documents"), path)
    return token_store.token_rows(spark, path)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.learn(spark.createDataFrame(url_filter.default_labels(), "url string, label int"))
    return url_filter.judge(read(spark, sf_dir, "pages"), model)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_toxicity, op3_license_scan, op4_byte_bpe, op5_substring_dedup, op6_language_id, op7_simhash, op8_token_store, op9_top_k, op10_embedding_dedup, op11_url_filter, op12_importance_resampling, op13_token_alignment]
    return {f.__name__: f for f in found}


#: Passages by their text: a word goes if the last repeated window that starts at or before it covers it.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
h AS (SELECT r, doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS lo FROM h GROUP BY k),
z AS (SELECT h.r, s FROM h JOIN f USING (k) WHERE lo < h.doc_id),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
c AS (SELECT p.r, x, p.p, max(z.s) OVER (PARTITION BY p.r ORDER BY p.p) AS last FROM p LEFT JOIN z ON z.r = p.r AND z.s = p.p),
g AS (SELECT r, count(*) FILTER (p - last < 50) AS gone, string_agg(x, ' ' ORDER BY p) FILTER (last IS NULL OR p - last >= 50) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""

#: All pairs by cosine and the closure of their links, over unique ids.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.oracle(), "op5_substring_dedup": SUBSTRING_SQL, "op9_top_k": topk.oracle(), "op10_embedding_dedup": EMBEDDING_SQL, "op12_importance_resampling": importance.oracle()}
