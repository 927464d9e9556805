"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm._common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 16)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.embedding_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"), (5, 2, 1), 3).drop("text_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 3)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.line_dedup import line_decisions

    found = line_decisions(table(spark, sf_dir, "documents"))
    return found.select(found.doc.alias("doc_id"), found.line.alias("line_no"), "kept", found.first_doc.alias("first_doc_id"), found.first_line.alias("first_line_no"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.line_quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldloom.llm.bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_embedding_near_dedup, op3_mixing, op4_toxicity, op5_simhash, op6_line_dedup, op7_line_quality, op8_language_model, op9_quality_rules, op10_bpe)}

#: SQL of those that it can express. The other queries rest on hashes, fitted models or merges that SQL lacks; tests hold
#: them against brute force, tiktoken or held-out labels.
ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least_of LEFT JOIN counted USING (vec_id)""",
    "op3_mixing": r"""
WITH w AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || doc_id) AS u FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM w GROUP BY source),
r AS (
  SELECT *, 3.0 * source_size / weight AS ratio, sum(source_size) OVER () AS total,
         coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS uncapped FROM s),
lvl AS (SELECT (total - capped)::DOUBLE / uncapped AS level FROM r WHERE (total - capped)::DOUBLE / uncapped <= ratio ORDER BY ratio, source LIMIT 1),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM s, lvl),
g AS (SELECT *, CAST(least(floor(target / source_size), 3) AS BIGINT) AS whole FROM t),
h AS (SELECT *, CAST(greatest(0, round(target - whole * source_size)) AS BIGINT) AS need FROM g),
o AS (SELECT w.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM w)
SELECT doc_id, size, source_size, target::DOUBLE AS target, CAST(whole * size + least(greatest(need - ahead, 0), size) AS BIGINT) AS taken
FROM o JOIN h ON h.source IS NOT DISTINCT FROM o.source""",
    "op6_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(x) AS line, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS line_no FROM cut),
l AS (SELECT doc_id, line_no, lower(trim(regexp_replace(line, '[\s\x0B\x{a0}]+', ' ', 'g'))) AS form, doc_id * 1000000 + line_no AS place FROM lines),
f AS (SELECT form, min(place) AS place, length(form) AS n FROM l WHERE form <> '' GROUP BY form),
k AS (SELECT form, place, unnest([n - 1, n, n + 1]) AS m FROM f WHERE n >= 16),
near AS (SELECT a.form, min(b.place) AS near FROM k a JOIN f b ON b.n = a.m AND b.n >= 16 AND b.place < a.place AND levenshtein(a.form, b.form) <= 1 GROUP BY a.form)
SELECT doc_id, line_no, l.place = f.place AND near IS NULL AS kept, least(f.place, near) // 1000000 AS first_doc_id, least(f.place, near) % 1000000 AS first_line_no
FROM l JOIN f USING (form) LEFT JOIN near USING (form)""",
}
