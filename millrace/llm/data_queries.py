"""Queries of the problems on vectors, terms and names (2, 3 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import name_variants, term_counts, vector_knn
from millrace.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories of which one is among the 5 most similar of the other."""
    return vector_knn.similar_pairs(table(spark, sf_dir, "memories"), "memory_id", "embedding_preview")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every memory whose id is divisible by 50, searched among all memories."""
    near = vector_knn.nearest_vectors(table(spark, sf_dir, "memories"), "memory_id", "embedding_preview")
    return near.where(F.col("id") % 50 == 0).withColumnRenamed("id", "memory_id")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"tokens": term_counts.token_terms(F.col("tokens")), "entities": term_counts.entity_terms(F.col("entities"))}
    return term_counts.mark_terms(table(spark, sf_dir, "memories"), "memory_id", fields)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common to be useful."""
    return _terms(spark, sf_dir).where("mark IS NOT NULL").select("field", "term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term, with its mark."""
    return _terms(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, and labels and notes, that mean the same person or organisation."""
    return name_variants.variant_links(table(spark, sf_dir, "memories"), table(spark, sf_dir, "notes"))


_USABLE = """
  SELECT memory_id AS id, any_value(embedding_preview) AS v FROM memories
  WHERE embedding_preview IS NOT NULL AND len(list_filter(embedding_preview, lambda x: x <> 0)) > 0 GROUP BY memory_id"""
_NEAR = f"""
  usable AS ({_USABLE}),
  sims AS (SELECT a.id AS id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
           FROM usable a, usable b WHERE a.id <> b.id),
  near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) <= 5)"""
_TERMS = """
  records AS (SELECT memory_id, any_value(tokens) AS tokens, any_value(entities) AS entities FROM memories GROUP BY memory_id),
  terms AS (
    SELECT 'tokens' AS field, memory_id, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS term
    FROM (SELECT memory_id, unnest(tokens) AS t FROM records) WHERE t IS NOT NULL
    UNION ALL
    SELECT 'entities', memory_id, e.type || ':' || lower(e.value) FROM (SELECT memory_id, unnest(entities) AS e FROM records)),
  totals AS (SELECT 'tokens' AS field, count(tokens) AS total FROM records
             UNION ALL SELECT 'entities', count(entities) FROM records),
  counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT memory_id) AS records
             FROM terms WHERE term IS NOT NULL AND term <> '' GROUP BY field, term),
  marked AS (SELECT field, term, occurrences, records,
                    CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS mark
             FROM counts JOIN totals USING (field))"""

QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found}
SQL = {
    "p2_found": f"WITH {_NEAR} SELECT DISTINCT least(id, neighbour) AS memory_a, greatest(id, neighbour) AS memory_b FROM near",
    "p2_neighbours": f"WITH {_NEAR} SELECT id AS memory_id, neighbour, similarity FROM near WHERE id % 50 = 0",
    "p3_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_counts": f"WITH {_TERMS} SELECT field, term, occurrences, records, mark FROM marked",
}
