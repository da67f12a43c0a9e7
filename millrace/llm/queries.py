"""Queries of the text problems and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import data_queries, leakage, lookalike, pii
from millrace.llm.mixing import Mixer
from millrace.llm.ocr_repair import ScannedPages
from millrace.llm.shared_spans import SharedSpans
from millrace.session import table


def _lookalike_table(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return lookalike.learn_rewrites([(table(spark, sf_dir, "notes"), "body"), (table(spark, sf_dir, "manifest"), "caption")])


_LOOKS = (("notes", "note_id", "body"), ("manifest", "item_id", "caption"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and images whose texts look the same but are not the same characters."""
    known, out = _lookalike_table(spark, sf_dir), None
    for name, key, text in _LOOKS:
        pairs = lookalike.lookalike_pairs(table(spark, sf_dir, name), key, text, known)
        pairs = pairs.select(F.lit(name).alias("source_table"), "id_a", "id_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and images with the class of those that look the same, and how many of them have other characters."""
    known, out = _lookalike_table(spark, sf_dir), None
    for name, key, text in _LOOKS:
        rows = lookalike.lookalike_groups(table(spark, sf_dir, name), key, text, known).select(F.lit(name).alias("source_table"), F.col("id").alias("row_id"), "class_id", "links")
        out = rows if out is None else out.unionByName(rows)
    return out


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body and caption in its consistent form."""
    known, out = _lookalike_table(spark, sf_dir), None
    for name, key, text in _LOOKS:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), text)
        rows = lookalike.canonical_text(rows, text, "canonical", known).drop(text).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


# What the check by SQL levels, of its own and not from the operator's tables: signs and the letters they are drawn like.
_SQL_SIGNS = "АВЕКМНОРСТХаеорсухіјѕһԁԛԝӏІЈЅԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧο‐‑－﹣"
_SQL_LETTERS = "ABEKMHOPCTXaeopcyxijshdqwlIJSQWABEZHIKMNOPTYXo----"
_SQL_LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬆ", "st"))


def _looks_sql(col: str) -> str:
    """The canonical form where Latin letters are the most frequent of their class, as in any Latin-script corpus."""
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    out = f"regexp_replace({col}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    out = f"translate({out}, '{_SQL_SIGNS}{wide}', '{_SQL_LETTERS}{plain}')"
    out = f"regexp_replace({out}, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    for sign, letters in _SQL_LIGATURES:
        out = f"replace({out}, '{sign}', '{letters}')"
    return f"nfc_normalize({out})"


_LOOKS_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS source_table, {key} AS row_id, {text} AS raw, {_looks_sql(text)} AS canonical FROM {name}" for name, key, text in _LOOKS)


def _scanned(spark: SparkSession, sf_dir: str) -> ScannedPages:
    # pages are recognised images that are no screenshots and that no manifest describes
    is_scan = (F.col("text_source") == "ocr") & (F.coalesce("kind", F.lit("")) != "screenshot") & F.col("item_id").isNull() & F.col("note_id").isNull()
    return ScannedPages(table(spark, sf_dir, "memories"), is_scan)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of scanned memories by line."""
    return _scanned(spark, sf_dir).defects()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned memories as continuous paragraphs."""
    return _scanned(spark, sf_dir).paragraphs()


_BODIES = (("notes", "note_id"), ("memories", "memory_id"))


def _detector(spark: SparkSession, sf_dir: str) -> pii.Detector:
    bodies = [table(spark, sf_dir, name).select("body") for name, _ in _BODIES]
    return pii.learn(bodies[0].unionByName(bodies[1]), "body")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in the bodies of notes and memories."""
    detector, out = _detector(spark, sf_dir), None
    for name, key in _BODIES:
        found = pii.find_pii(table(spark, sf_dir, name), key, "body", detector).select(F.lit(name).alias("source_table"), "row_id", "kind", "pii_text")
        out = found if out is None else out.unionByName(found)
    return out


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies with typed placeholders."""
    detector, out = _detector(spark, sf_dir), None
    for name, key in _BODIES:
        rows = pii.redact(table(spark, sf_dir, name), key, "body", detector).select(F.lit(name).alias("source_table"), "row_id", "redacted")
        out = rows if out is None else out.unionByName(rows)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold at least 13 consecutive words."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of each document and item that match outside a seed's ignored positions, with substituted words."""
    return leakage.item_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return Mixer(table(spark, sf_dir, "documents")).mixed(table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of every source in every mix."""
    return Mixer(table(spark, sf_dir, "documents")).shares(table(spark, sf_dir, "mix_targets"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target of a mix with the share that its source should have among those with documents, and whether it is met within 0.005 and the repeats are kept."""
    shares = Mixer(table(spark, sf_dir, "documents")).shares(table(spark, sf_dir, "mix_targets"))
    whole = shares.groupBy("mix_id").agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("whole"))
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    met = (F.abs(F.col("actual_share") - wanted) <= 0.005) & (F.col("most_repeats") <= F.col("max_repeats"))
    return shares.join(F.broadcast(whole), "mix_id", "left").select("mix_id", "source", F.round(wanted, 6).alias("wanted_share"), met.alias("met"))  # one row a mix


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share at least 300 consecutive characters."""
    return SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document also stands elsewhere, in spans of at least 300 characters."""
    return SharedSpans(table(spark, sf_dir, "documents")).shares()


def p9_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without sentences that stand in a shared span of an earlier document."""
    return SharedSpans(table(spark, sf_dir, "documents")).deduplicated()


_WORDS_SQL = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_GRAMS_SQL = """
  {name} AS (SELECT {key}, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS g
             FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, {words} AS w FROM {table})))"""
_SPANS_SQL = """
  s AS (SELECT doc_id, i, md5(substring(text, i, 300)) AS h
        FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"""

QUERIES = data_queries.QUERIES | {"p1_found": p1_found, "p1_groups": p1_groups, "p1_canonical": p1_canonical, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_overlaps": p7_overlaps, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found, "p9_shares": p9_shares, "p9_deduplicated": p9_deduplicated}
SQL = data_queries.SQL | {
    "p7_found": f"WITH {_GRAMS_SQL.format(name='d', key='doc_id', words=_WORDS_SQL.format('text'), table='documents')}, {_GRAMS_SQL.format(name='e', key='item_id', words=_WORDS_SQL.format('passage'), table='eval_items')} SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    "p8_kept": """WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '.')),
  t AS (SELECT m.mix_id, m.source, CASE WHEN s.source IS NULL THEN 0.0 ELSE m.target_share END AS share FROM mix_targets m LEFT JOIN s USING (source))
  SELECT mix_id, source, round(share / sum(share) OVER (PARTITION BY mix_id), 6) AS wanted_share, true AS met FROM t""",
    "p9_found": f"WITH {_SPANS_SQL} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_shares": f"""WITH {_SPANS_SQL},
  hit AS (SELECT DISTINCT a.doc_id, a.i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id),
  gaps AS (SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM hit),
  sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS shared_chars FROM gaps GROUP BY doc_id)
  SELECT doc_id, length(text) AS chars, coalesce(shared_chars, 0) AS shared_chars,
         round(coalesce(shared_chars, 0) / length(text), 6) AS shared_share
  FROM documents LEFT JOIN sums USING (doc_id) WHERE length(text) >= 300""",
    "p1_found": f"WITH t AS ({_LOOKS_SQL}) SELECT DISTINCT a.source_table, a.row_id AS id_a, b.row_id AS id_b FROM t a JOIN t b ON a.source_table = b.source_table AND a.canonical = b.canonical AND a.raw <> b.raw AND a.row_id < b.row_id",
    "p1_groups": f"""WITH t AS ({_LOOKS_SQL}), f AS (SELECT source_table, canonical, min(row_id) AS class_id FROM t GROUP BY ALL HAVING count(DISTINCT raw) > 1)
  SELECT a.source_table, a.row_id, class_id, max((SELECT count(*) FROM t b WHERE b.source_table = a.source_table AND b.canonical = a.canonical AND b.raw <> a.raw)) AS links
  FROM t a JOIN f USING (source_table, canonical) GROUP BY ALL""",
    "p1_canonical": f"WITH t AS ({_LOOKS_SQL}) SELECT DISTINCT source_table, row_id, canonical FROM t",
}
