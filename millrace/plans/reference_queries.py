"""Queries of the retrieval operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import entities as E
from millrace.functions import routing as R
from millrace.functions import text as T
from millrace.operators import answers as A
from millrace.operators import graph as G
from millrace.operators import ranking as K
from millrace.operators import store as S
from millrace.operators.hybrid import HybridRanking
from millrace.plans import sql as Q
from millrace.session import materialise, spread
from millrace.session import table as stored
from millrace.streaming.ingest import ingest_stream

#: The moment that ages are counted from.
NOW = "2026-07-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(stored(spark, d, name))


def memories(spark: SparkSession, d: str) -> DataFrame:
    """The memories without re-deliveries: of each the row that came first."""
    return S.latest(table(spark, d, "memories"), ["memory_id"], [F.asc("ingested_at")])


_MEMORIES = "m AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at) = 1)"
_NOTES = "n AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY ingested_at) = 1)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "notes"), ["note_id"], [F.asc("ingested_at")])


# ---- text functions


@query(f"SELECT doc_id, {Q.clean('text')} AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, array_to_string({Q.tokens('text')}, ' ') AS tokens, len({Q.tokens('text')}) AS n FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query(f"SELECT doc_id, array_to_string({Q.content('text')}, ' ') AS tokens FROM documents")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.content_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT stem, count(*) AS n FROM (SELECT unnest({Q.stems(Q.tokens('text'))}) AS stem FROM documents) GROUP BY stem")
def stem_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(T.stems(T.tokens(F.col("text")))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {Q.fold('text')} AS folded FROM documents")
def strip_accents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS sentence FROM (SELECT doc_id, list_filter({Q.sentences(Q.clean('text'))}, lambda x: length(x) > 1) AS s FROM documents)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(T.clean_text(F.col("text")))).alias("place", "sentence"))


@query(f"SELECT doc_id, {Q.truncate('text', 80)} AS short FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 80).alias("short"))


@query(f"WITH {_MEMORIES} SELECT memory_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CAST(floor(size / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f', floor(size / 1048576 * 10 + 0.5) / 10) || ' MB' END AS shown FROM m")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", T.format_bytes(F.col("size")).alias("shown"))


@query(f"WITH {_MEMORIES} SELECT memory_id, strftime(captured_at, '%-d %b %Y') AS shown FROM m")
def format_date(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", T.format_date(F.col("captured_at")).alias("shown"))


_DAYS = f"CAST(floor(date_diff('microsecond', captured_at, TIMESTAMPTZ '{NOW}+00') / 86400000000.0 + 0.5) AS BIGINT)"
_RELATIVE = """CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 30 THEN days || ' days ago'
  WHEN months < 12 THEN months || CASE WHEN months = 1 THEN ' month ago' ELSE ' months ago' END
  ELSE CAST(floor(months / 12 + 0.5) AS BIGINT) || CASE WHEN floor(months / 12 + 0.5) = 1 THEN ' year ago' ELSE ' years ago' END END"""


@query(f"WITH {_MEMORIES}, a AS (SELECT memory_id, {_DAYS} AS days FROM m), b AS (SELECT *, CAST(floor(days / 30 + 0.5) AS BIGINT) AS months FROM a) SELECT memory_id, {_RELATIVE} AS shown FROM b")
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", T.relative_date(F.col("captured_at"), now()).alias("shown"))


_COVER = f"SELECT item_id, list_distinct(list_filter({Q.stems(Q.terms('question'))}, lambda t: length(t) > 1)) AS q, {Q.stems(Q.tokens('passage'))} AS p FROM eval_items"


@query(f"SELECT item_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, p)) / len(q), 6) END AS coverage FROM ({_COVER})")
def term_coverage(spark: SparkSession, d: str) -> DataFrame:
    share = T.term_coverage(R.query_terms(F.col("question")), T.tokens(F.col("passage")))
    return table(spark, d, "eval_items").select("item_id", F.round(share, 6).alias("coverage"))


_PHRASE = "as soon as possible"


@query(f"SELECT source, count(*) AS documents, sum(CASE WHEN contains({Q.squash('text')}, '{_PHRASE}') THEN 1 ELSE 0 END) AS hits FROM documents GROUP BY source")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(T.squashed(F.col("text")), F.lit(_PHRASE)).cast("int")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("hits"))


_TERMS = ["warranty", "battery", "saturday"]
_HITS = " + ".join(f"CASE WHEN contains(substring(lower, i + 1, 220), '{t}') THEN 1 ELSE 0 END" for t in _TERMS)


_SNIPPETS = f"""a AS (SELECT note_id, regexp_replace({Q.clean('body')}, '\\n+', ' · ', 'g') AS text FROM n),
  b AS (SELECT note_id, text, {Q.fold('lower(text)')} AS lower FROM a),
  c AS (SELECT *, unnest(range(0, greatest(length(lower), 1), 12)) AS i FROM b),
  e AS (SELECT note_id, text, i FROM c QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY {_HITS} DESC, i) = 1),
  f AS (SELECT note_id, text, greatest(i - 40, 0) AS start, least(greatest(i - 40, 0) + 220, length(text)) AS stop FROM e),
  g AS (SELECT *, strpos(substring(text, stop + 1, 24), ' ') AS gap FROM f),
  h AS (SELECT note_id, {Q.trimmed("substring(text, start + 1, CASE WHEN stop < length(text) AND gap > 0 THEN stop + gap - 1 ELSE stop END - start)")} AS snippet FROM g)"""


@query(f"WITH {_NOTES}, {_SNIPPETS} SELECT note_id, snippet FROM h")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("note_id", T.snippet(F.col("body"), F.array(*map(F.lit, _TERMS))).alias("snippet"))


#: Terms of which some lie within or beside others.
_MARKS = ["warranty", "battery", "saturday", "day", "bat"]


@query(f"""WITH {_NOTES}, {_SNIPPETS}, l AS (SELECT note_id, {Q.fold('lower(snippet)')} AS lower FROM h),
  p AS (SELECT note_id, lower, t, unnest(range(0, length(lower))) AS i FROM l, (SELECT unnest([{Q.words(_MARKS)}]) AS t)),
  o AS (SELECT DISTINCT note_id, unnest(range(i, i + length(t))) AS pos FROM p WHERE substring(lower, i + 1, length(t)) = t),
  k AS (SELECT note_id, pos, pos - row_number() OVER (PARTITION BY note_id ORDER BY pos) AS run FROM o)
  SELECT note_id, min(pos) AS range_start, max(pos) + 1 AS range_end FROM k GROUP BY note_id, run""")
def snippet_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Where the terms stand in the snippets."""
    shown = T.snippet(F.col("body"), F.array(*map(F.lit, _TERMS)))
    found = notes(spark, d).select("note_id", F.explode(T.highlight_ranges(shown, F.array(*map(F.lit, _MARKS)))).alias("r"))
    return found.select("note_id", F.col("r.start").cast("bigint").alias("range_start"), F.col("r.end").cast("bigint").alias("range_end"))


@query(f"WITH {_NOTES} SELECT note_id, regexp_replace(title, '(?i)(saturday|warranty|battery)', '<mark>\\1</mark>', 'g') AS shown FROM n")
def highlight_titles(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("note_id", T.highlight(F.col("title"), _TERMS).alias("shown"))


# ---- ingest projections and identity


@query()
def wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).where("text_source = 'ocr'")
    return rows.select("memory_id", T.join_wrapped_lines(F.col("body")).alias("body"))


@query()
def recognised_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).where("text_source = 'ocr'")
    return rows.select("memory_id", F.coalesce(T.title_from_lines(F.col("body")), F.col("name")).alias("title"))


@query(f"""WITH w AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({Q.content('text')}) AS t FROM documents) WHERE length(t) >= 3 GROUP BY doc_id, t),
  r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) <= 12)
  SELECT doc_id, coalesce(k, '') AS keywords FROM documents LEFT JOIN (SELECT doc_id, string_agg(t, ' ' ORDER BY n DESC, t) AS k FROM r GROUP BY doc_id) USING (doc_id)""")
def keywords_top(spark: SparkSession, d: str) -> DataFrame:
    return S.keywords(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", F.array_join("keywords", " ").alias("keywords"))


_HASH = "sha1(lower(trim(coalesce(title, ''))) || '|' || coalesce(body, ''))"


@query(f"WITH {_NOTES} SELECT note_id, {_HASH} AS hash, 'doc_' || substring({_HASH}, 1, 12) AS id FROM n")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = S.content_hash(F.col("title"), F.col("body"))
    return notes(spark, d).select("note_id", h.alias("hash"), S.document_id(h).alias("id"))


@query(f"WITH {_NOTES}, h AS (SELECT *, {_HASH} AS hash FROM n) SELECT note_id, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY captured_at, note_id) = 1")
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    hashed = notes(spark, d).withColumn("hash", S.content_hash(F.col("title"), F.col("body")))
    return S.latest(hashed, ["hash"], [F.asc("captured_at"), F.asc("note_id")]).select("note_id", "hash")


@query("SELECT memory_id, max(ingested_at) AS ingested_at FROM memories GROUP BY memory_id")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of 2025 and later over the store of what came before."""
    rows = table(spark, d, "memories").select("memory_id", "ingested_at")
    last = lambda df: S.latest(df, ["memory_id"], [F.desc("ingested_at")])
    old, batch = rows.where("ingested_at < TIMESTAMP '2025-01-01'"), rows.where("ingested_at >= TIMESTAMP '2025-01-01'")
    return S.upsert(last(old), last(batch), "memory_id")


@query("SELECT DISTINCT note_id FROM notes WHERE note_id NOT IN (SELECT note_id FROM memories WHERE note_id IS NOT NULL)")
def notes_not_stored(spark: SparkSession, d: str) -> DataFrame:
    return S.only_new(table(spark, d, "notes").select("note_id"), table(spark, d, "memories"), ["note_id"]).distinct()


@query("SELECT DISTINCT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE album = 'Captures')")
def deleted_album(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories").select("memory_id", "album")
    return S.delete(rows, rows.where("album = 'Captures'"), "memory_id").select("memory_id").distinct()


_PARTS = ("title", "source", "kind", "location", "album", "caption", "url", "body")


@query(f"WITH {_MEMORIES} SELECT memory_id, {Q.clean('concat_ws(chr(10), ' + ', '.join(f'''nullif({p}, '')''' for p in _PARTS) + ')')} AS text FROM m")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", S.search_text(**{p: F.col(p) for p in _PARTS}).alias("text"))


_SEARCHED = Q.clean('concat_ws(chr(10), ' + ', '.join(f"nullif({p}, '')" for p in _PARTS) + ')')
_EMBEDDED = Q.clean("concat_ws(chr(10), nullif(title, ''), nullif(caption, ''), CASE WHEN kind <> '' AND source <> '' THEN kind || ' from ' || source END, nullif(location, ''), nullif(body, ''))")


@query(f"WITH {_MEMORIES}, t AS (SELECT memory_id, {_EMBEDDED} AS x FROM m) SELECT memory_id, {Q.truncate('x', 1500)} AS text FROM t")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", S.embedding_text(*[F.col(c) for c in ("title", "caption", "kind", "source", "location", "body")]).alias("text"))


@query("SELECT DISTINCT item_id, CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM manifest")
def mime_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("item_id", S.mime_type(F.col("file")).alias("mime")).distinct()


@query("SELECT DISTINCT item_id, coalesce(nullif(title, ''), file) AS title, coalesce(nullif(location, ''), '') AS location, coalesce(nullif(app, ''), 'Imported') AS source FROM manifest")
def defaults(spark: SparkSession, d: str) -> DataFrame:
    or_else = lambda c, x: F.coalesce(S.present(F.col(c)), x)
    return table(spark, d, "manifest").select("item_id", or_else("title", F.col("file")).alias("title"), or_else("location", F.lit("")).alias("location"), or_else("app", F.lit("Imported")).alias("source")).distinct()


@query(f"WITH {_MEMORIES} SELECT memory_id, round(coalesce(list_avg(list_filter(list_transform(ocr_lines, lambda x: x.c), lambda c: c >= 55)), ocr.confidence), 1) AS confidence FROM m WHERE ocr IS NOT NULL")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    good = F.filter(F.transform("ocr_lines", lambda x: x["c"]), lambda c: c >= 55)
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, c: s + c) / F.size(good))
    return memories(spark, d).where("ocr IS NOT NULL").select("memory_id", F.round(F.coalesce(mean, F.col("ocr.confidence")), 1).alias("confidence"))


# ---- entities

_B = "\\b"
_TEXT = f"SELECT doc_id, {Q.clean('text')} AS t FROM documents"


def _entity_query(kind: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = table(spark, d, "documents").select("doc_id", F.explode(E.pattern_entities(F.col("text"), [kind])).alias("e"))
        return found.select("doc_id", "e.value", "e.label")

    QUERIES[f"entities_{kind}"] = run
    SQL[f"entities_{kind}"] = f"WITH t AS ({_TEXT}), {sql}"


def _whole(kind: str, pattern: str, value: str, group: int = 0) -> None:
    _entity_query(kind, f"g AS (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', {group})) AS x FROM t) SELECT DISTINCT doc_id, {value} AS value, {value} AS label FROM g")


def _groups(pattern: str, n: int) -> str:
    cols = ", ".join(f"unnest(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', {i})) AS g{i}" for i in range(1, n + 1))
    return f"g AS (SELECT doc_id, {cols} FROM t)"


_FIRST = "SELECT doc_id, value, label FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY 1) = 1"
_entity_query("phone", f"{_groups(E.PHONE + _B, 3)} SELECT DISTINCT doc_id, '0' || g1 || g2 || g3 AS value, '0' || g1 || ' ' || g2 || ' ' || g3 AS label FROM g")
_entity_query("money", f"""{_groups(_B + E.MONEY + _B, 2)}, w AS (SELECT doc_id, CAST(regexp_replace(g1, '[ ,]', '', 'g') AS BIGINT) AS n, coalesce(g2, '') AS c FROM g)
  SELECT DISTINCT doc_id, 'R' || n || regexp_replace(regexp_replace('.' || c, '0+$', ''), '\\.$', '') AS value,
         'R' || replace(format('{{:,}}', n), ',', ' ') || CASE WHEN c = '' THEN '' ELSE '.' || c END AS label FROM w WHERE n >= 10""")
_whole("email", _B + E.EMAIL + _B, "lower(x)")
_entity_query("website", f"{_groups('(?i)' + _B + E.WEBSITE, 2)} SELECT DISTINCT doc_id, lower(g1) AS value, lower(g1) || coalesce(g2, '') AS label FROM g WHERE NOT regexp_matches(lower(g1), '^[0-9]')")
_whole("time", _B + E.TIME + _B, "lpad(x, 5, '0')")
_entity_query("date", f"""{_groups('(?i)' + _B + E.DATE + _B, 3)},
  v AS (SELECT doc_id, CASE WHEN coalesce(g3, '') = '' THEN '????' ELSE g3 END || '-' || lpad(CAST((strpos('{E.MONTHS}', substring(lower(g2), 1, 3)) + 3) // 4 AS VARCHAR), 2, '0') || '-' || lpad(CAST(CAST(g1 AS INT) AS VARCHAR), 2, '0') AS value,
               g1 || ' ' || g2 || CASE WHEN coalesce(g3, '') = '' THEN '' ELSE ' ' || g3 END AS label FROM g WHERE CAST(g1 AS INT) BETWEEN 1 AND 31
        UNION ALL SELECT doc_id, x, x FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_B + E.ISO_DATE + _B}')) AS x FROM t)) {_FIRST}""")
_whole("weekday", "(?i)" + _B + E.WEEKDAY + _B, "lower(substring(x, 1, 3))")
_whole("reference", "(?i)" + _B + E.REFERENCE + _B + E.REFERENCE_CODE + _B, "upper(x)", 1)
_whole("quote", E.QUOTE.replace("\n", "\\n"), "x", 1)


_IDENTITY = """e.type || ':' || CASE WHEN e.type = 'phone' THEN right(regexp_replace(e.value, '[^0-9]', '', 'g'), 9)
  WHEN e.type = 'website' THEN lower(regexp_replace(e.value, '^www\\.', '')) WHEN e.type IN ('money', 'date', 'time') THEN e.value ELSE lower(e.value) END"""


@query(f"WITH {_MEMORIES}, x AS (SELECT memory_id, unnest(entities) AS e FROM m) SELECT {_IDENTITY} AS identity, count(*) AS n, count(DISTINCT memory_id) AS memories FROM x GROUP BY 1")
def entity_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).select("memory_id", F.explode("entities").alias("e")).select("memory_id", E.identity(F.col("e")).alias("identity"))
    # first within a memory, then over all, so that nothing is held a memory
    return rows.groupBy("identity", "memory_id").agg(F.count("*").alias("k")).groupBy("identity").agg(F.sum("k").alias("n"), F.count("*").alias("memories"))


@query()
def names_and_organisations(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(E.name_entities(T.clean_text(F.col("text")))).alias("e"))
    return found.select("doc_id", "e.type", "e.value", "e.label")


# ---- questions


_QUESTION = f"SELECT item_id, {Q.clean('question')} AS raw FROM eval_items"


@query(f"""WITH q AS ({_QUESTION}) SELECT item_id,
  CASE WHEN regexp_matches(lower(raw), '{R.NAVIGATE}\\b') THEN 'navigate' WHEN regexp_matches(lower(raw), '{R.QUESTION}\\b') OR contains(raw, '?') THEN 'question' ELSE 'lookup' END AS intent,
  concat_ws(' ', {', '.join(f"CASE WHEN regexp_matches(lower(raw), '{_B}({p}){_B}') THEN '{k}' END" for k, p in R.KIND_HINTS.items())}) AS kinds,
  concat_ws(' ', {', '.join(f"CASE WHEN regexp_matches(lower(raw), '{p}') THEN '{k}' END" for k, p in R.SOURCE_HINTS.items())}) AS sources FROM q""")
def routes(spark: SparkSession, d: str) -> DataFrame:
    r = R.route(F.col("question"))
    return table(spark, d, "eval_items").select("item_id", r["intent"].alias("intent"), F.array_join(r["kinds"], " ").alias("kinds"), F.array_join(r["sources"], " ").alias("sources"))


_SYNONYMS = "MAP {" + ", ".join(f"{Q.quoted(w)}: [{Q.words(others)}]" for w, others in R.synonym_map().items()) + "}"
_FLAT = f"flatten(list_transform({Q.content('text')}, lambda t: coalesce({_SYNONYMS}[t], [])))"


@query(f"WITH f AS (SELECT doc_id, {_FLAT} AS f, {Q.terms('text')} AS t FROM documents) SELECT doc_id, array_to_string(t, ' ') AS terms, array_to_string(list_slice({Q.ordered_distinct('f')}, 1, 6), ', ') AS expansions FROM f")
def terms_and_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as a question."""
    return table(spark, d, "documents").select("doc_id", F.array_join(R.query_terms(F.col("text")), " ").alias("terms"), F.array_join(R.expansions(F.col("text")), ", ").alias("expansions"))


@query(f"WITH {_MEMORIES}, a AS (SELECT source, max(CASE WHEN kind = 'page' THEN 1 ELSE 0 END) AS hit FROM m GROUP BY source) SELECT memory_id, m.source, kind FROM m JOIN a USING (source) WHERE kind = 'page' OR hit = 0")
def soft_kind_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each source, or all of a source without pages."""
    return K.soft_filter(memories(spark, d).select("memory_id", "source", "kind"), F.col("kind") == "page", ["source"])


@query(f"WITH {_MEMORIES} SELECT memory_id, captured_at FROM m WHERE captured_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 31 DAY AND captured_at < TIMESTAMPTZ '{NOW}+00' + INTERVAL 1 DAY")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    """What was captured in the period that a question names."""
    at, span = F.col("captured_at"), R.period(F.lit("what did I save in the last month?"), now())
    return memories(spark, d).where((at >= span["since"]) & (at < span["until"])).select("memory_id", "captured_at")


_ASKED_MONTHS = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '\\b({m}|{m[:3]})\\b') THEN {i}" for i, m in enumerate("january february march april may june july august september october november december".split(), 1)) + " END"


@query(f"""WITH q AS (SELECT item_id, {_ASKED_MONTHS} AS month FROM eval_items WHERE NOT regexp_matches(question, '\\b20[0-9][0-9]\\b')),
  s AS (SELECT item_id, make_date(CASE WHEN month > 7 THEN 2025 ELSE 2026 END, month, 1) AS since FROM q WHERE month IS NOT NULL)
  SELECT item_id, since, CAST(since + INTERVAL 1 MONTH AS DATE) AS until FROM s""")
def asked_months(spark: SparkSession, d: str) -> DataFrame:
    """The months that questions name."""
    rows = table(spark, d, "eval_items").where(~F.col("question").rlike(r"\b20[0-9][0-9]\b")).select("item_id", R.period(F.col("question"), now()).alias("p"))
    months = F.col("p.label").isin([f"in {m}" for m in R.MONTHS])
    return rows.where(months).select("item_id", F.to_date("p.since").alias("since"), F.to_date("p.until").alias("until"))


# ---- ranking


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is read from the questions: terms, filters, and the entities they name."""
    r, span = R.route(F.col("question")), R.period(F.col("question"), now())
    found = F.concat(E.pattern_entities(F.col("question")), E.name_entities(T.clean_text(F.col("question"))))
    rows = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), r["raw"].alias("raw"), r["terms"].alias("terms"), r["kinds"].alias("kinds"), r["sources"].alias("sources"), span["since"].alias("since"), span["until"].alias("until"), found.alias("entities"))
    return rows.withColumn("identities", F.transform("entities", E.identity))


@query()
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities that the questions name."""
    return questions(spark, d).select("query_id", F.explode("entities").alias("e")).select("query_id", "e.type", "e.label", E.identity(F.col("e")).alias("identity"))


def _bm25_sql(docs: str) -> str:
    return f"""d AS (SELECT doc_id, {Q.stems(Q.tokens('text'))} AS s FROM {docs}), corpus AS (SELECT count(*) AS n, avg(len(s)) AS mean FROM d),
  p AS (SELECT doc_id, len(any_value(s)) AS l, t AS stem, count(*) AS tf FROM (SELECT doc_id, s, unnest(s) AS t FROM d) GROUP BY doc_id, t),
  f AS (SELECT stem, count(*) AS df FROM p GROUP BY stem),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest({Q.stems(Q.terms(Q.clean('question')))}) AS stem FROM eval_items),
  raw AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (0.28 + 0.72 * l / mean))) AS raw
          FROM asked JOIN p USING (stem) JOIN f USING (stem), corpus GROUP BY query_id, doc_id),
  kw AS (SELECT query_id, doc_id, raw / greatest(max(raw) OVER (PARTITION BY query_id), 0.0001) AS keyword FROM raw)"""


_TOP = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(keyword, 6) DESC, doc_id) AS rank, round(keyword, 6) AS keyword FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(keyword, 6) DESC, doc_id) <= 12"


def _bm25_top(docs: DataFrame, asked: DataFrame) -> DataFrame:
    found = HybridRanking(docs.select("doc_id", "text"), now()).keywords(asked.select("query_id", "raw", "terms"), 12)
    return found.select("query_id", "doc_id", "rank", "keyword")


@query(f"WITH {_bm25_sql('documents')} {_TOP}")
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The 12 documents that match each evaluation question best."""
    return _bm25_top(table(spark, d, "documents"), questions(spark, d))


_CHATS = "(SELECT * FROM documents WHERE source = 'PingChat')"


@query(f"WITH {_bm25_sql(_CHATS)} {_TOP}")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among one source only, whose statistics then count."""
    return _bm25_top(table(spark, d, "documents").where("source = 'PingChat'"), questions(spark, d))


@query(f"WITH {_bm25_sql('documents')}, r AS (SELECT query_id, doc_id, round(keyword, 6) AS score FROM kw) SELECT * FROM r QUALIFY score >= greatest(0.14, 0.32 * max(score) OVER (PARTITION BY query_id))")
def relevance_band(spark: SparkSession, d: str) -> DataFrame:
    ranking = HybridRanking(table(spark, d, "documents").select("doc_id", "text"), now())
    scored = ranking.keywords(questions(spark, d).select("query_id", "raw", "terms"), least=0.14)
    return K.relevance_band(scored.select("query_id", "doc_id", F.col("keyword").alias("score")))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The memories with a vector, as the ranking takes them. Stored vectors hold what a model made of a memory."""
    rows = memories(spark, d).withColumn("vector", F.col("embedding_preview")).where("vector IS NOT NULL")
    text = S.search_text(**{p: F.col(p) for p in _PARTS})
    return rows.select(F.col("memory_id").alias("doc_id"), text.alias("text"), "title", "body", "caption", "kind", "source", "captured_at", "location", "entities", "text_source", F.col("ocr.confidence").alias("ocr_confidence"), "vector")


def exemplary(spark: SparkSession, d: str) -> DataFrame:
    """The questions, each with the vector and the details of one memory in place of a model's: the first question those of the memory with the smallest id, and so on."""
    asked = table(spark, d, "eval_items").count()
    first = indexed(spark, d).select("doc_id", "vector", "entities").orderBy("doc_id").limit(asked)
    numbered = first.select(F.row_number().over(Window.orderBy("doc_id")).cast("bigint").alias("query_id"), F.array("vector").alias("vectors"), F.transform("entities", E.identity).alias("identities"))
    return questions(spark, d).drop("identities", "kinds", "sources", "since", "until").join(numbered, "query_id", "left")


_INDEXED = f"""{_MEMORIES}, t AS (SELECT memory_id AS doc_id, {_SEARCHED} AS text, captured_at, coalesce(entities, []) AS entities, embedding_preview AS v, row_number() OVER (ORDER BY memory_id) AS k FROM m WHERE embedding_preview IS NOT NULL),
  {_bm25_sql('t')},
  q AS (SELECT item_id AS query_id, list_distinct(list_filter({Q.stems(Q.terms(Q.clean('question')))}, lambda t: length(t) > 1)) AS qs, trim({Q.squash(Q.clean('question'))}) AS phrase, t.v AS qv FROM eval_items LEFT JOIN t ON k = item_id),
  di AS (SELECT doc_id, e.type AS type, {_IDENTITY} AS identity FROM (SELECT doc_id, unnest(entities) AS e FROM t)),
  qi AS (SELECT DISTINCT k AS query_id, {_IDENTITY} AS identity FROM (SELECT k, unnest(entities) AS e FROM t)),
  en AS (SELECT query_id, doc_id, least(count(*) + 1.5 * count_if(type = 'phone'), 3.0) AS entity, count_if(type = 'phone') > 0 AS phone FROM di JOIN qi USING (identity) GROUP BY 1, 2),
  ds AS (SELECT doc_id, {Q.stems(Q.tokens('text'))} AS s, {Q.squash('text')} AS flat, 1 / (1 + greatest(0.0, date_diff('microsecond', captured_at, TIMESTAMPTZ '{NOW}+00') / 86400000000.0) / 365) AS recency, v FROM t),
  sig AS (SELECT q.query_id, ds.doc_id, greatest(0.0, (coalesce(list_inner_product(ds.v, q.qv), -1.0) - 0.05) / 0.75) AS semantic, coalesce(keyword, 0.0) AS keyword,
            CASE WHEN len(qs) = 0 THEN 0.0 ELSE len(list_intersect(qs, s)) / len(qs) END AS coverage, coalesce(entity, 0.0) AS entity, coalesce(phone, false) AS phone,
            CASE WHEN length(phrase) > 12 AND contains(flat, phrase) THEN 1.0 ELSE 0.0 END AS phrase, coalesce(recency, 0.0) AS recency
          FROM q CROSS JOIN ds LEFT JOIN kw USING (query_id, doc_id) LEFT JOIN en USING (query_id, doc_id)),
  base AS (SELECT query_id, doc_id, 0.5 * semantic + 0.26 * keyword + 0.13 * coverage + 0.075 * least(entity, 2.0) + 0.05 * phrase + 0.03 * recency + CASE WHEN phone THEN 0.25 ELSE 0.0 END AS s FROM sig)"""
_BEST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 12"


@query(f"WITH {_INDEXED} SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round(s, 6) AS score FROM base) WHERE score > 0.02 {_BEST}")
def hybrid_top(spark: SparkSession, d: str) -> DataFrame:
    """The 12 best memories of each evaluation question by all signals."""
    return HybridRanking(indexed(spark, d), now(), E.identity).top(exemplary(spark, d)).select("query_id", "doc_id", "score")


_BRIDGED = """first AS (SELECT query_id, doc_id AS leader FROM base QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) = 1),
  bi AS (SELECT * FROM di WHERE type IN ('phone', 'name', 'org', 'email', 'website', 'reference')),
  li AS (SELECT DISTINCT query_id, leader, identity FROM first JOIN bi ON doc_id = leader),
  br AS (SELECT query_id, doc_id, CAST(least(0.15, 0.06 + 0.04 * count(*)) AS DOUBLE) AS bridge FROM li JOIN bi USING (identity) WHERE doc_id <> leader GROUP BY 1, 2)"""


@query(f"WITH {_INDEXED}, {_BRIDGED} SELECT query_id, doc_id, score, bridge FROM (SELECT query_id, doc_id, round(s + coalesce(bridge, 0.0), 6) AS score, round(coalesce(bridge, 0.0), 3) AS bridge FROM base LEFT JOIN br USING (query_id, doc_id)) WHERE score > 0.02 {_BEST}")
def hybrid_bridged(spark: SparkSession, d: str) -> DataFrame:
    """The same, with every memory raised that shares a detail with the best one before the 12 are taken."""
    return HybridRanking(indexed(spark, d), now(), E.identity).top(exemplary(spark, d), bridged=True).select("query_id", "doc_id", "score", F.round("bridge", 3).alias("bridge"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = indexed(spark, d), questions(spark, d)
    ranked = materialise(HybridRanking(docs, now(), E.identity).top(asked, bridged=True))
    mine = docs.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi")  # at most 12 memories a question
    words = S.keywords(mine, "doc_id", F.concat_ws(" ", "title", "caption", "body"))
    return A.compose(ranked, asked, mine.join(words, "doc_id"), now())


@query()
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Headline, kind, trail, confidence, notes and follow-ups of the answer to every question, filters and entities of the question used."""
    rows = _answers(spark, d)
    lines = lambda c: F.array_join(c, "\n")
    return rows.select("query_id", "headline", "kind", lines(F.transform("bullets", lambda b: F.concat(b["text"], F.lit(" / "), b["why"]))).alias("bullets"), lines("trail").alias("trail"), "confidence", lines("notes").alias("notes"), lines("follow_ups").alias("follow_ups"))


@query()
def answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The memories that each answer rests on, with the reasons."""
    return _answers(spark, d).select("query_id", F.posexplode("evidence").alias("place", "e")).select("query_id", "place", "e.doc_id", "e.score", F.array_join("e.reasons", "\n").alias("reasons"), "e.quote")


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"""WITH v AS ({_VECTORS}), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank, similarity, round(greatest(0.0, (similarity - 0.05) / 0.75), 6) AS semantic FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 12""")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    """The 12 nearest vectors of every vector whose id is divisible by 50, among all."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return K.nearest_of(v, v.where("vec_id % 50 = 0"), 12).withColumn("semantic", F.round(K.semantic(F.col("similarity")), 6))


@query(f"WITH v AS ({_VECTORS}), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM v) SELECT vec_id, round(norm, 4) AS norm, len(v) AS dims, round(v[1] / norm, 3) AS first, round(v[16] / norm, 3) AS sixteenth FROM n")
def vector_facts(spark: SparkSession, d: str) -> DataFrame:
    unit = K.l2_normalised(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(K.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dims"), F.round(unit[0], 3).alias("first"), F.round(unit[15], 3).alias("sixteenth"))


@query(f"WITH {_MEMORIES} SELECT memory_id, round(1 / (1 + greatest(0.0, date_diff('microsecond', captured_at, TIMESTAMPTZ '{NOW}+00') / 86400000000.0) / 365), 6) AS recency FROM m")
def recency(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", F.round(K.recency(F.col("captured_at"), now()), 6).alias("recency"))


@query(f"""WITH {_MEMORIES}, x AS (SELECT memory_id, unnest(entities) AS e FROM m), i AS (SELECT memory_id, e.type AS type, {_IDENTITY} AS identity FROM x),
  q AS (SELECT DISTINCT memory_id AS query_id, identity FROM i WHERE memory_id % 50 = 0)
  SELECT query_id, memory_id AS doc_id, least(sum(CASE WHEN type = 'phone' THEN 2.5 ELSE 1.0 END), 3.0)::DOUBLE AS hits, bool_or(type = 'phone') AS phone FROM i JOIN q USING (identity) GROUP BY 1, 2""")
def entity_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What every memory whose id is divisible by 50 shares with all memories."""
    found = G.mentions(memories(spark, d), kinds=None).select(F.col("memory_id").alias("doc_id"), "type", "identity")
    asked = found.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "identity").distinct()
    return K.entity_hits(found, asked)


# ---- graph


_MENTIONS = f"x AS (SELECT memory_id, captured_at, unnest(entities) AS e FROM m), i AS (SELECT e.type AS type, {_IDENTITY} AS identity, memory_id, min(captured_at) AS captured_at FROM x WHERE e.type IN ('phone', 'name', 'website', 'reference', 'email') GROUP BY 1, 2, 3)"
_EDGES = f"{_MEMORIES}, {_MENTIONS}, c AS (SELECT *, lag(memory_id) OVER (PARTITION BY identity ORDER BY captured_at, memory_id) AS from_id, count(*) OVER (PARTITION BY identity) AS strength FROM i), edges AS (SELECT identity, type, from_id, memory_id AS to_id, strength FROM c WHERE from_id IS NOT NULL)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.chain_edges(G.mentions(memories(spark, d)))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def connections(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {_EDGES} SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges")
def connection_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(_edges(spark, d))


_HELD = f"{_MEMORIES}, {_MENTIONS}, h AS (SELECT *, count(*) OVER (PARTITION BY identity) AS strength FROM i QUALIFY strength > 1)"
_SHARED_LABEL = "'same ' || CASE type WHEN 'phone' THEN 'phone number ' WHEN 'name' THEN 'person: ' WHEN 'website' THEN 'site ' ELSE type || ' ' END || label"


@query(f"WITH {_HELD} SELECT identity, type, memory_id, captured_at, strength FROM h")
def memberships(spark: SparkSession, d: str) -> DataFrame:
    """The details that more than one memory holds, with the memories that hold them."""
    return G.memberships(G.mentions(memories(spark, d)))


@query(f"""WITH {_HELD}, l AS (SELECT memory_id, {_IDENTITY} AS identity, min(e.label) AS label FROM x WHERE e.type IN ('phone', 'name', 'website', 'reference', 'email') GROUP BY 1, 2)
  SELECT a.memory_id AS asked, b.memory_id AS other, identity, b.type AS type, {_SHARED_LABEL.replace('type', 'b.type')} AS label, b.strength FROM h a JOIN h b USING (identity) JOIN l ON l.memory_id = a.memory_id AND l.identity = a.identity WHERE a.memory_id % 50 = 0 AND a.memory_id <> b.memory_id""")
def related_edges(spark: SparkSession, d: str) -> DataFrame:
    """All that the memories whose id is divisible by 50 share with any other."""
    rows = memories(spark, d)
    return G.partners(G.mentions(rows), rows.where("memory_id % 50 = 0").select(F.col("memory_id").alias("id")))


@query(f"WITH {_EDGES} SELECT * FROM edges WHERE from_id % 50 = 0 OR to_id % 50 = 0")
def chained_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the chains at the memories whose id is divisible by 50."""
    return G.related(_edges(spark, d), memories(spark, d).where("memory_id % 50 = 0").select(F.col("memory_id").alias("id")))


@query(f"WITH {_EDGES} SELECT * FROM edges ORDER BY strength DESC, identity, from_id, to_id LIMIT 40")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The 40 strongest edges, as the overview shows them."""
    return _edges(spark, d).orderBy(F.desc("strength"), "identity", "from_id", "to_id").limit(40)


@query(f"WITH {_NOTES}, t AS (SELECT note_id, title, captured_at, regexp_replace({Q.clean('body')}, '\\n+', ' · ', 'g') AS x FROM n) SELECT note_id, title, captured_at, {Q.truncate('x', 150)} AS snippet FROM t")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    flat = F.regexp_replace(T.clean_text(F.col("body")), "\n+", " · ")
    return notes(spark, d).select("note_id", "title", "captured_at", T.truncate(flat, 150).alias("snippet")).orderBy("captured_at", "note_id")


@query(f"""WITH {_MEMORIES}, t AS (SELECT *, {Q.trimmed(f"regexp_replace({Q.clean('caption')}, '\\s+', ' ', 'g')")} AS deck_, {Q.clean('body')} AS body_ FROM m)
  SELECT memory_id, title, kind, source, {Q.truncate('deck_', 240)} AS deck, {Q.truncate('body_', 4000)} AS body, array_to_string(list_transform(list_slice(entities, 1, 8), lambda e: e.key), ', ') AS entities FROM t""")
def cards(spark: SparkSession, d: str) -> DataFrame:
    deck = F.trim(F.regexp_replace(T.clean_text(F.col("caption")), r"\s+", " "))
    first = F.array_join(F.transform(F.slice("entities", 1, 8), lambda e: e["key"]), ", ")
    return memories(spark, d).select("memory_id", "title", "kind", "source", T.truncate(deck, 240).alias("deck"), T.truncate(T.clean_text(F.col("body")), 4000).alias("body"), first.alias("entities"))


@query(f"""WITH {_MEMORIES}, w AS (SELECT memory_id, t, count(*) AS n FROM (SELECT memory_id, unnest({Q.content("concat_ws(' ', title, caption, body)")}) AS t FROM m) WHERE length(t) >= 3 GROUP BY ALL),
  r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY n DESC, t) <= 6), k AS (SELECT memory_id, string_agg(t, ' ' ORDER BY n DESC, t) AS k FROM r GROUP BY memory_id),
  x AS (SELECT memory_id, regexp_replace({Q.clean("coalesce(nullif(body, ''), nullif(caption, ''), title, '')")}, '\\n+', ' · ', 'g') AS text FROM m),
  c AS (SELECT memory_id, {Q.trimmed("substring(text, 1, 190 + CASE WHEN length(text) > 190 THEN greatest(strpos(substring(text, 191, 24), ' ') - 1, 0) ELSE 0 END)")} AS snippet FROM x)
  SELECT memory_id, coalesce(k, '') AS keywords, snippet, coalesce(array_to_string(list_filter({Q.sentences(Q.clean("coalesce(body, '')"))}, lambda x: length(x) > 24 AND length(x) < 260)[:6], chr(10)), '') AS sentences,
    coalesce(array_to_string(list_transform(embedding_preview[:12], lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ' '), '') AS vector_thousandths FROM m LEFT JOIN k USING (memory_id) JOIN c USING (memory_id)""")
def card_details(spark: SparkSession, d: str) -> DataFrame:
    """What a card unfolds to: six keywords, the text's beginning, the sentences shown, and the first twelve numbers of the vector."""
    words = F.array_join(S.top_words(F.concat_ws(" ", "title", "caption", "body"), 6), " ")
    first = F.coalesce(S.present(F.col("body")), S.present(F.col("caption")), F.col("title"), F.lit(""))
    numbers = F.array_join(F.transform(F.slice("embedding_preview", 1, 12), lambda v: F.round(v * 1000).cast("bigint").cast("string")), " ")
    return memories(spark, d).select(
        "memory_id", words.alias("keywords"), T.snippet(first, F.array().cast("array<string>"), 190).alias("snippet"),
        F.array_join(T.display_lines(F.col("body")), "\n").alias("sentences"), F.coalesce(numbers, F.lit("")).alias("vector_thousandths"),
    )


# ---- answers


_ASKED = ["warranty", "fridge", "saturday"]


@query(f"""WITH {_NOTES}, s AS (SELECT note_id, title, list_filter({Q.sentences(Q.clean('body'))}, lambda x: length(x) > 8 AND NOT regexp_matches(x, '^\\W+$') AND lower(x) <> lower(coalesce(title, ''))) AS s FROM n),
  l AS (SELECT note_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS line FROM s),
  r AS (SELECT note_id, place, line, round(len(list_filter({Q.stems(Q.tokens('line'))}, lambda t: t IN ({Q.words(_ASKED)})))
    + CASE WHEN regexp_matches(line, '(\\d{{3}}[\\s-]?\\d{{4}}|R\\s?\\d|:\\d\\d)') THEN 0.5 ELSE 0 END - CASE WHEN length(line) > 220 THEN 0.4 ELSE 0 END - CASE WHEN length(line) < 24 THEN 0.9 ELSE 0 END - CASE WHEN place = 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM l)
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, place) <= 2""")
def answer_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The two sentences of each note that answer best."""
    lines = notes(spark, d).select("note_id", F.posexplode(A.answer_sentences(F.col("body"), F.col("title"))).alias("place", "line"))
    score = A.sentence_score(F.col("line"), F.col("place"), F.array(*map(F.lit, _ASKED)), F.lit(None).cast("array<string>"))
    return K.top_k(lines.withColumn("score", score), 2, ["note_id"], [F.desc("score"), F.asc("place")]).drop("rank")


_TOTAL = f"trim(regexp_replace(nullif(regexp_extract({Q.clean('body')}, '(?i)\\btotal\\b[^A-Za-z0-9]{{0,8}}({A.AMOUNT})', 1), ''), '\\s+', ' ', 'g'))"


@query(f"""WITH {_MEMORIES}, e AS (SELECT memory_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM m),
  b AS (SELECT memory_id, e.label AS label, TRY_CAST(regexp_replace(e.value, '[^\\d.]', '', 'g') AS DOUBLE) AS v, i FROM e WHERE e.type = 'money'),
  best AS (SELECT * FROM b WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY v DESC, i) = 1)
  SELECT memory_id, coalesce({_TOTAL}, CASE WHEN v >= 50 THEN label END) AS total FROM m LEFT JOIN best USING (memory_id)""")
def answer_totals(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", A.total_amount(F.col("body"), F.col("entities")).alias("total"))


@query(f"""WITH {_NOTES} SELECT note_id, coalesce(nullif(regexp_extract({Q.clean('body')}, '\\b(?:watch|watching|read|reading|listen to|listening to|play|playing)\\s+(?:the\\s+)?([A-Z][A-Za-z0-9''\\-]+(?:\\s+[A-Z][A-Za-z0-9''\\-]+)?)', 1), ''),
  nullif(regexp_extract({Q.clean('body')}, '[“"]([^”"\\n]{{3,40}})[”"]', 1), '')) AS title FROM n""")
def answer_titles(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("note_id", A.named_title(F.col("body")).alias("title"))


_RANGE = f"(?i)\\b({A.CLOCK})\\s*(?:to|until|-|–)\\s*({A.CLOCK})\\b"


@query(f"""WITH {_NOTES}, t AS (SELECT note_id, {Q.clean('body')} AS b FROM n) SELECT note_id, coalesce(nullif(regexp_extract(b, '{_RANGE}', 1), '') || ' – ' || nullif(regexp_extract(b, '{_RANGE}', 2), ''), nullif(regexp_extract(b, '\\b({A.CLOCK})\\b', 1), '')) AS time FROM t""")
def answer_times(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("note_id", A.time_range(F.col("body")).alias("time"))


@query()
def answer_details(spark: SparkSession, d: str) -> DataFrame:
    """Secrets, balances and mentions of each memory's first name."""
    first = F.try_element_at(F.transform(F.filter("entities", lambda e: (e["type"] == "name") & A.person_like(e["label"])), lambda e: e["label"]), F.lit(1))
    rows = memories(spark, d).withColumn("person", first)
    return rows.select("memory_id", A.secret(F.col("body")).alias("secret"), A.balance_amount(F.col("body")).alias("balance"), "person", F.when(F.col("person").isNotNull(), A.mention(F.col("body"), F.col("person"))).alias("mention"))


@query(f"""WITH {_MEMORIES}, e AS (SELECT memory_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM m),
  w AS (SELECT memory_id, e.type || ': ' || e.label AS t, CASE e.type WHEN 'phone' THEN 0 WHEN 'name' THEN 1 WHEN 'money' THEN 2 WHEN 'website' THEN 3 ELSE 4 END AS w, i FROM e),
  r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY w, i) AS k FROM w),
  g AS (SELECT memory_id, string_agg(t, '; ' ORDER BY k) AS trail FROM r WHERE k <= 4 GROUP BY memory_id)
  SELECT memory_id, coalesce(trail, '') AS trail FROM m LEFT JOIN g USING (memory_id) WHERE entities IS NOT NULL""")
def entity_trails(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where("entities IS NOT NULL").select("memory_id", F.array_join(A.entity_trail(F.col("entities")), "; ").alias("trail"))


_FACT = "(list_filter(entities, lambda e: e.type = '{}')[1]).label"


@query(f"WITH {_MEMORIES} SELECT memory_id, array_to_string(list_slice(list_filter([{', '.join(_FACT.format(k) for k in ('phone', 'money', 'website', 'date'))}, nullif(location, '')], lambda x: x IS NOT NULL), 1, 4), '; ') AS facts FROM m WHERE entities IS NOT NULL")
def fact_strips(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where("entities IS NOT NULL").select("memory_id", F.array_join(A.fact_strip(F.col("entities"), F.col("location")), "; ").alias("facts"))


# ---- statistics and listings


@query(f"WITH {_MEMORIES} SELECT 'kind' AS field, kind AS value, count(*) AS n FROM m GROUP BY kind UNION ALL SELECT 'source', source, count(*) FROM m GROUP BY source")
def counts_by_kind_and_source(spark: SparkSession, d: str) -> DataFrame:
    return S.counts_by(memories(spark, d), ["kind", "source"])


@query(f"""WITH {_MEMORIES} SELECT count(*) AS memories, min(captured_at) AS first, max(captured_at) AS last, sum(size)::BIGINT AS bytes, sum(coalesce(len(entities), 0))::BIGINT AS entities, sum(coalesce(len(tokens), 0))::BIGINT AS tokens,
  count_if(text_source = 'ocr') AS scanned, round(coalesce(avg(ocr.confidence) FILTER (text_source = 'ocr'), 0), 1) AS confidence, CAST(round(coalesce(avg(ocr.ms) FILTER (text_source = 'ocr'), 0)) AS BIGINT) AS ms FROM m""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.sum(F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)))
    scanned = F.col("text_source") == "ocr"
    return memories(spark, d).agg(
        F.count("*").alias("memories"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last"), F.sum("size").alias("bytes"), size("entities").alias("entities"), size("tokens").alias("tokens"),
        F.count_if(scanned).alias("scanned"), F.round(F.coalesce(F.avg(F.when(scanned, F.col("ocr.confidence"))), F.lit(0.0)), 1).alias("confidence"), F.round(F.coalesce(F.avg(F.when(scanned, F.col("ocr.ms"))), F.lit(0.0))).cast("bigint").alias("ms"),
    )


@query(f"WITH {_MEMORIES} SELECT memory_id, title, captured_at FROM m ORDER BY captured_at DESC, memory_id LIMIT 60 OFFSET 60")
def second_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the listing, newest first."""
    return memories(spark, d).select("memory_id", "title", "captured_at").orderBy(F.desc("captured_at"), "memory_id").offset(60).limit(60)


@query(f"WITH {_MEMORIES} SELECT memory_id, title, captured_at FROM m ORDER BY title NULLS LAST, memory_id LIMIT 60 OFFSET 60")
def second_page_by_title(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the listing by title."""
    return memories(spark, d).select("memory_id", "title", "captured_at").orderBy(F.asc_nulls_last("title"), "memory_id").offset(60).limit(60)


@query(f"""WITH {_MEMORIES}, s AS (SELECT memory_id, list_filter({Q.sentences(Q.clean('body'))}, lambda x: length(x) > 24 AND length(x) < 260)[:6] AS s FROM m),
  l AS (SELECT memory_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS line FROM s)
  SELECT memory_id, place, line, {" + ".join(f"CASE WHEN contains(lower(line), '{t}') THEN 1 ELSE 0 END" for t in _TERMS)} AS score FROM l""")
def display_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The first six sentences of each memory that are neither short nor long, with the terms that each holds."""
    lines = memories(spark, d).select("memory_id", F.posexplode(T.display_lines(F.col("body"))).alias("place", "line"))
    return lines.withColumn("score", sum((F.contains(F.lower("line"), F.lit(t)).cast("int") for t in _TERMS), F.lit(0)))


@query(f"""WITH {_NOTES}, w AS (SELECT note_id, t, count(*) AS n FROM (SELECT note_id, unnest({Q.content("concat_ws(' ', title, body)")}) AS t FROM n) WHERE length(t) >= 3 GROUP BY ALL),
  r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY n DESC, t) <= 12), k AS (SELECT note_id, string_agg(t, ' ' ORDER BY n DESC, t) AS k FROM r GROUP BY note_id)
  SELECT note_id, coalesce(k, '') AS keywords, len({Q.tokens(Q.clean("concat_ws(chr(10), nullif(title, ''), nullif(source, ''), nullif(kind, ''), nullif(location, ''), nullif(url, ''), nullif(body, ''))"))}) AS tokens FROM n LEFT JOIN k USING (note_id)""")
def finished_notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes as documents: search text, tokens and keywords."""
    rows = notes(spark, d).withColumn("text", S.search_text(**{p: F.col(p) for p in ("title", "source", "kind", "location", "url", "body")}))
    return S.finish(rows, "note_id", ["title", "body"]).select("note_id", F.array_join("keywords", " ").alias("keywords"), F.size("tokens").alias("tokens"))


@query("WITH r AS (SELECT kind, row_number() OVER (PARTITION BY note_id ORDER BY ingested_at) AS k, body FROM notes) SELECT kind, count_if(body IS NULL) AS error, count_if(body IS NOT NULL AND k = 1) AS created, count_if(body IS NOT NULL AND k > 1) AS skipped FROM r GROUP BY kind")
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What came of each delivery of a note: created, skipped as already there, or an error without a body."""
    rows = table(spark, d, "notes").groupBy("note_id", "kind").agg(F.count_if(F.col("body").isNull()).alias("e"), F.count("body").alias("b"))
    return rows.groupBy("kind").agg(F.sum("e").alias("error"), F.sum(F.least("b", F.lit(1))).alias("created"), F.sum(F.greatest(F.col("b") - 1, F.lit(0))).alias("skipped"))


@query("""WITH r AS (SELECT note_id, body, row_number() OVER (PARTITION BY note_id ORDER BY body) AS k FROM notes), h AS (SELECT DISTINCT note_id FROM memories WHERE note_id IS NOT NULL)
  SELECT CASE WHEN body IS NULL THEN 'failed' WHEN h.note_id IS NOT NULL OR k > 1 THEN 'skipped' ELSE 'created' END AS outcome, count(*) AS n FROM r LEFT JOIN h USING (note_id) GROUP BY 1""")
def seeded(spark: SparkSession, d: str) -> DataFrame:
    """What comes of filling the memories with all notes."""
    store = table(spark, d, "memories").where("note_id IS NOT NULL").select("note_id", "body")
    _, outcomes = S.seed(store, table(spark, d, "notes").select("note_id", "body"), "note_id")
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT note_id, {_HASH} AS hash FROM notes")
def streamed_notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes as a stream of files, each note stored once."""
    return ingest_stream(spark, f"{d}/notes.parquet", "note_id").select("note_id", S.content_hash(F.col("title"), F.col("body")).alias("hash"))
