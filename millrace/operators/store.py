"""Identity, deduplication, upserts and statistics of stored memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.entities import ENTITY, distinct_entities, name_entities, pattern_entities
from millrace.functions.text import clean_text, content_tokens, let, tokens, truncate


def present(c: Column) -> Column:
    """Null for the empty text."""
    return F.when(c != "", c)


def content_hash(title: Column, body: Column) -> Column:
    """The digest that makes two texts the same: of the trimmed, lower-cased title and the body."""
    return F.sha1(F.concat(F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("|"), F.coalesce(body, F.lit(""))))


def document_id(digest: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(digest, 1, 12))


def mime_type(file: Column) -> Column:
    """The type of an image by its name's extension."""
    ext = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "webp", "bmp", "gif"), F.concat(F.lit("image/"), ext)).when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise("application/octet-stream")


def search_text(**parts: Column) -> Column:
    """The text a memory is found by: its non-empty parts, a line each."""
    return clean_text(F.concat_ws("\n", *[present(p) for p in parts.values()]))


def embedding_text(title: Column, caption: Column, kind: Column, source: Column, location: Column, body: Column) -> Column:
    """The text a memory is embedded by, at most 1500 characters."""
    origin = F.when((kind != "") & (source != ""), F.concat(kind, F.lit(" from "), source))
    return truncate(clean_text(F.concat_ws("\n", present(title), present(caption), origin, present(location), present(body))), 1500)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order``; Spark limits each partition before it shuffles, so a crowded key stays cheap."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The store with the batch's rows in place of those of equal key; columns are matched by name."""
    return store.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def only_new(batch: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch of which no key is in the store, one a key."""
    for key in keys:
        batch = batch.join(store.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return batch


def keywords(df: DataFrame, id_col: str, text: Column, n: int = 12) -> DataFrame:
    """``(id, keywords)``: each text's ``n`` most frequent content tokens of three letters or more; ties in code point order.

    Counting stays within the row, so nothing is shuffled.
    """
    return df.select(id_col, top_words(text, n).alias("keywords"))


def top_words(text: Column, n: int = 12) -> Column:
    """The ``n`` most frequent content tokens of three letters or more; sorted and counted by runs, so linear in a long text."""
    words = F.array_sort(F.filter(content_tokens(text), lambda t: F.length(t) >= 3))

    def counted(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (w[i] != w[F.greatest(i - 1, F.lit(0))]))
        runs = lambda s: F.transform(s, lambda at, j: F.struct((at - F.coalesce(F.get(s, j + 1), F.size(w))).alias("n"), w[at].alias("t")))
        return F.when(F.size(w) > 0, let(starts, runs))

    ranked = F.transform(F.slice(F.array_sort(let(words, counted)), 1, n), lambda s: s["t"])
    return F.coalesce(ranked, F.array().cast("array<string>"))


def finish(df: DataFrame, id_col: str, parts: list[str]) -> DataFrame:
    """``df``, which has ``text``, with ``tokens`` of it, and ``keywords``, ``entities`` and ``entity_index`` (their keys) of the named parts.

    Null parts count as empty; a null text has no tokens.
    """
    whole = F.concat_ws("\n", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    found = F.concat(pattern_entities(whole), name_entities(clean_text(whole)))
    rows = df.withColumn("tokens", tokens(F.col("text"))).withColumn("keywords", top_words(F.concat_ws(" ", *parts))).withColumn("entities", found)
    return rows.withColumn("entity_index", F.array_distinct(F.transform("entities", lambda e: e["key"])))


def merged_entities(a: Column, b: Column) -> Column:
    """The entities of ``a``, then those of ``b`` whose key is not among them; null counts as none."""
    none = F.array().cast(ENTITY)
    return distinct_entities(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def seed(store: DataFrame, items: DataFrame, key: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The store filled with the items that it doesn't hold, and what came of each: ``(key, outcome)``, created, skipped or failed without a body.

    With ``force`` the store is emptied first. Items that repeat a key count once, as skipped the other times.
    """
    store = store.limit(0) if force else store
    turn = F.row_number().over(Window.partitionBy(key).orderBy("body"))
    known = items.withColumn("_turn", F.when(F.col("body").isNotNull(), turn)).join(store.select(key, F.lit(True).alias("_held")).distinct(), key, "left")
    outcome = F.when(F.col("body").isNull() | F.col(key).isNull(), "failed").when(F.col("_held") | (F.col("_turn") > 1), "skipped").otherwise("created")
    marked = known.withColumn("outcome", outcome)
    fresh = marked.where("outcome = 'created'").drop("_turn", "_held", "outcome")
    return store.unionByName(fresh, allowMissingColumns=True), marked.select(key, "outcome")


def counts_by(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, value, n)``: the rows of each value of each field, all in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))
