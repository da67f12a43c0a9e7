"""Variant spellings of people and organisations (problem 4).

Method: names become forms of sorted tokens; the distinct words are blocked by phonetic codes and compared by Jaro-Winkler
and by nicknames, from a table and by rule; forms that have one such pair of words, and another beside it, are compared whole; accepted
pairs are clustered by connected components. A surname with an initial joins a cluster only where one person
answers to it. Words, names and titles grow with the input, so no side of a join is broadcast, and results that are used
twice are written, which keeps the driver's plans small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import names
from millrace.operators.components import connected_components
from millrace.session import materialise, merged, salted_join

#: The block of a word with more different neighbours than this is spread over this many sub-keys.
COMMON, SALTS = 60, 8


@F.pandas_udf(T.StringType())
def _form(kinds: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([names.form(k, names.plain_tokens(t)) if t else None for k, t in zip(kinds, labels)])


def _windows(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def forms(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: names.windows(t, most))

    return forms


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(tokens: pd.Series) -> pd.Series:
    return tokens.map(names.phonetic_keys)


@F.pandas_udf(T.BooleanType())
def _same_word(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names.same_word(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def _same_name(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names.same_name(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def _named_by(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names.named_by(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def _partial(a: pd.Series) -> pd.Series:
    return a.map(names.is_partial)


@F.pandas_udf(T.BooleanType())
def _same_beside(kinds: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names.same_beside(k, x, y) for k, x, y in zip(kinds, a, b)], dtype=bool)


_KEYS = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("asks", "answers")])


@F.pandas_udf(_KEYS)
def _beside_keys(kinds: pd.Series, words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([names.beside_keys(k, w) for k, w in zip(kinds, words)], columns=["asks", "answers"])


@F.pandas_udf(_KEYS)
def _initial_keys(kinds: pd.Series, words: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([names.initial_keys(k, w) for k, w in zip(kinds, words)], columns=["asks", "answers"])


_TAGGED = T.ArrayType(T.StructType([*[T.StructField(c, T.StringType()) for c in ("kind", "word", "beside")], T.StructField("asking", T.BooleanType())]))


@F.pandas_udf(_TAGGED)
def _tags(forms: pd.Series) -> pd.Series:
    def one(f: str) -> list[dict]:
        kind, _, rest = f.partition("|")
        tokens, out = rest.split(" "), {}
        tell = set(names.telling(tokens))
        for i, t in enumerate(tokens):
            for j, u in enumerate(tokens):
                if t in tell and i != j:
                    # a given name beside a surname tells no one apart: same_name compares by the surname
                    led = len(tokens) == 2 and t in names.FORMAL and len(u) > 1 and u not in names.FORMAL
                    out[t, u] = {"kind": kind, "word": t, "beside": u, "asking": not led}
        return [out[k] for k in sorted(out)]

    return forms.map(one)


def _tagged(forms: DataFrame) -> DataFrame:
    """``(form, kind, word, beside, asking)``: every word that may tell a form apart, with each word beside it."""
    return forms.select("form", F.inline(_tags("form")))


def word_pairs(known: DataFrame, asked: DataFrame) -> DataFrame:
    """``(asked, known)``: words equal or close; both inputs are distinct ``word`` columns."""
    k = known.select(F.col("word").alias("known"), F.explode(_keys("word")).alias("key"))
    a = asked.select(F.col("word").alias("asked"), F.explode(_keys("word")).alias("key"))
    near = a.join(merged(k), "key").where(F.abs(F.length("asked") - F.length("known")) <= 2).select("asked", "known").distinct()
    return near.where(_same_word("asked", "known"))


def beside_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``(kind, beside, other)``: words that may stand beside the telling ones and mean the same; worked out on distinct words, not on names."""
    words = lambda df: df.where(F.length("beside") > 1).select("kind", "beside").distinct().withColumn("keys", _beside_keys("kind", "beside"))
    a = words(asked.where("asking")).select("kind", "beside", F.explode("keys.asks").alias("key"))
    k = words(known).select("kind", F.col("beside").alias("other"), F.explode("keys.answers").alias("key"))
    return a.join(merged(k), ["kind", "key"]).select("kind", "beside", "other").distinct().where(_same_beside("kind", "beside", "other"))


def _candidates(asked: DataFrame, known: DataFrame, pairs: DataFrame, common: DataFrame) -> DataFrame:
    """``(asked, known)``: pairs of forms that share a telling word and one beside it, or an initial; the blocks of common words are salted."""
    hot = F.col("is_common").isNotNull()
    beside = materialise(beside_pairs(asked, known))
    word = lambda c: F.concat(F.lit("="), c)
    k = known.join(merged(common), "word", "left").select(F.col("form").alias("known"), "kind", F.col("word").alias("known_word"), F.explode(F.array_union(F.array(word("beside")), _initial_keys("kind", "beside")["answers"])).alias("tag"), hot.alias("hot")).distinct()
    k = k.select("known", "kind", "known_word", "tag", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    near = asked.where("asking").join(merged(pairs.select(F.col("asked").alias("word"), F.col("known").alias("known_word"))), "word").select("form", "kind", "beside", F.col("known_word").alias("word"))
    full = near.join(merged(beside), ["kind", "beside"]).select("form", "kind", "word", word("other").alias("tag"))
    initial = near.select("form", "kind", "word", F.explode(_initial_keys("kind", "beside")["asks"]).alias("tag"))
    a = full.unionByName(initial).join(merged(common), "word", "left")
    a = a.select(F.col("form").alias("asked"), "kind", F.col("word").alias("known_word"), "tag", F.when(hot, F.pmod(F.xxhash64("form"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")).distinct()
    return a.join(merged(k), ["kind", "known_word", "tag", "salt"]).select("asked", "known").distinct()


def label_clusters(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From distinct ``(kind, label)``: ``(form, cluster)``, ``(label, form)`` and the common words."""
    formed = materialise(labels.select("kind", "label", _form("kind", "label").alias("form")))
    forms = formed.where("form IS NOT NULL").select("form").distinct()
    tagged = materialise(_tagged(forms))
    common = materialise(tagged.select("word", "beside").distinct().groupBy("word").count().where(F.col("count") > COMMON).select("word", F.lit(True).alias("is_common")))
    vocabulary = tagged.select("word").distinct()
    pairs = materialise(word_pairs(vocabulary, vocabulary))
    candidates = _candidates(tagged, tagged, pairs, common).where("asked < known")
    edges = materialise(candidates.where(_same_name("asked", "known")).withColumn("ap", _partial("asked")).withColumn("kp", _partial("known")))
    full = connected_components(edges.where("NOT ap AND NOT kp").select("asked", "known").unionByName(forms.where(~_partial("form")).select(F.col("form").alias("asked"), F.col("form").alias("known"))), "asked", "known")
    full = materialise(full.withColumnsRenamed({"node": "form", "component": "cluster"}))
    # a surname with initials: the clusters of full names it may stand for
    half = edges.where("ap <> kp").select(F.when(F.col("ap"), F.col("asked")).otherwise(F.col("known")).alias("part"), F.when(F.col("ap"), F.col("known")).otherwise(F.col("asked")).alias("form"))
    answers = half.join(merged(full), "form").groupBy("part").agg(F.count_distinct("cluster").alias("n"), F.min("cluster").alias("cluster"))
    answers = materialise(answers)
    loose = edges.where("ap AND kp").join(merged(answers.select(F.col("part").alias("asked"))), "asked", "left_anti").join(merged(answers.select(F.col("part").alias("known"))), "known", "left_anti")
    lone = forms.where(_partial("form")).join(merged(answers.select(F.col("part").alias("form"))), "form", "left_anti")
    rest = connected_components(loose.select("asked", "known").unionByName(lone.select(F.col("form").alias("asked"), F.col("form").alias("known"))), "asked", "known")
    one = answers.select(F.col("part").alias("form"), F.when(F.col("n") == 1, F.col("cluster")).otherwise(F.col("part")).alias("cluster"))
    clusters = full.unionByName(one).unionByName(rest.select(F.col("node").alias("form"), F.col("component").alias("cluster")))
    return materialise(clusters), formed, common


def title_clusters(titles: DataFrame, clusters: DataFrame, common: DataFrame) -> DataFrame:
    """``(title, cluster)``: the clusters that distinct titles name. An initial that fits several people names none."""
    most = clusters.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 0  # no label has more words
    cut = materialise(titles.select("title", F.explode(_windows(most + 1)("title")).alias("form")))
    tagged = materialise(_tagged(cut.select("form").distinct()))
    known = materialise(_tagged(clusters.select("form")))
    pairs = materialise(word_pairs(known.select("word").distinct(), tagged.select("word").distinct()))
    found = _candidates(tagged, known, pairs, common).where(_named_by("asked", "known"))
    named = materialise(found.join(merged(clusters.withColumnRenamed("form", "known")), "known").select(F.col("asked").alias("form"), "cluster").distinct())
    several = named.groupBy("form").agg(F.count("*").alias("n"))
    sure = named.join(merged(several), "form").where(~_partial("form") | (F.col("n") == 1)).select("form", "cluster")
    return cut.join(merged(sure), "form").select("title", "cluster").distinct()


def variant_links(memories: DataFrame, notes: DataFrame) -> DataFrame:
    """``(left_key, right_key)``: labels of one person or organisation, and labels with the notes whose titles name it.

    Null entities, labels and titles name nothing; equal labels and equal titles are compared once; rows that
    repeat a note_id count once; names of a single word link nothing; a title's runs of words are compared up to the length of
    the longest label. Titles are expanded to notes at the very end, spread
    over tasks, as one person may be named by a large part of the notes.
    """
    labels = (
        memories.where("entities IS NOT NULL").select(F.explode("entities").alias("e"))
        .select(F.col("e.type").alias("kind"), F.col("e.label").alias("label"))
        .where(F.col("kind").isin("name", "org") & F.col("label").isNotNull()).distinct()
    )
    clusters, formed, common = label_clusters(labels)
    member = materialise(formed.join(merged(clusters), "form").select("cluster", F.concat(F.lit("label:"), "label").alias("key")).distinct())
    twin = member.withColumnRenamed("key", "other")
    between = salted_join(member, merged(twin), ["cluster"]).where("key < other").select(F.col("key").alias("left_key"), F.col("other").alias("right_key"))
    titled = notes.where(F.col("title").isNotNull() & F.col("note_id").isNotNull()).select("note_id", "title").distinct()
    named = title_clusters(titled.select("title").distinct(), clusters, common)
    per_title = materialise(salted_join(named, merged(member), ["cluster"]).select("title", "key").distinct())
    across = salted_join(titled, merged(per_title), ["title"]).select(F.col("key").alias("left_key"), F.concat(F.lit("note:"), "note_id").alias("right_key"))
    return between.unionByName(across).distinct()
