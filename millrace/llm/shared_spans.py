"""Long exact spans shared between records (problem 9).

Method: sliding sentence spans. Every text is cut into pieces at its sentence starts, and a sentence
longer than ``REACH`` characters is cut further at points that depend only on the characters around
them. From every piece the run of consecutive pieces that follows is hashed over ``RUN`` characters
and joined globally. Two texts that share 300 characters share such a run, wherever the span starts:
within its first 96 characters lies a piece start that both texts have, and 200 more follow it. Runs on
one diagonal are merged, compared character by character and extended at their ends.

Pairs of records are only made where pairs are asked for. How much of a record is shared comes from the windows of
``SPAN`` characters around shared runs, each counted once a text; deduplication from the runs of whole consecutive
sentences. Both are linear in the texts, however many records hold a footer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialise, salted_join

#: Shortest span searched for; the run hashed; the length from which a sentence is cut further; characters a cut depends on.
SPAN, RUN, REACH, GRAM = 300, 200, 72, 12

SENTENCE = re.compile(r"(?<=[.!?])[ \n]|\n")


def sentence_starts(text: str) -> list[int]:
    """Starts of sentences: after a full stop, exclamation or question mark and a blank, or after a line break."""
    return [0, *[m.end() for m in SENTENCE.finditer(text) if m.end() < len(text)]]


def piece_starts(texts: list[str]) -> list[np.ndarray]:
    """Per text the starts of its pieces. Inside a long sentence: where the hash of the next characters is the least among ``REACH`` places.

    All texts are hashed in one go; the least of every stretch of ``REACH`` places comes from running minima within
    blocks of that length, from the left and from the right.
    """
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum([0, *map(len, texts)])
    own = [np.array(sentence_starts(t)) + o for t, o in zip(texts, first)]
    starts = np.concatenate(own)
    ends = np.append(starts[1:], first[-1])
    usable = np.minimum(ends, np.repeat(first[1:], [len(x) for x in own]) - GRAM + 1)
    long = (ends - starts > REACH) & (usable - starts >= REACH)
    found = [starts]
    n = len(code) - GRAM + 1
    if long.any():
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = (h ^ code[k : k + n]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        place = np.arange(n, dtype=np.uint64)
        key = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = h >> np.uint64(32) << np.uint64(32) | place  # of equal hashes the first place
        blocks = key.reshape(-1, REACH)
        to_right = np.minimum.accumulate(blocks, 1).ravel()
        to_left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, starts[long], 1)
        np.add.at(change, usable[long] - REACH + 1, -1)
        i = np.flatnonzero(np.cumsum(change)[:n])
        least = np.minimum(to_left[i], to_right[i + REACH - 1]) & np.uint64(0xFFFFFFFF)
        found.append(np.unique(least).astype(starts.dtype))
    every = np.unique(np.concatenate(found))
    cuts = np.searchsorted(every, first)
    return [every[a:b] - o for a, b, o in zip(cuts, cuts[1:], first)]


#: Characters that are hashed in one go, about.
CHUNK = 400_000


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def text_key(text: str) -> bytes:
    """128 bits, so that equal keys mean equal texts in any collection."""
    return xxhash.xxh3_128_digest(text.encode())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hashes, places = [], [], []
        for text, starts in (x for part in chunks(batch.column(0).to_pylist()) for x in zip(part, piece_starts(part))):
            starts = starts[starts <= len(text) - RUN]
            h = [xxhash.xxh3_64_intdigest(text[s : s + RUN].encode()) - (1 << 63) for s in starts]
            keys += [text_key(text)] * len(h)
            hashes.append(np.array(h, np.int64))
            places.append(starts)
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(hashes), pa.int64()), pa.array(np.concatenate(places), pa.int32())], names=["text_key", "run", "place"])


@F.pandas_udf(T.BinaryType())
def _key_udf(texts: pd.Series) -> pd.Series:
    return texts.map(text_key)


def _common(s: str, t: str) -> int:
    """Characters that two texts have in common from their beginnings on; by halving, so that the comparing is done by slices."""
    low, high = 0, min(len(s), len(t))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if s[low:middle] == t[low:middle] else (low, middle - 1)
    return low


@F.pandas_udf(T.StructType([T.StructField("back", T.IntegerType()), T.StructField("ahead", T.IntegerType())]))
def _extension(a: pd.Series, b: pd.Series, from_a: pd.Series, from_b: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Characters by which a shared span goes on to both sides; null where what was hashed alike isn't the same."""
    back, ahead = [], []
    for s, t, i, j, m in zip(a, b, from_a, from_b, n):
        same = s[i : i + m] == t[j : j + m]
        back.append(_common(s[:i][::-1], t[:j][::-1]) if same else None)
        ahead.append(_common(s[i + m :], t[j + m :]) if same else None)
    return pd.DataFrame({"back": pd.array(back, "Int32"), "ahead": pd.array(ahead, "Int32")})


def _windows(span: int):
    """A digest of every window of ``span`` characters that may be shared: those that begin up to ``span - RUN`` before a shared run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "places"))):
                near = np.unique(np.array(places)[:, None] - np.arange(span - RUN + 1))
                at = near[(near >= 0) & (near <= len(text) - span)]
                data = text.encode() if text.isascii() else None
                digests = [xxhash.xxh3_128_digest(text[w : w + span].encode() if data is None else data[w : w + span]) for w in at]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32())], names=["window", "text_key", "place"])

    return run


@F.pandas_udf(T.IntegerType())
def _covered(places: pd.Series, span: pd.Series) -> pd.Series:
    """Characters that the windows at the given places cover together."""
    return pd.Series([int(np.minimum(np.diff(np.sort(p)), n).sum() + n) for p, n in zip(places, span)], dtype="int32")


def sentence_runs(text: str, least: int) -> list[tuple[int, int]]:
    """From each sentence on the shortest run of two or more sentences that has ``least`` characters: first and last sentence."""
    starts = [*sentence_starts(text), len(text)]
    out, last = [], 0
    for first in range(len(starts) - 2):
        last = max(last, first + 1)
        while last < len(starts) - 1 and starts[last + 1] - starts[first] < least:
            last += 1
        if last >= len(starts) - 1:
            break
        out.append((first, last))
    return out


def _sentence_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, firsts, lasts = [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                starts = [*sentence_starts(text), len(text)]
                for first, last in sentence_runs(text, least):
                    ids.append(i)
                    digests.append(xxhash.xxh3_128_digest(text[starts[first] : starts[last + 1]].rstrip().encode()))
                    firsts.append(first)
                    lasts.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["run", "doc_id", "first", "last"])

    return run


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the sentences of the given runs."""
    out = []
    for text, runs in zip(texts, gone):
        starts = [*sentence_starts(text), len(text)]
        away = {k for r in runs for k in range(r["first"], r["last"] + 1)}
        out.append("".join(text[s:e] for k, (s, e) in enumerate(zip(starts, starts[1:])) if k not in away).strip())
    return pd.Series(out)


class SharedSpans:
    """Shared spans of a table of texts.

    Null texts and texts shorter than the span share nothing; rows that repeat an id and its text count once;
    every other column is ignored. Identical texts are compared once and expanded where pairs of records are asked for.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = SPAN):
        if min_chars < SPAN:
            raise ValueError(f"spans of fewer than {SPAN} characters aren't found reliably")
        self.min_chars = min_chars
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") >= min_chars))
        self.members = materialise(self.docs.select("doc_id", _key_udf("text").alias("text_key"), F.length("text").alias("chars")).distinct())

    def shared_runs(self) -> DataFrame:
        """``(run, text_key, place)``: the runs that more than one text has, once each; counted before any join, so that a run of very many texts is one row."""
        runs = materialise(self.docs.select("text").mapInArrow(_runs, "text_key binary, run bigint, place int"))
        several = runs.groupBy("run").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("run")
        return salted_join(runs, several, ["run"]).distinct()

    def islands(self) -> DataFrame:
        """``(a, b, from_a, from_b, n)``: runs shared by two distinct texts, joined where they overlap on one diagonal."""
        runs = materialise(self.shared_runs())
        left, right = runs.withColumnsRenamed({"text_key": "a", "place": "from_a"}), runs.withColumnsRenamed({"text_key": "b", "place": "from_b"})
        shared = materialise(salted_join(left, right, ["run"]).where("a < b").select("a", "b", "from_a", "from_b"))
        line = Window.partitionBy("a", "b", F.expr("from_a - from_b")).orderBy("from_a")
        fresh = F.when(F.col("from_a") > F.lag("from_a").over(line) + RUN, 1).otherwise(0)
        marked = shared.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(line))
        grouped = marked.groupBy("a", "b", F.expr("from_a - from_b").alias("_shift"), "_island")
        return grouped.agg(F.min("from_a").alias("from_a"), F.min("from_b").alias("from_b"), (F.max("from_a") - F.min("from_a") + RUN).alias("n"))

    def text_spans(self) -> DataFrame:
        """``(a, b, from_a, from_b, n)``: the maximal spans of at least ``min_chars`` shared by two distinct texts."""
        islands = materialise(self.islands())
        needed = islands.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
        texts = self.members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).join(needed, "text_key").join(self.docs.dropDuplicates(["doc_id"]), "doc_id").select("text_key", "text")
        # a text of very many spans is split by Spark's own handling of skewed joins, as salts would multiply whole texts
        both = islands.join(texts.withColumnsRenamed({"text_key": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"text_key": "b", "text": "text_b"}), "b")
        grown = both.withColumn("e", _extension("text_a", "text_b", "from_a", "from_b", "n"))
        spans = grown.select("a", "b", (F.col("from_a") - F.col("e.back")).alias("from_a"), (F.col("from_b") - F.col("e.back")).alias("from_b"), (F.col("n") + F.col("e.back") + F.col("e.ahead")).alias("n"))
        return spans.where(F.col("n") >= self.min_chars).distinct()  # a null length was no equal text

    def pairs(self) -> DataFrame:
        """``(doc_a, doc_b)``, ``doc_a < doc_b``: records that share a span, copies included."""
        found = self.text_spans().select("a", "b").distinct()
        mine = lambda key, name: self.members.select(F.col("text_key").alias(key), F.col("doc_id").alias(name))
        across = salted_join(mine("b", "y"), salted_join(mine("a", "x"), found, ["a"]), ["b"])
        several = self.members.groupBy("text_key").count().where("count > 1").select("text_key")
        copied = salted_join(mine("text_key", "x"), several, ["text_key"])
        copies = salted_join(copied, copied.withColumnRenamed("x", "y"), ["text_key"]).where("x < y")
        both = across.select("x", "y").unionByName(copies.select("x", "y")).where("x <> y")
        return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()

    def shares(self) -> DataFrame:
        """``(doc_id, chars, shared_chars, shared_share)`` of every record long enough to share a span.

        A text of which there are copies is shared whole; of any other those characters count that lie in a window of
        ``min_chars`` which another text has too. No pairs of texts are made.
        """
        places = self.shared_runs().groupBy("text_key").agg(F.collect_list("place").alias("places"))
        firsts = self.members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("chars").alias("chars"))
        texts = firsts.join(places, "text_key").join(self.docs.dropDuplicates(["doc_id"]), "doc_id").select("text_key", "text", "places")
        windows = materialise(texts.mapInArrow(_windows(self.min_chars), "window binary, text_key binary, place int"))
        several = windows.groupBy("window").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("window")
        held = salted_join(windows, several, ["window"]).groupBy("text_key").agg(F.collect_set("place").alias("at"))
        sums = held.select("text_key", _covered("at", F.lit(self.min_chars)).alias("in_windows"))
        per_text = firsts.join(sums, "text_key", "left").select("text_key", F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("in_windows", F.lit(0))).alias("shared_chars"))
        rows = salted_join(self.members, per_text, ["text_key"])
        return rows.select("doc_id", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("shared_share"))

    def deduplicated(self) -> DataFrame:
        """``(doc_id, text)``: texts without the sentences of any run of sentences that stands in an earlier record, or earlier in the same one.

        A run is two or more consecutive sentences with ``min_chars`` characters or more; the record with the smallest id keeps
        its own. Every run is hashed and grouped once over the whole collection.
        """
        whole = self.docs.dropDuplicates(["doc_id"])
        runs = materialise(whole.mapInArrow(_sentence_runs(self.min_chars), "run binary, doc_id bigint, first int, last int"))
        repeated = runs.groupBy("run").agg(F.min(F.struct("doc_id", "first")).alias("keeps"), F.count("*").alias("n")).where("n > 1").select("run", "keeps")
        gone = salted_join(runs, repeated, ["run"]).where((F.col("keeps.doc_id") != F.col("doc_id")) | (F.col("keeps.first") != F.col("first")))
        cuts = gone.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
        none = F.array().cast("array<struct<first:int,last:int>>")
        rows = whole.join(cuts, "doc_id", "left")
        return rows.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(_without("text", F.coalesce("cuts", none))).alias("text"))
