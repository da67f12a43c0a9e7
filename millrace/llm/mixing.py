"""Mixing sources to target weights (problem 8).

Method: the tokens of each source are packed into blocks of fixed length; every output shard draws how many
slots each source gets; a slot is mapped through a pseudorandom permutation of its source's block numbers, one
permutation a pass over the source; and blocks are joined by number. Quotas are settled in tokens: the last slot
of a source is cut where its quota ends, so shares are exact to a token whatever the length of a block. The draws are
multinomial, conditioned on the totals: a shard draws without replacement from what the sources have left, so the shares come
out exact and no source runs over its repeats.
"""

from __future__ import annotations

import base64
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialise

#: Where the vocabulary of the public tokenizer lies unless the caller names another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's tokenizer parts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixParams:
    """``block``: tokens a block. ``shard``: slots an output shard, at least; ``shards``: output shards a mix, at most.
    ``bucket``: documents that are numbered in one task."""

    block: int = 2_048
    shard: int = 256
    shards: int = 4_096
    bucket: int = 20_000
    seed: int = 17


def token_counts(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A Pandas UDF that counts the tokens of a text; 0 for null and empty texts. The vocabulary file goes out to the executors."""
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]
    state: list = []

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        if not state:
            import tiktoken

            with open(SparkFiles.get(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            state.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return texts.map(lambda t: len(state[0].encode_ordinary(t)) if t else 0)

    return count


def _round(left: np.ndarray, right: np.ndarray, key: np.ndarray, r: int, mask: np.ndarray) -> np.ndarray:
    """``left`` mixed with what ``right`` gives in round ``r``."""
    z = (right + key + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return left ^ ((z >> np.uint64(32)) & mask)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Each ``index`` under a pseudorandom permutation of ``0 .. n-1`` chosen by ``key``, or ``back`` from it: a Feistel network, walked until it falls below ``n``."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, m, h, k = x[todo], mask[todo], half[todo], key[todo]
        left, right = a >> h, a & m
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            left, right = (_round(right, left, k, r, m), left) if back else (right, _round(left, right, k, r, m))
        x[todo] = (left << h) | right
        todo = x >= n
    return x.astype(np.int64)


def _key(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "big")


@F.pandas_udf(T.LongType())
def _block_of(index: pd.Series, n: pd.Series, mix: pd.Series, source: pd.Series) -> pd.Series:
    """The block that the ``index``-th slot of a source takes: the passes over the source follow each other, each permuted anew."""
    turn, keys = index // n, {}
    key = np.array([keys.setdefault(p, _key(*p)) if p not in keys else keys[p] for p in zip(mix, source, turn)], np.uint64)
    return pd.Series(permuted((index % n).to_numpy(), n.to_numpy(), key))


class Mixer:
    """Documents as blocks of tokens, for any number of mixes.

    Documents with a null source, a null id or no tokens take no part; rows that repeat an id count once. A source
    that a mix names but that has no documents gets nothing, and the others share by their weights; a target with a
    null or non-positive share or repeat takes no part. A mix is as large as its scarcest source allows with all shares kept,
    or as ``size`` says where that is less.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None, vocabulary: str = VOCABULARY, size: int | None = None):
        self.p, self.size = params or MixParams(), size
        rows = docs.where(F.col(source_col).isNotNull() & F.col(id_col).isNotNull())
        counted = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), token_counts(docs.sparkSession, vocabulary)(F.col(text_col)).alias("tokens"))
        self.docs = materialise(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")).where("tokens > 0"))
        self.pieces = self._packed()
        self.sources = {r["source"]: r["tokens"] for r in self.docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a source

    def blocks(self, source: str) -> int:
        return -(-self.sources[source] // self.p.block)

    def _packed(self) -> DataFrame:
        """``(source, block, doc_id, at, n)``: the tokens each document has in each block of its source, and the place in the block from which.

        Documents are ordered by a hash within their source. Sums run over buckets first and within a bucket then, so that
        a source with a third of all documents is numbered by many tasks.
        """
        buckets = max(1, self.docs.count() // self.p.bucket)
        rows = self.docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(self.p.seed)), F.lit(buckets)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
        inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("own", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(offsets, ["source", "bucket"])
        b = F.lit(self.p.block)
        start = F.col("offset") + F.col("own")
        spread = placed.select("source", "doc_id", start.alias("start"), (start + F.col("tokens")).alias("end"))
        each = spread.select("*", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b))).alias("block"))
        n = F.least("end", (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b)
        return materialise(each.select("source", "block", "doc_id", (F.greatest("start", F.col("block") * b) - F.col("block") * b).alias("at"), n.alias("n")))

    def quotas(self, targets: list[tuple]) -> dict[int, dict[str, tuple[int, bool]]]:
        """Tokens of each source in each mix, and whether that source limits the mix."""
        out: dict[int, dict[str, tuple[int, bool]]] = {}
        mixes: dict[int, dict[str, tuple[float, int]]] = {}
        for mix, source, share, repeats in targets:
            if mix is not None and source in self.sources and share and share > 0 and repeats and repeats > 0:
                mixes.setdefault(mix, {})[source] = (share, repeats)
        for mix, wanted in mixes.items():
            whole = sum(s for s, _ in wanted.values())
            room = {s: self.sources[s] * repeats for s, (_, repeats) in wanted.items()}
            allows = {s: room[s] * whole / share for s, (share, _) in wanted.items()}
            scarcest = min(allows, key=lambda s: (allows[s], s))
            total = math.floor(min(allows[scarcest], math.inf if self.size is None else self.size))
            exact = {s: total * share / whole for s, (share, _) in wanted.items()}
            tokens = {s: min(room[s], math.floor(x)) for s, x in exact.items()}
            # what rounding left goes where most was cut off
            for s in sorted(exact, key=lambda s: (tokens[s] - exact[s], s))[: max(0, total - sum(tokens.values()))]:
                tokens[s] += tokens[s] < room[s]
            out[mix] = {s: (n, s == scarcest and (self.size is None or self.size > allows[s])) for s, n in tokens.items() if n}
        return out

    def slots_of(self, mix: int, source: str, tokens: int) -> tuple[int, int]:
        """How many slots hold the first ``tokens`` tokens of a source's passes, and how many tokens of the last slot count.

        A pass is all blocks of the source in permuted order; the block with the highest number may be part-filled.
        """
        n, block, blocks = self.sources[source], self.p.block, self.blocks(source)
        turn, rest = divmod(tokens, n)
        if not rest:
            return turn * blocks, block
        missing = blocks * block - n
        key = np.array([_key(mix, source, turn)], np.uint64)
        short_at = int(permuted(np.array([blocks - 1]), np.array([blocks]), key, back=True)[0])
        held = lambda k: k * block - missing * (short_at < k)
        k = -(-rest // block)
        k += held(k) < rest
        return turn * blocks + k, rest - held(k - 1)

    def draws(self, counts: dict[int, dict[str, int]]) -> list[tuple]:
        """``(mix_id, shard, source, first, count)``: the slots each shard draws from each source. At most ``shards`` rows a mix and source."""
        out = []
        for mix, slots in counts.items():
            names, left = sorted(slots), np.array([slots[s] for s in sorted(slots)], np.int64)
            total = int(left.sum())
            shards = max(1, min(self.p.shards, total // self.p.shard))
            sizes = np.diff(np.linspace(0, total, shards + 1).astype(np.int64))
            rng, first = np.random.default_rng(_key(self.p.seed, mix)), np.zeros(len(names), np.int64)
            for k, size in enumerate(sizes):
                drawn = rng.multivariate_hypergeometric(left, int(size), method="marginals")
                out += [(mix, k, names[i], int(first[i]), int(drawn[i])) for i in np.flatnonzero(drawn)]
                left, first = left - drawn, first + drawn
        return out

    def slots(self, targets: DataFrame) -> DataFrame:
        """``(mix_id, shard, source, block, tokens)``: the blocks of every output shard, and how many tokens of each count."""
        spark: SparkSession = self.docs.sparkSession
        cut = {(mix, s): self.slots_of(mix, s, n) for mix, quota in self._wanted(targets).items() for s, (n, _) in quota.items()}
        counts: dict[int, dict[str, int]] = {}
        for (mix, s), (n, _) in cut.items():
            counts.setdefault(mix, {})[s] = n
        draws = spark.createDataFrame(self.draws(counts), "mix_id bigint, shard int, source string, first bigint, count bigint")
        # one row a mix and source
        ends = spark.createDataFrame([(mix, s, self.blocks(s), n - 1, last) for (mix, s), (n, last) in cut.items()], "mix_id bigint, source string, blocks bigint, last_slot bigint, last_tokens bigint")
        each = draws.join(F.broadcast(ends), ["mix_id", "source"]).select("*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
        tokens = F.when(F.col("slot") == F.col("last_slot"), F.col("last_tokens")).otherwise(self.p.block)
        return each.select("mix_id", "shard", "source", _block_of("slot", "blocks", "mix_id", "source").alias("block"), tokens.alias("tokens"))

    def _wanted(self, targets: DataFrame) -> dict[int, dict[str, tuple[int, bool]]]:
        return self.quotas([tuple(r) for r in targets.select("mix_id", "source", "target_share", "max_repeats").collect()])  # a stated request: a row a mix and source

    def mixed(self, targets: DataFrame) -> DataFrame:
        """``(mix_id, source, doc_id, repeats, tokens)``: the documents of each mix, how often the most used part of each is used, and the tokens they bring."""
        used = self.slots(targets).groupBy("mix_id", "source", "block", F.col("tokens").alias("upto")).agg(F.count("*").alias("times"))
        taken = F.least("n", F.col("upto") - F.col("at"))
        joined = self.pieces.join(used, ["source", "block"]).where("upto > at").select("mix_id", "source", "doc_id", "block", "times", (taken * F.col("times")).alias("tokens"))
        blocks = joined.groupBy("mix_id", "source", "doc_id", "block").agg(F.sum("times").alias("times"), F.sum("tokens").alias("tokens"))
        return blocks.groupBy("mix_id", "source", "doc_id").agg(F.max("times").alias("repeats"), F.sum("tokens").alias("tokens"))

    def shares(self, targets: DataFrame) -> DataFrame:
        """``(mix_id, source, target_share, actual_share, tokens, documents, max_repeats, most_repeats, limits)`` for every target.

        ``limits`` says that the source is the one of its mix that allows no larger size.
        """
        spark: SparkSession = self.docs.sparkSession
        limits = spark.createDataFrame([(mix, s, lim) for mix, quota in self._wanted(targets).items() for s, (_, lim) in quota.items()], "mix_id bigint, source string, limits boolean")
        got = self.mixed(targets).groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
        whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("whole"))
        rows = targets.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").join(F.broadcast(limits), ["mix_id", "source"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return rows.select("mix_id", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens"), zero("documents"), "max_repeats", zero("most_repeats"), F.coalesce("limits", F.lit(False)).alias("limits"))
