"""Signals of the ranking as Column expressions, and searches by vector and by shared detail; see also ``hybrid``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.session import salted_join

K1, B = 1.4, 0.72
WEIGHTS = {"semantic": 0.5, "keyword": 0.26, "coverage": 0.13, "entity": 0.075, "phrase": 0.05, "recency": 0.03}
#: Vectors that are asked for at once, at most.
ASKED = 20_000


def soft_filter(df: DataFrame, match: Column, keys: list[str]) -> DataFrame:
    """Rows that match, or all rows of a key of which none does."""
    any_match = df.groupBy(*keys).agg(F.max(match.cast("int")).alias("_any")) if keys else df.agg(F.max(match.cast("int")).alias("_any"))
    flagged = df.join(any_match, keys) if keys else df.crossJoin(F.broadcast(any_match))
    return flagged.where(match | (F.col("_any") == 0)).drop("_any")


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark limits each partition before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    scaled = lambda x: F.transform(x["v"], lambda y: y / F.when(x["n"] == 0, 1.0).otherwise(x["n"]))
    return let(a.cast("array<double>"), lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def semantic(similarity: Column) -> Column:
    """A cosine on the scale of the blend; not capped at 1."""
    return F.greatest(F.lit(0.0), (similarity - 0.05) / 0.75)


def recency(captured: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(captured)) / F.lit(86_400_000_000.0))
    return F.when(captured.isNotNull(), 1 / (1 + days / 365))


def nearest_of(rows: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """``(query_id, id, similarity, rank)``: the ``k`` rows nearest to each asked vector by dot product, rounded to six decimals; ties go to the smaller id.

    ``asked`` has the same columns and goes out in blocks of ``ASKED`` vectors; every task keeps its own best, so nothing is shuffled but these.
    A row isn't its own neighbour; null vectors and vectors of another length take no part.
    """
    spark, out = rows.sparkSession, None
    usable = asked.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(id_col, F.col(vec_col).cast("array<double>").alias("v"))
    blocks = max(1, -(-usable.count() // ASKED))
    for b in range(blocks):
        mine = usable.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b).collect()
        by_size: dict[int, tuple[list, list]] = {}
        for i, v in mine:
            ids, vectors = by_size.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
        model = spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v)) for n, (i, v) in by_size.items()})
        all_rows = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        found = all_rows.mapInArrow(_nearest_of(model, k), "query_id bigint, id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    best = top_k(out, k, ["query_id"], [F.desc("similarity"), F.asc("id")])
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "rank", "similarity")


def _nearest_of(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for size, (asked, vectors) in model.value.items():
                rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
                if not len(rows):
                    continue
                ids, v = rows.column("id").to_numpy(), rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                for at in range(0, len(asked), 1024):
                    sim = np.round(vectors[at : at + 1024] @ v.T, 6)
                    sim[asked[at : at + 1024, None] == ids[None]] = -np.inf
                    top = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                    best = np.take_along_axis(sim, top, 1)
                    q, j = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at : at + 1024][q]), pa.array(ids[top[q, j]]), pa.array(best[q, j])], names=["query_id", "id", "similarity"])

    return run


def blend(semantic: Column, keyword: Column, coverage: Column, entity: Column, phrase: Column, recency: Column, phone: Column | None = None) -> Column:
    """The weighted sum of the signals; a shared phone number adds a quarter."""
    w = WEIGHTS
    score = w["semantic"] * semantic + w["keyword"] * keyword + w["coverage"] * coverage + w["entity"] * F.least(entity, F.lit(2.0)) + w["phrase"] * phrase + w["recency"] * recency
    return score + F.when(phone, 0.25).otherwise(0.0) if phone is not None else score


def entity_hits(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """``(query_id, doc_id, hits, phone)`` from ``(doc_id, type, identity)`` and ``(query_id, identity)``: a shared entity counts one, a phone 2.5; at most three."""
    joined = salted_join(entities, asked, ["identity"])
    hits = F.least(F.sum(F.when(F.col("type") == "phone", 2.5).otherwise(1.0)), F.lit(3.0))
    return joined.groupBy("query_id", "doc_id").agg(hits.alias("hits"), F.max(F.col("type") == "phone").alias("phone"))


def relevance_band(ranked: DataFrame) -> DataFrame:
    """Rows within 0.32 of their question's best score, and of at least 0.14."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("_best", best).where(F.col("score") >= F.greatest(F.lit(0.14), 0.32 * F.col("_best"))).drop("_best")
