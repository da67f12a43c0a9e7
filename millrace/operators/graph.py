"""Connections between memories that share a detail, and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.entities import identity
from millrace.session import salted_join

CONNECTING = ("phone", "name", "website", "reference", "email")


def mentions(memories: DataFrame, id_col: str = "memory_id", kinds: tuple[str, ...] | None = CONNECTING) -> DataFrame:
    """``(id, captured_at, type, label, identity)``: the entities of each memory, with what makes two of them the same."""
    rows = memories.select(id_col, "captured_at", F.explode("entities").alias("e"))
    rows = rows.select(id_col, "captured_at", F.col("e.type").alias("type"), F.col("e.label").alias("label"), identity(F.col("e")).alias("identity"))
    return rows.where(F.col("type").isin(*kinds)) if kinds else rows


def memberships(found: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """``(identity, type, id, captured_at, strength)``: the memories that hold each detail which more than one holds; ``strength`` is their number."""
    once = found.groupBy("identity", "type", id_col).agg(F.min("captured_at").alias("captured_at"))
    size = once.groupBy("identity").agg(F.count("*").alias("strength")).where("strength > 1")
    return salted_join(once, size, ["identity"])


def chain_edges(found: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """``(identity, type, from_id, to_id, strength)``: the memories that share a detail, linked in the order of time.

    A detail of n memories gives n - 1 edges rather than all pairs: each memory is linked to the one before, so the same memories
    are connected, and a detail that a third of all memories hold stays linear. Chains are built month by month and the
    months' ends linked then, so such a detail is no single task. For all partners of asked memories see :func:`partners`.
    """
    linked = memberships(found, id_col).withColumn("month", F.trunc("captured_at", "month"))
    order = Window.partitionBy("identity", "month").orderBy("captured_at", id_col)
    inner = linked.withColumn("from_id", F.lag(id_col).over(order)).where("from_id IS NOT NULL").select("identity", "type", "from_id", F.col(id_col).alias("to_id"), "strength")
    at = F.struct("captured_at", id_col)
    months = linked.groupBy("identity", "month").agg(F.min_by(F.struct(id_col, "type"), at).alias("first"), F.max_by(id_col, at).alias("last"), F.first("strength").alias("strength"))
    before = Window.partitionBy("identity").orderBy("month")
    across = months.withColumn("from_id", F.lag("last").over(before)).where("from_id IS NOT NULL").select("identity", "first.type", "from_id", F.col(f"first.{id_col}").alias("to_id"), "strength")
    return inner.unionByName(across)


def partners(found: DataFrame, ids: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """``(asked, other, identity, type, label, strength)``: what every asked memory shares with any other, each shared detail once a pair."""
    held = memberships(found, id_col).select("identity", "type", id_col, "strength")
    labels = found.groupBy("identity", id_col).agg(F.min("label").alias("label"))
    asked = held.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi").join(labels, ["identity", id_col])
    asked = asked.select("identity", F.col(id_col).alias("asked"), "label")
    pairs = salted_join(held, asked, ["identity"]).where(F.col(id_col) != F.col("asked"))
    return pairs.select("asked", F.col(id_col).alias("other"), "identity", "type", edge_label(F.col("type"), F.col("label")).alias("label"), "strength")


def edge_label(kind: Column, label: Column) -> Column:
    """What two memories share, in words."""
    what = F.when(kind == "phone", "phone number ").when(kind == "name", "person: ").when(kind == "website", "site ").otherwise(F.concat(kind, F.lit(" ")))
    return F.concat(F.lit("same "), what, label)


def nodes(edges: DataFrame) -> DataFrame:
    """``(id)``: both ends of all edges, once each."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def related(edges: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with either end among ``ids``, taken before any limit."""
    hit = edges.join(ids.select(F.col(id_col).alias("from_id")), "from_id", "left_semi").unionByName(edges.join(ids.select(F.col(id_col).alias("to_id")), "to_id", "left_semi"))
    return hit.distinct()
