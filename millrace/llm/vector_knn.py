"""The k most similar vectors of every vector (problem 2).

Method: balanced posting lists. Centroids are fitted on a bounded sample and split until no list
holds much more than its share; every distinct vector is posted to its own list and, near a border,
to further ones; a graph over the centroids, held in memory by each task, finds the nearest lists,
and a query reads those whose distance is within a ratio of the nearest list's. Within a list all
pairs are compared exactly, in blocks. Equal vectors are indexed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise, salted_join

SCALE = 1_000_000  # similarities are rounded to 6 decimals


@dataclass(frozen=True)
class KnnParams:
    """``sample``: vectors the centroids are fitted on, at most. ``list_size``: vectors a list aims at.
    ``replicas``, ``replica_ratio``: lists a vector is posted to, and how much farther than the nearest
    they may be. ``probes``, ``probe_ratio``: the same for the lists a query reads. ``block``: vectors of
    a list compared in one task; longer lists are compared block against block. ``split``: how many times
    ``list_size`` a list may hold before it gets lists inside it; ``inner_sample``: vectors these are fitted on, about."""

    sample: int = 65_536
    split: int = 8
    inner_sample: int = 4_096
    list_size: int = 300
    replicas: int = 4
    replica_ratio: float = 1.35
    probes: int = 10
    probe_ratio: float = 1.7
    block: int = 6_000
    degree: int = 16
    beam: int = 24
    seed: int = 11


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the labels."""
    if k <= 1 or len(x) <= k:
        return np.zeros(len(x), int) if k <= 1 else np.arange(len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.concatenate([np.argmax(x[i : i + 8192] @ c.T, 1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), x[rng.choice(len(x), k)])
    return label


def balanced_centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """About ``k`` unit centroids of the unit vectors ``x``; a cluster above its share is split again."""
    share, todo, done = max(1.0, len(x) / k), [x], []
    while todo:
        part = todo.pop()
        pieces = min(64, round(len(part) / share))
        labels = _kmeans(part, pieces, rng) if pieces > 1 and len(part) > 1.5 * share else None
        if labels is None or len(np.unique(labels)) < 2:
            mean = part.sum(0)
            done.append(mean if mean @ mean > 1e-12 else part[0])
        else:
            todo += [part[labels == j] for j in np.unique(labels)]
    return _unit(np.array(done))


def neighbour_graph(c: np.ndarray, degree: int, rng: np.random.Generator) -> np.ndarray:
    """For each centroid its nearest ones and two random ones, which keep the graph connected."""
    m, near = len(c), min(degree, len(c) - 1)
    if near < 1:
        return np.zeros((m, 1), int)
    rows = []
    for i in range(0, m, 1024):
        s = c[i : i + 1024] @ c.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        rows.append(np.argpartition(-s, near - 1, 1)[:, :near])
    return np.concatenate([np.concatenate(rows), rng.integers(0, m, (m, 2))], 1)


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: ids and distances of the nearest centroids, nearest first."""
    m = len(c)
    beam = min(beam, m)
    entry = np.unique(np.linspace(0, m - 1, max(beam, min(m, 2 * math.isqrt(m)))).astype(int))
    d = 1 - q @ c[entry].T
    pick = np.argpartition(d, min(beam, len(entry)) - 1, 1)[:, :beam]
    ids, d = entry[pick], np.take_along_axis(d, pick, 1)
    open_ = np.ones(ids.shape, bool)
    while m > len(entry) and open_.any():
        best = np.argsort(np.where(open_, d, np.inf), 1)[:, :step]
        expand = np.take_along_axis(ids, best, 1)
        useful = np.take_along_axis(open_, best, 1)
        np.put_along_axis(open_, best, False, 1)
        found = graph[expand].reshape(len(q), -1)
        dist = 1 - np.einsum("bd,bkd->bk", q, c[found])
        dist[~np.repeat(useful, graph.shape[1], 1)] = np.inf
        order = np.argsort(found, 1, kind="stable")
        by_id = np.take_along_axis(found, order, 1)
        twice = np.zeros(found.shape, bool)
        np.put_along_axis(twice[:, :], order[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
        dist[twice | (found[:, :, None] == ids[:, None, :]).any(2)] = np.inf
        ids, d = np.concatenate([ids, found], 1), np.concatenate([d, dist], 1)
        open_ = np.concatenate([open_, np.isfinite(dist)], 1)
        pick = np.argpartition(d, beam - 1, 1)[:, :beam]
        ids, d, open_ = (np.take_along_axis(a, pick, 1) for a in (ids, d, open_))
    order = np.argsort(d, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(0, 2 * np.take_along_axis(d, order, 1)))


def choose_lists(q: np.ndarray, c: np.ndarray, graph: np.ndarray, p: KnnParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate lists of each vector with two masks: where it is posted, and where it searches."""
    ids, d = graph_search(q, c, graph, p.beam)
    ids, d = ids[:, : max(p.probes, p.replicas)], d[:, : max(p.probes, p.replicas)]
    nearest = np.maximum(d[:, :1], 1e-6)
    rank = np.arange(ids.shape[1])
    search = (d <= p.probe_ratio * nearest) & (rank < p.probes)
    search[:, : min(3, ids.shape[1])] = True
    post = (d <= p.replica_ratio * nearest) & (rank < p.replicas)
    post[:, 0] = True
    # a list closer to one already taken than to the vector brings nothing new
    for j in range(1, min(p.replicas, ids.shape[1])):
        for i in range(j):
            gap = np.sqrt(np.maximum(0, 2 - 2 * (c[ids[:, j]] * c[ids[:, i]]).sum(1)))
            post[:, j] &= ~(post[:, i] & (gap < 0.6 * d[:, j]))
    return ids, post, search


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


KEYS = ["list", "sub"]
ASSIGNED = "list int, sub int, vid bigint, ids array<bigint>, vec array<double>, posted boolean, asks boolean"


def _assigned(rows: pa.RecordBatch | pa.Table, i: np.ndarray, lists: np.ndarray, subs: np.ndarray, posted: np.ndarray, asks: np.ndarray) -> list[pa.Array]:
    """The columns of ``ASSIGNED`` for the rows ``i`` of ``rows``."""
    own = [rows.column(c).take(pa.array(i)) for c in ("vid", "ids", "vec")]
    return [pa.array(lists, pa.int32()), pa.array(subs, pa.int32()), *own, pa.array(posted), pa.array(asks)]


def _assign(index, p: KnnParams):
    """Posts every vector to its lists and names those it searches; each length of vectors has lists of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_of = index.value
        for batch in batches:
            lengths = batch.column("vec").value_lengths().to_numpy()
            for size in np.unique(lengths):
                mine = batch.take(pa.array(np.flatnonzero(lengths == size)))
                first, c, graph = index_of[int(size)]
                for at in range(0, len(mine), 2048):
                    rows = mine.slice(at, 2048)
                    ids, post, search = choose_lists(_unit(_vectors(rows.column("vec"))), c, graph, p)
                    i, j = np.nonzero(post | search)
                    yield pa.RecordBatch.from_arrays(_assigned(rows, i, first + ids[i, j], np.zeros(len(i), int), post[i, j], search[i, j]), names=[*KEYS, "vid", "ids", "vec", "posted", "asks"])

    return run


def _fit_second(p: KnnParams):
    """Centroids inside one list, from a bounded sample of its postings."""

    def run(rows: pa.Table) -> pa.Table:
        x = _unit(_vectors(rows.column("vec")))
        size = rows.column("size")[0].as_py()
        rng = np.random.default_rng(p.seed)
        c = balanced_centroids(x, max(1, min(round(size / p.list_size), len(x) // 8)), rng)
        return pa.table({"list": pa.array(np.full(len(c), rows.column("list")[0].as_py()), pa.int32()), "centre": pa.array(list(c), pa.list_(pa.float64()))})

    return run


def _assign_second(p: KnnParams):
    """Shares the rows of one list out to the lists inside it; a group is a bounded part of the list's rows."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        out = []
        if len(rows):
            c = _vectors(centres.column("centre"))
            graph = neighbour_graph(c, p.degree, np.random.default_rng(p.seed))
            posted, asks = (rows.column(x).to_numpy() for x in ("posted", "asks"))
            first = rows.column("list")[0].as_py()
            for at in range(0, len(rows), 2048):
                part = rows.slice(at, 2048).combine_chunks()
                ids, post, search = choose_lists(_unit(_vectors(part.column("vec"))), c, graph, p)
                post, search = post & posted[at : at + 2048, None], search & asks[at : at + 2048, None]
                i, j = np.nonzero(post | search)
                out.append(pa.table(_assigned(part, i, np.full(len(i), first), 1 + ids[i, j], post[i, j], search[i, j]), names=[*KEYS, "vid", "ids", "vec", "posted", "asks"]))
        return pa.concat_tables(out) if out else rows.select([*KEYS, "vid", "ids", "vec", "posted", "asks"])

    return run


def _within_lists(assigned: DataFrame, sizes: DataFrame, p: KnnParams) -> DataFrame:
    """``assigned`` with the rows of every list that holds far more than its share shared out to lists inside it.

    The centroids of the first level are bounded by the sample, so beyond ``sample / 8`` lists' worth of vectors each list
    gets a second level, fitted on at most ``inner_sample`` of its own postings; so the number of lists grows with the vectors.
    """
    large = sizes.where(F.col("size") > p.split * p.list_size).select("list", "size")
    if not large.limit(1).count():
        return assigned
    every = F.greatest(F.lit(1), F.floor(F.col("size") / p.inner_sample))
    marked = materialise(assigned.join(large, "list", "left"))
    sample = marked.where("size IS NOT NULL AND posted").where(F.pmod(F.xxhash64("vid", F.lit(p.seed)), every) == 0)
    fitted = sample.groupBy("list").applyInArrow(_fit_second(p), "list int, centre array<double>")
    # a list's rows meet its centroids in parts of about ``block`` rows
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / p.block)).cast("int")
    centres = fitted.join(large, "list").select("list", "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    split = marked.where("size IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("vid"), parts).cast("int"))
    second = split.groupBy("list", "part").cogroup(centres.groupBy("list", "part")).applyInArrow(_assign_second(p), ASSIGNED)
    return marked.where("size IS NULL").drop("size").unionByName(second)


def _search(k: int):
    def run(rows: pa.Table) -> pa.Table:
        vec = _unit(_vectors(rows.column("vec")))
        posted = np.nonzero(rows.column("posted").to_numpy())[0]
        asks = np.nonzero(rows.column("asks").to_numpy())[0]
        ids = rows.column("ids").combine_chunks()
        vid = rows.column("vid").to_numpy()
        posted = posted[np.argsort(vid[posted], kind="stable")]  # columns in the order of their smallest id
        starts, lengths, flat = ids.offsets.to_numpy(), ids.value_lengths().to_numpy(), ids.values.to_numpy()
        n, out_vid, out_len, out_sim, out_id = len(posted), [], [], [], []
        for at in range(0, len(asks) if n else 0, 512):
            mine = asks[at : at + 512]
            sim = np.rint(np.round(vec[mine] @ vec[posted].T, 6) * SCALE).astype(np.int64)
            key = sim * n - np.arange(n)
            top = np.argpartition(-key, min(k, n - 1), 1)[:, : k + 1]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), 1), 1)
            rows_at = posted[top].ravel()
            size = lengths[rows_at]
            query = np.repeat(np.repeat(np.arange(len(mine)), top.shape[1]), size)
            s = np.repeat(np.take_along_axis(sim, top, 1).ravel(), size)
            inner = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            i = flat[np.repeat(starts[rows_at], size) + inner]
            order = np.lexsort((i, -s, query))
            query, s, i = query[order], s[order], i[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            keep = place <= k
            out_vid.append(vid[mine])
            out_len.append(np.bincount(query[keep], minlength=len(mine)))
            out_sim.append(-s[keep])
            out_id.append(i[keep])
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        size = whole(out_len, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(whole(out_sim, np.int64), pa.int32()), pa.array(whole(out_id, np.int64), pa.int64())], names=["s", "id"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pa.table({"vid": pa.array(whole(out_vid, np.int64), pa.int64()), "top": pa.ListArray.from_arrays(offsets, pairs)})

    return run


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)``, a row a distinct id: vectors that are neither null, empty nor all zero and hold no null or NaN.

    Vectors of different lengths are different collections, as no cosine is defined between lengths.
    """
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
        .dropDuplicates(["id"])
    )


def _index(reps: DataFrame, p: KnnParams) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors the number of its first list, its centroids and their graph.

    One row a length reaches the driver, and of lengths with more vectors than a list aims at a bounded sample.
    """
    out, first = {}, 0
    rng = np.random.default_rng(p.seed)
    for size, n in sorted(reps.groupBy(F.size("vec").alias("size")).count().collect()):
        lists, c = round(n / p.list_size), np.full((1, size), 1 / math.sqrt(size))
        if lists > 1:
            drawn = F.pmod(F.xxhash64("vid"), F.lit(max(1, n // p.sample))) == 0
            x = _unit(_vectors(reps.where((F.size("vec") == size) & drawn).select("vec").limit(p.sample).toArrow().column("vec")))
            c = balanced_centroids(x, max(1, min(lists, len(x) // 8)), rng)
        out[size] = (first, c, neighbour_graph(c, p.degree, rng))
        first += len(c)
    return out


def nearest_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 5, params: KnnParams | None = None) -> DataFrame:
    """``(id, neighbour, similarity)``: for every usable vector its ``k`` most similar others.

    Similarity is the cosine in double precision, rounded to 6 decimals; ties go to the smaller id.
    Rows that repeat an id count once; unusable vectors (see :func:`usable_vectors`) neither ask nor
    answer; with fewer than ``k`` others, all of them are returned. Extra columns are ignored. The search is
    approximate across lists and exact within them; with one list it is exact. Each length of vectors is searched
    by itself.
    """
    p = params or KnnParams()
    spark = df.sparkSession
    members = usable_vectors(df, id_col, vec_col)
    first = Window.partitionBy("vec").orderBy("id")
    reps = materialise(
        members.withColumn("_n", F.row_number().over(first)).where(f"_n <= {k + 1}")  # limited before the shuffle
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("vid"), "ids", "vec")
    )
    index = spark.sparkContext.broadcast(_index(reps, p))  # at most sample / 8 centroids a length
    assigned = materialise(reps.mapInArrow(_assign(index, p), ASSIGNED))
    counted = lambda rows: rows.where("posted").groupBy(*KEYS).agg(F.count("*").alias("size"))
    listed = _within_lists(assigned, counted(assigned), p)
    # lists longer than a block are compared block against block: as a query a row meets every block of postings, as a posting every part of queries
    hot = counted(listed).where(F.col("size") > p.block).select(*KEYS, F.ceil(F.col("size") / p.block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    sized = listed.join(hot, KEYS, "left").withColumn("own", F.pmod(F.xxhash64("vid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = sized.select("*", F.explode(F.array_distinct(F.array(F.struct(F.col("own").alias("part"), F.col("other").alias("block")), F.struct(F.col("other").alias("part"), F.col("own").alias("block"))))).alias("cell"))
    cells = cells.select(*KEYS, "cell.part", "cell.block", "vid", "ids", "vec", (F.col("posted") & (F.col("cell.block") == F.col("own"))).alias("posted"), (F.col("asks") & (F.col("cell.part") == F.col("own"))).alias("asks"))
    found = (
        cells.where("posted OR asks")
        .groupBy(*KEYS, "part", "block")
        .applyInArrow(_search(k), "vid bigint, top array<struct<s: int, id: bigint>>")
        .groupBy("vid")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k + 1).alias("top"))
    )
    top = materialise(reps.join(found, "vid").select("vec", "ids", "top"))
    own = top.select(F.explode("ids").alias("id"), "top")
    # groups of equal vectors with more members than were kept
    crowded = top.where(F.size("ids") == k + 1).select("vec", F.col("ids")[k].alias("_last"), "top")
    rest = salted_join(members, crowded, ["vec"]).where("id > _last").select("id", "top")
    pairs = own.unionByName(rest).select("id", F.explode(F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k)).alias("t"))
    return pairs.select("id", F.col("t.id").alias("neighbour"), (-F.col("t.s") / F.lit(float(SCALE))).alias("similarity"))


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, params: KnnParams | None = None) -> DataFrame:
    """``(memory_a, memory_b)``, ``memory_a < memory_b``: one of the two is among the ``k`` nearest of the other."""
    near = nearest_vectors(df, id_col, vec_col, k, params)
    return near.select(F.least("id", "neighbour").alias("memory_a"), F.greatest("id", "neighbour").alias("memory_b")).distinct()
