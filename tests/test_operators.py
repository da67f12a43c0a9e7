import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.entities import identity
from millrace.operators import graph, hybrid, ranking, store
from millrace.operators.components import connected_components
from millrace.operators.hybrid import HybridRanking
from millrace.session import salted_join
from tests.conftest import rows


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a int, b int"), "a", "b")))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert rows(connected_components(spark.createDataFrame([], "a int, b int"), "a", "b")) == []


# ---- retrieval


def test_bm25_worked_example(spark):
    docs = spark.createDataFrame([(1, "cheap flight to cape"), (2, "cheap coat"), (3, "plumber note for geyser leak fix"), (4, None)], "doc_id bigint, text string").where("text IS NOT NULL")
    asked = spark.createDataFrame([(9, ["cheap", "flights"]), (8, [])], "query_id bigint, terms array<string>")
    got = {r["doc_id"]: (round(r["raw"], 6), round(r["keyword"], 6), r["matched"]) for r in HybridRanking(docs, F.lit("2026-01-01").cast("timestamp")).keywords(asked).collect()}
    assert got == {1: (1.450833, 1.0, 2), 2: (0.594941, 0.410069, 1)}


def test_blend(spark):
    score = ranking.blend(ranking.semantic(F.lit(0.6)), F.lit(0.8), F.lit(0.5), F.lit(2.5), F.lit(0.0), 1 / (1 + F.lit(100.0) / 365))
    assert round(spark.range(1).select(score.alias("s")).first()["s"], 6) == 0.813215


_DOCS = "doc_id bigint, text string, captured_at timestamp, vector array<double>, kind string, source string, entities array<struct<type: string, value: string, label: string, key: string>>"
_ASK = "query_id bigint, raw string, terms array<string>, kinds array<string>, sources array<string>, since timestamp, until timestamp, identities array<string>, vectors array<array<double>>"
_NOW = datetime(2026, 1, 1)


def hybrid_tables(spark, n=60, seed=3):
    rng, words = random.Random(seed), "cheap flight coat geyser leak dentist trail parking wifi jacket".split()
    phone = lambda k: ("phone", f"07155501{k:02}", f"071 555 01{k:02}", f"phone:{k}")
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12))) if i % 9 else None, _NOW - timedelta(days=rng.randint(0, 900)) if i % 7 else None, [rng.uniform(-1, 1) for _ in range(3)] if i % 5 else None, rng.choice(["note", "page", None]), rng.choice(["Notes", "Chrome", None]), [phone(rng.randint(0, 5))] if i % 2 else None) for i in range(n)]
    asked = [
        (1, "cheap flight", ["cheap", "flights"], None, None, None, None, None, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]),
        (2, "dentist trail parking wifi jacket", ["dentist", "trail"], ["page"], ["chrome"], None, None, ["phone:715550102"], [[0.0, 0.6, 0.8]]),
        (3, "", [], ["email"], ["Notes"], _NOW - timedelta(days=100), _NOW, None, None), (4, None, None, ["note"], ["Maps"], _NOW + timedelta(days=9), _NOW + timedelta(days=10), ["phone:715550101"], [None]),
    ]
    return docs, asked


def hybrid_by_hand(docs, asked, k, bridged):
    """The ranking document by document."""
    stem = lambda w: w[:-1] if len(w) > 4 and w.endswith("s") else w
    out = {}
    for q, raw, terms, kinds, sources, since, until, identities, vectors in asked:
        left = docs
        for part in (lambda x: not kinds or x[4] in kinds, lambda x: not sources or x[5] is not None and x[5].lower() in [s.lower() for s in sources], lambda x: since is None or x[2] is not None and since <= x[2] < until):
            left = [x for x in left if part(x)] or left
        words = {x[0]: (x[1] or "").split() for x in left}
        wanted = {stem(t) for t in terms or ()}
        mean, raws = sum(map(len, words.values())) / len(words) or 1.0, {}
        for x in left:
            tf = {w: words[x[0]].count(w) for w in wanted}
            raws[x[0]] = sum(math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * n * 2.4 / (n + 1.4 * (0.28 + 0.72 * len(words[x[0]]) / mean)) for w, n in tf.items() if n and (df := sum(w in ws for ws in words.values())))
        best, scores, details = max([0.0001, *raws.values()]), {}, {}
        for i, text, at, v, _, _, ents in left:
            sim = max([sum(a * b for a, b in zip(v, u)) for u in vectors if u] or [-1]) if v and vectors else -1
            hits = sum(2.5 for e in ents or () if "phone:" + e[1][-9:] in (identities or ()))
            days = (_NOW - at).total_seconds() / 86400 if at else math.inf
            cover = len(wanted & set(words[i])) / len(wanted) if wanted else 0
            phrase = len(raw or "") > 12 and raw in (text or "")
            scores[i] = 0.5 * max(0, (sim - 0.05) / 0.75) + 0.26 * raws[i] / best + 0.13 * cover + 0.075 * min(hits, 2) + 0.05 * phrase + 0.03 / (1 + days / 365) + 0.25 * (hits > 0)
            details[i] = [e[1] for e in ents or ()]
        if bridged:
            leader = min(scores, key=lambda i: (-round(scores[i], 6), i))
            for i in scores:
                n = sum(d in details[leader] for d in details[i])
                scores[i] += min(0.15, 0.06 + 0.04 * n) if n and i != leader else 0
        ranked = sorted((-round(s, 6), i) for i, s in scores.items() if round(s, 6) > 0.02)[:k]
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("bridged", [False, True])
def test_hybrid_by_hand(spark, bridged, monkeypatch):
    docs, asked = hybrid_tables(spark)
    want = hybrid_by_hand(docs, asked, 7, bridged)
    for block, piece in ((2_000, 512), (1, 5)):
        monkeypatch.setattr(hybrid, "BLOCK", block)
        rank = HybridRanking(spark.createDataFrame(docs, _DOCS), F.lit(_NOW), identity)
        got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rank.top(spark.createDataFrame(asked, _ASK), 7, bridged).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    empty = HybridRanking(spark.createDataFrame([], _DOCS), F.lit(_NOW), identity)
    assert rows(empty.top(spark.createDataFrame(asked, _ASK))) == [] == rows(rank.top(spark.createDataFrame([], _ASK)))


def test_nearest_of(spark):
    rng = random.Random(1)
    vectors = {i: [round(rng.uniform(-1, 1), 2) for _ in range(3 if i % 4 else 2)] for i in range(50)}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()] + [(None, [1.0], None), (99, None, None), (98, [], None)], "vec_id bigint, embedding array<double>, rank string")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ranking.nearest_of(df, df.where("vec_id % 5 = 0"), 4).collect()}
    for q in range(0, 50, 5):
        near = sorted((-round(sum(a * b for a, b in zip(vectors[q], v)), 6), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        assert [got[q, r] for r in range(1, 5)] == [i for _, i in near[:4]]


def test_soft_filter(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int")
    assert rows(ranking.soft_filter(df, F.col("n") == 1, ["k"])) == [("a", 1), ("b", 3)]
    assert len(rows(ranking.soft_filter(df, F.col("n") == 9, []))) == 3


def test_store(spark):
    h = spark.range(1).select(store.content_hash(F.lit(" A "), F.lit("b")).alias("h")).first()["h"]
    assert h == "9abe6de24a871364bf412a1c301698b5ed30dbb7"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([("c", 2), ("d", 3)], "v string, k int")
    assert rows(store.upsert(old, new, "k")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.only_new(new.select("k"), old, ["k"])) == [(3,)]


def test_edges(spark):
    at = lambda n: datetime(2025, n, 3)
    found = spark.createDataFrame([(1, at(5), "phone", "n", "p"), (2, at(4), "phone", "n", "p"), (3, at(5), "phone", "n", "p"), (3, at(6), "phone", "n", "p"), (4, at(1), "name", "m", "q"), (5, None, "phone", "n", "p")], "memory_id int, captured_at timestamp, type string, label string, identity string")
    assert rows(graph.chain_edges(found).select("from_id", "to_id", "strength")) == [(1, 3, 4), (2, 1, 4), (5, 2, 4)]
    ids = spark.createDataFrame([(1,), (4,)], "id int")
    assert rows(graph.partners(found, ids).select("asked", "other", "label")) == [(1, i, "same phone number n") for i in (2, 3, 5)]
    assert rows(graph.memberships(found).select("memory_id", "strength")) == [(i, 4) for i in (1, 2, 3, 5)]


def test_finish_and_seed(spark):
    docs = spark.createDataFrame([(1, "Geyser", "The geyser leaks, call 071 555 0199. Geyser man", "t"), (2, None, None, None)], "k int, title string, body string, text string")
    done = {r["k"]: r for r in store.finish(docs, "k", ["title", "body"]).collect()}
    assert done[1]["keywords"][:1] == ["geyser"] and "phone:071 555 0199" in done[1]["entity_index"] and done[2]["keywords"] == [] == done[2]["entities"]
    held = spark.createDataFrame([(1, "a")], "k int, body string")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, body string")
    for force, want in ((False, [(1, "skipped"), (2, "created"), (2, "skipped"), (3, "failed")]), (True, [(1, "created"), (2, "created"), (2, "skipped"), (3, "failed")])):
        full, outcome = store.seed(held, items, "k", force)
        assert rows(outcome) == want and rows(full) == [(1, "a"), (2, "b")]


def test_salted_join(spark):
    big, small = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99)], "k int, n int"), spark.createDataFrame([(1, "a"), (3, "b")], "k int, s string")
    assert rows(salted_join(big, small, ["k"])) == [(1, i, "a") for i in range(50)]
