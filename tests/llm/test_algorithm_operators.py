import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import names as N
from millrace.llm.name_variants import variant_links
from millrace.llm.term_counts import entity_terms, mark_terms, term_counts, token_terms
from millrace.llm.vector_knn import KnnParams, nearest_vectors, similar_pairs
from tests.conftest import rows

# ---- problem 2


def brute(vectors: dict[int, list[float]], k: int) -> set[tuple[int, int]]:
    out = set()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    for i, v in unit.items():
        best = sorted((-round(float(v @ w), 6), j) for j, w in unit.items() if j != i)[:k]
        out |= {(i, j) for _, j in best}
    return out


def vector_table(spark, data):
    return spark.createDataFrame(data, "memory_id bigint, v array<double>, vec string, list int, vid string")


def test_nearest_vectors_small(spark):
    rng = random.Random(1)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(40)}
    for i in range(40, 60):  # a crowd of equal vectors, and ties
        vectors[i] = [1.0, 2.0, 0.0, 0.0]
    data = [(i, v, None, 1, "x") for i, v in vectors.items()] + [(3, vectors[3], "again", 2, None)]
    data += [(100, None, "", 1, ""), (101, [0.0] * 4, "", 1, ""), (102, [], "", 1, ""), (103, [1.0, None, 0.0, 0.0], "", 1, ""), (None, [1.0] * 4, "", 1, ""), (104, [math.nan] * 4, "", 1, "")]
    got = {(r["id"], r["neighbour"]) for r in nearest_vectors(vector_table(spark, data), "memory_id", "v", 5).collect()}
    assert got == brute(vectors, 5)


def test_nearest_vectors_in_many_lists_and_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    vectors = {i: (centres[i % 12] + 0.4 * rng.normal(size=8)).round(3).tolist() for i in range(1500)}
    df = vector_table(spark, [(i, v, None, None, None) for i, v in vectors.items()])
    got = {(r["id"], r["neighbour"]) for r in nearest_vectors(df, "memory_id", "v", 5, KnnParams(list_size=60, block=40)).collect()}
    want = brute(vectors, 5)
    assert len(got & want) / len(want) >= 0.9
    assert len(got) == len(want)


def test_nearest_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    by_length = {n: {1000 * n + i: rng.normal(size=n).round(3).tolist() for i in range(m)} for n, m in ((3, 500), (4, 30), (7, 1))}
    df = vector_table(spark, [(i, v, None, None, None) for vs in by_length.values() for i, v in vs.items()])
    got = {(r["id"], r["neighbour"]) for r in nearest_vectors(df, "memory_id", "v", 5, KnnParams(list_size=100)).collect()}
    want = set().union(*(brute(vs, 5) for vs in by_length.values()))
    assert len(got & want) / len(want) > 0.98 and len(got) == len(want)


def test_nearest_vectors_in_lists_within_lists(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 6))
    vectors = {i: (centres[0 if i % 3 == 0 else i % 6] + 0.4 * rng.normal(size=6)).round(3).tolist() for i in range(3000)}
    df = vector_table(spark, [(i, v, None, None, None) for i, v in vectors.items()])
    params = KnnParams(sample=64, list_size=40, split=4, inner_sample=300, block=50)
    got = {(r["id"], r["neighbour"]) for r in nearest_vectors(df, "memory_id", "v", 5, params).collect()}
    want = brute(vectors, 5)
    assert len(got & want) / len(want) >= 0.9 and len(got) == len(want)


def test_nearest_vectors_empty_and_few(spark):
    assert rows(similar_pairs(vector_table(spark, []), "memory_id", "v")) == []
    assert rows(similar_pairs(vector_table(spark, [(1, [1.0], "", 1, "")]), "memory_id", "v")) == []
    assert rows(similar_pairs(vector_table(spark, [(1, [1.0], "", 1, ""), (2, [2.0], "", 1, "")]), "memory_id", "v")) == [(1, 2)]


# ---- problem 3

_T = "memory_id bigint, tokens array<string>, entities array<struct<type: string, value: string>>, term string, records int"


def test_term_marks(spark):
    data = [(i, ["the", " The ", f"t{i}", None, "", "  "], [("name", "Ann")] if i % 2 else None, "x", 1) for i in range(30)]
    data += [data[0], (None, ["lost"], None, None, None), (50, None, [], None, None), (51, [], [("org", None)], None, None), (52, ["z" * 100_000], None, None, None)]
    df = spark.createDataFrame(data, _T)
    out = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in mark_terms(df, "memory_id", {"tokens": token_terms(F.col("tokens")), "entities": entity_terms(F.col("entities"))}).collect()}
    assert out["tokens", "the"] == (60, 30, "common")
    assert out["tokens", "t0"] == (1, 1, "rare")
    assert out["tokens", "z" * 100_000] == (1, 1, "rare")
    assert out["entities", "name:ann"] == (15, 15, "common")
    assert not any(t in ("", None) for _, t in out)


def test_term_counts_flush_and_empty(spark):
    data = [(i, [f"w{i % 50}", f"w{(i * 7) % 50}", "all"], None, None, None) for i in range(300)]
    df = spark.createDataFrame(data, _T)
    want = {}
    for i, ws, *_ in data:
        for w in set(ws):
            o, r = want.get(w, (0, 0))
            want[w] = (o + ws.count(w), r + 1)
    for most in (5, 10_000):
        assert {r[0]: (r[1], r[2]) for r in term_counts(df, "memory_id", token_terms(F.col("tokens")), max_terms=most).collect()} == want
    assert rows(term_counts(spark.createDataFrame([], _T), "memory_id", token_terms(F.col("tokens")))) == []


# ---- problem 4


def test_same_name():
    f = lambda kind, s: N.form(kind, N.plain_tokens(s))
    same = [("name", "Rebecca Dutalozile", "Bex Dutalozile"), ("name", "Dutalozile, Rebecca", "REBECCA DUTALOZILE"), ("name", "R. Dutalozile", "Rebecca J. Dutalozile"), ("name", "Rebecca Dutalozlie", "Rebecca Dutalozile"), ("name", "Rébéccá Dutalozile", "Rebecca  Dutalozile"), ("org", "Bobuvondlo Bakery", "Bobuvondlo Bake."), ("org", "The Bobuvondlo Bakery Co", "Bakery Bobuvondlo"), ("org", "Bobuvondlo & Sons Hardware", "Bobuvondlo-Hdw"), ("org", "Bobuvondlo Baekry", "Bobuvondlo Bakery (Pty) Ltd")]
    other = [("name", "Rebecca Dutalozile", "Samantha Dutalozile"), ("name", "Gabriella Vorneveld", "Daniella Vorneveld"), ("name", "T. Dutalozile", "Rebecca Dutalozile"), ("org", "Bobuvondlo Bakery", "Bobuvondlo Plumbing"), ("org", "Bobuvondlo Bakery", "Klavendrist Bakery")]
    assert [p for p in same if not N.same_name(f(p[0], p[1]), f(p[0], p[2]))] == []
    assert [p for p in other if N.same_name(f(p[0], p[1]), f(p[0], p[2]))] == []
    assert f("name", "Rebecca") is None and f("name", "") is None
    # names that no table holds: short words, several words, two slips in a long word, short forms by rule
    same = [("name", "Lee, Ann", "ANN LEE"), ("name", "A. Lee", "Ann Lee"), ("name", "Maria van der Merwe Louw Botha", "Botha, Maria van der Merwe Louw"), ("name", "Esmeraldine Dutalozile", "Esme Dutalozile"), ("name", "Marcellina Dutalozile", "Marcie Dutalozile"), ("name", "Florentina Dutalozile", "Tina Dutalozile"), ("name", "Oyinkansola Dutaloizle", "Oyinkansola Dutlaozile")]
    other = [("name", "Ann Lee", "Ann Lea"), ("name", "Esmeraldine Dutalozile", "Florentina Dutalozile"), ("name", "Tom Lee", "Ann Lee"), ("name", "Daniel Dutalozile", "Daniella Dutalozile")]
    assert [p for p in same if not N.same_name(f(p[0], p[1]), f(p[0], p[2]))] == []
    assert [p for p in other if N.same_name(f(p[0], p[1]), f(p[0], p[2]))] == []


def test_jaro_winkler_and_edits():
    assert round(N.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(N.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert N.jaro_winkler("abc", "xyz") == 0.0
    assert all(N.one_edit("abcd", x) for x in ("abcd", "abd", "abxd", "abcde", "acbd", "bcd")) and not N.one_edit("abcd", "adcb")


_M = "memory_id bigint, entities array<struct<type: string, label: string>>, cluster string"
_N = "note_id bigint, title string, form string"


def test_variant_links(spark):
    labels = ["Rebecca Dutalozile", "R. Dutalozile", "Bex Dutalozile", "Samantha Dutalozile", "Rebecca Dutalozlie", "B. Klandrivel", "Benjamin Klandrivel", "Bartholomew Klandrivel"]
    memories = spark.createDataFrame([(i, [("name", x), ("org", None), ("money", "R5")], "c") for i, x in enumerate(labels)] + [(90, None, "c"), (91, [], None), (0, [("name", labels[0])], "c")], _M)
    notes = spark.createDataFrame([(1, "Chat with Dutalozile, Rebecca", "f"), (1, "Chat with Dutalozile, Rebecca", "f"), (2, None, "f"), (3, "", None), (4, "Plan for tomorrow", "f"), (5, "x " * 5000, "f"), (6, "Chat with B. Klandrivel", "f")], _N)
    got = {tuple(r) for r in variant_links(memories, notes).collect()}
    person = sorted(f"label:{x}" for x in labels[:3] + labels[4:5])
    want = {(a, b) for a in person for b in person if a < b} | {(a, "note:1") for a in person}
    assert got == want  # an initial that two people answer to links nothing


def test_variant_links_of_a_surname_of_many(spark):
    sounds = "bdklmr"  # one of each class; any two of these given names differ in two
    others = [f"{sounds[i]}o{sounds[j]}e{sounds[k]}a{sounds[(i + j + k) % 6]}i Dutalozile" for i in range(5) for j in range(6) for k in range(3)]
    person = ["Rebecca Dutalozile", "Bex Dutalozile", "R. Dutalozile"]
    firms = ["Dutalozile Plumbing", "Dutalozile Plmb"]
    data = [(i, [("name", x)], "c") for i, x in enumerate(others + person)] + [(900 + i, [("org", x)], "c") for i, x in enumerate(firms)]
    notes = spark.createDataFrame([(1, "Chat with Becky Dutalozile", "f"), (2, "Chat with R. Dutalozile", "f")], _N)
    got = {tuple(r) for r in variant_links(spark.createDataFrame(data, _M), notes).collect()}
    keys = sorted(f"label:{x}" for x in person)
    assert got == {(a, b) for a in keys for b in keys if a < b} | {(a, f"note:{n}") for a in keys for n in (1, 2)} | {tuple(sorted(f"label:{x}" for x in firms))}


def test_variant_links_of_generated_names(spark):
    """Recall and precision on names and given names that no table holds."""
    rng, keys, truth = random.Random(7), [], {}
    syllables = "ba ko li mu ne ra shi to va zu gre dal fon".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()
    for person in range(60):
        given, surname = word(4), word(4)
        at = rng.randrange(1, len(surname) - 1)
        typed = surname[:at] + surname[at + 1] + surname[at] + surname[at + 2 :]
        for label in {f"{given} {surname}", f"{surname}, {given}", f"{given.upper()} {surname.upper()}", f"{given} {typed}", f"{given[:1]}. {surname}", f"{given[:4]} {surname}", f"{given} Q. {surname}"}:
            keys.append(label)
            truth[f"label:{label}"] = person
    notes = [(i, f"Lunch with {surname}", "f") for i, surname in enumerate(keys[::5])]
    got = {tuple(r) for r in variant_links(spark.createDataFrame([(i, [("name", x)], "c") for i, x in enumerate(keys)], _M), spark.createDataFrame(notes, _N)).collect()}
    truth |= {f"note:{i}": truth[f"label:{keys[5 * i]}"] for i, _, _ in notes}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and a.startswith("label:")}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_variant_links_broadcast_nothing(spark):
    """What a join's side is unfolded to grows with the input, so it must not be built in the driver's memory, however small its files are."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    memories = spark.createDataFrame([(i, [("name", x)], "c") for i, x in enumerate(["Rebecca Dutalozile", "Bex Dutalozile", "R. Dutalozile", "B. Klandrivel"])], _M)
    assert len(variant_links(memories, spark.createDataFrame([(1, "Chat with Becky Dutalozile", "f")], _N)).collect()) == 6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    plans = [r.physicalPlanDescription() for r in map(runs.apply, range(runs.size())) if r.executionId() not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_variant_links_empty(spark):
    assert rows(variant_links(spark.createDataFrame([], _M), spark.createDataFrame([], _N))) == []
