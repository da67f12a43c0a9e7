"""Ranking of all documents for a stated set of questions, by six signals.

The questions go out in blocks of bounded size, the documents stay where they are: every task scores its documents against
the whole block with matrix products and keeps the best of each question, so that no row a question and document is
ever shuffled. Statistics of BM25 are those of the documents that a question's filters leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import squashed, stems, tokens
from millrace.operators.ranking import B, K1, WEIGHTS, top_k
from millrace.session import materialise

#: Questions that go out at once, at most; documents scored in one go.
BLOCK, SLICE = 2_000, 512
#: Kinds of details by which a question's best document lifts others.
BRIDGING = ("phone", "name", "org", "email", "website", "reference")
SIGNALS = ("semantic", "keyword", "coverage", "entity", "phrase", "recency")


def _at(d: dict, key) -> int:
    return d.setdefault(key, len(d))


@dataclass
class Asked:
    """A block of questions as arrays: which stems, identities and filters each has."""

    ids: list = field(default_factory=list)
    stems: dict[str, int] = field(default_factory=dict)
    identities: dict[str, int] = field(default_factory=dict)
    filters: dict[tuple, int] = field(default_factory=dict)
    filter_of: list[int] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    own: list[tuple[list[int], list[int], int]] = field(default_factory=list)
    vectors: list = field(default_factory=list)

    @classmethod
    def of(cls, rows: list) -> Asked:
        a = cls()
        for r in sorted(rows, key=lambda r: r["query_id"]):
            codes = sorted({_at(a.stems, s) for s in r["stems"] or ()})
            a.own.append((codes, sorted({_at(a.identities, i) for i in r["identities"] or ()}), len({s for s in r["stems"] or () if len(s) > 1})))
            a.filter_of.append(_at(a.filters, (tuple(r["kinds"] or ()), tuple(s.lower() for s in r["sources"] or ()), r["since"], r["until"])))
            a.phrases.append(r["phrase"] if len(r["phrase"] or "") > 12 else "")
            a.vectors += [(len(a.ids), i, v) for i, v in enumerate(r["vectors"] or ()) if v is not None and None not in v]
            a.ids.append(r["query_id"])
        return a

    def wanted(self, place: int, width: int) -> np.ndarray:
        out = np.zeros((width, len(self.ids)))
        for q, own in enumerate(self.own):
            out[own[place], q] = 1
        return out


@dataclass
class Statistics:
    """What the documents as a whole say to a block: per filter which of its parts apply, counts, lengths and document frequencies; per question its best raw score and its leader's details."""

    applies: np.ndarray | None = None
    n: np.ndarray | None = None
    mean: np.ndarray | None = None
    df: np.ndarray | None = None
    best: np.ndarray | None = None
    leaders: dict[int, tuple] = field(default_factory=dict)


def _matrix(codes: pa.Array, width: int, values: np.ndarray | None = None) -> np.ndarray:
    """Rows of codes as a dense matrix of counts."""
    out = np.zeros((len(codes), width))
    np.add.at(out, (np.repeat(np.arange(len(codes)), codes.value_lengths().fill_null(0).to_numpy()), codes.flatten().to_numpy()), 1.0 if values is None else values)
    return out


def _parts(asked: Asked, kinds: list, sources: list, at: list) -> np.ndarray:
    """Documents x filters x (kind, source, period): whether each part of a filter lets a document through; a part that asks for nothing lets all through."""
    out = np.ones((len(kinds), len(asked.filters), 3), bool)
    for (ks, ss, since, until), f in asked.filters.items():
        if ks:
            out[:, f, 0] = [k in ks for k in kinds]
        if ss:
            out[:, f, 1] = [s is not None and s.lower() in ss for s in sources]
        if since is not None:
            out[:, f, 2] = [t is not None and since <= t < until for t in at]
    return out


def _left(parts: np.ndarray, applies: np.ndarray) -> np.ndarray:
    """Documents x filters: what is left by the parts that apply."""
    return (parts | ~applies[None]).all(2)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


class HybridRanking:
    """Documents with ``doc_id`` and ``text``, and, where there are such columns, ``captured_at``, ``vector``, ``kind``, ``source`` and ``entities``.

    ``vector`` is taken to have unit length; documents without one have no similarity. A null text has no words, a null
    ``captured_at`` no recency, null entities share nothing; ``doc_id`` has to be unique and not null.
    """

    def __init__(self, docs: DataFrame, now: Column, identity: Callable[[Column], Column] | None = None):
        has = lambda name, kind: F.col(name) if name in docs.columns else F.lit(None).cast(kind)
        details = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), identity(e).alias("identity"))) if identity and "entities" in docs.columns else F.lit(None).cast("array<struct<type: string, identity: string>>")
        age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(has("captured_at", "timestamp"))) / F.lit(86_400_000_000.0))
        # written once, as several passes read it and stemming costs more than reading
        self.docs = materialise(docs.select(
            "doc_id", stems(tokens(F.col("text"))).alias("stems"), F.trim(squashed(F.coalesce("text", F.lit("")))).alias("flat"), F.when(has("captured_at", "timestamp").isNotNull(), 1 / (1 + age / 365)).otherwise(0.0).alias("recency"),
            has("vector", "array<double>").cast("array<double>").alias("vector"), has("kind", "string").alias("kind"), has("source", "string").alias("source"), F.unix_micros(has("captured_at", "timestamp")).alias("at"), details.alias("details"),
        ))
        self.spark = docs.sparkSession

    def _blocks(self, questions: DataFrame) -> Iterator[tuple[Asked, DataFrame]]:
        """The questions in blocks, with the documents encoded for each: only what a block asks for is kept."""
        none = {"kinds": "array<string>", "sources": "array<string>", "since": "timestamp", "until": "timestamp", "identities": "array<string>", "vectors": "array<array<double>>", "raw": "string"}
        for name, kind in none.items():
            if name not in questions.columns:
                questions = questions.withColumn(name, F.lit(None).cast(kind))
        ready = questions.select("query_id", F.array_distinct(stems(F.col("terms"))).alias("stems"), F.trim(squashed("raw")).alias("phrase"), "kinds", "sources", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "identities", "vectors")
        count = ready.count()
        blocks = max(1, -(-count // BLOCK))
        for b in range(blocks):
            asked = Asked.of(ready.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect())  # a stated set of questions
            codes = self.spark.sparkContext.broadcast((asked.stems, asked.identities))
            schema = "doc_id bigint, codes array<int>, length int, bridge array<int>, hits array<int>, phones array<int>, flat string, recency double, vector array<double>, kind string, source string, at bigint, identities array<string>"
            yield asked, materialise(self.docs.mapInArrow(_encode(codes), schema))

    def _statistics(self, asked: Asked, docs: DataFrame) -> Statistics:
        """Three small passes: which filters leave anything, document frequencies, and each question's best raw score."""
        s, sc = Statistics(), self.spark.sparkContext
        f = len(asked.filters)
        everything = sc.broadcast((asked, s))
        seen = docs.mapInArrow(_count_parts(everything), "f int, mask int, n bigint").groupBy("f", "mask").agg(F.sum("n").alias("n")).collect()  # eight rows a filter
        n = np.zeros((f, 8), int)
        for r in seen:
            n[r["f"], r["mask"]] = r["n"]
        applies = np.zeros((f, 3), bool)
        for i in range(f):
            mask = 0
            for part in range(3):  # a part that would leave nothing is given up
                if n[i, mask | 1 << part]:
                    applies[i, part] = True
                    mask |= 1 << part
        s.applies = applies
        rows = docs.mapInArrow(_count_words(sc.broadcast((asked, s))), "f int, code int, n bigint").groupBy("f", "code").agg(F.sum("n").alias("n")).collect()  # a row a filter and stem that is asked for
        s.df, s.n, s.mean = np.zeros((f, len(asked.stems))), np.zeros(f), np.ones(f)
        length = np.zeros(f)
        for r in rows:
            if r["code"] == -1:
                s.n[r["f"]] = r["n"]
            elif r["code"] == -2:
                length[r["f"]] = r["n"]
            else:
                s.df[r["f"], r["code"]] = r["n"]
        s.mean = np.where(length > 0, length / np.maximum(s.n, 1), 1.0)
        best = docs.mapInArrow(_best_raw(sc.broadcast((asked, s))), "q int, raw double").groupBy("q").agg(F.max("raw").alias("raw")).collect()  # a row a question
        s.best = np.full(len(asked.ids), 0.0001)
        for r in best:
            s.best[r["q"]] = max(0.0001, r["raw"])
        return s

    def keywords(self, questions: DataFrame, k: int | None = None, least: float = 0.0) -> DataFrame:
        """``(query_id, doc_id, raw, keyword, matched)`` of the documents that share a stem with a question, ``keyword`` rounded to six decimals.

        With ``k`` the best of each question with their rank; ``least`` is the smallest ``keyword`` kept.
        """
        out = None
        for asked, docs in self._blocks(questions):
            model = self.spark.sparkContext.broadcast((asked, self._statistics(asked, docs)))
            rows = docs.mapInArrow(_keyword_rows(model, k, least), "query_id bigint, doc_id bigint, raw double, keyword double, matched bigint")
            out = rows if out is None else out.unionByName(rows)
        return top_k(out, k, ["query_id"], [F.desc("keyword"), F.asc("doc_id")]) if k else out

    def top(self, questions: DataFrame, k: int = 12, bridged: bool = False) -> DataFrame:
        """``(query_id, rank, doc_id, score, variant, bridge, semantic, keyword, coverage, entity, phrase, recency)``: the ``k`` best documents of each question.

        Scores of 0.02 and less are left out, ties go to the smaller id. With ``bridged`` every document that shares a detail
        with a question's best one gains before the best are taken; the best one itself gains nothing.
        """
        out = None
        fields = "query_id bigint, doc_id bigint, score double, variant int, bridge double, " + ", ".join(f"{s} double" for s in SIGNALS)
        order = [F.desc("score"), F.asc("doc_id")]
        for asked, docs in self._blocks(questions):
            s = self._statistics(asked, docs)
            if bridged:
                first = top_k(docs.mapInArrow(_rank(self.spark.sparkContext.broadcast((asked, s)), 1, -1.0), fields), 1, ["query_id"], order).select("query_id", "doc_id")
                s.leaders = {r["query_id"]: (r["doc_id"], frozenset(r["identities"] or ())) for r in docs.select("doc_id", "identities").join(F.broadcast(first), "doc_id").collect()}  # a row a question
            rows = docs.mapInArrow(_rank(self.spark.sparkContext.broadcast((asked, s)), k, 0.02), fields)
            out = rows if out is None else out.unionByName(rows)
        return top_k(out, k, ["query_id"], order)


def _encode(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem_of, identity_of = codes.value
        for batch in _slices(batches):
            words = [[stem_of[w] for w in ws if w in stem_of] for ws in _column(batch, "stems")]
            details = [x or [] for x in _column(batch, "details")]
            known = [[(identity_of[x["identity"]], x["type"]) for x in d if x["identity"] in identity_of] for d in details]
            lists = [words, [[c for c, t in d if t in BRIDGING] for d in known], [[c for c, _ in d] for d in known], [[c for c, t in d if t == "phone"] for d in known]]
            codes_, bridge, hits, phones = (pa.array(x, pa.list_(pa.int32())) for x in lists)
            bridging = pa.array([[x["identity"] for x in d if x["type"] in BRIDGING and x["identity"]] for d in details], pa.list_(pa.string()))
            keep = {n: batch.column(n) for n in ("flat", "recency", "vector", "kind", "source", "at")}
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64()), "codes": codes_, "length": pa.array([len(w) for w in _column(batch, "stems")], pa.int32()), "bridge": bridge, "hits": hits, "phones": phones, **keep, "identities": bridging}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _counted(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "n" else pa.int32()) for c, n in zip(columns, names)], names=names)


def _count_parts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, _ = model.value
        n = np.zeros((len(asked.filters), 8), int)
        for batch in _slices(batches):
            parts = _parts(asked, _column(batch, "kind"), _column(batch, "source"), _column(batch, "at"))
            for mask in range(8):
                n[:, mask] += (parts | ~np.array([mask >> p & 1 for p in range(3)], bool)).all(2).sum(0)
        yield _counted([(f, m, int(n[f, m])) for f in range(len(n)) for m in range(8)], ["f", "mask", "n"])

    return run


def _count_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, s = model.value
        df, n, length = np.zeros((len(asked.filters), len(asked.stems))), np.zeros(len(asked.filters)), np.zeros(len(asked.filters))
        for batch in _slices(batches):
            left = _left(_parts(asked, _column(batch, "kind"), _column(batch, "source"), _column(batch, "at")), s.applies).astype(float)
            df += left.T @ (_matrix(batch.column("codes"), len(asked.stems)) > 0)
            n += left.sum(0)
            length += left.T @ batch.column("length").to_numpy()
        rows = [(f, c, int(df[f, c])) for f, c in zip(*np.nonzero(df))] + [(f, -1, int(n[f])) for f in range(len(n))] + [(f, -2, int(length[f])) for f in range(len(n))]
        yield _counted(rows, ["f", "code", "n"])

    return run


def _raw(batch: pa.RecordBatch, asked: Asked, s: Statistics) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents x questions: BM25, the number of a question's stems that a document has, and whether the question's filters leave the document."""
    tf = _matrix(batch.column("codes"), len(asked.stems))
    wanted, length = asked.wanted(0, len(asked.stems)), batch.column("length").to_numpy()[:, None]
    left = _left(_parts(asked, _column(batch, "kind"), _column(batch, "source"), _column(batch, "at")), s.applies)
    filter_of, raw = np.array(asked.filter_of, int), np.zeros((len(batch), len(asked.ids)))
    for f in range(len(asked.filters)):
        mine = np.flatnonzero(filter_of == f)
        idf = np.log(1 + (s.n[f] - s.df[f] + 0.5) / (s.df[f] + 0.5))
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / s.mean[f]))
        raw[:, mine] = gain @ (idf[:, None] * wanted[:, mine])
    mask = left[:, filter_of]
    return np.where(mask, raw, 0.0), (tf > 0) @ wanted, mask


def _best_raw(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, s = model.value
        best = np.zeros(len(asked.ids))
        for batch in _slices(batches):
            best = np.maximum(best, _raw(batch, asked, s)[0].max(0, initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(best)), pa.int32()), pa.array(best)], names=["q", "raw"])

    return run


def _best_of(score: np.ndarray, k: int | None, least: float, mask: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and questions of the scores above ``least``, of each question the best ``k`` only; ties go to the smaller id."""
    keep = mask & (score > least)
    if k is not None and len(score) > k:
        order = np.lexsort((np.broadcast_to(ids[:, None], score.shape), -np.where(keep, score, -np.inf)), axis=0)[:k]
        top = np.zeros_like(keep)
        np.put_along_axis(top, order, True, 0)
        keep &= top
    return np.nonzero(keep)


def _keyword_rows(model, k: int | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, s = model.value
        queries = np.array(asked.ids, np.int64)
        for batch in _slices(batches):
            raw, matched, mask = _raw(batch, asked, s)
            keyword, ids = np.round(raw / s.best, 6), batch.column("doc_id").to_numpy()
            i, j = _best_of(np.where(keyword >= least, keyword, -1.0), k, -0.5, mask & (matched > 0), ids)
            yield pa.RecordBatch.from_arrays([pa.array(queries[j]), pa.array(ids[i]), pa.array(raw[i, j]), pa.array(keyword[i, j]), pa.array(matched[i, j].astype(np.int64))], names=["query_id", "doc_id", "raw", "keyword", "matched"])

    return run


def _similarity(batch: pa.RecordBatch, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Documents x questions: the best dot product over a question's vectors and which of them it is; the first wins ties. Vectors of another length count as none."""
    best, variant = np.full((len(batch), len(asked.ids)), -1.0), np.zeros((len(batch), len(asked.ids)), np.int32)
    for size in sorted({len(v) for _, _, v in asked.vectors}):
        vectors = _column(batch, "vector")
        rows = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v], int)
        if len(rows):
            mine = np.array([vectors[i] for i in rows])
            for q, n, v in asked.vectors:
                if len(v) == size:
                    sim = mine @ np.array(v)
                    better = sim > best[rows, q]
                    best[rows[better], q], variant[rows[better], q] = sim[better], n
    return best, variant


def _rank(model, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, s = model.value
        queries, n_ident = np.array(asked.ids, np.int64), len(asked.identities)
        identities, many = asked.wanted(1, n_ident), np.array([n for _, _, n in asked.own])
        covering = np.zeros((len(asked.stems), len(asked.ids)))
        for w, c in asked.stems.items():
            covering[c] = len(w) > 1
        covering *= asked.wanted(0, len(asked.stems))
        lead = [s.leaders.get(q, (None, frozenset())) for q in asked.ids]
        for batch in _slices(batches):
            ids = batch.column("doc_id").to_numpy()
            raw, _, mask = _raw(batch, asked, s)
            sim, variant = _similarity(batch, asked)
            has = _matrix(batch.column("codes"), len(asked.stems)) > 0
            coverage = (has @ covering) / np.maximum(many, 1)
            phones = _matrix(batch.column("phones"), n_ident) @ identities
            entity = np.minimum(_matrix(batch.column("hits"), n_ident) @ identities + 1.5 * phones, 3.0)
            phrase = np.zeros_like(raw)
            # a text that holds the whole question holds all its words
            flat = _column(batch, "flat")
            for i, q in zip(*np.nonzero((coverage >= 0.999) | (many == 0))):
                phrase[i, q] = bool(asked.phrases[q]) and asked.phrases[q] in flat[i]
            signals = {"semantic": np.maximum(0.0, (sim - 0.05) / 0.75), "keyword": raw / s.best, "coverage": coverage, "entity": entity, "phrase": phrase, "recency": np.broadcast_to(batch.column("recency").to_numpy()[:, None], raw.shape)}
            score = sum(WEIGHTS[name] * (np.minimum(x, 2.0) if name == "entity" else x) for name, x in signals.items()) + 0.25 * (phones > 0)
            bridge = np.zeros_like(raw)
            if s.leaders:
                details = _column(batch, "identities")
                for q, (leader, shared) in enumerate(lead):
                    if shared:
                        n = np.array([sum(x in shared for x in d) for d in details])
                        bridge[:, q] = np.where((n > 0) & (ids != leader), np.minimum(0.15, 0.06 + 0.04 * n), 0.0)
            score = np.round(score + bridge, 6)
            i, j = _best_of(score, k, least, mask, ids)
            columns = {"query_id": queries[j], "doc_id": ids[i], "score": score[i, j], "variant": variant[i, j], "bridge": bridge[i, j]} | {name: x[i, j] for name, x in signals.items()}
            yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})

    return run
