"""Passages of held-out items inside a corpus (problem 7).

Method: spaced-seed hashing. Fixed masks over a window of words ignore some positions; window hashes
of the items are matched against those of every document, and around each hit the overlap is verified,
once exactly and once tolerating substituted words. The items are a stated query set: they go out in
blocks of bounded size, and the corpus is never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are the longest runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Fixed masks over 13 words; a window of which one inner word was substituted still matches one of them.
MASKS = ("1011011011011", "1101101101101", "1110110110111")
#: Items that go out at once, at most.
ITEM_BLOCK = 20_000

SCHEMA = "doc_id bigint, item_id bigint, doc_from int, item_from int, exact_words int, similar_words int, substituted int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mask_offsets(min_words: int) -> list[np.ndarray]:
    """The masks stretched or cut to windows of ``min_words`` words."""
    masks = [np.resize([c == "1" for c in m], min_words) for m in MASKS]
    for m in masks:
        m[0] = True
    return [np.nonzero(m)[0] for m in masks]


def window_hashes(codes: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """A hash of the unmasked words of each window of ``span`` words, modulo 2^64."""
    n = len(codes) - span + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for o in offsets:
        h = (h ^ codes[o : o + n]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """Window hashes of a block of items, sorted, with item and position."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.span, self.offsets = min_words, _mask_offsets(min_words)
        self.items = [(i, words(t)) for i, t in items if t]
        self.items = [(i, w) for i, w in self.items if len(w) >= min_words]
        #: Words outside the items share code 0, so most windows of a document match nothing.
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.coded = [self.encode(ws) for _, ws in self.items]
        self.tables = []
        for o in self.offsets:
            hashes = [window_hashes(c, o, min_words) for c in self.coded]
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, int)
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], item[order], at[order]))

    def encode(self, ws: list[str]) -> np.ndarray:
        return np.array([self.code.get(w, 0) for w in ws], np.uint64)

    def hits(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every seed hit; the diagonal is position in the document minus position in the item."""
        out = set()
        for offsets, (h, item, at) in zip(self.offsets, self.tables):
            own = window_hashes(codes, offsets, self.span)
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            for p in np.nonzero(hi > lo)[0]:
                out |= {(int(item[k]), int(p - at[k])) for k in range(lo[p], hi[p])}
        return out

    def overlaps(self, codes: np.ndarray, max_substituted: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Per hit diagonal: item, start in document and item, longest exact run, longest similar run, its substitutions."""
        for item, shift in self.hits(codes):
            target = self.coded[item]
            lo, hi = max(0, shift), min(len(codes), len(target) + shift)
            same = codes[lo:hi] == target[lo - shift : hi - shift]
            if not same.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            runs = edges[1::2] - edges[::2]
            wrong = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
            gap = min(max_substituted + 1, len(wrong) - 1)
            reach = wrong[gap:] - wrong[: len(wrong) - gap] - 1
            best = int(np.argmax(reach))
            start = int(wrong[best]) + 1
            yield item, lo + start, lo + start - shift, int(runs.max()), int(reach[best]), int((~same[start : start + reach[best]]).sum())


def _scan(index, max_substituted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                if len(ws) < table.span:
                    continue
                codes = table.encode(ws)
                if np.count_nonzero(codes) >= min(len(o) for o in table.offsets):
                    out += [(doc, table.items[i][0], *rest) for i, *rest in table.overlaps(codes, max_substituted)]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "doc_from", "item_from", "exact_words", "similar_words", "substituted"])

    return run


def item_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", *, min_words: int = 13, max_substituted: int = 2) -> DataFrame:
    """``(doc_id, item_id, doc_from, item_from, exact_words, similar_words, substituted)``: the best overlap of each pair.

    A pair appears if some window of ``min_words`` words matches a passage outside a mask's ignored
    positions. Whole texts are read. Null or short texts and passages match nothing; repeated rows count once;
    empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col)
    passages = items.where(F.col(passage_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("i"), F.col(passage_col).alias("p")).distinct()
    blocks = max(1, -(-passages.count() // ITEM_BLOCK))
    out = None
    for b in range(blocks):
        mine = passages.where(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == b) if blocks > 1 else passages
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in mine.collect()], min_words))
        found = texts.mapInArrow(_scan(index, max_substituted), SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("exact_words", "similar_words", (-F.col("doc_from")).alias("doc_from"), (-F.col("item_from")).alias("item_from"), "substituted")).alias("b")
    rows = out.groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", (-F.col("b.doc_from")).alias("doc_from"), (-F.col("b.item_from")).alias("item_from"), "b.exact_words", "b.similar_words", "b.substituted")


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 13) -> DataFrame:
    """``(doc_id, item_id)``: the document holds at least ``min_words`` consecutive words of the item's passage."""
    return item_overlaps(docs, items, min_words=min_words).where(F.col("exact_words") >= min_words).select("doc_id", "item_id")
