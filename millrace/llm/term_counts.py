"""Occurrences and record counts of every distinct term (problem 3).

Method: last-seen counters. Records are hash-partitioned and read in order of their identifier;
each term keeps occurrences, records and the last record it was seen in, so no set of records is
ever held. Counters of different partitions cover disjoint records, hence they add up; a partial
table leaves a task whenever it holds ``max_terms`` terms, which bounds its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = "term string, occurrences bigint, records bigint"


class LastSeen:
    """Counters of one task. Codes number the terms in the order of their first appearance."""

    def __init__(self, max_terms: int):
        self.max_terms = max_terms
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def _grow(self, n: int) -> None:
        if n > len(self.last):
            more = max(n, 2 * len(self.last)) - len(self.last)
            self.occurrences = np.append(self.occurrences, np.zeros(more, np.int64))
            self.records = np.append(self.records, np.zeros(more, np.int64))
            self.last = np.append(self.last, np.full(more, -1, np.int64))

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """Terms of whole records, in record order; ``record`` numbers the records of the task."""
        encoded = terms.dictionary_encode()
        own = np.array([self.code.setdefault(t, len(self.code)) for t in encoded.dictionary.to_pylist()], np.int64)
        if not len(own):
            return
        self._grow(len(self.code))
        codes = own[encoded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(codes, kind="stable")
        codes, record = codes[order], record[order]
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        before = np.empty(len(codes), np.int64)
        before[1:] = record[:-1]
        before[first] = self.last[codes[first]]
        np.add.at(self.occurrences, codes, 1)
        np.add.at(self.records, codes, (record != before).astype(np.int64))
        self.last[codes] = record  # the later of equal codes stays

    def batch(self) -> pa.RecordBatch:
        n = len(self.code)
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(self.code), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])],
            names=["term", "occurrences", "records"],
        )
        self.clear()
        return out


def _counters(max_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, last_id = LastSeen(max_terms), 0, None
        for batch in batches:
            ids = batch.column(0)
            n = len(ids)
            if not n:
                continue
            before = pa.concat_arrays([pa.array([last_id], ids.type), ids.slice(0, n - 1)])
            again = pc.fill_null(pc.equal(ids, before), False).to_numpy(zero_copy_only=False)  # a re-delivered record
            terms = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(at, at + n), lengths)
            keep = ~np.repeat(again, lengths)
            seen.add(terms.flatten().filter(pa.array(keep)), record[keep])
            at, last_id = at + n, ids[n - 1].as_py()
            if len(seen.code) >= seen.max_terms:
                yield seen.batch()
        yield seen.batch()

    return run


def term_counts(df: DataFrame, id_col: str, terms: Column, *, max_terms: int = 200_000) -> DataFrame:
    """``(term, occurrences, records)`` over all records of ``df``.

    ``terms`` is an expression for the record's array of terms. Rows that repeat a record identifier
    count once (their content is taken to be equal); a null identifier is a record of its own. Null
    terms and null arrays count nothing, an empty table gives no rows. Only the identifier and the
    terms are shuffled, then one partial counter a task and term; records with terms and the same identifier are dropped to one.
    """
    rows = df.select(F.col(id_col).alias("record"), F.filter(terms, lambda t: t.isNotNull()).alias("terms")).where(F.size("terms") > 0)
    # re-deliveries are dropped before the shuffle too, so a record that is delivered very often crowds no task
    once = rows.withColumn("_own", F.when(F.col("record").isNull(), F.monotonically_increasing_id())).dropDuplicates(["record", "_own"])
    records = once.drop("_own").sortWithinPartitions("record")
    return (
        records.mapInArrow(_counters(max_terms), PARTIAL)
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def record_totals(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(field, total)``: the distinct records whose field is not null."""
    flags = df.groupBy(id_col).agg(*[F.max(F.col(f).isNotNull().cast("int")).alias(f) for f in fields])
    sums = flags.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in fields])))


#: Blanks cut from a token's ends: ASCII white space and the Unicode blanks.
BLANKS = "\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def token_terms(col: Column) -> Column:
    """The terms of an array of tokens: without outer blanks, lower-cased, without empty ones."""
    clean = F.transform(col, lambda t: F.lower(F.regexp_replace(t, f"^[{BLANKS}]+|[{BLANKS}]+$", "")))
    return F.filter(clean, lambda t: t != "")


def entity_terms(col: Column) -> Column:
    """The terms of an array of entities: type, colon, lower-cased value; none where either is null."""
    return F.transform(col, lambda e: F.concat(e["type"], F.lit(":"), F.lower(e["value"])))


def mark_terms(df: DataFrame, id_col: str, fields: dict[str, Column], *, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """``(field, term, occurrences, records, mark)`` for every term of the named fields.

    ``fields`` maps each column name to its terms. ``mark`` is rare (at most ``rare_records``
    records), common (more than ``common_share`` of the records whose field is not null), or null.
    """
    totals = record_totals(df, id_col, list(fields))
    counts = None
    for name, terms in fields.items():
        one = term_counts(df, id_col, terms).select(F.lit(name).alias("field"), "term", "occurrences", "records")
        counts = one if counts is None else counts.unionByName(one)
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("total"), "common")
    # one row a field: bounded by the number of fields
    return counts.join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", mark.alias("mark"))
