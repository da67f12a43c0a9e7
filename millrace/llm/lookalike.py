"""One consistent form for text that looks the same but differs in its characters (problem 1).

Method: union-find over strings and code points gives transitive look-alike classes; of each class
the member most frequent in the corpus is its representative; a multi-pattern automaton rewrites the
other members, leftmost and longest first, until nothing changes.

Only the encoding of the visible text is levelled. Case, accents, digits, punctuation, line breaks
and letters that merely resemble each other (l, I, 1) stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialise, salted_join

# Letters of other scripts that are drawn like a Latin letter.
LATIN_TWINS = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈͿᎫ", "K": "ΚКKᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν",
    "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮУ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "р", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "Å": "Å",
}
#: Letters of two other scripts that are drawn alike.
OTHER_TWINS = {"Π": "П", "Γ": "Г", "Φ": "Ф", "Λ": "Ʌ", "ε": "ɛ", "Ə": "Ә", "ə": "ә", "µ": "μ"}
#: Hyphens drawn like hyphen-minus.
HYPHENS = "‐‑－﹣"
#: Characters without width beyond those of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Latin ligatures drawn like their letters.
LIGATURES = {"ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "st": "ﬆ"}


#: Decompositions that only name how a character is shaped or set, whatever the script: its look is that of what it stands for.
SHAPED = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


def _plain_look(c: str, tag: str) -> bool:
    """Whether a compatibility character is drawn like its decomposition: forms of shaping, upright mathematical letters, Roman
    numerals and radicals. Bold, slanted, script and enclosed letters look different and stay."""
    name = unicodedata.name(c, "")
    if tag == "<font>":
        return name.startswith(("MATHEMATICAL SANS-SERIF ", "MATHEMATICAL MONOSPACE ")) and not {"BOLD", "ITALIC"} & set(name.split())
    if tag == "<compat>":
        return "ROMAN NUMERAL" in name or name.startswith(("KANGXI RADICAL ", "CJK RADICAL "))
    return tag in SHAPED


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.parent.setdefault(s, s)
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out = defaultdict(list)
        for s in self.parent:
            out[self.find(s)].append(s)
        return {k: sorted(v) for k, v in out.items() if len(v) > 1}


@lru_cache(maxsize=1)
def lookalike_classes() -> list[list[str]]:
    """The classes: from Unicode's decompositions by rule, for all scripts, and from the letters above."""
    u = Classes()
    composed = []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        tag, _, _ = unicodedata.decomposition(c).partition(" ")
        if kind == "Zs":
            u.union(c, " ")
        elif kind == "Cf" and not 0xE0000 <= ord(c) or c in INVISIBLE:
            u.union(c, "")
        elif tag and _plain_look(c, tag):
            u.union(c, unicodedata.normalize("NFKC", c))
        elif tag and tag[0] != "<":
            s = unicodedata.normalize("NFD", c)
            u.union(c, s)
            if len(s) > 1 and unicodedata.combining(s[-1]):
                composed.append((c, s))
    for latin, twins in (LATIN_TWINS | OTHER_TWINS).items():
        for t in twins:
            u.union(t, latin)
    for h in HYPHENS:
        u.union(h, "-")
    for letters, sign in LIGATURES.items():
        u.union(sign, letters)
        if len(letters) == 3:
            u.union(LIGATURES["ff"] + letters[2], sign)
            u.union("f" + LIGATURES["f" + letters[2]], sign)
    # an accent on any member of a letter's class gives a member of the accented letter's class
    same = u.members()
    for c, s in composed:
        for base in same.get(u.find(s[:-1]), []):
            if base:
                u.union(base + s[-1], c)
    return list(u.members().values())


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the class members in a task's texts; the members are a fixed table of some thousand strings."""
    members = {m for c in lookalike_classes() for m in c if m}
    automaton = _automaton({m: m for m in members})
    counts: Counter[str] = Counter()
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        plain = "\n".join(t for t in texts if t.isascii())
        counts.update(plain)
        counts.update({s: plain.count(s) for s in LIGATURES})
        for t in texts:
            if not t.isascii():
                counts.update(m for _, (_, m) in automaton.iter_long(t))
    found = sorted(members & counts.keys())
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([counts[m] for m in found], pa.int64())], names=["unit", "n"])


def unit_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(unit, n)``: how often each class member occurs in all texts, counted whole; at most one row a member."""
    return df.select(text_col).mapInArrow(_count_units, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def _spelt(m: str) -> bool:
    """Whether a composed member is written in several letters, with or without blanks between them."""
    return len(m) > 1 and m[0] != " " and all(unicodedata.category(c)[0] == "L" or c == " " for c in m)


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """For each member its class's representative: the most frequent one, then the shortest, then the first in
    code point order; for what has no width the empty string.

    Members that only differ in composition count together and are represented composed. All ligatures are decided
    together, as they hold each other: letters, unless the corpus has more ligatures than their letters. Other signs that
    stand for several letters, such as Roman numerals, are spelt out, as their letters are members of classes of their own:
    how often each letter occurs decides.
    """
    signs = sum(counts.get(s, 0) for s in LIGATURES.values())
    letters = sum(counts.get(s, 0) for s in LIGATURES)
    out = {}
    for members in lookalike_classes():
        weight: Counter[str] = Counter()
        for m in members:
            weight[unicodedata.normalize("NFC", m)] += counts.get(m, 0)
        own = [s for s, sign in LIGATURES.items() if sign in members]
        if own:
            best = LIGATURES[own[0]] if signs > letters else own[0]
        else:
            marks = [m for m in members if len(m) == 1 and unicodedata.combining(m)]  # a mark that stands alone would never compose
            spelt = [m for m in weight if _spelt(m)]
            best = "" if "" in members else marks[0] if marks else min(spelt or weight, key=lambda m: (-weight[m], len(m), m))
        out |= {m: best for m in members if m != best}
    return out


def _automaton(table: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for m, best in table.items():
        a.add_word(m, (len(m), best))
    a.make_automaton()
    return a


#: Rounds of rewriting a text may need; a round more is an error of the table, not a result.
ROUNDS = 1_000


def rewrite(text: str, automaton: ahocorasick.Automaton) -> str:
    """``text`` with every member replaced, again and again until nothing changes."""
    for _ in range(ROUNDS):
        out, at = [], 0
        text = unicodedata.normalize("NFC", text)
        for end, (n, best) in automaton.iter_long(text):
            out += (text[at : end - n + 1], best)
            at = end + 1
        if not at:
            return text
        new = "".join(out) + text[at:]
        if new == text:
            return text
        text = new
    raise RuntimeError(f"a text of {len(text)} characters still changes after {ROUNDS} rounds of rewriting")


def canonical_udf(table: dict[str, str]):
    """A Pandas UDF that brings a string column to its canonical form; null stays null."""
    ascii_stays = not any(m.isascii() for m in table)
    state: list[ahocorasick.Automaton] = []

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(_automaton(table))
        return texts.map(lambda t: t if t is None or ascii_stays and t.isascii() else rewrite(t, state[0]))

    return canonical


def learn_rewrites(sources: list[tuple[DataFrame, str]]) -> dict[str, str]:
    """Representatives by their frequency in the given columns; what reaches the driver is a count a class member."""
    texts = None
    for df, col in sources:
        one = df.select(F.col(col).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    return rewrites({r["unit"]: r["n"] for r in unit_counts(texts, "text").collect()})


def canonical_text(df: DataFrame, text_col: str, out_col: str = "canonical", table: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``out_col``, the canonical form of ``text_col``.

    Null stays null, the empty text stays empty, texts of any length are rewritten whole; every other column is kept.
    """
    table = learn_rewrites([(df, text_col)]) if table is None else table
    return df.withColumn(out_col, canonical_udf(table)(F.col(text_col)))


def _digests(df: DataFrame, id_col: str, text_col: str, table: dict[str, str]) -> DataFrame:
    """``(id, raw, form)``: digests of each record's text and of its canonical form, once each; null texts and ids are left out."""
    canonical = canonical_udf(table)(F.col(text_col))
    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.md5(text_col).alias("raw"), F.md5(canonical).alias("form")).distinct()


def lookalike_groups(df: DataFrame, id_col: str, text_col: str, table: dict[str, str]) -> DataFrame:
    """``(id, class_id, links)``, a row a record whose text some other record shows in other characters.

    ``class_id`` is the smallest id of the records that look the same, ``links`` how many of them have other characters than
    this one. Linear in the records, however large a class is. A re-delivered record counts once; an id with several
    texts has a row for each class it is in.
    """
    rows = materialise(_digests(df, id_col, text_col, table))
    variants = rows.groupBy("form", "raw").agg(F.count("*").alias("own"), F.min("id").alias("least"))
    forms = variants.groupBy("form").agg(F.sum("own").alias("all"), F.min("least").alias("class_id"), F.count("*").alias("looks")).where("looks > 1")
    sizes = variants.join(forms, "form").select("raw", "form", "class_id", (F.col("all") - F.col("own")).alias("links"))
    return salted_join(rows, sizes, ["raw", "form"]).groupBy("id", "class_id").agg(F.max("links").alias("links"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, table: dict[str, str]) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: records whose texts look the same but are not the same characters.

    A re-delivered record counts once; null texts take no part; identical texts make no pair. Classes
    are found between distinct texts, so a crowd of copies adds only the pairs that it has to; the joins of a crowded
    text or form are salted. For a row a record instead of all pairs see :func:`lookalike_groups`.
    """
    rows = materialise(_digests(df, id_col, text_col, table))  # written once, as it is read four times
    variants = rows.select("form", "raw").distinct()
    several = materialise(variants.join(variants.groupBy("form").count().where("count > 1").select("form"), "form"))
    a, b = several.select("form", F.col("raw").alias("raw_a")), several.select("form", F.col("raw").alias("raw_b"))
    pairs = salted_join(a, b, ["form"]).where("raw_a < raw_b").select("raw_a", "raw_b")
    left = salted_join(rows.select(F.col("raw").alias("raw_a"), F.col("id").alias("x")), pairs, ["raw_a"])
    both = salted_join(rows.select(F.col("raw").alias("raw_b"), F.col("id").alias("y")), left, ["raw_b"]).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
