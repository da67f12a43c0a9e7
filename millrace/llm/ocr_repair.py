"""Repair of text from scanned pages (problem 5).

Method: a hidden Markov model over the lines of each record, with layout features of the text and of the
recogniser's boxes as emissions, labels every line header, page_number, body or break (the last line of a paragraph).
It is fitted on a bounded sample by Viterbi training, starting from rules of high precision. Words are checked
against the whole corpus: a word is misread if undoing typical confusions gives a word that is far more frequent; words
that confusions may have made of each other share a key of strokes, by which they are joined.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.names import jaro_winkler
from millrace.session import materialise

#: Records the line model is fitted on, at most.
SAMPLE = 1_500
#: A word is known if texts that no scanner read have it twice, and once in so many of them.
KNOWN_IN = 5_000
STATES = ("header", "page_number", "body", "break")

# What a scanner reads (left) for what is printed (right).
CONFUSIONS = {
    "0": "o", "1": "l i", "|": "l i", "!": "i l", "@": "a", "+": "t", "5": "s", "9": "g", "6": "b", "8": "b", "(": "c", "$": "s", "3": "e", "é": "e",
    "cl": "d", "rn": "m", "ri": "n", "li": "h", "ii": "u", "vv": "w", "m": "rn in", "c": "e", "v": "y", "l": "i", "d": "cl",
}
#: Signs read for the letters of such a pair in turn.
SIGNS = {"i": "1!|", "l": "1!|", "c": "("}


def _readings() -> dict[str, tuple[str, ...]]:
    """The confusions, with pairs of letters of which one or both were read as a sign; a sign for c may also stand for e read as c."""
    out: dict[str, set[str]] = defaultdict(set)
    for seen, true in CONFUSIONS.items():
        out[seen] |= set(true.split())
        if len(seen) == 2:
            for a in seen[0] + SIGNS.get(seen[0], ""):
                for b in seen[1] + SIGNS.get(seen[1], ""):
                    out[a + b] |= set(true.split())
    out["("].add("e")
    return {k: tuple(sorted(v)) for k, v in out.items()}


READINGS = _readings()
#: Marks that break a word at a line's end.
BREAKS = "-‐‑¬­"

NUMBER = r"(?:[0-9lIoO|!]{1,4}|[ivxlc]{1,7})"
PAGE_MARKED = re.compile(rf"(?i)^(?:p[a@]ge?\s+{NUMBER}(?:\s*(?:of|/)\s*{NUMBER})?|[-–—]\s*{NUMBER}\s*[-–—]|[\[(]\s*{NUMBER}\s*[\])])$")
PAGE_BARE = re.compile(rf"^{NUMBER}$")
EDGE_NUMBER = re.compile(r"^\s*[0-9lIoO]{1,4}\s{2,}|\s{2,}[0-9lIoO]{1,4}\s*$")


def flat(line: str) -> str:
    """A line for comparison with other running lines: lower case, without a page number at its edge, confusable characters levelled."""
    s = EDGE_NUMBER.sub("", line).strip().lower()
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ri", "n")):
        s = s.replace(a, b)
    return " ".join(s.translate(str.maketrans("01|!il@+5968($3écve", "oiiiiiatsgbbcsceeye"[:19])).split()).replace("c", "e")


def lines_of(body: str) -> list[tuple[str, bool]]:
    """Non-empty lines, and whether an empty line stands before."""
    out, gap = [], False
    for line in body.split("\n"):
        if line.strip():
            out.append((line, gap))
            gap = False
        else:
            gap = True
    return out


Box = tuple[list[int] | None, int | None]


def _of_boxes(boxes: list[Box] | None, n: int) -> list[tuple]:
    """Features of each line's box: indent, height and distance to the line above against what is usual, and the recogniser's confidence.

    What isn't known, because the record has no boxes or not one a line, is a value of its own.
    """
    boxes = boxes if boxes and len(boxes) == n else [(None, None)] * n
    known = [b for b, _ in boxes if b and len(b) == 4 and None not in b]
    middle = lambda values, default: sorted(values)[len(values) // 2] if values else default
    left, height = middle([b[0] for b in known], 0), max(1, middle([b[3] - b[1] for b in known], 1))
    tops = [b[1] if b and len(b) == 4 else None for b, _ in boxes]
    steps = [y - x if x is not None and y is not None else None for x, y in zip(tops, tops[1:])]
    step = max(1, middle([d for d in steps if d is not None], 1))
    level = lambda x, low, high: "?" if x is None else "low" if x < low else "high" if x > high else "usual"
    out = []
    for i, (b, c) in enumerate(boxes):
        whole = b and len(b) == 4 and None not in b
        out.append((
            ("bi", level(b[0] - left if whole else None, -height / 2, height / 2)), ("bh", level((b[3] - b[1]) / height if whole else None, 0.8, 1.25)),
            # the first line has none above it, which its place already tells
            ("bg", "usual" if i == 0 else level(steps[i - 1] / step if steps[i - 1] is not None else None, 0.7, 1.4)), ("bc", level(c, 70, 90)),
        ))
    return out


def layout(body: str, title: str | None, repeated: set[str], boxes: list[Box] | None = None) -> list[tuple]:
    """The discrete features of every line: page-number form, likeness to a running line, place, length, end, start, gaps around it and figures in it, and those of its box."""
    lines = lines_of(body)
    head = flat(re.sub(r"\s+\d+$", "", title)) if title else ""
    flats = [flat(t) for t, _ in lines]
    often = Counter(flats)
    usual = sorted(len(t.rstrip()) for t, _ in lines)[len(lines) // 2] if lines else 1
    boxed = _of_boxes(boxes, len(lines))
    out = []
    for i, (text, gap) in enumerate(lines):
        s = text.strip()
        number = 2 if PAGE_MARKED.match(s) else 1 if PAGE_BARE.match(s) else 0
        titled = bool(head) and not number and (flats[i] == head or abs(len(flats[i]) - len(head)) <= 2 and jaro_winkler(flats[i], head) >= 0.93)
        figures = sum(c.isdigit() for c in s) >= 4
        short = len(s) <= 0.6 * usual and not figures  # a sentence or a row of a table may come again by chance
        again = not number and len(flats[i]) > 3 and short and (flats[i] in repeated or often[flats[i]] > 1)
        running = (2 if EDGE_NUMBER.search(text) else 1) if titled or again else 0
        place = "first" if i == 0 else "last" if i == len(lines) - 1 else "second" if i == 1 else "inner"
        size = min(2, int(3 * len(s) / max(1, usual)))
        end = "mark" if text.rstrip()[-1] in BREAKS else "stop" if s[-1] in ".!?:" else "open"
        start = "lower" if s[0].islower() else "upper" if s[0].isupper() else "other"
        after = lines[i + 1][1] if i + 1 < len(lines) else True
        out.append((("n", number), ("r", running), ("p", place), ("l", size), ("e", end), ("s", start), ("g", gap), ("a", after), ("d", figures), *boxed[i]))
    return out


def seed_labels(features: list[tuple]) -> list[int]:
    """Labels by rules, to start the training from."""
    out = []
    for f in features:
        v = dict(f)
        if v["n"] == 2 or v["n"] == 1 and v["l"] == 0:
            out.append(1)
        elif v["r"] and (v["l"] < 2 or v["s"] != "lower") and v["e"] == "open":
            out.append(0)
        else:
            out.append(3 if v["a"] or v["e"] == "stop" and v["l"] < 2 else 2)
    return out


class LineModel:
    """A hidden Markov model with independent discrete features."""

    def __init__(self) -> None:
        self.start: list[float] = []
        self.move: list[list[float]] = []
        self.emit: list[dict] = []

    def fit(self, pages: list[list[tuple]], labels: list[list[int]]) -> None:
        k = len(STATES)
        start, move, seen, total = [1.0] * k, [[1.0] * k for _ in range(k)], [Counter() for _ in range(k)], [0] * k
        values = defaultdict(set)
        for feats, lab in zip(pages, labels):
            if lab:
                start[lab[0]] += 1
            for a, b in zip(lab, lab[1:]):
                move[a][b] += 1
            for f, s in zip(feats, lab):
                seen[s].update(f)
                total[s] += 1
        for c in seen:
            for name, v in c:
                values[name].add(v)
        self.start = [math.log(x / sum(start)) for x in start]
        self.move = [[math.log(x / sum(row)) for x in row] for row in move]
        self.emit = [{(n, v): math.log((seen[s][n, v] + 0.1) / (total[s] + 0.1 * len(vs))) for n, vs in values.items() for v in vs} for s in range(k)]

    def decode(self, feats: list[tuple]) -> list[int]:
        if not feats:
            return []
        emit = lambda s, f: sum(self.emit[s].get(x, -7.0) for x in f)
        k = range(len(STATES))
        score, back = [self.start[s] + emit(s, feats[0]) for s in k], []
        for f in feats[1:]:
            best = [max(k, key=lambda p, s=s: score[p] + self.move[p][s]) for s in k]
            score = [score[best[s]] + self.move[best[s]][s] + emit(s, f) for s in k]
            back.append(best)
        at = max(k, key=lambda s: score[s])
        out = [at]
        for best in reversed(back):
            out.append(at := best[at])
        return out[::-1]

    @classmethod
    def trained(cls, pages: list[list[tuple]], rounds: int = 3) -> LineModel:
        """Viterbi training: labels by rules, then by the model itself."""
        model, labels = cls(), [seed_labels(p) for p in pages]
        for _ in range(rounds):
            model.fit(pages, labels)
            labels = [model.decode(p) for p in pages]
        return model


# The strokes of the key; letters and signs that a scanner takes for each other come out alike.
STROKES = {
    "o": "0", "I": "1|!lir", "a": "@", "t": "+", "s": "5$", "g": "9", "b": "68", "C": "(3éce", "v": "y",
}
WIDE_STROKES = {"n": "II", "h": "II", "u": "II", "m": "III", "d": "CI", "w": "vv"}


def stroke_key(word: Column) -> Column:
    """The same for any two words of which one may be read for the other; words that merely look related may share it too."""
    key = F.translate(word, "".join(STROKES.values()), "".join(k * len(v) for k, v in STROKES.items()))
    for letter, strokes in WIDE_STROKES.items():
        key = F.replace(key, F.lit(letter), F.lit(strokes))
    return key


@lru_cache(maxsize=200_000)
def misreads(word: str, true: str) -> bool:
    """Whether ``word`` may have been read for ``true``: every sign that no word holds is undone, and letters at up to two places, or one in four."""
    far = len(word) + 1
    cost = [[far] * (len(true) + 1) for _ in range(len(word) + 1)]
    cost[0][0] = 0
    for i in range(len(word)):
        for j in range(len(true) + 1):
            if (so_far := cost[i][j]) >= far:
                continue
            if j < len(true) and word[i] == true[j] and (word[i].isalpha() or word[i] in "-'"):
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], so_far)
            for size in (1, 2):
                part = word[i : i + size]
                if len(part) == size and part in READINGS:
                    for reading in READINGS[part]:
                        if true.startswith(reading, j):
                            at = j + len(reading)
                            cost[i + size][at] = min(cost[i + size][at], so_far + part.isalpha())
    return word != true and cost[-1][-1] <= max(2, len(word) // 4)


@F.pandas_udf(T.BooleanType())
def _misreads(words: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([misreads(w, t) for w, t in zip(words, true)], dtype=bool)


EDGE = ".,;:?\"'“”"


def bare(token: str) -> str:
    """A token as it is looked up: lower case, without punctuation at its ends."""
    return token.strip(EDGE).lower()


WORD_SQL = "[a-zà-öø-ÿ]+(?:[-'][a-zà-öø-ÿ]+)*"


def lexicon(bodies: DataFrame, body: str, clean: Column) -> DataFrame:
    """``(word, n, clean)``: how often each word occurs in all texts, and in those that no scanner read."""
    words = bodies.select(F.explode(F.regexp_extract_all(F.lower(body), F.lit(WORD_SQL), F.lit(0))).alias("word"), clean.cast("int").alias("clean"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.sum("clean").alias("clean"))


#: Signs of READINGS at a token's end: the word may go on in them, so the letters between are no word by themselves.
_SIGNS = "".join(sorted({c for k in READINGS for c in k if not c.isalpha()}))
SIGN_AT_EDGE = rf"^[{re.escape(_SIGNS)}]|[{re.escape(_SIGNS)}]$"


def _trimmed(token: str) -> Column:
    return F.lower(F.regexp_replace(token, f"^[{EDGE}]+|[{EDGE}]+$", ""))


def signed_tokens(bodies: DataFrame, body: str) -> DataFrame:
    """``(word, whole)``: how often each token with a sign at its end stands in texts that no scanner read."""
    tokens = bodies.select(F.explode(F.split(body, r"\s+")).alias("t")).select(_trimmed("t").alias("word"))
    return tokens.where((F.length("word") >= 2) & F.col("word").rlike(SIGN_AT_EDGE) & F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.count("*").alias("whole"))


#: A number of two figures or more, with a unit or an ending, is no word.
NUMERAL = r"^\d[\d.,:/]*\d\p{L}{0,2}$"


def page_words(pages: DataFrame, distinct: bool) -> DataFrame:
    """``(memory_id, word)``: the words of the pages as they are looked up, words broken across lines and sheets whole too."""
    marks = f"[{BREAKS}]"
    joined = F.transform(F.regexp_extract_all("body", F.lit(rf"\S+{marks}[ \t]*\n+[ \t]*\S+"), F.lit(0)), lambda x: F.regexp_replace(x, rf"{marks}[ \t]*\n+[ \t]*", ""))
    # over a running line the word goes on in the next line of text
    tokens = F.concat(F.split("body", r"\s+"), joined, F.coalesce("broken", F.array().cast("array<string>")), F.array(F.concat("open", "next")))
    words = F.filter(F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, f"^[{EDGE}]+|[{EDGE}]+$", ""))), lambda t: t.isNotNull())
    return pages.select("memory_id", F.explode(F.array_distinct(words) if distinct else words).alias("word"))


def misread_words(seen_words: DataFrame, words: DataFrame, signed: DataFrame, least: float = 2) -> DataFrame:
    """``(word, correction)`` for every distinct word of the scans that is taken for misread.

    A word stays as it is if texts that no scanner read have it ``least`` times (with a sign at its end the whole token, from
    ``signed``), or if no correction is at least three times as frequent and four times as frequent as the word itself.
    """
    seen = seen_words.where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(NUMERAL)).groupBy("word").agg(F.count("*").alias("seen"))
    core = F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "")
    own = seen.join(words.withColumnsRenamed({"word": "core", "n": "own"}), core == F.col("core"), "left")
    own = own.select("word", F.greatest("seen", F.when(F.length("core") == F.length("word"), F.col("own")).otherwise(0)).alias("own"), F.coalesce("clean", F.lit(0)).alias("clean"))
    known = F.when(F.col("word").rlike(SIGN_AT_EDGE), F.coalesce("whole", F.lit(0))).otherwise(F.col("clean"))
    asked = own.join(signed, "word", "left").where(known < least).select("word", "own", stroke_key(F.col("word")).alias("key"))
    likely = words.where("n >= 3").select(F.col("word").alias("correction"), "n", stroke_key(F.col("word")).alias("key"))
    found = asked.join(likely, "key").where((F.col("n") >= 4 * F.col("own")) & (F.col("word") != F.col("correction"))).where(_misreads("word", "correction"))
    return found.groupBy("word").agg(F.max_by("correction", F.struct("n", "correction")).alias("correction"))


def broken_words(lines: list[str], states: list[int]) -> tuple[str | None, list[str], str | None]:
    """The first word of a record, its words that are broken across lines, put together, and the part left open at its end."""
    text = [lines[i] for i, s in enumerate(states) if s >= 2]
    first, whole, carried = None, [], None
    for place, line in enumerate(text):
        words = [bare(t) for t in line.split()]
        if not words:
            continue
        if place == 0:
            first = words[0]
        if carried is not None:
            whole.append(carried + words[0])
        last = line.rstrip()
        carried = words[-1].rstrip(BREAKS) if len(last) > 1 and last[-1] in BREAKS and last[-2].isalpha() else None
    return first, whole, carried


def page_defects(lines: list[str], states: list[int], known: dict[str, str], following: str | None) -> list[tuple]:
    """``(line_no, defect, probe)`` of one record. A hyphen's probe is the word as a compound, to be looked up; ``following`` is
    the first word of the next sheet, where a word that is left open goes on."""
    out = [(i + 1, STATES[s], None) for i, s in enumerate(states) if s < 2]
    text = [i for i, s in enumerate(states) if s >= 2]
    carried = ""  # the first part of a word broken at the end of the line before
    for place, i in enumerate(text):
        last = lines[i].rstrip()
        broken = len(last) > 1 and last[-1] in BREAKS and last[-2].isalpha()
        words = [bare(t) for t in lines[i].split()]
        wrong = False
        if carried and words:
            whole = known.get(carried + words[0])
            wrong |= bool(whole) and not whole.endswith(words[0])
            words = words[1:]
        carried = ""
        if broken and words:
            carried = words.pop().rstrip(BREAKS)
            tail = bare((lines[text[place + 1]].split() or [""])[0]) if place + 1 < len(text) else following or ""
            if place + 1 == len(text) or tail[:1].isalpha() or tail[:1] in READINGS:
                out.append((i + 1, "hyphen", f"{carried}-{tail}"))
                whole = known.get(carried + tail)
                wrong |= bool(whole) and not whole.startswith(carried)
            else:
                carried = ""
        wrong |= any(w in known for w in words)
        if wrong:
            out.append((i + 1, "misread", None))
    return out


DECODED = "memory_id bigint, album string, sheet int, body string, states array<int>, first string, broken array<string>, open string"


def _decode(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, edges = [], []
            for body, title, repeated, boxes in zip(*(batch.column(c).to_pylist() for c in ("body", "title", "repeated", "boxes"))):
                states.append(model.decode(layout(body, title, set(repeated or ()), [(x["b"], x["c"]) if x else (None, None) for x in boxes or ()])))
                edges.append(broken_words([t for t, _ in lines_of(body)], states[-1]))
            first, broken, left = zip(*edges) if edges else ((), (), ())
            own = [batch.column(c) for c in ("memory_id", "album", "sheet", "body")]
            found = [pa.array(states, pa.list_(pa.int32())), pa.array(first, pa.string()), pa.array(broken, pa.list_(pa.string())), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *found], names=["memory_id", "album", "sheet", "body", "states", "first", "broken", "open"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            out += [(r["memory_id"], *d) for d in page_defects([t for t, _ in lines_of(r["body"])], r["states"], dict(r["known"] or ()), r["next"])]
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["memory_id", "line_no", "defect", "probe"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edge_lines(bodies: pd.Series) -> pd.Series:
    """The first and last two lines of each record, levelled, where they could be running lines."""

    def one(body: str) -> list[str]:
        lines = [t for t, _ in lines_of(body)]
        return sorted({f for t in lines[:2] + lines[-2:] if not PAGE_MARKED.match(t.strip()) and len(f := flat(t)) > 3})

    return bodies.map(one)


class ScannedPages:
    """Scanned records of a table with ``memory_id, album, name, title, body, ocr_lines``.

    Null and empty bodies have no lines; null albums and titles give no hint of running lines, null ``ocr_lines`` and boxes none of
    the layout; a re-delivered record counts once; other columns are ignored. The sheet is the last number in ``name``; where
    an album has a sheet twice, words broken at the end of the sheet before go on in the one of the smaller ``memory_id``.
    """

    def __init__(self, memories: DataFrame, is_scan: Column):
        self.memories = memories
        rows = memories.where(is_scan & F.col("body").isNotNull() & F.col("memory_id").isNotNull())
        boxes = F.transform("ocr_lines", lambda x: F.struct(x["b"].alias("b"), x["c"].alias("c")))
        self.scans = rows.select("memory_id", "album", F.regexp_extract("name", r"(\d+)\D*$", 1).try_cast("int").alias("sheet"), "title", "body", boxes.alias("boxes"))
        bodies, clean = memories.where("body IS NOT NULL"), ~F.coalesce(is_scan, F.lit(False))
        self.words = materialise(lexicon(bodies, "body", clean))
        self.clean = bodies.where(clean)

    def pages(self) -> DataFrame:
        """The scans with the levelled lines that also stand at the edge of another record of the album; once each."""
        edges = self.scans.where("album IS NOT NULL").select("memory_id", "album", F.explode(_edge_lines("body")).alias("line")).distinct()
        often = edges.groupBy("album", "line").agg(F.count("*").alias("n")).where("n > 1")
        mine = edges.join(often, ["album", "line"]).groupBy("memory_id").agg(F.collect_set("line").alias("repeated"))
        return self.scans.dropDuplicates(["memory_id"]).join(mine, "memory_id", "left")

    def model(self, pages: DataFrame) -> LineModel:
        """Fitted on the ``SAMPLE`` records whose identifiers have the least hashes."""
        sample = pages.select("memory_id", "title", "body", "repeated", "boxes").orderBy(F.xxhash64("memory_id"), "memory_id").limit(SAMPLE).collect()
        return LineModel.trained([layout(r["body"], r["title"], set(r["repeated"] or ()), [(x["b"], x["c"]) if x else (None, None) for x in r["boxes"] or ()]) for r in sample])

    def decoded(self) -> DataFrame:
        """The pages with the label of every line, the word that begins and the part that ends each, and the first word of the next sheet."""
        pages = materialise(self.pages())
        found = materialise(pages.mapInArrow(_decode(self.model(pages)), DECODED))
        follows = found.where("album IS NOT NULL AND first IS NOT NULL").groupBy("album", (F.col("sheet") - 1).alias("sheet")).agg(F.min_by("first", "memory_id").alias("next"))
        open_ = found.where("open IS NOT NULL").select("memory_id", "album", "sheet").join(follows, ["album", "sheet"]).select("memory_id", "next")
        return found.drop("album", "sheet", "first").join(open_, "memory_id", "left")

    def misread(self, decoded: DataFrame) -> DataFrame:
        """``(word, correction)`` of the pages' misread words."""
        return misread_words(page_words(decoded, False), self.words, signed_tokens(self.clean, "body"), max(2, self.clean.count() / KNOWN_IN))

    def corrected(self) -> DataFrame:
        """The decoded pages with ``known``, the corrections of the words that each holds; nothing unbounded is broadcast."""
        decoded = materialise(self.decoded())
        wrong = materialise(self.misread(decoded))
        mine = page_words(decoded, True).join(wrong, "word").groupBy("memory_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("known"))
        return decoded.join(mine, "memory_id", "left")

    def defects(self) -> DataFrame:
        """``(memory_id, line_no, defect)``: header, page_number, hyphen and misread lines, lines counted from 1 without empty ones."""
        marks = materialise(self.corrected().select("memory_id", "body", "states", "known", "next").mapInArrow(_mark, "memory_id bigint, line_no bigint, defect string, probe string"))
        sure = marks.where("defect <> 'hyphen'").select("memory_id", "line_no", "defect")
        compounds = self.words.where(F.col("word").contains("-")).select(F.col("word").alias("probe"), "n", F.regexp_replace("word", "-", "").alias("word"))
        whole = compounds.join(self.words.select("word", F.col("n").alias("plain")), "word", "left").where(F.col("n") > F.coalesce("plain", F.lit(0))).select("probe")
        hyphens = marks.where("defect = 'hyphen'").join(whole, "probe", "left_anti").select("memory_id", "line_no", "defect")
        return sure.unionByName(hyphens).distinct()

    def paragraphs(self) -> DataFrame:
        """``(memory_id, text)``: continuous paragraphs, parted by an empty line; running lines left out, broken words joined, misread ones corrected.

        A word left open at the end of a sheet is completed there by the first word of the next sheet, which keeps it too.
        """
        pages = self.corrected()
        compounds = self.words.where(F.col("word").contains("-") & (F.col("clean") > 0)).select("word")
        breaks = pages.select("memory_id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(rf"([\p{{L}}']+)[{BREAKS}][ \t]*\n+[ \t]*([\p{{L}}']+)"), F.lit(0))).alias("b"))
        kept = breaks.select("memory_id", F.regexp_replace("b", rf"[{BREAKS}][ \t]*\n+[ \t]*", "-").alias("word")).join(compounds, "word").groupBy("memory_id").agg(F.collect_set("word").alias("compounds"))

        @F.pandas_udf(T.StringType())
        def repaired(bodies: pd.Series, states: pd.Series, known: pd.Series, compounds: pd.Series, following: pd.Series) -> pd.Series:
            none = lambda x: () if x is None else x
            return pd.Series([repair(b, list(s), dict(none(k)), set(none(c)), f) for b, s, k, c, f in zip(bodies, states, known, compounds, following)])

        return pages.join(kept, "memory_id", "left").select("memory_id", repaired("body", "states", "known", "compounds", "next").alias("text"))


def repair(body: str, states: list[int], known: dict[str, str], compounds: set[str], following: str | None) -> str:
    """The text of one record as paragraphs."""
    lines = lines_of(body)
    paragraphs, carried, fresh = [[]], "", False

    def fixed(token: str) -> str:
        word = bare(token)
        if word not in known:
            return token
        at = token.lower().find(word)
        right = known[word].capitalize() if token[at : at + 1].isupper() else known[word]
        return token[:at] + right + token[at + len(word) :]

    for (line, gap), state in zip(lines, states):
        if state < 2:
            continue
        if (gap or fresh) and not carried and paragraphs[-1]:
            paragraphs.append([])
        tokens = line.split()
        if carried and tokens:
            compound = f"{bare(carried)}-{re.sub(r'[^a-z].*$', '', bare(tokens[0]))}" in compounds
            tokens[0] = carried + "-" * compound + tokens[0]
            carried = ""
        last = line.rstrip()
        if len(last) > 1 and last[-1] in BREAKS and last[-2].isalpha():
            carried = tokens.pop().rstrip(BREAKS)
        paragraphs[-1] += map(fixed, tokens)
        fresh = state == 3 and not carried
    if carried:
        paragraphs[-1].append(fixed(carried + following) if following else carried + "-")
    return "\n\n".join(" ".join(p) for p in paragraphs if p)
