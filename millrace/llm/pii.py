"""Personal information in free text (problem 6).

Method: generators of high recall propose overlapping spans of each kind; boosted trees score them by
format and by context; thresholds calibrated on held-out candidates select the redactions. Labels come
from rules that look at a candidate alone (check digits, given names, words that name this or another kind of
number) and abstain where they can't tell; what stands around labelled candidates then teaches the trees
the contexts, by which they judge the rest. Given names are those of a general table and those that the corpus
itself shows: capitalised words that stand before many different capitalised words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.names import FORMAL, abbreviates, held_keys, is_given, plain_tokens, same_word, short_keys, short_of
from millrace.llm.boosting import BoostedTrees, best_threshold
from millrace.llm.lookalike import HYPHENS, INVISIBLE, LATIN_TWINS
from millrace.session import materialise, salted_join

#: Different texts the trees are fitted on, at most.
SAMPLE = 4_000
#: A word that stands before so many different capitalised words is taken for a given name.
FOLLOWERS = 5
#: Lower-case words and given names that go out with the detector, at most; of more, each text gets those that it is judged by, through a join, with the same results.
WORD_LIMIT = 300_000
KINDS = ("email", "phone", "id_number", "address", "name")

# Words for the trade of a firm.
TRADES = frozenset("plumbing bakery hardware roofing motors computers tutors clinic studio catering nursery travel express electrical upholstery optics pharmacy butchery dentists attorneys builders garage laundry florist bank insurance school church hotel restaurant cafe store stores supermarket services solutions holdings group foods".split())
# Kinds of streets with their abbreviations.
STREETS = "street st road rd avenue ave lane ln drive dr close cl crescent cres way place pl court ct boulevard blvd terrace square sq"
# Words before numbers that are no personal numbers, and before ones that are.
OTHER_NUMBERS = frozenset("order barcode serial invoice waybill ticket booking claim firmware readings reading meter isbn ean row deck slot version price locker r".split())
PHONE_WORDS = frozenset("call phone number reachable tel telephone cell mobile fax sms whatsapp ring on contact".split())
ID_WORDS = frozenset("id identity passport idno".split())
TITLES = frozenset("dr mr mrs ms miss prof rev sir".split())
UNITS = frozenset("unit flat apartment apt suite".split())

_SHADOW = {t: latin for latin, ts in LATIN_TWINS.items() for t in ts} | {h: "-" for h in HYPHENS} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


@lru_cache(maxsize=4096)
def _shadow_char(c: str) -> str:
    """A character as it is read: its Latin twin, a plain blank, its first letter without accents, or nothing."""
    if c in _SHADOW:
        return _SHADOW[c]
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind in ("Cf", "Mn") or c in INVISIBLE:
        return ""
    if kind[0] == "L":
        return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return c


def shadow(text: str) -> tuple[str, list[int] | None]:
    """The text as it is read, and for each of its characters the place in ``text``; None where the places are the same."""
    if text.isascii():
        return text, None
    table = {ord(c): _shadow_char(c) for c in set(text) if c >= "\x80"}
    if all(len(s) == 1 for s in table.values()):
        return text.translate(table), None
    at: list[int] = []
    for i, c in enumerate(text):
        at += [i] * len(table.get(ord(c), c))
    return text.translate(table), [*at, len(text)]


_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"(?i)(?<![\w.+%-])[a-z0-9][\w.+%-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+")
NUMBER = re.compile(r"(?<![\w.+-])(?:\+|\()?\d(?:[ ().\-/]{0,3}\d){6,16}(?![\w-])")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{1,2} ?\d(?:[ -]?\d){5,8}(?: ?[A-Z])?(?![\w-])")
ADDRESS = re.compile(rf"(?i)(?<!\w)(?:(?:unit|flat|apartment|apt|suite)\.? ?\d+[a-z]?(?: ?[,/] ?| ))?\d{{1,5}}[a-z]?,? (?:[a-z][a-z'-]* ){{1,3}}(?:{'|'.join(STREETS.split())})\b")
WORD = re.compile(r"[A-Z][A-Za-z'’]+|[A-Z](?![\w])\.?")
JOIN = re.compile(r" {1,3}$|, ?$|\. ?$")
NAMED = re.compile(r"[A-Za-z][A-Za-z'-]*")
LOWER_RUN = re.compile(r"[a-z]{4,}")
LOWER_PAIR = re.compile(r"(?<![\w.@+-])[a-z]{4,} (?=([a-z]{4,})(?![\w@+-]|\.\w))\1")
BEFORE = re.compile(r"[A-Za-z0-9@]+")
SMALL = re.compile(r"(?<![\w'.@+-])[a-z]{2,}(?![\w'@+-]|\.\w|\[|\()")
PAIR = re.compile(r"(?<![\w'.@+-])([A-Z][a-z]{2,}) (?=([A-Z][a-z]{2,})(?![\w'@+-]))")
# Amounts and dates, which are no identity numbers whatever stands before them.
NO_ID = re.compile(r"[./]|^\d{4}-\d{2}-\d{2}$")
# How phone numbers of different countries are written: with a country code, with a trunk zero, as area code and number, in groups of 3-3-4 or of twos.
PHONE_FORMS = re.compile(r"(?:\+|00)\d[\d ().\-/]{6,20}|\(?0\d[\d ().\-/]{7,14}|\(\d{3}\) ?\d{3}[ -]\d{4}|\d{3}([ .-])\d{3}\1\d{4}|\d{2}(?:[ .]\d{2}){4}")
CAPITAL = re.compile(r"(?<=[A-Za-z.] )(?<![.!?] )[A-Z][a-z]+")


@dataclass
class Span:
    kind: str
    start: int
    end: int
    features: list[float] = field(default_factory=list)
    label: int | None = None
    context: tuple[str, ...] = ()


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


@lru_cache(maxsize=100_000)
def _trade(word: str) -> bool:
    """A trade, also abbreviated or misspelt."""
    return word in TRADES or len(word) >= 5 and any(same_word(word, t) for t in TRADES if t[0] == word[0]) or len(word) in (3, 4, 5) and word not in FORMAL and any(abbreviates(word, t) for t in TRADES)


class Words(frozenset):
    """Lower-case words, and given names with a ``^`` before them."""

    @cached_property
    def given(self) -> Container[str]:
        return FORMAL.keys() | {w[1:] for w in self if w[0] == "^"}

    @cached_property
    def short(self) -> dict[str, float]:
        return {}

    def short_given(self, word: str) -> float:
        """Whether a word is a short form by rule of a given name."""
        if word not in self.short:
            self.short[word] = 0.7 if word not in self and any(short_of(word, g) for g in self.given) else 0.0
        return self.short[word]


class OwnWords(Words):
    """Those of the words that some texts ask for (``asked_words``), looked up in the table of all; short forms by rule of any given name have a ``<`` before them."""

    @cached_property
    def given(self) -> Container[str]:
        return _Marked(self)

    def short_given(self, word: str) -> float:
        return 0.7 if word not in self and "<" + word in self else 0.0


class _Marked:
    """The given names of the table and those that are marked."""

    def __init__(self, words: OwnWords):
        self.words = words

    def __contains__(self, word: str) -> bool:
        return word in FORMAL or "^" + word in self.words

    def isdisjoint(self, words: Iterable[str]) -> bool:
        return not any(w in self for w in words)


@lru_cache(maxsize=100_000)
def _near_given(word: str) -> float:
    return 0.7 if len(word) >= 5 and is_given(word) else 0.0


def _given(word: str, words: Words) -> float:
    return 1.0 if word in words.given else _near_given(word) or words.short_given(word)


def _around(s: str, start: int, end: int) -> tuple[str, ...]:
    """The two words before and after, and the signs right at the span's ends."""
    left = BEFORE.findall(s[max(0, start - 40) : start])
    right = BEFORE.findall(s[end : end + 30])
    one = lambda ws, i: re.sub(r"\d+", "0", ws[i].lower()) if -len(ws) <= i < len(ws) else ""
    tail = s[end : end + 1]
    before = s[max(0, start - 1) : start]
    return one(left, -1), f"{one(left, -2)} {one(left, -1)}", one(right, 0), f"{one(right, 0)} {one(right, 1)}", before + "_" + tail


def candidates(s: str, lower: Words) -> list[Span]:
    """All candidate spans of a shadow text with format features, a label where a rule is sure, and the context.

    ``lower`` holds the words that are usually in lower case, of which one with a capital is seldom a name, and the given names.
    """
    out = []
    small = s.lower()
    spelt_out = "@" in s or " dot " in small or any(f"at{x}" in small or f"at {x}" in small for x in ")]")
    for m in EMAIL.finditer(s) if spelt_out else ():
        t = m.group()
        spelt = "@" not in t
        label = 1 if "@" in t or re.search(r"(?i)[\[(]at[\])]|dot", t) else None
        out.append(Span("email", m.start(), m.end(), [len(t), t.count("."), float(spelt), float(bool(re.search(r"(?i)\bdot\b", t))), float(" " in t)], label))
    for m in NUMBER.finditer(s):
        t = m.group()
        opened = t.startswith("(") and ")" not in t
        start, t = (m.start() + 1, t[1:]) if opened else (m.start(), t)
        digits = re.sub(r"\D", "", t)
        ctx = _around(s, start, m.end())
        words = set(ctx[1].split())
        nation = re.sub(r"^(?:\+|00)\d{2}(?:\s*\(0\))?", "0", t)
        national = re.sub(r"\D", "", nation)
        dated = len(digits) == 13 and 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= 31
        grouping = [len(g) for g in re.findall(r"\d+", t)]
        feats = [len(digits), float(t[0] == "+"), float(digits.startswith("00")), float(digits[0] == "0"), float(len(national) == 10 and national[0] == "0"), float(dated), float(dated and luhn(digits)), len(grouping), max(grouping), float("(" in t), float(bool(words & OTHER_NUMBERS)), float(bool(words & PHONE_WORDS)), float(bool(words & ID_WORDS))]
        phone_like = 7 <= len(digits) <= 15 and bool(PHONE_FORMS.fullmatch(t))
        feats.append(float(phone_like))
        other = bool(words & OTHER_NUMBERS - {"r"})
        named = bool(words & ID_WORDS) or "identity" in s[max(0, start - 20) : start].lower()
        out.append(Span("phone", start, m.end(), feats, 0 if dated or not phone_like or named else 0 if other and not words & PHONE_WORDS else 1 if words & PHONE_WORDS or t[0] == "+" else None))
        # a number that its text names is one in any country's form; else only the form with a date and a check digit is left open
        if not NO_ID.search(t):
            out.append(Span("id_number", start, m.end(), feats, 0 if other else 1 if named else None if dated else 0))
    for m in PASSPORT.finditer(s):
        t = m.group()
        ctx = _around(s, m.start(), m.end())
        words = set(ctx[1].split())
        digits = re.sub(r"\D", "", t)
        feats = [len(digits), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, float(len(digits)), 0.0, float(bool(words & OTHER_NUMBERS)), 0.0, float(bool(words & ID_WORDS)), 0.0]
        out.append(Span("id_number", m.start(), m.end(), feats, 1 if words & ID_WORDS else 0 if words & OTHER_NUMBERS or len(digits) < 7 else None))
    for m in ADDRESS.finditer(s):
        t = m.group()
        parts = plain_tokens(t)
        named = NAMED.findall(t)
        inner = [w for w in named if w.lower() not in UNITS and len(w) > 1][:-1]
        capital = sum(w[0].isupper() for w in inner) / max(1, len(inner))
        known = sum(w.lower() in lower for w in inner) / max(1, len(inner))
        unit = float(bool(parts) and parts[0] in UNITS)
        feats = [len(t), len(inner), capital, known, unit, float(named[-1][0].isupper())]
        # an address written in lower case all through is an address; in running text, its number counts something
        out.append(Span("address", m.start(), m.end(), feats, 1 if capital == 1 and named[-1][0].isupper() else 1 if capital == 0 and len(inner) == 1 and not known else 0 if capital == 0 and len(inner) > 1 else None))
    out += _name_spans(s, lower)
    for x in out:
        x.context = _around(s, x.start, x.end)
    return out


def _name_spans(s: str, lower: Words) -> list[Span]:
    runs, run, last = [], [], None
    for m in WORD.finditer(s):
        if run and (m.start() - last > 3 or not JOIN.match(s[last : m.start()]) or "\n" in s[last : m.start()]):
            runs.append(run)
            run = []
        run.append(m)
        last = m.end()
    runs.append(run)
    out = []
    for run in runs:
        for size in (2, 3, 4):
            for i in range(len(run) - size + 1):
                part = run[i : i + size]
                text = s[part[0].start() : part[-1].end()]
                words = [p.group().rstrip(".'’").lower() for p in part]
                commas = text.count(",")
                if commas > 1 or commas == 1 and not s[part[0].end() :].startswith(","):
                    continue
                if any("." in s[p.start() : q.start()] and len(w) > 1 for p, q, w in zip(part, part[1:], words)):
                    continue  # the end of a sentence
                longs, initials = [w for w in words if len(w) > 1], sum(len(w) == 1 for w in words)
                if not longs or len(longs) > 3 or initials > 2 or words[0] in TITLES:
                    continue
                end = part[-1].end() - (part[-1].group().endswith(".") and initials and len(words[-1]) == 1 and s[part[-1].end() : part[-1].end() + 2].strip() == "")
                givens = [_given(w, lower) for w in longs]
                trade = sum(map(_trade, longs))
                after = [x for x in re.findall(r"^[ \-‐‑&]{1,3}([A-Za-z]+)", s[part[-1].end() : part[-1].end() + 20])]
                nexttrade = float(bool(after) and (_trade(after[0].lower()) or after[0] in ("Sons",)) and s[part[-1].end() : part[-1].end() + 1] not in ".,")
                common = sum(w in lower and w not in lower.given for w in longs)
                joined_left = float(i > 0 and len(run[i - 1].group()) > 1 and (left := run[i - 1].group().rstrip(".").lower()) not in TITLES and left not in lower and "." not in s[run[i - 1].start() : part[0].start()] and "," not in s[run[i - 1].end() : part[0].start()])
                joined_right = float(i + size < len(run) and "," not in s[part[-1].end() : run[i + size].start()] and not (s[part[-1].end() - 1] == "." and len(words[-1]) > 1))
                plain = [w for w, g in zip(longs, givens) if not g]
                capitals = float(all(p.group().isupper() for p in part if len(p.group()) > 2))
                feats = [size, len(longs), initials, max(givens), sum(g > 0 for g in givens), trade, nexttrade, common, joined_left, joined_right, commas, capitals, min(map(len, longs)), max(map(len, longs)), float(len(words[0]) == 1), float(len(words[-1]) == 1)]
                label = None
                if trade or nexttrade or common:
                    label = 0
                elif initials and len(longs) == 1 and len(longs[0]) >= 5 and "." in text and not joined_left and not joined_right:
                    label = 1
                elif max(givens) == 1.0 and len(longs) == 2 and len(plain) == 1 and not common and len(plain[0]) >= 5:
                    # a longer run holds it, or it stands alone
                    label = 1 if not joined_right and not joined_left else None
                elif not any(givens) and not initials:
                    label = 0
                out.append(Span("name", part[0].start(), end, feats, label))
    for m in LOWER_PAIR.finditer(s) if not lower.given.isdisjoint(LOWER_RUN.findall(s)) else ():
        a, b = m.group().split()
        for given, other in ((a, b), (b, a)):
            if given in lower.given and len(given) > 3 and given not in lower and len(other) >= 5 and other not in lower and not _trade(other):
                out.append(Span("name", m.start(), m.end(), [2, 2, 0, 1.0, 1, 0, 0.0, 0, 0.0, 0.0, 0, 0.0, min(len(a), len(b)), max(len(a), len(b)), 0.0, 0.0], None))
                break
    return out


def asked_words(text: str) -> set[tuple[str, str]]:
    """``(word, beside)``: every word on which the candidates of a text may depend, marked by what is asked of it.

    ``word`` as a lower-case word, with a ``^`` as a given name, with a ``<`` as a short form of one. Words of two in lower case are
    asked for as given names, and only where they are, the one ``beside`` them as a lower-case word; else that is empty.
    """
    s, asked, out = shadow(text)[0], set(), set()
    for m in set(WORD.findall(s)):
        for w in {m.rstrip(".'’").lower(), m.rstrip(".").lower()}:
            asked |= ({w, "^" + w} if len(w) > 1 else set()) | ({"<" + w} if short_keys(w) else set())
    for m in ADDRESS.finditer(s):
        asked.update(w.lower() for w in NAMED.findall(m.group()))
    for m in LOWER_PAIR.finditer(s):
        a, b = m.group().split()
        for given, other in ((a, b), (b, a)):
            if given in FORMAL:
                asked |= {given, other}
            else:  # no given name that the texts show is a lower-case word
                out.add(("^" + given, other))
    return out | {(w, "") for w in asked}


class Detector:
    """Per kind: boosted trees, the log-odds of context words, and a threshold.

    ``lower`` holds the lower-case words; where they are too many to go out with the detector, ``words`` is the
    table of them and ``lower`` has those of the fitted texts only.
    """

    def __init__(self) -> None:
        self.lower = Words()
        self.words: DataFrame | None = None
        self.trees: dict[str, BoostedTrees] = {}
        self.odds: dict[str, list[dict[str, float]]] = {}
        self.threshold: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def matrix(self, kind: str, spans: list[Span]) -> np.ndarray:
        odds = self.odds[kind]
        return np.array([[*x.features, *(o.get(c, 0.0) for o, c in zip(odds, x.context))] for x in spans], float)

    def fit(self, texts: list[str], lower: Words | None = None) -> Detector:
        """Fit to ``texts``; ``lower`` holds the lower-case words and given names of the whole corpus, those of ``texts`` where left out."""
        shadows = [shadow(t)[0] for t in texts]
        if lower is None:
            counts, capital = word_uses(shadows)
            followers = Counter(a for a, _ in {p for s in shadows for p in capital_pairs(s)})
            small = {w for w, n in counts.items() if n > 1 and n > capital[w]}
            lower = Words(small | {"^" + w for w, n in followers.items() if n >= FOLLOWERS and w not in small and plausible_given(w)})
        self.lower = lower
        spans = [(i, x) for i, s in enumerate(shadows) for x in candidates(s, self.lower)]
        for kind in KINDS:
            known = [(i, x) for i, x in spans if x.kind == kind and x.label is not None]
            train, held = [x for i, x in known if i % 3], [x for i, x in known if i % 3 == 0]
            base = (sum(x.label for x in train) + 1) / (len(train) + 2)
            self.odds[kind] = []
            for c in range(5):
                n, yes = Counter(x.context[c] for x in train), Counter(x.context[c] for x in train if x.label)
                self.odds[kind].append({w: float(np.log((yes[w] + 4 * base) / (k - yes[w] + 4 * (1 - base)))) - float(np.log(base / (1 - base))) for w, k in n.items() if k > 2})
            y = np.array([x.label for x in train])
            x = self.matrix(kind, train) if train else np.zeros((0, 1))
            if kind == "name" and train:
                # names as they look to who knows no given names: from these the trees learn the contexts
                for hidden in (0.7, 0.0):
                    blind = x[(y == 1) & (x[:, 3] == 1.0)].copy()
                    blind[:, 3] = np.minimum(blind[:, 3], hidden)
                    blind[:, 4] = np.minimum(blind[:, 4], hidden > 0)
                    x, y = np.concatenate([x, blind]), np.concatenate([y, np.ones(len(blind), y.dtype)])
            self.trees[kind] = BoostedTrees().fit(x, y)
            prob = self.trees[kind].probability(self.matrix(kind, held)) if held else np.zeros(0)
            self.threshold[kind] = best_threshold(prob, np.array([x.label for x in held]))
        return self

    def select(self, texts: list[str], lower: list[Words] | None = None) -> list[list[tuple[str, int, int]]]:
        """Per text the redactions ``(kind, start, end)``, without overlaps, in the order of the text; ``lower`` has the lower-case words of each."""
        shadows = [shadow(t) for t in texts]
        spans = [(i, x) for i, (s, _) in enumerate(shadows) for x in candidates(s, self.lower if lower is None else lower[i])]
        scored: list[list[tuple[float, Span]]] = [[] for _ in texts]
        for kind in KINDS:
            mine = [(i, x) for i, x in spans if x.kind == kind]
            if mine:
                prob = self.trees[kind].probability(self.matrix(kind, [x for _, x in mine]))
                for (i, x), p in zip(mine, prob):
                    if p >= self.threshold[kind]:
                        scored[i].append((float(p), x))
        out = []
        for (s, at), found in zip(shadows, scored):
            taken: list[Span] = []
            # a longer span wins over what it holds unless it is clearly less likely
            for p, x in sorted(found, key=lambda f: (-(f[0] + 0.01 * (f[1].end - f[1].start)), f[1].start)):
                if all(x.end <= t.start or t.end <= x.start for t in taken):
                    taken.append(x)
            place = (lambda i: i) if at is None else (lambda i, at=at: at[i])
            ends = (lambda i: i) if at is None else (lambda i, at=at: at[i - 1] + 1)
            out.append(sorted((x.kind, place(x.start), ends(x.end)) for x in taken))
        return [sorted(o, key=lambda r: r[1]) for o in out]


def word_uses(shadows: list[str]) -> tuple[Counter, Counter]:
    """How often each word is used in lower case, and with a capital within a sentence."""
    return Counter(w for s in shadows for w in SMALL.findall(s)), Counter(w.lower() for s in shadows for w in CAPITAL.findall(s))


def capital_pairs(s: str) -> set[tuple[str, str]]:
    """Capitalised words with the capitalised word that follows, in lower case; firms, streets and titles left out."""
    pairs = {(a.lower(), b.lower()) for a, b in PAIR.findall(s)}
    return {(a, b) for a, b in pairs if not _trade(b) and b not in _STREETS and a not in TITLES}


_STREETS = frozenset(STREETS.split())


def plausible_given(word: str) -> bool:
    return not _trade(word) and word not in _STREETS and word not in TITLES and word not in UNITS


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = sorted({p for t in batch.column(0).to_pylist() for p in capital_pairs(shadow(t)[0])})
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["word", "after"])


@F.pandas_udf(T.BooleanType())
def _plausible(words: pd.Series) -> pd.Series:
    return words.map(plausible_given)


def given_words(texts: DataFrame, text_col: str, lower: DataFrame) -> DataFrame:
    """``(word)``: the given names that all texts together show, with a ``^`` before them.

    A given name stands before ``FOLLOWERS`` or more different capitalised words and isn't usually in lower case.
    """
    pairs = texts.where(F.length(text_col) > 0).select(text_col).mapInArrow(_pairs, "word string, after string").distinct()
    many = pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= FOLLOWERS).join(lower, "word", "left_anti")
    return many.where(_plausible("word")).select(F.concat(F.lit("^"), "word").alias("word"))


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word uses of a task's texts, given out whenever many words have come together."""
    small, capital = Counter(), Counter()

    def table() -> pa.RecordBatch:
        words = sorted(small.keys() | capital.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([small[w] for w in words], pa.int64()), pa.array([capital[w] for w in words], pa.int64())], names=["word", "small", "capital"])

    for batch in batches:
        a, b = word_uses([shadow(t)[0] for t in batch.column(0).to_pylist()])
        small.update(a)
        capital.update(b)
        if len(small) + len(capital) > WORD_LIMIT:
            yield table()
            small, capital = Counter(), Counter()
    yield table()


def lower_words(texts: DataFrame, text_col: str) -> DataFrame:
    """``(word)``: the words that all texts together have in lower case more than once and more often than with a capital."""
    uses = texts.where(F.length(text_col) > 0).select(text_col).mapInArrow(_uses, "word string, small bigint, capital bigint")
    return uses.groupBy("word").agg(F.sum("small").alias("small"), F.sum("capital").alias("capital")).where("small > 1 AND small > capital").select("word")


def fitted_texts(rows: DataFrame, text_col: str, sample: int) -> list[str]:
    """The ``sample`` different texts of the least hashes, in their order: neither the number of rows nor repeated texts count."""
    key = F.xxhash64(text_col)
    last = rows.select(key.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return [r[0] for r in rows.where(key <= F.lit(last)).select(text_col).distinct().orderBy(key, text_col).limit(sample).collect()]


def learn(texts: DataFrame, text_col: str, sample: int = SAMPLE, word_limit: int = WORD_LIMIT) -> Detector:
    """A detector fitted on at most ``sample`` different texts, those of the least hashes; lower-case words and given names are counted over all texts.

    Whether the words go out with the detector or reach each text by a join, every candidate is judged by all of them: ``word_limit``
    decides where words are kept, not what is found.
    """
    rows = texts.where(F.length(text_col) > 0).select(text_col)
    fitted = fitted_texts(rows, text_col, sample)
    lower = materialise(lower_words(rows, text_col))
    words, detector = materialise(lower.unionByName(given_words(rows, text_col, lower))), Detector()
    if words.count() <= word_limit:
        return detector.fit(fitted, Words(r[0] for r in words.collect()))
    detector.words = words
    asked = sorted(set().union(*map(asked_words, fitted)))
    asked = words.sparkSession.createDataFrame([(0, w, b) for w, b in asked], "row_id bigint, word string, beside string")
    return detector.fit(fitted, OwnWords(r["word"] for r in _known(asked, words).collect()))


PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def _scan(model, emit_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = model.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            words = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                chosen = detector.select(part, words and [OwnWords(w or ()) for w in words[lo : lo + 500]])
                if emit_text:
                    out = []
                    for text, spans in zip(part, chosen):
                        pieces, at = [], 0
                        for kind, start, end in spans:
                            pieces += (text[at:start], PLACEHOLDER[kind])
                            at = end
                        out.append("".join(pieces) + text[at:])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), pa.array(out, pa.string())], names=["row_id", "redacted"])
                else:
                    rows = sorted({(lo + i, kind, text[a:b]) for i, (text, spans) in enumerate(zip(part, chosen)) for kind, a, b in spans})
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["row_id", "kind", "pii_text"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, w, b) for i, t in enumerate(batch.column(1).to_pylist()) for w, b in sorted(asked_words(t))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in found], pa.int64())), pa.array([w for _, w, _ in found], pa.string()), pa.array([b for _, _, b in found], pa.string())], names=["row_id", "word", "beside"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _short_keys(words: pd.Series) -> pd.Series:
    return words.map(short_keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _held_keys(words: pd.Series) -> pd.Series:
    return words.map(held_keys)


@F.pandas_udf(T.BooleanType())
def _short_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([short_of(x, y) for x, y in zip(a, b)], dtype=bool)


def _short_forms(asked: DataFrame, words: DataFrame) -> DataFrame:
    """``(word)``: the words asked for as short forms, with their ``<``, that are one of any given name, of the table or of the texts."""
    table = words.sparkSession.createDataFrame([(g,) for g in sorted(FORMAL)], "given string")
    given = words.where(F.col("word").startswith("^")).select(F.expr("substring(word, 2)").alias("given")).unionByName(table).distinct()
    short = asked.where(F.col("word").startswith("<")).select(F.expr("substring(word, 2)").alias("short")).distinct()
    pairs = short.select("short", F.explode(_short_keys("short")).alias("key")).join(given.select("given", F.explode(_held_keys("given")).alias("key")), "key")
    return pairs.select("short", "given").distinct().where(_short_of("short", "given")).select(F.concat(F.lit("<"), "short").alias("word")).distinct()


def _known(asked: DataFrame, words: DataFrame) -> DataFrame:
    """``(row_id, word)``: what holds of the words that texts ask for, from ``(row_id, word, beside)``."""
    held = materialise(salted_join(asked, words.unionByName(_short_forms(asked, words)), ["word"]))
    beside = held.where("beside <> ''").select("row_id", F.col("beside").alias("word")).distinct()
    return held.select("row_id", "word").unionByName(salted_join(beside, words, ["word"])).distinct()


def _texts(df: DataFrame, id_col: str, text_col: str, detector: Detector) -> DataFrame:
    """``(row_id, text)``, with the lower-case words that each text asks for where the detector can't hold all."""
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
    if detector.words is None:
        return rows
    asked = materialise(rows.mapInArrow(_asked, "row_id bigint, word string, beside string").distinct())
    return rows.join(_known(asked, detector.words).groupBy("row_id").agg(F.collect_set("word").alias("words")), "row_id", "left")


def find_pii(df: DataFrame, id_col: str, text_col: str, detector: Detector) -> DataFrame:
    """``(row_id, kind, pii_text)``: the personal information of each text, exactly as written, once a record and kind.

    Null and empty texts hold none; a re-delivered record counts once; whole texts are read; other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast(detector)
    return _texts(df, id_col, text_col, detector).mapInArrow(_scan(model, False), "row_id bigint, kind string, pii_text string").distinct()


def redact(df: DataFrame, id_col: str, text_col: str, detector: Detector) -> DataFrame:
    """``(row_id, redacted)``: each text with a typed placeholder in place of every piece of personal information."""
    model = df.sparkSession.sparkContext.broadcast(detector)
    return _texts(df, id_col, text_col, detector).mapInArrow(_scan(model, True), "row_id bigint, redacted string").dropDuplicates(["row_id"])
