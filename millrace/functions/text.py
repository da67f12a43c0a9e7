"""Scalar text functions as Column expressions; nothing here leaves the JVM.

Every function takes and returns Columns and gives null for null input unless it says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries; Java's own are Unicode-aware.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"



def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, with ``c`` computed once: Spark would repeat it wherever a lambda uses it."""
    return F.transform(F.array(c), f)[0]


# Stopwords.
STOPWORDS = """
a about above after again against all also am an and any are aren't as at be because been before being
below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during
each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more
most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same
shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those through to too under until up very
was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's
whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# Words after which a wrapped line goes on.
CONTINUES = """
on the a an to and with for of in at my his her their our your is was are were that this from by as or but so
if when while after before then than into over under not no it we they he she up out about because
""".split()

TOKEN = "[a-z0-9]+(?:['-][a-z0-9]+)*"
#: A sentence ends at line breaks, or after . ! ? where a capital, a digit or a bracket follows the blank.
SENTENCE_END = r"\n+|(?<=[.!?])\s+(?=[A-Z0-9(])"


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Characters whose compatibility form without accents is one ASCII letter or digit, and these, by Unicode's rule."""
    pairs = []
    for c in map(chr, range(0xAA, 0xFFFF)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Latin ligatures and their letters.
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬆ": "st"}


def clean_text(c: Column) -> Column:
    """Line ends, quotes, dashes and blanks in one form; at most one empty line in a row; trimmed."""
    for pattern, to in (("\r\n?", "\n"), ("[‘’‛]", "'"), ("[“”]", '"'), ("[–—]", "-"), ("\u00a0", " "), ("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_accents(c: Column) -> Column:
    """Latin letters without accents; full-width and other compatibility forms become plain letters and digits."""
    src, dst = fold_map()
    folded = F.translate(c, src, dst)
    for sign, letters in LIGATURES.items():
        folded = F.replace(folded, F.lit(sign), F.lit(letters))
    # most texts are plain ASCII and stay as they are
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, "[̀-ͯ]", "")).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of a text: lower case, without accents, letters and digits with inner apostrophes and hyphens."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(TOKEN), F.lit(0))


def is_stopword(c: Column) -> Column:
    return c.isin(STOPWORDS)


def content_tokens(c: Column) -> Column:
    """Tokens of more than one character that are no stopwords."""
    return F.filter(tokens(c), lambda t: ~is_stopword(t) & (F.length(t) > 1))


def stem(t: Column) -> Column:
    """A word without one common English suffix; the first rule that fits wins."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    es = F.lit(False)
    for suffix in ("ches", "shes", "xes", "sses", "zes"):
        es = es | t.endswith(suffix)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & es, cut(2))
        .when((n > 4) & t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us"), cut(1))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .otherwise(t)
    )


def stems(array: Column) -> Column:
    return F.transform(array, stem)


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, an ellipsis in place of what is cut; empty for null."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, n - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(c) <= n, c).otherwise(F.coalesce(cut, F.lit("")))


def format_bytes(c: Column) -> Column:
    """A size in B, KB without or MB with one decimal."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(F.floor(c / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.floor(c / 1048576 * 10 + 0.5) / 10), F.lit(" MB")))
    )


def format_date(c: Column) -> Column:
    """Day, short month and year."""
    return F.date_format(c, "d MMM yyyy")


def relative_date(c: Column, now: Column) -> Column:
    """today, yesterday, or so many days, months (of 30 days) or years (of 12 months) ago."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(c)) / F.lit(86_400_000_000.0) + 0.5)
    months = F.floor(days / 30 + 0.5)
    years = F.floor(months / 12 + 0.5)
    ago = lambda k, unit: F.concat(k.cast("string"), F.lit(f" {unit}"), F.when(k == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, ago(days, "day")).when(months < 12, ago(months, "month")).otherwise(ago(years, "year"))


def sentences(c: Column) -> Column:
    """The sentences of a text that have more than one character."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > 1)


def display_lines(c: Column) -> Column:
    """The first six sentences of a text that are neither short nor long, as a reader is shown them."""
    return F.slice(F.filter(sentences(clean_text(c)), lambda x: (F.length(x) > 24) & (F.length(x) < 260)), 1, 6)


def term_coverage(query: Column, document: Column) -> Column:
    """The share of the query's distinct stems, of more than one character, that the document's tokens hold; 0 without any."""
    q = F.array_distinct(F.filter(stems(query), lambda t: F.length(t) > 1))
    return let(q, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, stems(document))) / F.size(x)).otherwise(F.lit(0.0)))


def squashed(c: Column) -> Column:
    """Lower case, anything but word characters and blanks as blanks, blanks in a row as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " ")


def snippet(body: Column, terms: Column, length: int = 220) -> Column:
    """The stretch of a text, line breaks shown as dots, where most of the terms stand; windows start every 12 characters."""
    wanted = F.filter(F.array_distinct(terms), lambda t: F.length(t) > 1)

    def cut(x: Column) -> Column:
        text, lower = x["text"], x["lower"]
        places = F.sequence(F.lit(0), F.greatest(F.length(lower) - 1, F.lit(0)), F.lit(12))
        count = lambda window: F.size(F.filter(x["wanted"], lambda t: F.contains(window, t)))
        hits = F.transform(places, lambda i: F.struct(let(F.substring(lower, i + 1, F.lit(length)), count).alias("n"), (-i).alias("at")))
        return let(F.greatest(-F.array_max(hits)["at"] - 40, F.lit(0)), lambda start: ends(text, start))

    def ends(text: Column, start: Column) -> Column:
        end = F.least(start + length, F.length(text))
        space = F.locate(" ", F.substring(text, end + 1, F.lit(24)))
        end = F.when((end < F.length(text)) & (space > 0), end + space - 1).otherwise(end)
        return F.regexp_replace(F.substring(text, start + 1, end - start), r"^\s+|\s+$", "")

    flat = F.regexp_replace(clean_text(body), "\n+", " · ")
    return let(flat, lambda t: let(F.struct(t.alias("text"), strip_accents(F.lower(t)).alias("lower"), wanted.alias("wanted")), cut))


def highlight_ranges(c: Column, terms: Column) -> Column:
    """Where the terms of more than one character stand in ``c``, whatever case and accents: ``array<struct<start, end>>`` in order,
    from 0, the end excluded; ranges that overlap or touch are one. Empty for null and without terms. Meant for snippets: the work
    grows with the square of the ranges of one text."""
    wanted = F.filter(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))), lambda t: F.length(t) > 1)

    def occurrences(lower: Column, t: Column) -> Column:
        # a text split at a term has its pieces' lengths between the term's places
        pieces = F.transform(F.split(lower, F.regexp_replace(t, r"([^\w])", r"\\$1"), F.lit(-1)), lambda p: F.length(p))
        before = lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda i: F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda a, n: a + n) + (i - 1) * F.length(t))
        starts = let(pieces, lambda ps: F.when(F.size(ps) > 1, before(ps)).otherwise(F.array().cast("array<int>")))
        return F.transform(starts, lambda at: F.struct(at.alias("start"), (at + F.length(t)).alias("end")))

    def merge(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")))
        goes_on = (F.size(out) > 0) & (r["start"] <= last["end"])
        return F.when(goes_on, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), wider)).otherwise(F.concat(out, F.array(r)))

    found = let(F.struct(strip_accents(F.lower(F.coalesce(c, F.lit("")))).alias("lower"), wanted.alias("wanted")), lambda x: F.flatten(F.transform(x["wanted"], lambda t: occurrences(x["lower"], t))))
    return F.aggregate(F.array_sort(found), F.array().cast("array<struct<start: int, end: int>>"), merge)


def highlight(c: Column, terms: list[str]) -> Column:
    """``c`` with every term of more than two characters in ``<mark>`` tags, the longest first."""
    long = sorted({t.lower() for t in terms if len(t) > 2 and t.isalnum()}, key=lambda t: (-len(t), t))
    return F.regexp_replace(c, f"(?i)({'|'.join(long)})", "<mark>$1</mark>") if long else c


def join_wrapped_lines(c: Column) -> Column:
    """Lines of a text that was wrapped put together: a line goes on where it is unfinished and long, ends in a joining word, or is followed by a small letter."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def step(out: Column, line: Column) -> Column:
        last = trim(F.element_at(out, -1))
        open_ = ~last.rlike(r"[.!?:;)\]\"'”]$")
        tail = F.regexp_replace(F.lower(F.element_at(F.split(last, r"\s+"), -1)), "[^a-z]", "")
        joins = open_ & (tail.isin(CONTINUES) | (F.length(last) > 34) | line.rlike(r"^\s*[a-z(]"))
        merged = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws(" ", last, trim(line))))
        # an empty line neither goes on nor is gone on from
        return F.when((F.size(out) > 0) & (last != "") & joins, merged).otherwise(F.concat(out, F.array(line)))

    return clean_text(F.array_join(F.aggregate(F.split(clean_text(c), "\n"), F.array().cast("array<string>"), step), "\n"))


def title_from_lines(c: Column) -> Column:
    """The line of a recognised text that looks most like a title, at most 60 characters; null if none does."""
    lines = F.filter(F.transform(F.split(clean_text(c), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def rated(line: Column, i: Column) -> Column:
        letters, digits = F.length(F.regexp_replace(line, "[^A-Za-z]", "")), F.length(F.regexp_replace(line, "[^0-9]", ""))
        words = F.size(F.split(line, r"\s+"))
        fits = (letters >= 4) & words.between(2, 12) & ~line.rlike(r"^\d{1,2}:\d{2}") & ~line.rlike(r"(?i)^(\d+%|5g|4g|lte|wifi)$") & (digits <= letters) & ~line.rlike("(?i)^(page|menu|search|login|sign in|home)$")
        score = words * 1.2 + F.least(letters, F.lit(40)) / 10 + F.when(line.rlike("[A-Z][a-z]+ [A-Z][a-z]+"), 1.5).otherwise(0.0) - digits * 0.5 + F.greatest(F.lit(0.0), 3 - i * 0.4)
        return F.when(fits, F.struct(F.round(score, 9).alias("score"), (-i).alias("first"), line.alias("line")))

    best = F.array_max(F.filter(F.transform(lines, rated), lambda x: x.isNotNull()))["line"]
    best = F.regexp_replace(F.regexp_replace(best, "[|•·]+$", ""), r"\s+$", "")
    return F.when(F.length(best) > 60, F.concat(F.regexp_replace(F.substring(best, 1, 57), r"\s+$", ""), F.lit("…"))).otherwise(best)
