"""Entities of a text: patterns as Column expressions, names of people and organisations by an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import END, START, STOPWORDS, clean_text, let

ENTITY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "value", "label", "key")]))

# Patterns of entities.
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
PHONE = r"(?:\+27[\s-]?|0)(\d{2})[\s-]?(\d{3})[\s-]?(\d{4})"
MONEY = r"R\s?(\d{1,3}(?:[ ,]\d{3})+|\d{2,6})(?:\.(\d{2}))?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
WEBSITE = r"((?:[a-z0-9-]+\.)+(?:co\.za|com|org|net|gov\.za|io|za|dev|app))(?:\.)?(/[^\s,;)\"']*)?"
TIME = r"(?:[01]?\d|2[0-3]):[0-5]\d"
DATE = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?\s*(\d{{4}})?"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
WEEKDAY = "(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|sday|nesday|rsday|urday)?"
REFERENCE = r"(?:ref(?:erence)?|booking|claim|policy|invoice|waybill|ticket)"
REFERENCE_CODE = r"[^A-Za-z0-9]{0,14}([A-Z]{2,4}[0-9][A-Z0-9]{2,6})"
QUOTE = '"([^"\n]{3,60})"'
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

# Everyday words that are no names when they stand capitalised.
COMMON_WORDS = """
car cars service services booking bookings confirmation confirmed reminder reminders
grocery groceries shopping basket till total change cash card
wifi password network internet data bundle router
guests guest visitor visitors people person someone somebody anyone
winter summer autumn spring season sale sales
stage evening morning afternoon night tonight
series show shows movie film book books song album podcast
sorry thanks thank hello hey hi yes no okay ok please
reminder update notice alert message messages chat chats
ready open closed pending paid unpaid due overdue
tip note item items quantity qty price prices amount
your mine ours theirs his hers
""".split()
# Given names that stand alone.
FIRST_NAMES = """
thabo lerato sipho naledi zanele pieter denzel faizel kurt aisha naidoo mokoena ndlovu
thandiwe jabulani mandla anele bongani siphiwe tshepo katlego lebogang
peter john mary paul sarah david michael james daniel emma linda grace
hendrik johannes morne jacques riaz fatima yusuf
""".split()
# Verbs before a name.
LEADING_VERBS = """
ask call text sms email tell meet see contact phone whatsapp message remind thank
join visit pay send get give use try bring buy book order check print sign fetch
keep add remove move show share forward reply confirm cancel please
""".split()
# Words of organisations.
ORG_WORDS = """
computers plumbing hardware air airlines airlink flysafair motors traders hyper express
studio studios bank group holdings pty ltd inc pharmacy spar checkers discovery sanlam mica
mall school clinic hospital reserve nursery fuel tyres autos centre center garage
""".split()
ORG_END = re.compile(r"(?i)(computers|plumbing|hardware|airlines?|bank|studio|express|pty|ltd|mall|school|clinic)$")
# Words for days, months and streets, which no name holds.
CALENDAR_AND_PLACES = """
today tomorrow yesterday tonight week month year monday tuesday wednesday thursday friday saturday sunday
january february march april june july august september october november december
level bay lift block unit flat road street avenue lane drive place hill court park gate
""".split()
NAME_STOPWORDS = frozenset(STOPWORDS) | frozenset(CALENDAR_AND_PLACES)


def _entity(kind: str, value: Column, label: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), label.alias("label"), F.concat(F.lit(f"{kind}:"), label).alias("key"))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _three(text: Column, pattern: str) -> Column:
    """Groups 1 to 3 of every match, side by side."""
    return F.arrays_zip(_all(text, pattern, 1).alias("a"), _all(text, pattern, 2).alias("b"), _all(text, pattern, 3).alias("c"))


def _two(text: Column, pattern: str) -> Column:
    return F.arrays_zip(_all(text, pattern, 1).alias("a"), _all(text, pattern, 2).alias("b"))


def phones(t: Column) -> Column:
    part = lambda m, sep: F.concat(F.lit("0"), m["a"], F.lit(sep), m["b"], F.lit(sep), m["c"])
    return F.transform(_three(t, PHONE + END), lambda m: _entity("phone", part(m, ""), part(m, " ")))


def money(t: Column) -> Column:
    whole = lambda m: F.regexp_replace(m["a"], "[ ,]", "").cast("bigint")
    cents = lambda m: F.coalesce(m["b"], F.lit(""))
    value = lambda m: F.concat(F.lit("R"), whole(m).cast("string"), F.regexp_replace(F.regexp_replace(F.concat(F.lit("."), cents(m)), "0+$", ""), r"\.$", ""))
    label = lambda m: F.concat(F.lit("R"), F.replace(F.format_number(whole(m), 0), F.lit(","), F.lit(" ")), F.when(cents(m) != "", F.concat(F.lit("."), cents(m))).otherwise(""))
    found = F.filter(_two(t, START + MONEY + END), lambda m: whole(m) >= 10)
    return F.transform(found, lambda m: _entity("money", value(m), label(m)))


def emails(t: Column) -> Column:
    return F.transform(_all(t, START + EMAIL + END), lambda m: _entity("email", F.lower(m), F.lower(m)))


def websites(t: Column) -> Column:
    host = lambda m: F.lower(m["a"])
    found = F.filter(_two(t, "(?i)" + START + WEBSITE), lambda m: ~host(m).rlike("^[0-9]"))
    return F.transform(found, lambda m: _entity("website", host(m), F.concat(host(m), F.coalesce(m["b"], F.lit("")))))


def times(t: Column) -> Column:
    return F.transform(_all(t, START + TIME + END), lambda m: _entity("time", F.lpad(m, 5, "0"), F.lpad(m, 5, "0")))


def dates(t: Column) -> Column:
    """Dates with a month's name, then ISO dates; a missing year is written as question marks."""
    month = lambda m: (F.position(F.substring(F.lower(m["b"]), 1, 3), F.lit(MONTHS)) + 3) / 4
    iso = lambda m: F.concat_ws("-", F.when(F.coalesce(m["c"], F.lit("")) == "", "????").otherwise(m["c"]), F.lpad(month(m).cast("int").cast("string"), 2, "0"), F.lpad(m["a"].cast("int").cast("string"), 2, "0"))
    label = lambda m: F.concat(m["a"], F.lit(" "), m["b"], F.when(F.coalesce(m["c"], F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), m["c"])))
    named = F.filter(_three(t, "(?i)" + START + DATE + END), lambda m: m["a"].cast("int").between(1, 31))
    return F.concat(F.transform(named, lambda m: _entity("date", iso(m), label(m))), F.transform(_all(t, START + ISO_DATE + END), lambda m: _entity("date", m, m)))


def weekdays(t: Column) -> Column:
    short = lambda m: F.lower(F.substring(m, 1, 3))
    return F.transform(_all(t, "(?i)" + START + WEEKDAY + END), lambda m: _entity("weekday", short(m), short(m)))


def references(t: Column) -> Column:
    return F.transform(_all(t, "(?i)" + START + REFERENCE + END + REFERENCE_CODE + END, 1), lambda m: _entity("reference", F.upper(m), F.upper(m)))


def quotes(t: Column) -> Column:
    return F.transform(_all(t, QUOTE, 1), lambda m: _entity("quote", m, m))


PATTERNS = {"phone": phones, "money": money, "email": emails, "website": websites, "time": times, "date": dates, "weekday": weekdays, "reference": references, "quote": quotes}


def distinct_entities(array: Column) -> Column:
    """The first entity of each key, in order."""
    both = lambda a: F.struct(a.alias("all"), F.transform(a, lambda e: e["key"]).alias("keys"))
    first = lambda x: F.filter(x["all"], lambda e, i: F.array_position(x["keys"], e["key"]) == i + 1)
    return let(array, lambda a: let(both(a), first))


def pattern_entities(text: Column, kinds: list[str] | None = None) -> Column:
    """All entities of the given kinds (by default every pattern) in a text, each key once."""
    found = lambda t: F.concat(*[f(t) for k, f in PATTERNS.items() if kinds is None or k in kinds])
    return distinct_entities(let(clean_text(F.coalesce(text, F.lit(""))), found))


def extract_names(text: str, blocked: frozenset[str] = NAME_STOPWORDS) -> list[str]:
    """Capitalised runs of two or three words that may be people or organisations, and single known given names; longest first.

    ``blocked`` are words that no person's name holds; a run with a word of an organisation is kept all the same.
    """
    found: dict[str, str] = {}
    no_names = blocked | set(COMMON_WORDS)

    def take(run: list[str]) -> None:
        while len(run) > 1 and run[0].lower() in LEADING_VERBS:
            run = run[1:]
        lower = [w.lower() for w in run]
        if len(run) == 1:
            word = re.sub("(?i)['’]s$", "", run[0])
            if word.lower() in FIRST_NAMES and word.lower() not in no_names:
                found.setdefault(word.lower(), word)
        elif run and (any(w in ORG_WORDS for w in lower) or not any(w in no_names for w in lower)):
            phrase = re.sub(r"[^\w'\- ]", "", " ".join(run)).strip()
            found.setdefault(phrase.lower(), phrase)

    for line in text.split("\n"):
        run: list[str] = []
        for part in line.split():
            word = re.sub(r"^[\W_]+|[^\w'\-]+$", "", part)
            capital = bool(re.fullmatch(r"[A-Z][a-z'\-]+|[A-Z]{2,5}", word))
            if capital:
                run.append(word)
            if not capital or part[-1] in ".!?,;:" or len(run) == 3:
                take(run)
                run = []
        take(run)
    return sorted(found.values(), key=lambda p: -len(p))


@F.pandas_udf(ENTITY)
def name_entities(texts: pd.Series) -> pd.Series:
    """Names and organisations of cleaned texts."""

    def one(text: str | None) -> list[dict]:
        out = []
        for phrase in extract_names(text or ""):
            kind = "org" if ORG_END.search(phrase) else "name"
            out.append({"type": kind, "value": phrase, "label": phrase, "key": f"{kind}:{phrase}"})
        return out

    return texts.map(one)


def phone_key(c: Column) -> Column:
    """The last nine digits, or all where there are fewer."""
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(9))


def identity(e: Column) -> Column:
    """What makes two entities the same: a phone's last digits, a site without www., other values as they are or in lower case."""
    kind, value = e["type"], e["value"]
    return F.concat(
        kind, F.lit(":"),
        F.when(kind == "phone", phone_key(value)).when(kind == "website", F.lower(F.regexp_replace(value, r"^www\.", "")))
        .when(kind.isin("money", "date", "time"), value).otherwise(F.lower(value)),
    )
