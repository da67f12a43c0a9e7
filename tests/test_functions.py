from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import entities as E
from millrace.functions import routing as R
from millrace.functions import text as T


def value(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("parking", "park"), ("classes", "class"), ("series", "sery"), ("boxes", "box"), ("stories", "story"), ("washing", "wash"), ("speed", "spe"), ("houses", "house"), ("booked", "book"), ("bus", "bus"), ("status", "status"), ("glass", "glass"), ("ties", "ties"), ("king", "king"), ("bring", "bring")])
def test_stem(spark, word, stem):
    assert value(spark, T.stem(F.col("w")), w=word) == stem


def test_clean_and_tokens(spark):
    assert value(spark, T.clean_text(F.col("s")), s="\r\n a  b \n\n\n\n“c” – it’s \t") == "a b\n\n\"c\" - it's"
    assert value(spark, T.tokens(F.col("s")), s="Crème-Brûlée isn't ２nd ﬁne ß!") == ["creme-brulee", "isn't", "2nd", "fine"]
    assert value(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, T.content_tokens(F.col("s")), s="What is the cheap flight? a") == ["cheap", "flight"]


def test_sentences_and_truncate(spark):
    assert value(spark, T.sentences(F.col("s")), s="Hello there. Next one! 3 more\nline two. lower") == ["Hello there.", "Next one!", "3 more", "line two. lower"]
    assert value(spark, T.truncate(F.col("s"), 6), s="abcd efgh") == "abcd…"
    assert value(spark, T.truncate(F.lit(None).cast("string"), 6)) == ""


def test_dates_and_sizes(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = at("2026-07-01 00:00:00")
    ages = {"2026-07-02 00:00:00": "today", "2026-06-30 00:00:00": "yesterday", "2026-06-20 00:00:00": "11 days ago", "2026-06-01 00:00:00": "1 month ago", "2024-07-01 00:00:00": "2 years ago"}
    for when, said in ages.items():
        assert value(spark, T.relative_date(at(when), now)) == said
    assert [value(spark, T.format_bytes(F.lit(n))) for n in (5, 2048, 3 * 1024 * 1024)] == ["5 B", "2 KB", "3.0 MB"]


def test_wrapped_lines_and_title(spark):
    assert value(spark, T.join_wrapped_lines(F.col("s")), s="Meet me at the\nstation. Then go\nHome") == "Meet me at the station. Then go\nHome"
    assert value(spark, T.title_from_lines(F.col("s")), s="12:30\nCheap Flights Express\nR1 289 call 071 555 0199") == "Cheap Flights Express"
    assert value(spark, T.title_from_lines(F.col("s")), s="12:30") is None


def test_snippet_and_coverage(spark):
    body = "x " * 50 + "the battery died " + "y " * 300
    assert "battery" in value(spark, T.snippet(F.col("s"), F.array(F.lit("battery"))), s=body)
    assert value(spark, T.term_coverage(F.array(F.lit("flights"), F.lit("cheap")), F.array(F.lit("flight")))) == 0.5
    assert value(spark, T.term_coverage(F.array().cast("array<string>"), F.array(F.lit("flight")))) == 0.0


def test_pattern_entities(spark):
    text = 'Pay R1 289 or R456.90 or R5, call +27 71 555 0199 at 9:05 on 3rd March 2025 or 2025-04-01 (Sat). Claim: CLM448120 "no entry" see www.foo.co.za/x or a.b@c.dev'
    found = {(e["type"], e["value"], e["label"]) for e in value(spark, E.pattern_entities(F.col("s")), s=text)}
    assert {("money", "R1289", "R1 289"), ("money", "R456.9", "R456.90"), ("phone", "0715550199", "071 555 0199"), ("time", "09:05", "09:05"), ("date", "2025-03-03", "3 March 2025"), ("date", "2025-04-01", "2025-04-01"), ("weekday", "sat", "sat"), ("reference", "CLM448120", "CLM448120"), ("quote", "no entry", "no entry"), ("website", "www.foo.co.za", "www.foo.co.za/x"), ("email", "a.b@c.dev", "a.b@c.dev")} <= found
    assert not any(k == "money" and v == "R5" for k, v, _ in found)
    assert value(spark, E.pattern_entities(F.lit(None).cast("string"))) == []


def test_names():
    assert E.extract_names("Ask Thabo Mokoena about it.\nFaizel Motors phoned. Lerato's bag.") == ["Thabo Mokoena", "Faizel Motors", "Lerato"]
    assert E.extract_names("Monday Evening is here") == []


def test_routing(spark):
    q = "What was that website with the cheap flights I found?"
    assert value(spark, R.query_terms(F.col("q")), q=q) == ["website", "cheap", "flights"]
    assert value(spark, R.expansions(F.col("q")), q=q) == ["site", "web page", "web address", "link", "affordable", "budget"]
    assert value(spark, R.intent(F.col("q")), q=q) == "question"
    assert value(spark, R.sources(F.lower(F.col("q"))), q=q) == ["Chrome"]


@pytest.mark.parametrize(("q", "start", "label"), [("in 2024?", "2024-01-01", "in 2024"), ("notes of december", "2025-12-01", "in december"), ("yesterday", "2026-05-30", "yesterday"), ("today", "2026-05-31", "today"), ("three months ago", "2026-02-16", "3 months ago"), ("this year", "2026-01-01", "this year"), ("hello", None, None)])
def test_period(spark, q, start, label):
    found = value(spark, R.period(F.col("q"), F.lit(datetime(2026, 5, 31))), q=q)
    assert (found and (str(found["since"].date()), found["label"])) == (start and (start, label))


@pytest.mark.parametrize(
    ("text", "terms", "want"),
    [
        ("Saturday is a day, SATURDAY!", ["saturday", "day"], [(0, 8), (14, 17), (19, 27)]),
        ("aaaaa b", ["aa"], [(0, 4)]),
        ("battery", ["bat", "ter"], [(0, 6)]),
        ("a+b (c) a+b", ["a+b", "(c)"], [(0, 3), (4, 7), (8, 11)]),
        ("Crème brûlée", ["creme", "e"], [(0, 5)]),
        ("nothing", ["x1", ""], []),
        ("", ["ab"], []),
        (None, ["ab"], []),
        ("some", [], []),
        ("xyxy", ["xy", "xy"], [(0, 4)]),
    ],
)
def test_highlight_ranges(spark, text, terms, want):
    df = spark.createDataFrame([(text, terms)], "s string, t array<string>")
    got = df.select(T.highlight_ranges(F.col("s"), F.col("t")).alias("r")).first()["r"]
    assert [(r["start"], r["end"]) for r in got] == want


def test_display_lines(spark):
    body = " ".join(f"Sentence number {i} is long enough to show." for i in range(9)) + " Short one. " + "Long " * 60 + "end."
    assert value(spark, T.display_lines(F.col("s")), s=body) == [f"Sentence number {i} is long enough to show." for i in range(6)]
    assert value(spark, T.display_lines(F.lit(None).cast("string"))) == []
