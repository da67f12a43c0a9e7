"""Questions over a small library of own memories: what the headline and what the citations must hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import entities as E
from millrace.functions import routing as R
from millrace.functions import text as T
from millrace.operators import answers, store
from millrace.operators.hybrid import HybridRanking

NOW = datetime(2026, 5, 20)
_MEMORIES = "doc_id bigint, title string, body string, kind string, source string, captured_at timestamp, location string, text_source string, ocr_confidence double"
LIBRARY = [
    (1, "Wifi at the cottage", "Welcome to the cottage.\nWifi network: Seagull\nPassword: Heron#4417", "note", "Notes", datetime(2026, 3, 1), "Hermanus", "provided", None),
    (2, "Electrician for the oven", "The oven trips the mains again. Willem Strydom comes before Friday, 083 555 0142.\nHe asked R950 for the repair.", "message", "WhatsApp", datetime(2026, 4, 2), None, "provided", None),
    (3, "Chat with Anele Dube", "Anele Dube told me to ask for Willem Strydom, he fixed their stove in a day.\nThen we spoke of the choir.", "message", "WhatsApp", datetime(2026, 3, 30), None, "provided", None),
    (4, "Optician appointment", "Your eye test with the optician is on Tuesday at 14:30 to 15:00, Long Street branch.", "message", "Messages", datetime(2026, 5, 1), "Cape Town", "provided", None),
    (5, "Till slip Greenfields market", "Bread R32\nCheese R118.50\nTOTAL R389.75\nThank you for shopping at Greenfields market", "photo", "Camera", datetime(2026, 2, 11), "Greenfields", "ocr", 91.5),
    (6, "Bike insurance claim", "Your claim for the stolen bike was received. Claim reference CLX77821 is open until the end of the month.", "email", "Gmail", datetime(2026, 1, 9), None, "provided", None),
    (7, "What to watch", "Palesa says we should watch Northern Lights before the finale comes out next week.", "note", "Notes", datetime(2025, 12, 3), None, "provided", None),
    (8, "Second-hand tents", "Saved page with used tents and camping gear, see www.tentfinder.co.za/used for prices from R700.", "page", "Chrome", datetime(2025, 11, 20), None, "provided", None),
]
CASES = [
    ("what is the wifi password at the cottage?", "secret", "Heron#4417", "cottage"), ("what is the electrician's number for the oven?", "contact", "083 555 0142", "oven"),
    ("who recommended that electrician Willem Strydom?", "person", "Willem Strydom — mentioned by Anele Dube", "told me to ask for Willem Strydom"), ("when is my optician appointment?", "answer", "Tue 14:30 – 15:00 — Optician appointment", "eye test"),
    ("how much did I spend at the market?", "amount", "R389.75 — Till slip Greenfields market", "Cheese R118.50"), ("what is the reference of the bike insurance claim?", "reference", "CLX77821", "stolen bike"),
    ("which series did Palesa tell me to watch?", "answer", "Northern Lights — What to watch", "finale"), ("what was the website with the used tents?", "website", "www.tentfinder.co.za", "camping gear"),
    ("whose number is 083 555 0142?", "contact", "083 555 0142 — Willem Strydom", "oven"),
]


@pytest.fixture(scope="module")
def answered(spark):
    rows = spark.createDataFrame(LIBRARY, _MEMORIES).withColumn("text", store.search_text(title=F.col("title"), body=F.col("body"), source=F.col("source")))
    docs = store.finish(rows, "doc_id", ["title", "body"])
    asked = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CASES)] + [(100, ""), (101, None)], "query_id bigint, question string")
    r, found = R.route(F.col("question")), F.concat(E.pattern_entities(F.col("question")), E.name_entities(T.clean_text(F.col("question"))))
    asked = asked.select("query_id", r["raw"].alias("raw"), r["terms"].alias("terms"), found.alias("entities")).withColumn("identities", F.transform("entities", E.identity))
    ranked = HybridRanking(docs, F.lit(NOW), E.identity).top(asked, bridged=True)
    return {row["query_id"]: row for row in answers.compose(ranked, asked, docs, F.lit(NOW)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_answer(answered, i):
    _, kind, headline, cited = CASES[i]
    got = answered[i]
    context = "\n".join([*(f"{b['text']} {b['title']}" for b in got["bullets"]), *(f"{e['title']} {e['quote']}" for e in got["evidence"])])
    assert got["kind"] == kind and headline in got["headline"] and cited in context
    assert len(got["bullets"]) <= 4 and len(got["evidence"]) <= 3 and 0 <= got["confidence"] <= 1
    # the sentence that a headline cites may come again as the best one of its memory
    assert len({b["text"] for b in got["bullets"]}) >= len(got["bullets"]) - (kind == "person")


def test_answer_details(answered):
    assert "Read from the image (91.5% confidence)." in answered[4]["notes"] and answered[1]["trail"][0] == "phone: 083 555 0142"
    assert any(r.startswith("matches phone") for e in answered[8]["evidence"] for r in e["reasons"])
    assert set(answered) == {*range(len(CASES)), 100, 101}


def test_nothing_found(spark):
    none = spark.createDataFrame([], _MEMORIES + ", text string")
    docs = store.finish(none, "doc_id", ["title", "body"])
    asked = spark.createDataFrame([(1, "any idea?", ["idea"])], "query_id bigint, raw string, terms array<string>").withColumn("entities", F.array().cast(E.ENTITY))
    (row,) = answers.compose(HybridRanking(docs, F.lit(NOW), E.identity).top(asked), asked, docs, F.lit(NOW)).collect()
    assert row["kind"] == "empty" and row["bullets"] == row["evidence"] == row["trail"] == row["notes"] == [] and row["confidence"] == 0
