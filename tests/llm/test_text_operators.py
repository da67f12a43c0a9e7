import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import leakage, lookalike, mixing, ocr_repair, pii, shared_spans
from millrace.llm.boosting import BoostedTrees, best_threshold
from millrace.llm.shared_spans import RUN, SPAN, SharedSpans, piece_starts
from tests.conftest import rows

# ---- problem 1

_TEXTS = "note_id bigint, body string, form string, raw string"


def test_lookalike_pairs(spark):
    texts = {1: "the office café", 2: "thе оffice café", 3: "the oﬃce café", 4: "the off​ice café", 5: "the office cafe", 6: "The office café", 7: "the office café", 8: "", 9: None, 10: "ｔｈｅ office café", 11: "the offlce café"}
    df = spark.createDataFrame([(i, t, "f", None) for i, t in texts.items()] + [(2, texts[2], "again", "r"), (None, texts[1], None, None)], _TEXTS)
    table = lookalike.learn_rewrites([(df, "body")])
    same = [1, 2, 3, 4, 7, 10]
    want = [(a, b) for a in same for b in same if a < b and texts[a] != texts[b]]
    assert rows(lookalike.lookalike_pairs(df, "note_id", "body", table)) == want
    forms = {r["note_id"]: r["canonical"] for r in lookalike.canonical_text(df.where("note_id IS NOT NULL"), "body", table=table).collect()}
    assert {forms[i] for i in same} == {"the office café"} and forms[8] == "" and forms[9] is None and forms[11] == texts[11]
    empty = spark.createDataFrame([], _TEXTS)
    assert rows(lookalike.lookalike_pairs(empty, "note_id", "body", lookalike.learn_rewrites([(empty, "body")]))) == []


def test_lookalikes_of_many_scripts(spark):
    """Latin, Cyrillic, Greek, Armenian, Cherokee, Arabic, Japanese, Chinese: what is drawn alike is one, what isn't stays apart."""
    same = [("scope", "ѕсоре"), ("TAXI", "ΤΑΧΙ"), ("son", "ѕօո"), ("VAT", "ᏙᎪᎢ"), ("vigour", "νigour"), ("Henry VIII", "Henry Ⅷ"), ("code", "𝖼𝗈𝖽𝖾"), ("x1", "𝚡𝟷"), ("سلام", "ﺳﻼم"), ("ガイド", "ｶﾞｲﾄﾞ"), ("大人", "⼤⼈"), ("Пять", "Πять"), ("go", "ɡo")]
    other = [("bold", "𝐛old"), ("1st", "lst"), ("a", "á"), ("шт", "wt"), ("π", "n"), ("ي", "ى")]
    data = [(2 * i + j, t, None, None) for i, p in enumerate(same + other) for j, t in enumerate(p)]
    df = spark.createDataFrame(data + [(1000 + i, "the plain code of taxis has vigour and scope for every son who goes on " * 3, None, None) for i in range(3)], _TEXTS)
    table = lookalike.learn_rewrites([(df, "body")])
    assert rows(lookalike.lookalike_pairs(df, "note_id", "body", table)) == [(2 * i, 2 * i + 1) for i in range(len(same))]
    assert rows(lookalike.lookalike_groups(df, "note_id", "body", table)) == sorted((2 * i + j, 2 * i, 1) for i in range(len(same)) for j in (0, 1))


def test_lookalike_representative_follows_frequency():
    assert lookalike.rewrites({"о": 9, "o": 2})["o"] == "о"
    assert lookalike.rewrites({"о": 1, "o": 2})["о"] == "o"
    table = lookalike.rewrites({})
    automaton = lookalike._automaton(table)
    long = "аbс​" * 20_000
    assert lookalike.rewrite(long, automaton) == "abc" * 20_000
    once = lookalike.rewrite("ﬃ е́ ｅ́ l1I", automaton)
    assert once == "ffi é é l1I" == lookalike.rewrite(once, automaton)


def test_numerals_are_spelt_out(spark):
    df = spark.createDataFrame([(1, "LUDOVICA Ⅷ é"), (2, "LUDOⅥCA ⅧI é"), (3, "LUDOVICA VIII é"), (4, "plain II, III and XIV"), (5, "ⅡI, ⅠⅠⅠ and III")], "id bigint, body string")
    table = lookalike.learn_rewrites([(df, "body")])
    assert not any(m.isascii() for m in table)
    forms = {r["id"]: r["canonical"] for r in lookalike.canonical_text(df, "body", table=table).collect()}
    assert forms == {1: "LUDOVICA VIII é", 2: "LUDOVICA VIIII é", 3: "LUDOVICA VIII é", 4: "plain II, III and XIV", 5: "III, III and III"}
    assert rows(lookalike.lookalike_pairs(df, "id", "body", table)) == [(1, 3)]
    many = lookalike.rewrites({"Ⅰ": 9, "I": 2, "V": 5})  # the letters of a numeral follow their own classes
    assert lookalike.rewrite("Ⅵ VI", lookalike._automaton(many)) == "VⅠ VⅠ"


# ---- problem 5


def scan(i, body, album="Scan 1", title="House rules 1", name=None):
    lines = [(t, [24, 40 + 30 * k, 24 + 9 * len(t), 62 + 30 * k] if k % 5 else None, 90) for k, t in enumerate(x for x in (body or "").split("\n") if x.strip())]
    return (i, album, name or f"scan-1-{i:02}.png", title, body, "ocr", 0, lines if i % 3 else None)


_SCANS = "memory_id bigint, album string, name string, title string, body string, word string, line int, ocr_lines array<struct<t: string, b: array<int>, c: int>>"
_CLEAN = "visitors should carry a sturdy lantern and the well-worn coat in the morning\n" * 6


def scanned(spark, data):
    clean = [(100 + i, "x", f"note{i}", None, _CLEAN + "carry carrying well-worn check-in", None, None, None) for i in range(5)]
    return ocr_repair.ScannedPages(spark.createDataFrame(data + clean, _SCANS), F.col("name").startswith("scan-"))


def test_scanned_defects_and_paragraphs(spark):
    page = "House rules   {}\nVisitors should carry a stur-\ndy lantern and the well-\nworn coat in the morn1ng.\n\nVisitors shoulcl carry a lantern in the morning\nand the coat.\nPage {}"
    data = [scan(i, page.format(i, i)) for i in range(1, 9)]
    data += [data[0], scan(20, None), scan(21, ""), scan(22, "\n\n"), scan(23, "Visitors should carry a lantern.", None, None), (None, None, "scan-9", None, "lost", None, None, None)]
    pages = scanned(spark, data)
    got = [r for r in rows(pages.defects()) if r[0] == 1]
    assert got == [(1, 1, "header"), (1, 2, "hyphen"), (1, 4, "misread"), (1, 5, "misread"), (1, 8, "page_number")] or got == [(1, 1, "header"), (1, 2, "hyphen"), (1, 4, "misread"), (1, 5, "misread"), (1, 7, "page_number")]
    text = {r[0]: r[1] for r in pages.paragraphs().collect()}
    assert text[1] == "Visitors should carry a sturdy lantern and the well-worn coat in the morning.\n\nVisitors should carry a lantern in the morning and the coat."
    assert text[21] == "" and 20 not in text
    assert not [r for r in pages.defects().collect() if r[0] == 23]


def test_words_misread_at_their_ends(spark):
    clean = [(100 + i, "x", f"note{i}", None, "keeps the wall of soil keep wa so keep wa so f (at cat that find th f keep!\n" * 6, None, None, None) for i in range(5)]
    data = [scan(1, "Page about keep5 here\nand (at the wa11\n0f so!| again\nnow th@+ is keep!")]
    pages = ocr_repair.ScannedPages(spark.createDataFrame(data + clean, _SCANS), F.col("name").startswith("scan-"))
    want = {"keep5": "keeps", "wa11": "wall", "0f": "of", "so!|": "soil", "th@+": "that"}
    assert {r["word"]: r["correction"] for r in pages.misread(pages.decoded()).collect()} == want
    assert {r["line_no"] for r in pages.defects().where("defect = 'misread'").collect()} == {1, 2, 3, 4}


def test_known_words_are_a_share_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ocr_repair, "KNOWN_IN", 10)
    clean = [(100 + i, "x", f"note{i}", None, "the modem lantern" + " modern" * 4 + " lantem" * (i < 3), None, None, None) for i in range(100)]
    pages = ocr_repair.ScannedPages(spark.createDataFrame([scan(1, "A lantem and a modem")] + clean, _SCANS), F.col("name").startswith("scan-"))
    assert {r["word"]: r["correction"] for r in pages.misread(pages.decoded()).collect()} == {"lantem": "lantern"}


def test_scanned_empty(spark):
    pages = ocr_repair.ScannedPages(spark.createDataFrame([], _SCANS), F.col("name").startswith("scan-"))
    assert rows(pages.defects()) == [] and rows(pages.paragraphs()) == []


def test_words_misread_at_any_length(spark):
    long, many = "antidisestablishmentarianismconsiderations", "individualistically"
    seen = long.replace("s", "5").replace("i", "1"), many.replace("i", "!"), "c0nsiclerati0ri5"
    clean = [(100 + i, "x", f"note{i}", None, f"{long} {many} considerations loam " * 6, None, None, None) for i in range(5)]
    data = [scan(1, f"The {seen[0]} and\nthe {seen[1]} of\n{seen[2]} at 10am\n and stay")]
    pages = ocr_repair.ScannedPages(spark.createDataFrame(data + clean, _SCANS), F.col("name").startswith("scan-"))
    assert {r["word"]: r["correction"] for r in pages.misread(pages.decoded()).collect()} == dict(zip(seen, (long, many, "considerations")))


def test_word_broken_at_a_sheets_end(spark):
    data = [scan(1, "House rules  1\nVisitors should carry a mor-"), scan(2, "House rules  2\nn1ng coat and a lantern.", name="scan-1-02.png"), scan(3, "House rules  3\nmorning.", name="scan-1-03.png"), scan(4, "House rules  2\nzeal.", name="scan-1-02.png")]
    pages = scanned(spark, data)
    assert (1, 2, "hyphen") in rows(pages.defects())
    text = {r[0]: r[1] for r in pages.paragraphs().collect()}
    assert text[1] == "Visitors should carry a morning"


def test_box_features():
    body = "A title\nfirst line of text\nsecond line of text\n7"
    boxes = [([200, 10, 260, 50], 95), ([20, 80, 200, 100], 92), ([20, 110, 210, 130], 60), (None, None)]
    got = [dict(f) for f in ocr_repair.layout(body, None, set(), boxes)]
    assert [g["bi"] for g in got] == ["high", "usual", "usual", "?"] and [g["bh"] for g in got] == ["high", "usual", "usual", "?"]
    assert [g["bg"] for g in got][1:] == ["usual", "low", "?"] and [g["bc"] for g in got] == ["high", "high", "low", "?"]
    assert {g["bi"] for g in map(dict, ocr_repair.layout(body, None, set(), boxes[:2]))} == {"?"}


def test_misreads():
    read = {"uncler": "under", "w@rm": "warm", "arc1iived": "archived", "smce": "since", "clrnmlliivvcl": "clrnmlliivvd"}
    assert all(ocr_repair.misreads(a, b) for a, b in read.items())
    assert not ocr_repair.misreads("under", "under") and not ocr_repair.misreads("a1111111b", "ab") and not ocr_repair.misreads("clclcl", "dddddd"[:3] + "x")


# ---- problem 6

_GIVEN = "Brivandel Oyinkans Marutela Tsidelo Kaelwyn Zofimara Hedrunel Iskavya".split()  # no table holds them
_SURNAMES = "Dutalozile Klandrivel Vornemaved Brefendorp Gelkolepoul Hansivorde".split()


def letters(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        who = f"{rng.choice(_GIVEN)} {rng.choice(_SURNAMES)}"
        phone = f"0{rng.randint(10, 89)} 555 {rng.randint(1000, 9999)}"
        mail = f"{rng.choice(_SURNAMES).lower()}{rng.randint(1, 99)}@example.test"
        house = f"{rng.randint(1, 200)} {rng.choice(['Quince', 'Plover', 'Weaver'])} {rng.choice(['Street', 'Rd', 'Lane'])}"
        number = f"{rng.randint(50, 99)}0{rng.randint(1, 9)}1{rng.randint(1, 9)}{rng.randint(1000000, 9999999)}"
        out.append((f"Ask {who} about the red coat, phone {phone} or write to {mail}. New tenant {who}, ID {number}, lives at {house} near Starling Cross. Order number {rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-1111-2222 came from Umdoni Heights.", {("name", who), ("phone", phone), ("email", mail), ("address", house), ("id_number", number)}))
    return out


def test_pii_on_held_out_letters():
    model = pii.Detector().fit([t for t, _ in letters(300, 1)])
    held = letters(100, 2)
    found = [{(k, t[a:b]) for k, a, b in spans} for (t, _), spans in zip(held, model.select([t for t, _ in held]))]
    hit = sum(len(f & w) for f, (_, w) in zip(found, held))
    assert hit / sum(len(w) for _, w in held) > 0.97 and hit / sum(map(len, found)) > 0.97


def test_pii_of_several_countries(spark):
    rng, phones, numbers = random.Random(4), ["+44 20 7946 {:04}", "(212) 555 {:04}", "212-555-{:04}", "06 12 34 5{} 78", "+1 415 555 {:04}", "030 1234{:04}"], ["{:03}-45-6789", "AB 12 34 {:02} C", "8001015{:03}087", "X{:07}"]
    text = lambda i: (f"Please call {phones[i % 6].format(rng.randint(1000, 9999) if i % 6 != 3 else rng.randint(1, 9))} about the red coat. Her passport {numbers[i % 4].format(rng.randint(10, 99) * 10 if i % 4 != 1 else rng.randint(10, 99))} is on the table. Order {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} came with serial {rng.randint(10**11, 10**12)}.")
    model = pii.Detector().fit([text(i) for i in range(300)])
    held = [text(i) for i in range(1000, 1060)]
    found = [sorted(k for k, _, _ in spans) for spans in model.select(held)]
    assert sum(f == ["id_number", "phone"] for f in found) >= 57


def test_pii_table(spark):
    model = pii.Detector().fit([t for t, _ in letters(300, 1)])
    text, want = letters(1, 3)[0]
    schema = "note_id bigint, body string, row_id string, kind string"
    data = [(1, text, "x", "y"), (1, text, "again", None), (2, None, None, None), (3, "", None, None), (None, text, None, None), (4, text.replace(" ", " "), None, None), (5, "word " * 30_000, None, None)]
    df = spark.createDataFrame(data, schema)
    got = rows(pii.find_pii(df, "note_id", "body", model))
    assert {(k, t) for i, k, t in got if i == 1} == want and len(got) == len(set(got))
    assert {(k, t.replace(" ", " ")) for i, k, t in got if i == 4} == want
    redacted = {r[0]: r[1] for r in pii.redact(df, "note_id", "body", model).collect()}
    assert "[NAME]" in redacted[1] and "[EMAIL]" in redacted[1] and "Order number" in redacted[1] and redacted[5] == "word " * 30_000
    empty = spark.createDataFrame([], schema)
    assert rows(pii.find_pii(empty, "note_id", "body", pii.learn(empty, "body"))) == []


def test_pii_words_of_all_texts(spark):
    plain = [(i, f"We meet at noon near the plover and we plover on {i}.") for i in range(100)]
    data = plain + [(1000 + i, t) for i, (t, _) in enumerate(letters(300, 1))] + [(5000, "Ask Plover Meet about it.")]
    df = spark.createDataFrame(data, "note_id bigint, body string")
    whole = pii.Detector().fit([t for _, t in data]).lower
    model = pii.learn(df, "body", sample=10)
    assert model.lower == whole and {"meet", "plover"} <= set(whole) and {"^" + g.lower() for g in _GIVEN} <= set(whole)
    # too many words to go out with the detector: each text gets its own
    parted = pii.learn(df, "body", sample=200, word_limit=0)
    held = pii.learn(df, "body", sample=200)
    assert held.words is None and parted.words is not None and len(parted.lower) < len(held.lower)
    want = rows(pii.find_pii(df, "note_id", "body", held))
    assert want and rows(pii.find_pii(df, "note_id", "body", parted)) == want
    assert rows(pii.redact(df, "note_id", "body", parted)) == rows(pii.redact(df, "note_id", "body", held))


def test_pii_does_not_depend_on_where_words_are_kept(spark):
    """Short forms of given names that only other texts show, and the words beside given names in lower case, count the same either way."""
    shown = [f"Yesterday {g} {s} came." for g in ("Thandolwazi", "Wilgorimo") for s in ("Krandovel", "Bosterim", "Vulkandi", "Drimostal", "Fendarit", "Golbaster")]
    asking = [f"Ask {g} {s} about it, {g} {s} knows." for g in ("Thando", "Wilgo", "Gorimo") for s in ("Krandovel", "Zelbastor", "Mondarel")]
    asking += ["we asked thandolwazi meeting notes and wilgorimo zelbastor.", "the krandovel, thandolwazi, came; meeting thandolwazi.", "a meeting of the meeting about meeting notes", "Notes of Thando' Mondarel.", "so thandolwazi meeting it is", "by wilgorimo notes, to it"]
    df = spark.createDataFrame(list(enumerate([t for t, _ in letters(300, 1)] + shown + asking)), "note_id bigint, body string")
    held, parted = pii.learn(df, "body", word_limit=10**6), pii.learn(df, "body", word_limit=0)
    assert held.words is None and parted.words is not None
    assert held.lower.short_given("thando") == parted.lower.short_given("thando") == 0.7
    assert held.odds == parted.odds and held.threshold == parted.threshold
    assert rows(pii.find_pii(df, "note_id", "body", parted)) == rows(pii.find_pii(df, "note_id", "body", held))
    for r in pii._texts(df, "note_id", "body", parted).collect():
        s = pii.shadow(r["text"])[0]
        assert pii.candidates(s, type(parted.lower)(r["words"] or ())) == pii.candidates(s, held.lower), s


def test_pii_sample_does_not_depend_on_the_number_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Detector, "fit", lambda self, texts, lower=None: seen.append(texts) or self)
    for n, times in ((79, 1), (79, 3), (80, 1)):  # 80 is twice the sample
        pii.learn(spark.createDataFrame([(f"Text {i % n} is short.",) for i in range(n * times)], "body string"), "body", sample=40)
    assert seen[0] == seen[1] and len(set(seen[0])) == 40 and len(set(seen[2]) - set(seen[0])) <= 1


def test_shadow_places():
    text = "a​b ｃе́"
    s, at = pii.shadow(text)
    assert s == "ab ce" and [text[i] for i in at[:-1]] == ["a", "b", " ", "ｃ", "е"]


def test_boosting():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    p = BoostedTrees().fit(x[:600], y[:600]).probability(x[600:])
    assert ((p > best_threshold(p, y[600:])) == y[600:]).mean() > 0.9
    assert BoostedTrees().fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


# ---- problem 7

_DOCS = "doc_id bigint, text string, item_id bigint, source string"
_ITEMS = "item_id bigint, passage string, text string, doc_id string"


def words(n, seed):
    return [f"w{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(n)]


def test_leaks(spark):
    p = words(25, 1)
    wrong = [*p[:8], "x", *p[9:]]
    docs = {1: f"so {' '.join(p)} end", 2: "So, " + "; ".join(p[3:16]).upper(), 3: " ".join(p[3:15]), 4: " ".join(wrong), 5: " ".join(words(13, 7)), 6: None, 7: "", 8: "y " * 50_000 + " ".join(p[12:25])}
    docs_df = spark.createDataFrame([(i, t, 5, None) for i, t in docs.items()] + [(1, docs[1], None, "again")], _DOCS)
    items = spark.createDataFrame([(1, " ".join(p), "t", "d"), (1, " ".join(p), None, None), (2, None, None, None), (3, "too short", None, None), (4, " ".join(words(13, 7)), None, None)], _ITEMS)
    assert rows(leakage.leaked_items(docs_df, items)) == [(1, 1), (2, 1), (4, 1), (5, 4), (8, 1)]
    best = {(r["doc_id"], r["item_id"]): (r["exact_words"], r["similar_words"], r["substituted"]) for r in leakage.item_overlaps(docs_df, items).collect()}
    assert best[4, 1] == (16, 25, 1) and best[1, 1] == (25, 25, 0)
    assert rows(leakage.leaked_items(spark.createDataFrame([], _DOCS), items)) == []
    assert rows(leakage.leaked_items(docs_df, spark.createDataFrame([], _ITEMS))) == []


@pytest.mark.parametrize("gap", range(1, 12))
def test_one_substituted_word_is_found(gap):
    p = words(13, 3)
    index = leakage.ItemIndex([(1, " ".join(p))], 13)
    assert index.hits(index.encode([*p[:gap], "other", *p[gap + 1 :]]))


# ---- problem 8


def mix_tables(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["red", "coat", "lantern", "morning"]) for _ in range(n))
    data = [(i, text(rng.randint(20, 200)), "big" if i % 3 else "mid", "x") for i in range(400)] + [(900 + i, text(60), "tiny", None) for i in range(5)]
    data += [data[0], (1000, None, "big", ""), (1001, "", "big", ""), (1002, "text", None, ""), (None, "text", "big", "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([(1, "big", 0.5, 2), (1, "mid", 0.3, 1), (1, "tiny", 0.2, 4), (2, "big", 0.7, 1), (2, "none", 0.3, 1), (3, "none", 1.0, 1), (4, "big", None, 1)], "mix_id bigint, source string, target_share double, max_repeats int")
    return docs, targets


def test_mixing(spark):
    docs, targets = mix_tables(spark)
    mixer = mixing.Mixer(docs)
    used = {(r["mix_id"], r["source"], r["doc_id"]): r["repeats"] for r in mixer.mixed(targets).collect()}
    most = {(r["mix_id"], r["source"]): r["max_repeats"] for r in targets.collect()}
    assert used and all(n <= most[m, s] for (m, s, _), n in used.items())
    shares = {(r["mix_id"], r["source"]): r for r in mixer.shares(targets).collect()}
    assert len(shares) == 7
    for source, want in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(shares[1, source]["actual_share"] - want) < 0.001
    assert [s for (m, s), r in shares.items() if m == 1 and r["limits"]] == ["tiny"]
    assert shares[2, "big"]["actual_share"] == 1.0 and shares[3, "none"]["tokens"] == 0 and shares[4, "big"]["tokens"] == 0
    assert rows(mixer.mixed(targets)) == rows(mixing.Mixer(docs).mixed(targets))


@pytest.mark.parametrize("block", [7, 64, 5_000])
def test_mixing_settles_tokens(spark, block):
    docs, targets = mix_tables(spark)
    mixer = mixing.Mixer(docs, params=mixing.MixParams(block=block, shard=4), size=1_500)
    quota = mixer.quotas([tuple(r) for r in targets.collect()])
    got = {(r["mix_id"], r["source"]): (r["tokens"], r["most_repeats"], r["max_repeats"]) for r in mixer.shares(targets).collect()}
    assert sum(n for n, _ in quota[1].values()) == 1_500
    assert all(got[m, s][0] == n and got[m, s][1] <= got[m, s][2] for m, q in quota.items() for s, (n, _) in q.items())


def test_mixing_empty(spark):
    docs, targets = mix_tables(spark)
    assert {r["tokens"] for r in mixing.Mixer(docs.limit(0)).shares(targets).collect()} == {0}
    assert rows(mixing.Mixer(docs).shares(targets.limit(0))) == []


def test_permutation():
    import numpy as np

    for n in (1, 2, 7, 100, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(out) == list(range(n))
        assert list(mixing.permuted(out, np.full(n, n), np.full(n, 12345), back=True)) == list(range(n))
    assert not math.isclose(0, float(np.abs(out - np.arange(n)).sum()))


# ---- problem 9


def prose(n, seed, marks=".,"):
    rng = random.Random(seed)
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + rng.choice([" ", " ", " ", f"{marks[0]} ", f"{marks[-1]} "])
    return out[:n]


def longest(a, b):
    best = 0
    for i in range(len(a)):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best


_SPANS = "doc_id bigint, text string, chars string, a int"


@pytest.mark.parametrize("marks", [".,", "  ", "xy"])
def test_shared_spans_against_brute_force(spark, marks):
    rng, docs = random.Random(len(marks) + ord(marks[0])), {}
    for i in range(40):
        docs[i] = prose(rng.randint(300, 900), i, marks)
    for i in range(40, 110):  # spans just long enough and just too short, cut anywhere
        source, n = docs[rng.randrange(40)], rng.choice([290, 298, 299, 300, 301, 310, 350])
        at = rng.randrange(max(1, len(source) - n + 1))
        docs[i] = prose(rng.randint(0, 200), 1000 + i, marks) + source[at : at + n] + prose(rng.randint(0, 200), 2000 + i, marks)
    docs[200], docs[201] = docs[0], docs[0]
    # two long shared spans on one diagonal with one character between them that differs
    left, right = prose(250, 1, marks), prose(250, 2, marks)
    docs[202], docs[203] = left + "1" + right, left + "2" + right
    data = [(i, t, "x", 1) for i, t in docs.items()] + [(0, docs[0], None, None), (300, None, None, None), (301, "", None, None), (302, "short", None, None)]
    got = set(rows(SharedSpans(spark.createDataFrame(data, _SPANS)).pairs()))
    want = {(a, b) for a in docs for b in docs if a < b and longest(docs[a], docs[b]) >= 300}
    assert got == want


def test_shares_and_deduplication(spark):
    sentence = [f"{prose(70, i, 'zz').replace('. ', 'a').strip().capitalize()}. " for i in range(30)]
    shared = "".join(sentence[:8])
    docs = {1: shared + "".join(sentence[10:14]), 2: "".join(sentence[14:18]) + shared, 3: "".join(sentence[20:28]), 4: shared + "".join(sentence[10:14]), 5: "".join(sentence[18:20]) + shared[:302] + "é" + sentence[28]}
    spans = SharedSpans(spark.createDataFrame([(i, t, None, None) for i, t in docs.items()], _SPANS))
    share = {r["doc_id"]: r["shared_chars"] for r in spans.shares().collect()}
    assert share[1] == share[4] == len(docs[1]) and share[3] == 0 and abs(share[2] - len(shared)) <= 2 and abs(share[5] - 302) <= 2
    left = {r["doc_id"]: r["text"] for r in spans.deduplicated().collect()}
    assert left[1] == docs[1] and left[3] == docs[3] and left[4] == "" and shared.strip() not in left[2] and sentence[15].strip() in left[2]


def test_shares_against_brute_force(spark):
    rng, docs = random.Random(3), {}
    footer = prose(310, 77)
    for i in range(30):
        docs[i] = prose(rng.randint(300, 700), 300 + i)
    for i in range(30, 60):
        source, n = docs[rng.randrange(30)], rng.choice([299, 300, 330, 420])
        at = rng.randrange(max(1, len(source) - n + 1))
        docs[i] = prose(rng.randint(0, 90), 400 + i) + source[at : at + n] + (footer if i % 3 else "ü")
    docs = {i: t for i, t in docs.items() if len(t) >= 300}
    grams = {i: {t[w : w + 300] for w in range(len(t) - 299)} for i, t in docs.items()}
    want = {}
    for i, t in docs.items():
        others = set().union(*(g for j, g in grams.items() if j != i))
        want[i] = len({c for w in range(len(t) - 299) if t[w : w + 300] in others for c in range(w, w + 300)})
    got = {r["doc_id"]: r["shared_chars"] for r in SharedSpans(spark.createDataFrame([(i, t, None, None) for i, t in docs.items()], _SPANS)).shares().collect()}
    assert got == want


def test_sentence_runs():
    text = "One two three. Four five. Six! Seven eight nine ten. End"
    assert shared_spans.sentence_runs(text, 20) == [(0, 1), (1, 3), (2, 3), (3, 4)]
    assert shared_spans.sentence_runs("", 20) == [] == shared_spans.sentence_runs("No end", 3)
    assert shared_spans._common("abcdef", "abcxef") == 3 and shared_spans._common("", "a") == 0 and shared_spans._common("ab", "ab") == 2


def test_spans_empty_and_long(spark):
    assert rows(SharedSpans(spark.createDataFrame([], _SPANS)).pairs()) == []
    long = prose(200_000, 9, "xx")
    data = [(1, long, None, None), (2, prose(50, 8) + long[150_000:150_320], None, None)]
    assert rows(SharedSpans(spark.createDataFrame(data, _SPANS)).pairs()) == [(1, 2)]
    assert (piece_starts(["a" * 5_000])[0] < 5_000).all() and SPAN - RUN == 100


def test_pieces_do_not_depend_on_what_stands_beside():
    texts = [prose(random.Random(i).randint(1, 900), i, "xx") for i in range(60)] + [""]
    together = piece_starts(texts)
    assert all((piece_starts([t])[0] == s).all() for t, s in zip(texts[:-1], together)) and list(together[-1]) in ([], [0])
