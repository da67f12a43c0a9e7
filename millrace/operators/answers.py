"""Extractive answers: sentences, and the details that questions ask for, from bodies and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.entities import identity
from millrace.functions.text import END, SENTENCE_END, START, clean_text, relative_date, stems, tokens, truncate

# Patterns of times and amounts, and of what questions ask for.
CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d"
AMOUNT = r"R\s?[\d ,]+(?:\.\d{2})?"


def answer_sentences(body: Column, title: Column) -> Column:
    """The sentences of a body that may answer: longer than 8 characters, with a word character, and not the title."""
    trim = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.transform(F.split(clean_text(F.coalesce(body, F.lit(""))), SENTENCE_END), trim)
    return F.filter(lines, lambda s: (F.length(s) > 8) & ~s.rlike(r"^\W+$") & (F.lower(s) != F.lower(F.coalesce(title, F.lit("")))))


def sentence_score(line: Column, place: Column, query_stems: Column, labels: Column) -> Column:
    """Stems of the question, a bonus for an entity and for numbers, penalties for very long, very short and first sentences."""
    hits = F.size(F.filter(stems(tokens(line)), lambda s: F.array_contains(query_stems, s))).cast("double")
    named = F.when(F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda e: F.contains(line, e)), 0.6).otherwise(0.0)
    number = F.when(line.rlike(r"(\d{3}[\s-]?\d{4}|R\s?\d|:\d\d)"), 0.5).otherwise(0.0)
    return F.round(hits + named + number - F.when(F.length(line) > 220, 0.4).otherwise(0.0) - F.when(F.length(line) < 24, 0.9).otherwise(0.0) - F.when(place == 0, 0.1).otherwise(0.0), 6)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def total_after_word(body: Column) -> Column:
    """The amount after the word total; else null."""
    return F.trim(F.regexp_replace(_first(clean_text(body), "(?i)" + START + "total" + END + rf"[^A-Za-z0-9]{{0,8}}({AMOUNT})"), r"\s+", " "))


def largest_amount(entities: Column) -> Column:
    """The largest amount of money among the entities, the first of equal ones, as ``struct<v, i, label>``; else null."""
    value = lambda e: F.regexp_replace(e["value"], r"[^\d.]", "").try_cast("double")
    amounts = F.transform(F.filter(entities, lambda e: (e["type"] == "money") & value(e).isNotNull()), lambda e, i: F.struct(value(e).alias("v"), (-i).alias("i"), e["label"].alias("label")))
    return F.array_max(amounts)


def total_amount(body: Column, entities: Column) -> Column:
    """The amount after the word total; else the largest amount of money of at least 50; else null."""
    best = largest_amount(entities)
    return F.coalesce(total_after_word(body), F.when(best["v"] >= 50, best["label"]))


def balance_amount(body: Column) -> Column:
    """The amount after a word for what is still owed."""
    words = "balance|outstanding|remaining|still owe|left to pay"
    return F.trim(F.regexp_replace(_first(clean_text(body), "(?i)" + START + f"(?:{words})" + END + rf"[^A-Za-z0-9]{{0,24}}({AMOUNT})"), r"\s+", " "))


# What is watched or listened to, and what stands in quotes.
WATCHED = r"(?:watch|watching|read|reading|listen to|listening to|play|playing)\s+(?:the\s+)?([A-Z][A-Za-z0-9'\-]+(?:\s+[A-Z][A-Za-z0-9'\-]+)?)"
QUOTED = '[“"]([^”"\n]{3,40})[”"]'


def named_title(body: Column) -> Column:
    """What is watched, read, listened to or played; else the first words in quotes; else null."""
    text = clean_text(body)
    return F.coalesce(_first(text, START + WATCHED), _first(text, QUOTED))


def time_range(body: Column) -> Column:
    """The first range of clock times, else the first time, else null."""
    text = clean_text(body)
    pattern = "(?i)" + START + rf"({CLOCK})\s*(?:to|until|-|–)\s*({CLOCK})" + END
    start, end = _first(text, pattern, 1), _first(text, pattern, 2)
    return F.coalesce(F.concat(start, F.lit(" – "), end), _first(text, START + f"({CLOCK})" + END))


# How a password, pin or code is written: after its label, after a slash, after a network's label, after any colon.
SECRET_MARK = "[A-Za-z0-9_@!#$%^&*.-]"
SECRETS = (
    (rf"(?i)(?:password|passcode|pass|pin)\s*[:=\-]?\s*({SECRET_MARK}{{4,}})", False), (rf"(?:^|/)\s*({SECRET_MARK}{{4,}})[^/]*$", True),
    (rf"(?i)(?:wifi|wi-fi|network|key safe|code)\s*[:=\-]?\s*({SECRET_MARK}{{4,}})", False), (rf"[\w ]{{3,20}}:\s*({SECRET_MARK}{{5,}})", True),
)


def secret(body: Column, best: Column | None = None) -> Column:
    """A password, pin or code: after its label; after a slash, with a digit or sign in it; after a network's label or any colon; else null.

    ``best`` is the line that answers best and is tried before the others.
    """
    lines = F.filter(F.split(clean_text(body), "\n+"), lambda x: x != "")
    lines = lines if best is None else F.concat(F.filter(F.array(best), lambda x: x.isNotNull()), lines)
    strong = lambda v: v.rlike(r"[\d!@#$%^&*_]")

    def first(pattern: str, check: bool) -> Column:
        found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda v: (v != "") & (strong(v) if check else F.lit(True)))
        return F.try_element_at(found, F.lit(1))

    return F.coalesce(*[first(*rule) for rule in SECRETS])


def person_like(label: Column) -> Column:
    """Two words or more, not beginning like an app or a chore."""  # the pattern is a fixed value
    return (F.size(F.split(label, r"\s+")) >= 2) & ~label.rlike("(?i)^(chat|the|how|fix|car|note|gmail|chrome)")


# Words of recommendation.
CUES = "recommend(ed|s)?|cousin|friend|says|said|told me|ask for|shout|contact|works with|known as|host is|call"


def mention(body: Column, label: Column) -> Column:
    """The first sentence that holds a name and a word of recommendation; else null."""
    lines = F.transform(F.split(clean_text(body), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    found = F.filter(lines, lambda s: F.contains(F.lower(s), F.lower(label)) & s.rlike("(?i)" + START + f"({CUES})" + END))
    return F.try_element_at(found, F.lit(1))


def entity_trail(entities: Column, n: int = 4) -> Column:
    """The first ``n`` entities as type and label: phones, names, money, websites, then the rest, in their order."""
    weight = lambda k: F.when(k == "phone", 0).when(k == "name", 1).when(k == "money", 2).when(k == "website", 3).otherwise(4)
    ranked = F.array_sort(F.transform(entities, lambda e, i: F.struct(weight(e["type"]).alias("w"), i.alias("i"), F.concat(e["type"], F.lit(": "), e["label"]).alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["t"])


def fact_strip(entities: Column, location: Column) -> Column:
    """The first phone, amount, website and date, and the place; at most four."""
    first = lambda kind: F.try_element_at(F.transform(F.filter(entities, lambda e: e["type"] == kind), lambda e: e["label"]), F.lit(1))
    facts = F.array(first("phone"), first("money"), first("website"), first("date"), F.when(location != "", location))
    return F.slice(F.filter(facts, lambda x: x.isNotNull()), 1, 4)


def why(source: Column, kind: Column, when: Column, location: Column) -> Column:
    return F.concat(F.concat_ws(" • ", source, kind, when), F.coalesce(F.concat(F.lit(", "), F.when(location != "", location)), F.lit("")))


def confidence(semantic: Column, keyword: Column, coverage: Column, entity: Column) -> Column:
    """Between 0 and 1, two decimals, from the rounded signals of the best document."""
    c = 0.35 * F.round(semantic, 3) + 0.35 * F.round(keyword, 3) + 0.2 * F.round(coverage, 3) + 0.1 * F.least(F.round(entity, 2), F.lit(1.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 2)


# What a question wants to know, by its words.
WANTS = {
    "title": "series|show|movie|film|book|song|album|podcast|recipe|dish", "time": "when|what time|how late", "recommended": "who|recommended|recommend|said|told",
    "contact": "number|phone|cell|mobile|contact", "website": "website|site|link|url|browser|web page", "who": "who", "reference": "reference|ref|booking ref|claim ref",
    "amount": "how much|price|cost|cheap|fee|rand|pay|paid|spend|spent|total", "secret": "password|wifi|passcode|pin|code|login", "balance": "balance|outstanding|still owe|owe|remaining|left to pay",
}
#: Hits of a question that an answer is made from, at most.
HITS = 12


def _head(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def _of_type(entities: Column, kind: str) -> Column:
    return _head(F.filter(entities, lambda e: e["type"] == kind))


def _merged(a: Column, b: Column) -> Column:
    """The entities of ``a``, then those of ``b`` whose key is not among them."""
    return F.concat(a, F.filter(b, lambda e: ~F.exists(a, lambda x: x["key"] == e["key"])))


def scored_lines(body: Column, title: Column, query_stems: Column, labels: Column) -> Column:
    """The sentences of a body as ``struct<score, at, line>``, the best first; ``at`` counts backwards."""
    lines = F.transform(answer_sentences(body, title), lambda x, i: F.struct(sentence_score(x, i, query_stems, labels).alias("score"), (-i).alias("at"), x.alias("line")))
    return F.sort_array(lines, asc=False)


def compose(ranked: DataFrame, questions: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """The answer to every question, ``(query_id, headline, kind, bullets, evidence, trail, confidence, notes, follow_ups)``.

    ``ranked`` is what :class:`HybridRanking` gives, ``questions`` has ``query_id, raw, terms, entities``, ``docs`` has ``doc_id, title, body,
    kind, source, captured_at, location, entities, text_source, ocr_confidence, keywords``. Every bullet names its document. A question
    without hits has the kind ``empty``. The hits of a question, at most ``HITS``, meet in one row; everything else is expressions on it.
    """
    asked = questions.select("query_id", "raw", F.array_distinct(stems(F.col("terms"))).alias("stems"), F.coalesce("entities", F.array().cast("array<struct<type:string,value:string,label:string,key:string>>")).alias("asked"))
    none = F.array().cast("array<struct<type:string,value:string,label:string,key:string>>")
    hits = ranked.where(F.col("rank") <= HITS).join(docs, "doc_id").join(asked.select("query_id", "stems", "asked", "raw"), "query_id").withColumn("entities", F.coalesce("entities", none))
    labels = F.transform(F.filter("entities", lambda e: e["type"] != "time"), lambda e: e["label"])
    hits = hits.withColumn("lines", F.slice(scored_lines(F.col("body"), F.col("title"), F.col("stems"), labels), 1, 2))
    best = F.col("lines")[0]["line"]
    said = F.filter(F.transform(F.split(clean_text(F.col("body")), SENTENCE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike("(?i)" + START + f"({CUES})" + END))
    first_only = lambda c: F.when(F.col("rank") == 1, c)
    total, balance = total_after_word(F.col("body")), balance_amount(F.col("body"))
    hit = F.struct(
        "rank", "score", "doc_id", "title", "kind", "source", "captured_at", "location", "entities", "text_source", "ocr_confidence", "keywords", "semantic", "keyword", "coverage", "entity",
        F.transform("lines", lambda x: x["line"]).alias("lines"), F.when(F.col("rank") <= 6, said).alias("said"), total.alias("total"), balance.alias("balance"),
        largest_amount(F.col("entities")).alias("largest"), first_only(secret(F.col("body"), best)).alias("secret"), first_only(named_title(F.col("body"))).alias("named"), first_only(time_range(F.col("body"))).alias("time"),
        why(F.col("source"), F.col("kind"), relative_date(F.col("captured_at"), now), F.col("location")).alias("why"), reasons(F.col("asked"), F.col("raw"), F.col("stems")).alias("reasons"),
    )
    rows = asked.join(hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")), "query_id", "left")
    rows = rows.withColumn("top", _head(F.col("hits"))).withColumn("relevant", F.filter("hits", lambda h: h["score"] >= F.greatest(F.lit(0.14), 0.32 * F.col("top.score"))))
    lower, wants = F.lower("raw"), {k: F.lower("raw").rlike(START + f"(?:{p})" + END) for k, p in WANTS.items()}

    # entities of the memory that holds what the question names come first
    named = F.transform(F.filter("asked", lambda e: e["type"].isin("name", "org")), lambda e: F.lower(e["label"]))
    rows = rows.withColumn("named", named)
    holder = _head(F.filter("relevant", lambda h: F.exists(h["entities"], lambda e: F.array_contains(F.col("named"), F.lower(e["label"])))))
    rows = rows.withColumn("held", F.when(F.size("named") > 0, holder)).withColumn("found", F.when(F.col("held").isNotNull(), _merged(F.col("held.entities"), F.col("top.entities"))).otherwise(F.col("top.entities")))

    # the person: one the question names, one that looks like a person, any name
    people = F.filter("found", lambda e: e["type"] == "name")
    overlaps = lambda e: F.exists("named", lambda n: F.contains(n, F.lower(e["label"])) | F.contains(F.lower(e["label"]), n))
    rows = rows.withColumn("person", F.coalesce(_head(F.filter(people, overlaps)), _head(F.filter(people, lambda e: person_like(e["label"]))), _head(people)))
    parts = F.split(F.lower("person.label"), r"\s+")
    known = F.filter(F.flatten(F.transform(F.slice("relevant", 1, 6), lambda h: h["entities"])), lambda e: (e["type"] == "name") & F.exists(parts, lambda t: F.contains(F.lower(e["label"]), t)))
    fuller = _head(F.array_sort(F.transform(known, lambda e, i: F.struct((-F.length(e["label"])).alias("n"), i.alias("i"), e["label"].alias("label")))))["label"]
    rows = rows.withColumn("shown", F.coalesce(F.when(F.size("named") > 0, fuller), F.col("person.label")))
    spoken = F.transform(F.slice("hits", 1, 6), lambda h: F.struct(
        _head(F.filter(h["said"], lambda x: F.contains(F.lower(x), F.lower(F.col("person.label"))))).alias("line"), h.alias("hit"),
        _head(F.filter(h["entities"], lambda e: (e["type"] == "name") & (F.lower(e["label"]) != F.lower(F.col("person.label")))))["label"].alias("who")))
    rows = rows.withColumn("mention", F.when(F.col("person").isNotNull(), _head(F.filter(spoken, lambda m: m["line"].isNotNull()))))

    # what an amount or a reference is read from
    four = F.slice("relevant", 1, 4)
    amount = lambda name: _head(F.filter(F.transform(four, lambda h: F.struct(h[name].alias("amount"), h.alias("hit"))), lambda x: x["amount"].isNotNull()))
    money = F.sort_array(F.filter(F.transform(four, lambda h: F.struct(h["largest"]["v"].alias("v"), (-h["rank"]).alias("r"), h["largest"]["label"].alias("amount"), h.alias("hit"))), lambda x: x["v"].isNotNull()), asc=False)
    largest = F.when(_head(money)["v"] >= 50, F.struct(_head(money)["amount"].alias("amount"), _head(money)["hit"].alias("hit")))
    rows = rows.withColumn("sum", F.coalesce(F.when(wants["balance"], amount("balance")), amount("total"), largest))
    hunted = _head(F.filter(F.transform(F.slice("relevant", 1, 5), lambda h: F.struct(_of_type(h["entities"], "reference")["label"].alias("label"), h.alias("hit"))), lambda x: x["label"].isNotNull()))
    in_top = _of_type(F.col("found"), "reference")["label"]
    rows = rows.withColumn("reference", F.coalesce(F.when(in_top.isNotNull(), F.struct(in_top.alias("label"), F.col("top").alias("hit"))), hunted))

    # the headline: the first of these cases that applies
    phone, site, weekday = _of_type(F.col("found"), "phone")["label"], _of_type(F.col("found"), "website")["label"], _of_type(F.col("found"), "weekday")["label"]
    date = F.coalesce(_of_type(F.col("found"), "date")["label"], F.initcap(weekday))
    dash = lambda *c: F.concat_ws(" — ", *c)
    title = F.col("top.title")
    cases = [
        (F.col("top").isNull(), "empty", F.lit("Nothing matches that yet")),
        (wants["title"] & F.col("top.named").isNotNull(), "answer", dash(F.col("top.named"), title)),
        (wants["time"] & F.col("top.time").isNotNull(), "answer", dash(F.concat_ws(" ", date, F.col("top.time")), title)),
        (wants["recommended"] & F.col("mention").isNotNull(), "person", dash(F.col("person.label"), F.concat(F.lit("mentioned by "), F.col("mention.who")))),
        (F.exists("asked", lambda e: e["type"] == "phone") & phone.isNotNull(), "contact", dash(phone, F.coalesce("shown", title))),
        (wants["contact"] & phone.isNotNull(), "contact", dash(phone, F.col("shown"))), (wants["website"] & site.isNotNull(), "website", site),
        (wants["who"] & F.col("shown").isNotNull(), "person", F.col("shown")), (wants["reference"], "reference", F.col("reference.label")),
        (wants["amount"], "amount", F.coalesce(dash(F.col("sum.amount"), F.when(F.col("sum").isNotNull(), F.col("sum.hit.title"))), F.lit(""))),
        (wants["secret"], "secret", dash(F.col("top.secret"), title)),
    ]
    kind, headline = F.when(cases[0][0], F.lit(cases[0][1])), F.when(cases[0][0], cases[0][2])
    for condition, name, text in cases[1:]:
        kind, headline = kind.when(condition, F.lit(name)), headline.when(condition, text)
    rows = rows.withColumn("kind", kind.otherwise("answer")).withColumn("headline", headline)

    # bullets: what is cited for the headline first, then the best lines of the relevant memories, repeats left out
    bullet = lambda line, h, suffix="": F.struct(truncate(line, 240).alias("text"), h["doc_id"].alias("doc_id"), h["title"].alias("title"), F.concat(h["why"], F.lit(suffix)).alias("why"))
    own = F.flatten(F.transform(F.slice("relevant", 1, 4), lambda h: F.transform(F.slice(h["lines"], F.lit(1), F.when(h["rank"] == 1, 2).otherwise(1)), lambda x: bullet(x, h))))
    cited = F.when(F.col("kind") == "amount", F.col("sum.hit")).when(F.col("kind") == "reference", F.col("reference.hit"))
    extra = F.when((F.col("kind") == "person") & wants["recommended"] & F.col("mention").isNotNull(), bullet(F.col("mention.line"), F.col("mention.hit"), " — this is where it was first mentioned"))
    extra = extra.when(cited.isNotNull() & (cited["doc_id"] != F.col("top.doc_id")) & (F.size(cited["lines"]) > 0), bullet(cited["lines"][0], cited))
    key = lambda b: F.substring(F.lower(b["text"]), 1, 60)
    distinct = lambda a: F.filter(a, lambda b, i: F.array_position(F.transform(a, key), key(b)) == i + 1)
    bullets = F.slice(F.concat(F.filter(F.array(extra), lambda b: b.isNotNull()), F.slice(distinct(own), 1, 4)), 1, 4)
    quote = lambda h: F.struct(h["doc_id"].alias("doc_id"), h["title"].alias("title"), F.round(h["score"], 3).alias("score"), h["reasons"].alias("reasons"), truncate(F.coalesce(_head(h["lines"]), F.lit("")), 200).alias("quote"))
    rows = rows.withColumn("bullets", F.when(F.col("top").isNotNull(), bullets))
    fallback = F.coalesce(F.when(F.col("headline") != "", F.col("headline")), F.when(title != "", title), truncate(F.col("bullets")[0]["text"], 90), F.lit("Found it"))
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    top = F.col("top")
    notes = some(
        F.when(F.round(top["semantic"], 3) >= 0.4, "Matched by meaning, not just keywords."), F.when(top["entity"] > 0, "Connected through a shared detail in your data."),
        F.when(top["text_source"] == "ocr", F.concat(F.lit("Read from the image ("), F.coalesce(top["ocr_confidence"].cast("string"), F.lit("–")), F.lit("% confidence)."))), F.when(top["location"] != "", F.concat(F.lit("Memory is tagged "), top["location"], F.lit("."))),
    )
    more = some(F.concat(F.lit("everything about "), _head(top["keywords"])), F.concat(F.lit("who is "), _of_type(F.col("found"), "name")["label"], F.lit("?")), F.concat(F.lit("show "), phone), F.when(top["location"] != "", F.concat(top["location"], F.lit(" memories"))))
    sure = confidence(top["semantic"], top["keyword"], top["coverage"], top["entity"])
    return rows.select(
        "query_id", fallback.alias("headline"), "kind", F.coalesce("bullets", F.array().cast("array<struct<text:string,doc_id:bigint,title:string,why:string>>")).alias("bullets"), F.coalesce(F.transform(F.slice("hits", 1, 3), quote), F.array().cast("array<struct<doc_id:bigint,title:string,score:double,reasons:array<string>,quote:string>>")).alias("evidence"),
        entity_trail(F.coalesce("found", none)).alias("trail"), F.when(top.isNotNull(), sure).otherwise(0.0).alias("confidence"), F.when(top.isNotNull(), notes).otherwise(F.array().cast("array<string>")).alias("notes"), F.slice(more, 1, 3).alias("follow_ups"),
    )


def reasons(asked: Column, raw: Column, query_stems: Column) -> Column:
    """Why a hit came up, at most four reasons, from its signals, its entities and those of the question."""
    shared = F.transform(F.filter("entities", lambda e: F.exists(asked, lambda a: identity(a) == identity(e))), lambda e: F.concat(F.lit("matches "), e["type"], F.lit(' "'), e["label"], F.lit('"')))
    phrase = {
        "strong keyword overlap": (F.col("keyword") > 0.4) & (F.col("coverage") > 0.5), "close in meaning to your question": F.col("semantic") > 0.45, "contains the exact phrase": F.col("phrase") > 0,
        "every keyword found": (F.col("coverage") >= 0.999) & (F.size(query_stems) > 0),
    }
    scan = F.when((F.col("text_source") == "ocr") & (F.col("ocr_confidence") >= 70), F.concat(F.lit("read from the "), F.col("kind"), F.lit(" ("), F.col("ocr_confidence").cast("string"), F.lit("%)")))
    told = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in phrase.items()], scan, F.when(F.col("bridge") > 0, F.lit("connected to the best match through a detail"))), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(shared, told)), 1, 4)
