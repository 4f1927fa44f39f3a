"""Spans of the fixed patterns against plain Python, and disclosing terms on a small corpus."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from caseweave.llm.pii import find_personal_data, personal_data_digest, sanitise, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    spans = [
        (kind, m.start(), m.end())
        for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m[0])
    ]
    return spans


def check(docs):
    rows = personal_data_digest(docs).collect()
    texts = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    want = []
    for doc, text in texts:
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc, *[sum(k == x for x, _, _ in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted(want, key=repr)
    return rows


HARD = [
    "a@b.c_d@e.f", "aa@bb@cc.dd", "x@y", "x@y.", "x@y.z.", "é@a.b.c ñ a.b%c+d@e-f.gh", "😀 me@x.yy 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1 1.1.1.256 1.2.3", "00001.2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1111.", "4111  1111 1111 1111", "41111111111111111", "4111111111111112 5500000000000004",
    "+1 (988) 555-2485 +12 +123456789012345678 + 1234567890", "+1(+2)34567890", "+9 8.7-6 5432 )", "1" * 5000, "a" * 20000,
    "a." * 3000 + "@b" + ".c" * 5000, "", "1.1.1.1@x.yy +1.1.1.1 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_fixed_patterns(spark, documents):
    check(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"))
    check(documents)


def test_odd_rows(odd, none):
    check(odd)
    assert personal_data_digest(none).count() == 0


def test_terms(spark):
    """A project name that only ever stands near one address is disclosed; a common word isn't."""
    rows = [(i, f"note {i} from the zebrafish project by kim@lab.example.org about item {i * 31}") for i in range(6)]
    rows += [(100 + i, f"the project of the other people number {i} is about the garden") for i in range(300)]
    # Copies of one text are one surrounding only.
    rows += [(500 + i, "unique quagga here for max@zoo.example.org today") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_personal_data(docs).collect()}
    words = {d: {rows_[1][t["start"] : t["end"]] for t in found[d].terms} for d, rows_ in ((r[0], r) for r in rows)}
    assert all(words[i] == {"from", "zebrafish", "item", "note"} & words[i] and "zebrafish" in words[i] for i in range(6))
    assert all("the" not in w and "project" not in w for w in words.values())
    assert not any(words[i] for i in range(100, 400)) and not any(words[500 + i] for i in range(20))
    spans = {r.doc_id: r.spans for r in personal_data_digest(docs).collect()}
    start = rows[0][1].index("zebrafish")
    assert f"term:{start}:{start + 9}" in spans[0] and spans[0].startswith("email:")


def test_sanitised_text(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cc or 1.2.3.4 now"), (2, "nothing"), (3, "1.1.1.1@x.yy")], "doc_id long, text string")
    out = find_personal_data(docs).withColumn("whole", F.coalesce("text", F.lit("")))
    texts = {r.doc_id: r.t for r in out.select("doc_id", sanitised(F.col("whole"), F.col("base")).alias("t")).collect()}
    assert texts == {1: "write to [EMAIL] or [IP] now", 2: "nothing", 3: "[IP]@x.yy"}


def test_terms_away_from_the_entity(spark):
    """What discloses an entity is a span far off in the same text, too, and in texts without any match."""
    rows = [(i, f"note {i} from the zebrafish project by kim@lab.example.org about item {i * 31}") for i in range(6)]
    rows += [(100 + i, f"the project of the other people number {i} is about the garden") for i in range(300)]
    rows[0] = (0, rows[0][1] + " and so on" * 40 + " (Zebrafish)")
    rows += [(700, "Here the 😀 ZEBRAFISH stands alone, no zebrafishes."), (701, None), (702, "")]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    words = lambda d: [texts[d][t["start"] : t["end"]] for t in found[d].terms]
    assert [w for w in words(0) if w.lower() == "zebrafish"] == ["zebrafish", "Zebrafish"] and words(700) == ["ZEBRAFISH"]
    assert not found[701].terms and not found[702].terms and len(found) == len(rows)


def test_clean_texts_stay_whole(spark):
    """Every row keeps its text; the sanitised text of a row without spans is the text itself."""
    rows = [(i, f"note {i} from the zebrafish project by kim@lab.example.org about item {i * 31}") for i in range(6)]
    rows += [(100 + i, f"the project of the other people number {i} is about the garden") for i in range(300)]
    rows += [(700, "Only a Zebrafish here."), (701, None), (702, ""), (703, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in find_personal_data(docs).collect()} == dict(rows)
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[700] == "Only a [TERM] here." and "[EMAIL]" in clean[3] and "zebrafish" not in clean[3]
    assert all(clean[d] == t for d, t in rows if 100 <= d < 400 or d > 700)


def test_one_text_of_very_many_entities(spark):
    """A list of 20,000 addresses costs its length; the words between the addresses are still looked at."""
    listed = "\n".join(f"member{i} zebrafish user{i}@lab{i % 7}.example.org" for i in range(20_000))
    rows = [(1, listed)] + [(10 + i, f"note {i} of the zebrafish by kim@lab.example.org, item {i * 31}") for i in range(5)]
    begun = time.monotonic()
    found = {r.doc_id: r for r in personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - begun < 120
    assert found[1].n_email == 20_000
    spans = found[1].spans.split(",")
    matches = [f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], listed)]
    assert spans[:20_000] == matches
    assert not set(spans[20_000:]) & set(matches)


def test_words_that_touch_a_span(spark):
    """A word that overlaps a base span is none; one that ends where a span begins is; marks in the text are no letters."""
    rows = [(i, f"quokka+4912345{i:03d}99 x\ue000wombat\ue000 é{i}@a.bc") for i in range(6)]
    rows += [(100 + i, f"plain text number {i}") for i in range(300)]
    rows = [(d, t.replace(f"{d:03d}99", "00099") if d < 100 else t) for d, t in rows]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for d in range(6):
        words = [texts[d][t["start"] : t["end"]] for t in found[d].terms]
        assert words == ["quokka", "wombat"]
