"""Personal data: fixed patterns, and terms that give protected values away, by column functions only.

Patterns find e-mail addresses, network addresses, card numbers and telephone numbers.  Their values are
the protected entities.  A word near an entity discloses it when the corpus hardly knows the word
elsewhere: the pointwise mutual information of word and entity, as a share of the entity's own
information content, reaches a threshold.  Such words are spans too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import written as stored
from caseweave.session import materialise

# Fixed patterns.  Possessive repeats keep them linear: no repeat can give back what the next part needs.
# A match starts where its run of characters starts or right after another match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]+"

#: Stands for a letter or digit of a base span; a run that holds it is no word of its own.
MARK = "\ue000"
MARKED_WORD = r"[\p{L}\p{N}\x{E000}]+"

#: Matches of a text whose places are summed in one fold.
PIECE = 256

#: Bits (as powers of two) of the filter that tells which words can matter: 16 bits a word between these two.  Past
#: a million words more of the others come through; they are left out by the join that follows.
FILTER_BITS = (18, 24)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if every second digit from the right, doubled, and the others sum to a multiple of ten."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + worth(i))
    return total % 10 == 0


def _is_ip(value: Column) -> Column:
    return value.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(False)


#: Kind, pattern, what a match must meet, and a cheap test that a text can hold one.
KINDS: tuple[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]], ...] = (
    ("email", EMAIL, lambda v: F.lit(True), lambda t: t.contains("@")),
    ("ip", IP, _is_ip, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", CARD, _is_card, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
    ("phone", PHONE, lambda v: F.char_length(_digits(v)).between(8, 15), lambda t: t.rlike(r"\+[0-9]")),
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """(start, end, value) of the valid matches, leftmost first, in code points, end exclusive.

    The places follow from the lengths of the matches and of what lies between them.  They are summed in pieces
    of ``PIECE`` matches, then over the pieces, as a fold copies what it has gathered at every step.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )
    kind = "struct<at:int,out:array<struct<start:int,end:int,value:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(F.coalesce(x["value"], F.lit("")))
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(x["value"].isNotNull() & valid(x["value"]), F.array_append(done["out"], span))
            .otherwise(done["out"]).alias("out"),
        ).cast(kind)

    def join(done: Column, piece: Column) -> Column:
        moved = F.transform(piece["out"], lambda s: F.struct(
            (s["start"] + done["at"]).alias("start"), (s["end"] + done["at"]).alias("end"), s["value"].alias("value")
        ))
        return F.struct((done["at"] + piece["at"]).alias("at"), F.concat(done["out"], moved).alias("out")).cast(kind)

    def whole(found: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int")),
            lambda i: F.aggregate(F.slice(found, i * PIECE + 1, F.lit(PIECE)), start, step),
        )
        return F.aggregate(pieces, start, join, lambda done: done["out"])

    return _bound(found, whole)


def base_spans(text: str) -> Column:
    """(kind, start, end, value) of all fixed patterns, by kind and start."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
        ))

    parts = [
        named(kind, F.when(possible(F.col(text)), spans_of(F.col(text), pattern, valid)).otherwise(none))
        for kind, pattern, valid, possible in KINDS
    ]
    return F.concat(*parts)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def _characters(text: Column) -> Column:
    return F.split(F.translate(text, MARK, " "), "", -1)


def _blanked(characters: Column, spans: Column) -> Column:
    """The characters with a mark for each letter and digit of the spans (one kind's, so in order and apart)."""
    def part(i: Column) -> Column:
        own, before = F.get(spans, i), F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        begin = F.coalesce(own["start"], F.size(characters))
        inside = F.slice(characters, begin + 1, F.coalesce(own["end"], begin) - begin)
        return F.concat(
            F.slice(characters, before + 1, begin - before),
            F.transform(inside, lambda c: F.when(c.rlike(WORD), F.lit(MARK)).otherwise(c)),
        )

    return F.when(F.size(spans) == 0, characters).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), part))
    )


def _marked_characters(characters: Column, base: Column) -> Column:
    """The characters without what belongs to a base span of any kind; linear in characters and spans."""
    def without(characters: Column, kind: str) -> Column:
        spans = F.filter(base, lambda s: s["kind"] == kind)
        return _bound(characters, lambda c: _bound(spans, lambda own: _blanked(c, own)))

    for kind, *_ in KINDS:
        characters = without(characters, kind)
    return characters


def _surroundings(text: Column, base: Column, reach: int) -> Column:
    """Per base span: its entity, the first place around it, the characters there and the same without base spans."""
    def around(whole: Column, marked: Column, size: Column, s: Column) -> Column:
        begin = F.greatest(F.lit(0), s["start"] - reach)
        length = F.least(size, s["end"] + reach) - begin
        return F.struct(
            F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"), begin.alias("from"), size.alias("size"),
            F.xxhash64(F.array_join(F.slice(whole, begin + 1, length), "")).alias("context"),
            F.array_join(F.slice(marked, begin + 1, length), "").alias("around"),
        )

    return _bound(F.split(text, "", -1), lambda whole: _bound(
        _marked_characters(_characters(text), base), lambda marked: _bound(F.char_length(text), lambda size: F.transform(
            base, lambda s: around(whole, marked, size, s)
        ))
    ))


def disclosing_terms(
    rows: DataFrame, texts: DataFrame, reach: int = 200, min_contexts: int = 3, min_length: int = 3, disclosure: float = 0.9
) -> DataFrame:
    """(_row, start, end): every place of a word that discloses an entity, whatever text it is in.

    ``rows`` has _row, text and base spans of the texts with entities, ``texts`` those of the whole corpus.  The
    words come from within ``reach`` characters of an entity.
    With n(t) all occurrences of a word, n(t, e) those near the entity e, and p(e) the share of all
    words near e, disclosure = 1 - log(n(t) / n(t, e)) / -log p(e).  A word needs
    ``min_contexts`` different surroundings of the same entity, so one text, or any number of its exact
    copies, discloses nothing.  Base spans are blanked in the text once, so a text of very many
    entities costs its length, and a row of the explosion carries nothing of the whole text.
    """
    near = rows.select("_row", F.explode(_surroundings(F.col("text"), F.col("base"), reach)).alias("e")).select("_row", "e.*")
    words = near.select("_row", "entity", "from", "size", "context", F.char_length("around").alias("length"), F.explode(
        spans_of(F.col("around"), MARKED_WORD, lambda v: (F.char_length(v) >= min_length) & ~v.contains(MARK))
    ).alias("w"))
    # A word at the edge of the surroundings may be a part of a longer one.
    cut = ((F.col("w.start") == 0) & (F.col("from") > 0)) | (
        (F.col("w.end") == F.col("length")) & (F.col("from") + F.col("length") < F.col("size"))
    )
    words = words.where(~cut).select(
        "_row", "entity", "context", F.lower("w.value").alias("term"),
        (F.col("from") + F.col("w.start")).alias("start"), (F.col("from") + F.col("w.end")).alias("end"),
    )
    places = materialise(words.groupBy("entity", "term", "_row", "start", "end").agg(F.min("context").alias("context")))
    together = places.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("both"), F.approx_count_distinct("context", 0.01).alias("contexts")
    )
    maybe = materialise(together.where(F.col("contexts") >= min_contexts))
    split_words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    counted = (
        texts.select(F.explode(F.filter(split_words, _marked(*_word_filter(maybe)))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("all"))
    )
    around = places.groupBy("entity").agg(F.countDistinct("_row", "start").alias("near"))
    words_all = float(texts.agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("words")).first()["words"] or 1)
    share = -F.log(F.least(F.lit(0.5), F.col("near") / words_all))
    strong = (
        maybe.join(counted, "term").join(around, "entity")
        .where(1 - F.log(F.greatest(F.lit(1.0), F.col("all") / F.col("both"))) / share >= disclosure)
        .select("term").distinct()
    )
    strong = materialise(strong)
    told = _marked(*_word_filter(strong))
    free = F.when(F.size("base") == 0, F.translate("text", MARK, " ")).otherwise(
        F.array_join(_marked_characters(_characters(F.col("text")), F.col("base")), "")
    )
    hits = texts.where(F.exists(split_words, told)).select("_row", F.explode(
        spans_of(free, MARKED_WORD, lambda v: ~v.contains(MARK) & told(F.lower(v)))
    ).alias("w")).select("_row", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return hits.join(strong, "term", "left_semi").select("_row", "start", "end")


def _marked(bits: int, mask: list[int]) -> Callable[[Column], Column]:
    """The test that a word's bit is set in a bitmap of ``_word_filter``."""
    listed = F.split(F.lit(",".join(map(str, mask))), ",").cast("array<bigint>")  # folded to a constant

    def test(w: Column) -> Column:
        bit = F.pmod(F.xxhash64(w), F.lit(1 << bits))
        return F.getbit(F.get(listed, F.shiftright(bit, 6).cast("int")), bit.cast("int") % 64) == 1

    return test


def _word_filter(terms: DataFrame) -> tuple[int, list[int]]:
    """The size and the bitmap over word hashes, as whole numbers of 64 bits; the size follows the count of the words."""
    low, high = FILTER_BITS
    count = terms.agg(F.approx_count_distinct("term").alias("n")).first()["n"]
    bits = min(high, max(low, (16 * count).bit_length()))
    bit = F.pmod(F.xxhash64("term"), F.lit(1 << bits))
    rows = terms.select(bit.alias("bit")).selectExpr(
        "cast(bit div 64 AS int) AS at", "shiftleft(1L, cast(bit % 64 AS int)) AS b"
    )
    out = [0] * (1 << (bits - 6))
    for r in rows.groupBy("at").agg(F.bit_or("b").alias("b")).collect():
        out[r["at"]] = r["b"]
    return bits, out


def find_personal_data(docs: DataFrame, **disclosure) -> DataFrame:
    """Per row: doc_id, the whole text, base and terms, the spans of the patterns and of disclosing terms.

    A null text stays null and has no span.  Matches of different kinds may overlap; terms never
    overlap a base span.  ``disclosure`` goes to ``disclosing_terms``.
    """
    # Written, for the whole texts are read again, and a row must keep its number.
    rows = stored(
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .withColumn("base", base_spans("text")).withColumn("_row", F.monotonically_increasing_id()), "pii"
    )
    terms = (
        disclosing_terms(rows.where(F.size("base") > 0), rows, **disclosure)
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
            F.lit("term").alias("kind"), "start", "end"
        ))).alias("terms"))
    )
    return rows.join(terms, "_row", "left").withColumn(
        "terms", F.coalesce("terms", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans generalised to their kind in brackets; of overlapping spans the first stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < done["at"], done).otherwise(F.struct(
            s["end"].alias("at"), F.concat(done["out"], gap, mark).alias("out")
        ))

    return F.aggregate(ordered, start, step, lambda done: F.concat(
        done["out"], F.substring(text, done["at"] + 1, F.char_length(text))
    ))


def sanitise(docs: DataFrame, **disclosure) -> DataFrame:
    """Per row: doc_id and the text with base and term spans generalised; texts without a span are unchanged."""
    found = find_personal_data(docs, **disclosure)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", sanitised(F.col("text"), F.concat(plain, F.col("terms"))).alias("text"))


def personal_data_digest(docs: DataFrame, **disclosure) -> DataFrame:
    """Per document: counts by kind, the hash of the base spans, and all spans as text."""
    found = find_personal_data(docs, **disclosure)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k[0]) for k in KINDS], F.sha2(written(plain), 256).alias("base_sha256"),
        written(F.concat(plain, F.col("terms"))).alias("spans"),
    )
