"""Spelling variants: words at one edit from each other, found by permuterm rotations.

A word is marked with a terminator and rotated: ``ab`` gives ``b$a`` for every cut.  A word ``axb`` gives the
same text when the rotation that ends with ``x`` leaves its last letter away.  So after sorting, all rotations
that skip one letter and are equal otherwise stand together: they differ by a replaced letter, and a whole
rotation among them is the word that lacks the letter.  Such a group has at most one word per letter of the
alphabet and one whole word, whatever the size of the vocabulary; it is scanned once, and each member takes
the number of its neighbours there and the best of them.  No pair is written down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.shared import whole_text
from caseweave.plans.ordered import SLICE, range_slices
from caseweave.session import materialise

#: Letters of a word, as the body of a character class.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
DAMAGED = 97
#: A rotation of more code points stands as its digest, so that rows have a bounded width.
LONGEST_KEY = 64


def _lowered(run: Column) -> Column:
    """A-Z in lower case, other letters unchanged."""
    ascii_only = F.octet_length(run) == F.char_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def runs_of_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word): one row per maximal run of letters in a text, lower-cased, some with a letter taken out.

    The draw is the CRC-32 of ``<id>:<run>``; a null id is written as nothing, a null text has no run.
    """
    owner = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(
        owner.alias("_owner"), F.explode(F.split(whole_text(text_col), f"[^{LETTERS}]+")).alias("_run")
    ).where("_run <> ''").select("_owner", _lowered(F.col("_run")).alias("_run"))
    drawn = runs.select("_run", F.crc32(F.concat_ws(":", "_owner", "_run").cast("binary")).alias("_h"))
    place = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), place), F.substring("_run", place + 2, F.char_length("_run")))
    return drawn.select(F.when(F.col("_h") % damaged == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(rank, word, n) of the words with enough letters and occurrences; ranks follow code-point order.

    The words are sorted in ranges; a rank is the range's number and the place in it, so that no task sees
    more than one range.  Ranks order words, they have gaps.
    """
    counted = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    cut = range_slices(counted, ["word"])
    place = F.row_number().over(Window.partitionBy(SLICE).orderBy("word"))
    return materialise(cut.select((F.shiftleft(F.col(SLICE).cast("long"), 40) + place).alias("rank"), "word", "n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, rank, n, whole, first): every rotation of every word, whole and with its last letter skipped.

    ``first`` is false where the skipped letter equals the one before it: taking either out gives the same
    word, which is met at the first of them.
    """
    word, at = F.col("word"), F.col("at")
    length = F.char_length(word)
    before, after = F.substring(word, F.lit(1), at), F.substring(word, at + 1, length)
    skipped = F.substring(word, at + 2, length)
    repeated = (at > 0) & (F.substring(word, at + 1, F.lit(1)) == F.substring(word, at, F.lit(1)))
    cuts = words.select("rank", "n", "word", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    rows = cuts.select("rank", "n", F.explode(F.array(
        F.struct(F.concat(after, F.lit("$"), before).alias("key"), F.lit(True).alias("whole"), F.lit(True).alias("first")),
        F.when(at < length, F.struct(F.concat(skipped, F.lit("$"), before).alias("key"), F.lit(False).alias("whole"), (~repeated).alias("first"))),
    )).alias("r")).where("r IS NOT NULL").select("rank", "n", "r.*")
    # A digest has no terminator, so it equals no rotation.
    key = F.when(F.char_length("key") > LONGEST_KEY, F.sha2("key", 256)).otherwise(F.col("key"))
    return rows.withColumn("key", key)


def neighbours(rows: DataFrame) -> DataFrame:
    """(rank, n_near, best): per word, the number of near words and the best (n, -rank) among them."""
    group = Window.partitionBy("key")
    ordered = group.orderBy("whole", F.col("n").desc(), "rank")
    own = F.struct(F.col("n"), (-F.col("rank")).alias("r"))
    skips, met = ~F.col("whole"), ~F.col("whole") & F.col("first")
    scanned = rows.withColumns({
        "size": F.count(F.lit(1)).over(group),
        "others": F.sum(skips.cast("long")).over(group),
        "longer": F.sum(met.cast("long")).over(group),
        "shorter": F.max(F.when(F.col("whole"), own)).over(group),
        "top": F.max(F.when(skips, own)).over(group),
        "top_longer": F.max(F.when(met, own)).over(group),
        "next": F.lead(F.when(skips, own)).over(ordered),
        "place": F.row_number().over(ordered),
    }).where("size > 1")
    replaced = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    lacking = F.when(F.col("first"), F.col("shorter"))
    found = scanned.select(
        "rank",
        F.when(F.col("whole"), F.col("longer"))
        .otherwise(F.col("others") - 1 + lacking.isNotNull().cast("long")).alias("near"),
        F.when(F.col("whole"), F.col("top_longer")).otherwise(F.greatest(replaced, lacking)).alias("best"),
    ).where("near > 0")
    return found.groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(rank, root): the end of the way over ``links`` (rank, form), by pointer jumping.

    A form occurs at least twice as often as its word, so a way has at most 63 steps and six rounds do.
    Only words whose target moved are joined again; what points to an end is done.
    """
    state = materialise(links.select("rank", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not state.where("open").isEmpty():
        moved = (
            state.where("open").alias("a")
            .join(state.alias("b"), F.col("a.root") == F.col("b.rank"), "left")
            .select("a.rank", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("open"))
        )
        state = materialise(moved.unionByName(state.where("NOT open")))
    return state.select("rank", "root")


def group_spellings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = 5, least: int = 3, factor: int = 2, damaged: int = DAMAGED,
) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    Words are the runs of letters of all texts (``runs_of_letters``) with at least ``shortest`` code points
    and ``least`` occurrences.  Two words are near if one inserted, deleted or replaced code point makes them
    equal.  ``form`` is the near word of largest n (ties: the smaller in code-point order) if that n is at
    least ``factor`` times the word's own, else null; ``root`` is the end of the way over forms.  Null texts
    and texts without a letter have no words, an empty table gives no row, repeated rows count each time,
    and columns but the two named are not read.  ``factor`` must be at least 2, so that ways end.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = vocabulary(runs_of_letters(docs, id_col, text_col, damaged), shortest, least)
    near = neighbours(rotations(words))
    enough = F.col("best.n") >= F.lit(factor) * F.col("n")
    own = materialise(words.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, -F.col("best.r")).alias("form"), F.when(enough, F.col("best.n")).alias("form_n"),
    ))
    ends = roots(own.where("form IS NOT NULL").select("rank", "form"))
    named = words.select("rank", "word")
    return (
        own.withColumnRenamed("form", "form_rank")
        .join(named.select(F.col("rank").alias("form_rank"), F.col("word").alias("form")), "form_rank", "left")
        .join(ends, "rank", "left")
        .join(named.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )
