"""Statistics of whole texts as column expressions, shared by the two quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import BLANK, whole_text

#: Counts that describe a text; every one is a long.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars_all", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_stops", "n_distinct_words",
    "n_bars", "n_short_words",
)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _left(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are sorted by hash with their places; a place counts when a neighbour in that order has
    the same hash.  The places found, in order, each cover three words or up to the next place.
    """
    places = F.sequence(F.lit(0), n - 3)
    windows = F.sort_array(F.transform(places, lambda i: F.struct(
        F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("p"),
    )))
    return windows


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS; a null text counts as empty.

    Words are runs without white space (space and U+0009 to U+000D).  No Python, no shuffle: all is
    computed within the row, in n log n of its words.
    """
    text = whole_text(text_col)
    step = docs.withColumn("_text", text)
    step = step.withColumn("_words", F.filter(F.split("_text", f"[{BLANK}]+"), lambda w: w != ""))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_windows", F.when(
        F.col("n_words") >= 4, _repeat_words(F.col("_hashes"), F.col("n_words").cast("int"))
    ))
    last = F.size("_windows") - 1
    at = lambda i: F.get(F.col("_windows"), i)
    step = step.withColumn("_hits", F.sort_array(F.transform(
        F.filter(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.when(
                ((i > 0) & (at(i)["h"] == at(i - 1)["h"])) | ((i < last) & (at(i)["h"] == at(i + 1)["h"])), at(i)["p"]
            )),
            lambda p: p.isNotNull(),
        ),
        lambda p: p,
    )))
    covered = F.aggregate(
        F.transform("_hits", lambda p, i: F.least(
            F.lit(3), F.coalesce(F.get(F.col("_hits"), i + 1) - p, F.lit(3))
        )),
        F.lit(0).cast("long"), lambda total, x: total + x.cast("long"),
    )
    size = F.char_length("_text")
    count = lambda characters: (size - _without(F.col("_text"), characters)).cast("long")
    step = (
        step.withColumn("word_chars", _without(F.col("_text"), " \t\n\x0b\x0c\r").cast("long"))
        .withColumn("n_symbols", count("#*$%&|<>"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("n_chars_all", size.cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_upper", (size - _left(F.col("_text"), "\\p{Lu}")).cast("long"))
        .withColumn("n_digits", count("0123456789"))
        .withColumn("n_exclaim", count("!?"))
        .withColumn("n_stops", count(".,;:"))
        .withColumn("n_distinct_words", F.size(F.array_distinct("_hashes")).cast("long"))
        .withColumn("n_bars", count("|{}[]_=~^\\"))
        .withColumn("n_short_words", F.size(F.filter("_words", lambda w: F.char_length(w) <= 3)).cast("long"))
    )
    return step.drop("_text", "_words", "_lines", "_hashes", "_windows", "_hits")
