"""Document fingerprints: one-permutation MinHash, optimal densification, low-order bits, as column expressions only.

Every five-word shingle is hashed once (MD5).  The first two hex digits of the hash name one of 256 bins; a bin
holds its smallest hash.  An empty bin borrows: it asks bins in an order drawn for it, the same in every
document, until one is filled, so each filled bin is as likely to lend as any other.  Of each value four bits
are kept, one hex digit, and the fingerprint is the 256 digits (128 bytes).  The low bits of a borrowed value are
drawn anew for the bin that borrows, else a text of one shingle would be 256 times one digit.

Two fingerprints agree in a bin with chance J + (1 - J) / 16 for sets of Jaccard likeness J, so J is estimated as
(agreeing - 16) / 240, at least 0.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.shared import BLANK, whole_text
from caseweave.plans.ordered import SLICE, range_slices
from caseweave.session import materialise

#: Bins of a fingerprint: two hex digits of a hash.
BINS = 256
#: Bins that an empty bin asks by a fixed table, before it looks through the filled ones in its drawn order.
PROBES = 16
#: Words of a shingle.
SHINGLE = 5


@lru_cache(maxsize=1)
def _probes() -> str:
    """The table of bins asked, from MD5 of 'bin:try'."""
    return ",".join(
        str(int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:2], 16)) for i in range(BINS) for t in range(PROBES)
    )


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[{BLANK}]+"), "")


def _shingles(words: Column, k: int, first: Column) -> Column:
    """MD5 of every run of ``k`` words from place ``first`` on, of all words if there are fewer; null without words."""
    # Words by place: a slice would copy the shingle's words first.
    many = F.transform(F.sequence(first, F.size(words) - k), lambda i: F.md5(
        F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]).cast("binary")
    ))
    return F.when(F.size(words) >= k, F.when(first <= F.size(words) - k, many).otherwise(F.array().cast("array<string>"))).when(
        F.size(words) > 0, F.array(F.md5(F.concat_ws(" ", words).cast("binary")))
    )


def with_fingerprint(rows: DataFrame, text_col: str, name: str, k: int = SHINGLE) -> DataFrame:
    """``rows`` with the column ``name``, the fingerprint of the text; empty for a text without a word.

    Words are runs without white space, in lower case; a text of fewer than ``k`` words is one shingle.
    Columns that begin with ``_fp`` are used on the way.
    """
    step = rows.withColumn("_fp_words", _words(F.col(text_col)))
    step = step.withColumn("_fp_hashes", _shingles(F.col("_fp_words"), k, F.lit(0)))
    return _with_digits(step, "_fp_hashes", name).drop("_fp_words", "_fp_hashes")


def _with_both(rows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``rows`` (text, edited, kept) with the fingerprints of ``text`` and ``edited``, which both begin with ``kept``.

    All words of ``kept`` but the last stand in both texts; shingles of these are hashed once.
    """
    step = rows.withColumns({
        "_fp_words": _words(F.col("text")), "_fp_edited": _words(F.col("edited")),
        "_fp_shared": F.greatest(F.lit(0), F.size(_words(F.col("kept"))) - k),
    }).withColumn("_fp_hashes", _shingles(F.col("_fp_words"), k, F.lit(0)))
    fresh = _shingles(F.col("_fp_edited"), k, F.col("_fp_shared"))
    # Without a shared shingle, those of the text need not exist.
    step = step.withColumn("_fp_others", F.when(
        F.col("_fp_shared") > 0, F.concat(F.slice("_fp_hashes", F.lit(1), F.col("_fp_shared")), fresh)
    ).otherwise(fresh))
    step = step.drop("_fp_words", "_fp_edited")
    step = _with_digits(_with_digits(step, "_fp_hashes", "fingerprint"), "_fp_others", "edited_fingerprint")
    return step.drop("_fp_shared", "_fp_hashes", "_fp_others")


def _with_digits(rows: DataFrame, hashes_col: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``, the fingerprint of a text's shingle hashes; empty where they are null."""
    hashes, values, filled = F.col(hashes_col), F.col("_fp_values"), F.col("_fp_filled")
    # A mark at the upper end of every bin: after sorting, the first entry of a bin is its minimum, or the mark.
    marks = F.split(F.lit(",".join(f"{b:02x}g" for b in range(BINS))), ",")
    step = rows.withColumn("_fp_sorted", F.sort_array(F.concat(F.coalesce(hashes, F.array().cast("array<string>")), marks)))
    ordered = F.col("_fp_sorted")
    firsts = F.filter(ordered, lambda x, i: (i == 0) | ~F.startswith(F.get(ordered, i - 1), F.substring(x, 1, 2)))
    step = step.withColumn("_fp_values", F.transform(firsts, lambda x: F.when(F.octet_length(x) == 32, x)))
    step = step.withColumn("_fp_filled", F.filter(
        F.transform(values, lambda v, b: F.struct(b.alias("b"), v.alias("v"))), lambda e: e["v"].isNotNull()
    ))
    table = F.split(F.lit(_probes()), ",").cast("array<int>")

    def borrowed(i: Column) -> Column:
        asked = [F.get(values, F.get(table, i * PROBES + t)) for t in range(PROBES)]
        drawn = F.array_min(F.transform(filled, lambda e: F.concat(
            F.md5(F.concat_ws("/", i.cast("string"), e["b"].cast("string")).cast("binary")), e["v"]
        )))
        return F.coalesce(*asked, F.substring(drawn, 33, 32))

    digits = F.transform(values, lambda v, i: F.coalesce(
        F.substring(v, 32, 1), F.substring(F.md5(F.concat_ws(":", borrowed(i), i.cast("string")).cast("binary")), 32, 1)
    ))
    print_ = F.when(hashes.isNotNull(), F.array_join(digits, "")).otherwise("")
    return step.withColumn(name, print_).drop("_fp_sorted", "_fp_values", "_fp_filled")


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1; two empty ones are alike."""
    same = F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: x == y)
    agreeing = F.size(F.filter(same, lambda x: x))
    estimate = F.greatest(F.lit(0.0), (agreeing - BINS // 16) / F.lit(float(BINS - BINS // 16)))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(estimate)


def _with_next(light: DataFrame) -> DataFrame:
    """``light`` (key, id, ...) with ``next``, the key that follows in descending (id, key); after the last, the first.

    The rows are sorted in ranges; the last key of each range goes on to the following one.
    """
    cut = range_slices(light, ["id", "key"])
    inside = Window.partitionBy(SLICE).orderBy("id", "key")
    edges = cut.groupBy(SLICE).agg(F.max(F.struct("id", "key")).alias("edge"))
    # One row per range.
    ranges = Window.orderBy(SLICE)
    before = edges.select(SLICE, F.coalesce(
        F.lag("edge.key").over(ranges),
        F.last("edge.key").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("before"))
    return (
        cut.withColumn("lower", F.lag("key").over(inside)).join(before, SLICE)
        .withColumn("next", F.coalesce("lower", "before")).drop(SLICE, "lower", "before")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last third (rounded down) of its code points replaced by as many from the start of
    the next document's text, in descending order of id; the last document is followed by the first.
    ``near_edited`` and ``near_next`` are the likenesses of the fingerprint to those of the edited text and of
    the next document.

    A null text counts as empty; texts without a word have the empty fingerprint, alike to itself only.  A
    null id comes after all others.  Rows of one id are ordered by a digest of id and text, downwards; rows equal
    in id and text count as one document and are all returned.  Other columns are not read.  An empty table gives no row.

    Texts are shuffled once, by a digest of id and text after equal rows have met in map tasks; the order
    is found on ids and digests alone, and what goes to another document is the part it needs.
    """
    text = whole_text(text_col)
    owner = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("?"))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"),
        F.unhex(F.sha2(F.concat(owner, F.lit(":"), text).cast("binary"), 256)).alias("key"),
    )
    light = rows.groupBy("key").agg(
        F.min("id").alias("id"), F.max(F.char_length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )
    order = materialise(_with_next(light))
    # Both uses read the same two columns, so that one shuffle serves them.
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    asked = order.select(F.col("next").alias("key"), F.col("key").alias("asker"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    pieces = texts.join(asked, "key").select(
        F.col("asker").alias("key"), "third", F.substring("text", F.lit(1), F.col("third")).alias("piece")
    )
    kept = F.substring("text", F.lit(1), F.char_length("text") - F.col("third"))
    edited = texts.join(pieces, "key").select("key", "text", kept.alias("kept"), F.concat(kept, F.col("piece")).alias("edited"))
    printed = _with_both(edited)
    # Digits are written and shuffled as bytes, two to a byte.
    digests = {"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)}
    digests |= {n: F.col(n) for n in ("fingerprint", "edited_fingerprint")}
    own = materialise(printed.select("key", *[F.unhex(c).alias(n) for n, c in digests.items()]))
    following = own.select(F.col("key").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    found = own.join(order, "key").join(following, "next").withColumns(
        {n: F.lower(F.hex(n)) for n in (*digests, "next_fingerprint")}
    ).withColumns({
        "near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint"),
        "copy": F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))),
    })
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
