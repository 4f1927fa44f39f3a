"""Benchmark decontamination by template windows.

A text is turned into a template: numbers, names and units become typed placeholders, other words keep
their lower-case form.  Windows of consecutive template words are hashed and joined with those of the
benchmark.  Where windows meet, the values that stand in the placeholders must correspond one to one, so
a question whose numbers and names were exchanged throughout is found, while chance matches of form aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.hashing import LOWER, NOT_ALNUM, Runs, Words, byte_set, mix, pair, split_words
from caseweave.llm.shared import whole_text
from caseweave.session import materialise

# Number words, and units that may follow a number.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
    "thousand million billion half quarter dozen"
).split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons ounce ounces oz pound "
    "pounds lb lbs ml l liter liters litre litres gallon gallons cup cups second seconds sec s minute "
    "minutes min hour hours h day days week weeks month months year years cent cents dollar dollars euro "
    "euros usd eur degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules newton "
    "newtons pascal hz khz mhz ghz byte bytes kb mb gb tb percent mph kmh"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
_DIGIT = byte_set(b"0123456789")
_ENDS_SENTENCE = byte_set(b".!?:;\n\"")
#: Bits of the filter that tells which window hashes can be in the benchmark.
FILTER_BITS = 23


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(next(split_words(pa.array([" ".join(words)]), NOT_ALNUM, lower=True)).hashes)


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS)


@dataclass
class Template:
    """Template words of some texts: ``first`` as in Words, ``kind`` 0 for a word that stands for itself."""

    first: np.ndarray
    keys: np.ndarray  # hash of the word, or of its kind
    kind: np.ndarray
    values: np.ndarray  # hash of what was written there


def template(words: Words) -> Template:
    """A word of digits or a number word is a number; a capitalised word inside a sentence is a name; a unit
    word right after a number is a unit.  Runs of one kind with no sentence end between are one placeholder."""
    n = len(words.hashes)
    if not n:
        return Template(words.first, words.hashes, np.zeros(0, np.int64), words.hashes)
    data = words.data
    lowered = LOWER[data]
    own = _rehash(words, lowered)
    head = data[words.starts]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = ((digits[words.ends] - digits[words.starts]) * 2 > words.ends - words.starts) | _in(own, _NUMBER_HASHES)
    # Capital: A-Z, or the two-byte letters U+00C0 to U+00DE.
    second = data[np.minimum(words.starts + 1, len(data) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.concatenate([[0], np.cumsum(_ENDS_SENTENCE[data])])
    begins = np.ones(n, bool)
    begins[1:] = stops[words.starts[1:]] > stops[words.ends[:-1]]
    begins[words.first[:-1][np.diff(words.first) > 0]] = True
    # A point between digits ends no sentence.
    gap = np.zeros(n, np.int64)
    gap[1:] = words.starts[1:] - words.ends[:-1]
    joined = np.zeros(n, bool)
    joined[1:] = number[1:] & number[:-1] & (gap[1:] == 1)
    fresh_text = np.zeros(n, bool)
    fresh_text[words.first[:-1][np.diff(words.first) > 0]] = True
    kind = np.where(number, NUMBER, np.where(capital & ~begins, NAME, 0))
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1] & ~fresh_text[1:]
    kind = np.where(~number & after_number & _in(own, _UNIT_HASHES), UNIT, kind)
    follows = np.zeros(n, bool)
    follows[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (~begins[1:] | joined[1:]) & ~fresh_text[1:]
    keep = ~follows
    group = np.cumsum(keep) - 1
    # The value of a run: a sum of its words' hashes, each turned by its place in the run.
    place = np.arange(n) - np.flatnonzero(keep)[group]
    values = np.zeros(int(keep.sum()), np.uint64)
    np.add.at(values, group, mix(own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    kept_kind = kind[keep]
    keys = np.where(kept_kind > 0, mix(kept_kind.astype(np.uint64), 31), own[keep])
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    return Template(first, keys, kept_kind, values)


def _rehash(words: Words, lowered: np.ndarray) -> np.ndarray:
    """The words' hashes as they would be in lower case."""
    texts = pa.LargeStringArray.from_buffers(
        words.texts, pa.py_buffer(words.text_starts.astype(np.int64)), pa.py_buffer(lowered)
    )
    parts = [w.hashes for w in split_words(texts, NOT_ALNUM, lower=False, slice_bytes=len(lowered) + 1)]
    return np.concatenate(parts)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def template_windows(t: Template, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the windows of ``k`` template words, half of them at least not placeholders."""
    n = len(t.keys)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = t.keys[: n - k + 1]
    for j in range(1, k):
        hashes = pair(hashes, t.keys[j : n - k + 1 + j])
    plain = np.concatenate([[0], np.cumsum(t.kind == 0)])
    last = np.repeat(t.first[1:], np.diff(t.first))[: n - k + 1]
    at = np.arange(n - k + 1)
    places = np.flatnonzero((at + k <= last) & (2 * (plain[k:] - plain[: n - k + 1]) >= k))
    return mix(hashes[places], k), places


def _window_rows(
    batch: pa.RecordBatch, sizes: tuple[int, ...], only: np.ndarray | None, whole: int | None
) -> Iterator[pa.RecordBatch]:
    """(id, place, windows, hash, slots) of a batch's windows; ``only`` is a filter on hashes.

    ``windows`` counts the text's windows of that size.  ``whole`` set: each text makes windows of that size, or, if it is shorter, one of all its words.
    """
    ids = batch.column("id")
    for words in split_words(batch.column("text"), NOT_ALNUM, lower=False):
        t = template(words)
        counts = np.diff(t.first)
        for k in sizes:
            hashes, places = template_windows(t, k)
            owner = np.searchsorted(t.first, places, side="right") - 1
            usable = np.bincount(owner, minlength=words.texts)
            # Empty texts share the place of the next text's first word.
            use = np.ones(len(places), bool)
            if whole is not None:
                use = np.minimum(counts[owner], whole) == k
            if only is not None:
                bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                use &= (only[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            hashes, places, owner = hashes[use], places[use], owner[use]
            if not len(hashes):
                continue
            grid = places[:, None] + np.arange(k)
            filled = t.kind[grid] > 0
            slots = t.values[grid][filled].astype(np.int64)
            lengths = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(words.row + owner)), pa.array(places - t.first[owner]),
                pa.array(usable[owner].astype(np.int64)), pa.array(hashes.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), pa.array(slots)),
            ], names=["id", "place", "windows", "hash", "slots"])


def windows_of(rows: DataFrame, sizes: tuple[int, ...], only: bytes | None = None, whole: int | None = None) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(only, dtype=np.uint8) if only is not None else None
        for batch in batches:
            yield from _window_rows(batch, sizes, filter_, whole)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(made, f"id {kind}, place long, windows long, hash long, slots array<long>")


#: Words at the head of a sequence by which its places are found.
HEAD_WORDS = 8


def sequences_of(items: DataFrame, shortest: int, window: int) -> DataFrame:
    """(id, size, head, hash) of the texts that have words, but no window: their lower-case words in order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column("text"), NOT_ALNUM, lower=False):
                t = template(words)
                lost = np.diff(words.first) > 0
                for k in range(shortest, window + 1):
                    owner = np.searchsorted(t.first, template_windows(t, k)[1], side="right") - 1
                    lost[owner[np.minimum(np.diff(t.first)[owner], window) == k]] = False
                if not lost.any():
                    continue
                own = np.flatnonzero(lost)
                words.hashes = _rehash(words, LOWER[words.data])
                runs, at, sizes = Runs(words.hashes), words.first[own], np.diff(words.first)[own]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(words.row + own)), pa.array(sizes.astype(np.int64)),
                    pa.array(runs(at, np.minimum(sizes, HEAD_WORDS)).astype(np.int64)),
                    pa.array(runs(at, sizes).astype(np.int64)),
                ], names=["id", "size", "head", "hash"])

    kind = dict(items.dtypes)["id"]
    return items.mapInArrow(made, f"id {kind}, size long, head long, hash long")


def sequences_in(rows: DataFrame, sizes: list[int], heads: bytes, only: bytes) -> DataFrame:
    """(id, hash) of the runs of ``sizes`` words that pass both filters, of their heads and of the whole."""

    def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_head, by_whole = np.frombuffer(heads, dtype=np.uint8), np.frombuffer(only, dtype=np.uint8)
        for batch in batches:
            for words in split_words(batch.column("text"), NOT_ALNUM, lower=True):
                runs, n = Runs(words.hashes), len(words.hashes)
                left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)  # words up to the text's end
                for head in sorted({min(size, HEAD_WORDS) for size in sizes}):
                    places = np.flatnonzero(left >= head)
                    places = places[passes(by_head, runs(places, np.full(len(places), head)))]
                    for size in sizes:
                        if min(size, HEAD_WORDS) != head:
                            continue
                        at = places[left[places] >= size]
                        hashes = runs(at, np.full(len(at), size))
                        use = passes(by_whole, hashes)
                        owner = np.searchsorted(words.first, at[use], side="right") - 1
                        yield pa.RecordBatch.from_arrays([
                            batch.column("id").take(pa.array(words.row + owner)), pa.array(hashes[use].astype(np.int64)),
                        ], names=["id", "hash"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(made, f"id {kind}, hash long")


def hash_filter(windows: DataFrame) -> bytes:
    """A bitmap of fixed size in which the first bits of every hash are set; one bitmap per task is merged."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint64)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in windows.select("hash").coalesce(16).mapInArrow(marked, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, shortest: int = 5, coverage: float = 0.6,
    consistency: float = 0.8, drift: int = 8,
) -> DataFrame:
    """One row per contaminated (doc_id, item_id): windows found, of how many, and whether values differ.

    An item is in a document when at least ``coverage`` of the item's windows of ``window`` template words are
    found there, and at least ``consistency`` of the values in its placeholders stand against one value
    of the document throughout.  ``exact`` says that all those values are the same as in the item.
    Windows meet at an alignment, the place in the document less that in the item.  Each alignment is judged
    on its own, with the nearest meeting of each window up to ``drift`` words off; so is the document as a
    whole, with the first meeting of each window.  One that passes is enough.
    Windows of more placeholders than other words don't count.  An item of fewer template words is one window of
    all its words; one below ``shortest`` words, or without a window that counts, is looked for as it is
    written, by its lower-case words in order.  Null and empty texts hold and contain nothing; rows of one id count together.
    """
    items = benchmark.select(F.col("item_id").alias("id"), whole_text().alias("text"))
    sizes = tuple(range(shortest, window + 1))
    known = materialise(windows_of(items, sizes, whole=window))
    only = hash_filter(known)
    own = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    used = sizes if not known.where("windows = 1").isEmpty() else (window,)
    seen = windows_of(own, used, only=only).select(
        F.col("id").alias("doc_id"), F.col("place").alias("doc_place"), "hash", F.col("slots").alias("doc_slots")
    )
    met = materialise(seen.join(known.withColumnRenamed("id", "item_id"), "hash").drop("hash"))
    # No alignment has more windows than the document as a whole.
    enough = met.groupBy(F.col("doc_id").alias("d"), F.col("item_id").alias("i")).agg(
        F.countDistinct("place").alias("n_found"), F.max("windows").alias("n_windows")
    ).where(F.col("n_found") >= coverage * F.col("n_windows")).select("d", "i", "n_windows")
    near = met.join(enough, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")))
    aligned = near.withColumn("off", F.explode(F.array(*[F.lit(x) for x in range(-drift, drift + 1)]))).withColumn(
        "at", F.col("doc_place") - F.col("place") + F.col("off")
    )
    anywhere = near.withColumn("off", F.lit(0)).withColumn("at", F.lit(None).cast("long"))
    group = ["doc_id", "item_id", "at"]
    found = (
        aligned.unionByName(anywhere).groupBy(*group, "place").agg(
            F.max("n_windows").alias("n_windows"),
            F.min(F.struct(F.abs("off").alias("off"), "doc_place", "slots", "doc_slots")).alias("w"),
        )
        .groupBy(*group).agg(
            F.count(F.lit(1)).alias("n_found"), F.max("n_windows").alias("n_windows"), F.min("w.off").alias("off"),
            F.flatten(F.collect_list(F.arrays_zip("w.slots", "w.doc_slots"))).alias("values"),
        )
        .where((F.col("off") == 0) & (F.col("n_found") >= coverage * F.col("n_windows")))
    )
    group += ["n_found", "n_windows"]
    judged = (
        found.select(*group, F.explode_outer("values").alias("v"))
        .groupBy(*group, F.col("v.slots").alias("there"))
        .agg(F.min("v.doc_slots").alias("low"), F.max("v.doc_slots").alias("high"))
        .groupBy(*group).agg(
            F.avg((F.col("low") == F.col("high")).cast("int")).alias("consistent"),
            F.min((F.col("low") == F.col("high")) & (F.col("low") == F.col("there"))).alias("exact"),
        )
        .where(F.coalesce("consistent", F.lit(1.0)) >= consistency)
    )
    best = judged.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.coalesce("exact", F.lit(True)).alias("exact"), "n_found", "n_windows")).alias("b")
    )
    found = best.select("doc_id", "item_id", "b.n_found", "b.n_windows", "b.exact")
    bare = materialise(sequences_of(items, shortest, window))
    lengths = sorted(r["size"] for r in bare.select("size").distinct().collect())
    if not lengths:
        return found
    runs = sequences_in(own, lengths, hash_filter(bare.select(F.col("head").alias("hash"))), hash_filter(bare))
    one = F.lit(1).cast("long")
    written = runs.withColumnRenamed("id", "doc_id").distinct().join(
        bare.select(F.col("id").alias("item_id"), "hash"), "hash"
    ).select("doc_id", "item_id", one.alias("n_found"), one.alias("n_windows"), F.lit(True).alias("exact"))
    return found.unionByName(written).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("exact", "n_found", "n_windows")).alias("b")
    ).select("doc_id", "item_id", "b.n_found", "b.n_windows", "b.exact")
