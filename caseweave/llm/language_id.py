"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (n = 1 to 3, words padded with
a blank).  A text is compared by how far its own most frequent n-grams are out of place in each
profile; the nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseweave.llm.shared import fold

#: Bits of a code point; an n-gram is up to three of them in one number.
_BITS = 21
#: Stands for a run of other characters; no letter has this code point.
_BLANK = 1
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else the blank."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, np.arange(0x110000, dtype=np.int64), _BLANK)


def text_grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as numbers, with repeats; empty without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.full(len(codes) + 2, _BLANK, np.int64)
    letters[1:-1] = _letters()[codes]
    # Runs of other characters become one blank.
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] > _BLANK) | (letters[:-1] > _BLANK)
    s = letters[keep]
    a, b, c = s[:-2], s[1:-1], s[2:]
    singles = s[s > _BLANK]
    if not len(singles):
        return np.zeros(0, np.int64)
    pairs = s[:-1] << _BITS | s[1:]
    triples = a << 2 * _BITS | b << _BITS | c
    # A triple may have its blank at an end only; as a blank isn't 0, n-grams of unlike lengths differ.
    return np.concatenate([singles, pairs, triples[(b > _BLANK) & ((a > _BLANK) | (c > _BLANK))]])


def most_frequent(grams: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` n-grams, most frequent first, equal counts by number."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:k]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted, of all profiles
    ranks: np.ndarray  # gram x language; ``size`` where the profile lacks the gram
    size: int

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Mean places out of order per language, as a share of the profile size."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        there = self.grams[at] == top
        out = np.abs(self.ranks[at] - np.arange(len(top))[:, None])
        out[~there | (self.ranks[at] >= self.size).all(axis=1)] = self.size
        out[self.ranks[at] >= self.size] = self.size
        return np.minimum(out, self.size).sum(axis=0) / (self.size * len(top))


def learn_profiles(docs: DataFrame, size: int = 300, lang_col: str = "lang", text_col: str = "text") -> Profiles | None:
    """Count the n-grams of all rows with a language; the most frequent ``size`` make its profile.

    Counts are summed within a batch before the shuffle.  What reaches the driver is ``size`` numbers
    per language.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By language: n-grams not counted yet, and counts so far; both are emptied when they are long.
        fresh: dict[str, list[np.ndarray]] = {}
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(language: str) -> None:
            new = np.unique(np.concatenate(fresh.pop(language)), return_counts=True)
            counts[language] = summed([counts[language], new]) if language in counts else new

        def emitted(language: str) -> pa.RecordBatch:
            values, n = counts.pop(language)
            return pa.RecordBatch.from_arrays([
                pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)),
                pa.array(n.astype(np.int64)),
            ], names=["lang", "gram", "n"])

        waiting = 0
        for batch in batches:
            for language, text in zip(batch.column(0), batch.column(1), strict=True):
                language, grams = language.as_py(), text_grams(text.as_py())
                fresh.setdefault(language, []).append(grams)
                waiting += len(grams)
                if waiting > 2_000_000:
                    for x in list(fresh):
                        settle(x)
                    waiting = 0
                    if sum(len(v) for v, _ in counts.values()) > 1_000_000:
                        for x in list(counts):
                            yield emitted(x)
        for x in list(fresh):
            settle(x)
        for x in list(counts):
            yield emitted(x)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    )
    sums = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    if not top:
        return None
    languages = tuple(sorted({r["lang"] for r in top}))
    grams = np.array(sorted({r["gram"] for r in top}), dtype=np.int64)
    ranks = np.full((len(grams), len(languages)), size, dtype=np.int64)
    for r in top:
        ranks[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["rank"] - 1
    return Profiles(languages, grams, ranks, size)


def identify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language, score); the score falls as the nearest profile gets less near than the next."""
    grams = text_grams(text)
    if not len(grams):
        return UNDETERMINED, 0.0
    far = profiles.distances(most_frequent(grams, profiles.size))
    nearest = int(np.argmin(far))
    others = np.delete(far, nearest)
    lead = (others.min() - far[nearest]) / max(others.min(), 1e-9) if len(others) else 1.0
    return profiles.languages[nearest], float(min(1.0, max(0.0, 0.5 + 0.5 * lead)))


def identify_languages(
    docs: DataFrame, held_out_fold: int = 0, folds: int = 5, size: int = 300, keep_rows: bool = False
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; with ``keep_rows`` all columns of ``docs`` before them.

    Columns of ``docs`` with the names of the three results give way to the results.

    Profiles are learned from the rows with a language outside the held-out fold (crc32 of the id
    as text, modulo ``folds``).  A text that is null or has no letter is 'und' with score 0, as is every
    text when nothing could be learned.  Equal distances go to the first language by name.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.withColumn("held_out", fold("doc_id", folds) == held_out_fold)
    profiles = learn_profiles(own.where(~F.col("held_out")), size)

    results = ("held_out", "lang_pred", "score")
    columns = [c for c in docs.columns if c not in results] if keep_rows else ["doc_id"]
    whole = "_whole"
    while whole in docs.columns:
        whole += "_"
    sent = docs.select(
        *columns, (fold("doc_id", folds) == held_out_fold).alias("held_out"), F.col("text").cast("string").alias(whole)
    )

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                identify(t.as_py(), profiles) if profiles else (UNDETERMINED, 0.0) for t in batch.column(batch.num_columns - 1)
            ]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
            ], names=[*columns, *results])

    schema = StructType(sent.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    return sent.mapInArrow(named, schema)
