"""Near duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets.

1. Every text gets the fingerprint of its shingle set, 128 MinHash values in bands of four, and an odd
   sketch: one MinHash sample per bin of the hash range, folded into a bitmap by parity.  The bits in
   which two sketches differ count the samples in which the sets differ.  Short sets are sampled in fine
   bins, so that nearly all of their shingles are samples, long ones in coarse bins, and sets in between in both.
2. Texts with equal sets are one class from here on, named by its smallest id.
3. Classes that share a band are candidates.  First each class is held against the most widely shared
   class of every one of its bands, which joins a group of copies by as many links as it has members.
   What is left, pairs in one band that aren't in one component yet, is compared sketch by sketch in
   blocks; only pairs that may reach the threshold leave a block.
4. Links are confirmed by the sizes of intersection and union of the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.hashing import WHITE, mix, shingle_sets, split_words
from caseweave.llm.shared import small_batches
from caseweave.plans.fixpoint import components
from caseweave.session import materialise

#: Two sets at the threshold of 0.8 share none of 32 bands of 4 with probability 5e-8.
BANDS, ROWS = 32, 4
#: Bits of an odd sketch.
SKETCH_BITS = 2048
#: Bins of the hash range that give a sample each, for sets up to FINE_MOST and from COARSE_LEAST shingles.
#: Two sets within 20 % of each other's size always have one kind in common.
FINE_BINS, FINE_MOST = 1 << 13, 1200
COARSE_BINS, COARSE_LEAST = 1 << 10, 960
#: Standard deviations that an estimate may fall short of the threshold.
SAFETY = 5.0
#: Most members of a band that one block compares.
BLOCK = 1024


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return (mix(np.arange(BANDS * ROWS, dtype=np.uint64), 21) | np.uint64(1))[:, None]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """One minimum per permutation; long sets are worked on in parts."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[at : at + 2048][None, :] * _multipliers()).min(axis=1))
    return out


def odd_sketch(shingles: np.ndarray, bins: int) -> tuple[bytes, int]:
    """The parity bitmap of the samples, and their number.  ``shingles`` are sorted hashes."""
    place = shingles // np.uint64((1 << 64) // bins)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    samples = mix(shingles[first], 22) & np.uint64(SKETCH_BITS - 1)
    parity = np.bincount(samples.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes(), int(first.sum())


def odd_sketches(shingles: np.ndarray) -> tuple[bytes, bytes, int, int]:
    """The fine and the coarse sketch and their samples; empty and 0 where the size calls for none."""
    n = len(shingles)
    fine = odd_sketch(shingles, FINE_BINS) if n <= FINE_MOST else (b"", 0)
    coarse = odd_sketch(shingles, COARSE_BINS) if n >= COARSE_LEAST else (b"", 0)
    return fine[0], coarse[0], fine[1], coarse[1]


@dataclass
class Sketches:
    """Sizes and sketches of some sets, one per row; sketches as rows of 64-bit words."""

    n: np.ndarray
    fine: np.ndarray
    coarse: np.ndarray
    n_fine: np.ndarray
    n_coarse: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, side: str = "") -> Sketches:
        return cls(
            _numbers(batch, f"n{side}"), _bits(batch.column(f"fine{side}")), _bits(batch.column(f"coarse{side}")),
            _numbers(batch, f"n_fine{side}"), _numbers(batch, f"n_coarse{side}"),
        )

    def __getitem__(self, at: np.ndarray | int) -> Sketches:
        return Sketches(self.n[at], self.fine[at], self.coarse[at], self.n_fine[at], self.n_coarse[at])


def may_reach(x: Sketches, y: Sketches, threshold: float) -> np.ndarray:
    """False where sizes or sketches rule the threshold out; ``x`` may be one set against many.

    The size filter is exact.  For sets at the threshold, a sample of one set is a sample of the other
    with a known chance; the number of common samples follows from the bits that differ.  The margin covers the error of the
    parity count and of the samples, which is small where nearly all shingles are samples.
    """
    def occupied(size: np.ndarray) -> np.ndarray:
        return bins * (1 - np.exp(-size / bins))

    both_fine = (x.n_fine > 0) & (y.n_fine > 0)
    bins = np.where(both_fine, FINE_BINS, COARSE_BINS)
    e, f = (np.where(both_fine, s.n_fine, s.n_coarse).astype(float) for s in (x, y))
    differing = np.where(
        both_fine, np.bitwise_count(x.fine ^ y.fine).sum(axis=-1), np.bitwise_count(x.coarse ^ y.coarse).sum(axis=-1)
    )
    inner = 1 - 2 * differing / SKETCH_BITS
    changed = np.where(inner > 0, -SKETCH_BITS / 2 * np.log(np.maximum(inner, 1e-9)), np.inf)
    common = (e + f - changed) / 2
    # What two sets just at the threshold would have in common.
    union = (x.n + y.n) / (1 + threshold)
    chance = threshold * occupied(union) * (1 / occupied(x.n) + 1 / occupied(y.n)) / 2
    mean = (e + f) / 2
    expected = mean * np.minimum(chance, 1.0)
    apart = np.maximum(e + f - 2 * expected, 1.0)
    parity = np.maximum(SKETCH_BITS / 4 * np.expm1(4 * apart / SKETCH_BITS) - apart, 0.5) / 4
    unseen = np.clip(1 - 2 * mean / (x.n + y.n), 0.03, 1.0)
    margin = SAFETY * np.sqrt(parity + expected * (1 - np.minimum(chance, 0.999)) * unseen) + 1.0
    low, high = np.minimum(x.n, y.n), np.maximum(x.n, y.n)
    return (low >= threshold * high - 1e-9) & (common >= expected - margin)


#: The columns of a set's sketches.
SKETCHES = ("fine", "coarse", "n_fine", "n_coarse")


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, fp, bands, sketches) of each row; without a word n is 0 and the rest null."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for words in split_words(batch.column("text"), WHITE, lower=True):
                for shingles in shingle_sets(words, k):
                    if not len(shingles):
                        rows.append((0, *[None] * 6))
                        continue
                    values = min_hashes(shingles).reshape(BANDS, ROWS)
                    key = mix(np.arange(BANDS, dtype=np.uint64), 23)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
                    print_ = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                    rows.append((len(shingles), print_, key.astype(np.int64).tobytes(), *odd_sketches(shingles)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                *[pa.array(columns[c], pa.binary()) for c in (2, 3, 4)],
                *[pa.array(columns[c], pa.int32()) for c in (5, 6)],
            ], names=["id", "n", "fp", "bands", *SKETCHES])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(signed, f"id {kind}, n long, fp binary, bands binary, fine binary, coarse binary, n_fine int, n_coarse int")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the rows whose id is in ``ids``; shingles as sorted 64-bit hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, row = batch.column("id"), 0
            for words in split_words(batch.column("text"), WHITE, lower=True):
                found = [s.tobytes() for s in shingle_sets(words, k)]
                yield pa.RecordBatch.from_arrays(
                    [owners.slice(row, words.texts), pa.array(found, pa.binary())], names=["id", "shingles"]
                )
                row += words.texts

    kind = dict(docs.dtypes)["id"]
    return docs.join(ids, "id", "left_semi").mapInArrow(made, f"id {kind}, shingles binary")


def _bits(column: pa.Array) -> np.ndarray:
    none = bytes(SKETCH_BITS // 8)
    return np.frombuffer(b"".join(x or none for x in column.to_pylist()), dtype=np.uint64).reshape(
        len(column), SKETCH_BITS // 64
    )


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def promising(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sketches don't rule the threshold out."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = may_reach(Sketches.of(batch, "_a"), Sketches.of(batch, "_b"), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(mask))

    side = lambda s: sketches.select(
        F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", *SKETCHES)]
    )
    kind = dict(pairs.dtypes)["a"]
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(kept, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) with 100 * intersection >= percent * union of the whole sets."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                mask.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"shingles_{s}"))
    kind = dict(pairs.dtypes)["a"]
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(checked, f"a {kind}, b {kind}")


def blocks_to_compare(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (bucket, size, id, ...) with the ``block`` in which they are compared.

    The members of a bucket are dealt into parts of about BLOCK by a hash, and every two parts meet in
    one block; a bucket of one part is one block.  ``part`` is 0 or 1 in a block of two parts.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return (
        members.withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("block", F.xxhash64(
            "bucket", F.least("own", "other"), F.greatest("own", "other")
        ))
        .drop("parts", "size")
    )


def compared_in_blocks(members: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket but different components that may reach the threshold.

    A pair is compared in the first band that it shares only.
    """
    kind = dict(members.dtypes)["id"]
    rows = blocks_to_compare(members).join(known, "id").select(
        "block", "bucket", "band", "own", "other", "id", "component", "n", *SKETCHES, "bands"
    )

    def pairs_of(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().to_batches()[0]
        sketches = Sketches.of(block)
        bands = np.frombuffer(b"".join(block.column("bands").to_pylist()), dtype=np.int64).reshape(-1, BANDS)
        n = sketches.n
        component, own, other = _numbers(block, "component"), _numbers(block, "own"), _numbers(block, "other")
        bucket, band = _numbers(block, "bucket"), int(block.column("band")[0].as_py())
        across = bool((own != other).any())
        left, right = [], []
        for i in range(len(n) - 1):
            j = np.arange(i + 1, len(n))
            j = j[(component[j] != component[i]) & (bucket[j] == bucket[i])]
            if across:
                j = j[own[j] != own[i]]
            if len(j):
                j = j[(bands[j, :band] != bands[i, :band]).all(axis=1)]
            if len(j):
                ok = may_reach(sketches[i], sketches[j], threshold)
                left += [i] * int(ok.sum())
                right += j[ok].tolist()
        ids = block.column("id")
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    return rows.groupBy("block").applyInArrow(pairs_of, f"a {kind}, b {kind}")


def link_near_duplicates(
    docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept).

    Documents whose sets of ``k``-word shingles (A-Z lower-cased, words between white space) have
    100 * intersection >= percent * union are linked; ``component_id`` is the smallest id that can be
    reached, and the document with that id is kept.  A text of fewer than ``k`` words is one shingle; a
    text without a word, or null, is linked with nothing.  Rows with a null id are kept and linked with
    nothing.  Rows of one id with several texts are judged text by text.
    """
    with small_batches(docs.sparkSession):
        rows, named = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), k, percent)
    linked = rows.where("n > 0 AND id IS NOT NULL").join(named, "fp").select("id", "n", "component")
    alone = rows.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def _components(own: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, fp) of every row, and (fp, component) of every set; all steps are done on return."""
    threshold = percent / 100
    rows = materialise(signatures(own, k))
    # One row per set.  Equal sets meet in map tasks first, so a large group of copies is cheap.
    classes = materialise(
        rows.where("n > 0 AND id IS NOT NULL").groupBy("fp")
        .agg(F.min(F.struct("id", "n", *SKETCHES, "bands")).alias("c")).select("fp", "c.*")
    )
    spread = classes.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))
    )).alias("band", "bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(spread.join(sizes, "bucket").select("bucket", "band", "size", "id"))
    shared = members.groupBy("id").agg(F.sum(F.col("size") - 1).alias("popularity"))
    sketches = materialise(
        classes.join(shared, "id").select("id", "n", *SKETCHES, "bands", "popularity")
    )
    sets = materialise(whole_sets(own, shared.select("id"), k))

    ranked = members.join(sketches.select("id", "popularity"), "id")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct(
        F.col("popularity").alias("p"), F.col("id").alias("id")
    )).alias("hub")).select("bucket", F.col("hub.id").alias("a"))
    spokes = members.join(hubs, "bucket").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = materialise(confirmed(promising(spokes, sketches, threshold), sets, percent))

    found = materialise(components(links, "a", "b"))
    placed = materialise(
        members.join(found.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = placed.join(mixed.where("low <> high").select("bucket"), "bucket", "left_semi")
    more = materialise(confirmed(materialise(
        compared_in_blocks(rest, sketches.drop("popularity"), threshold).distinct()
    ), sets, percent))
    if not more.isEmpty():
        # Links between components that are known: a smaller graph than all links.
        name = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
        joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
            F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")
        )
        merged = materialise(components(joined, "a", "b"))
        # A node of ``merged`` is the name of a component, or a class that had no link before.
        renamed = found.join(merged.withColumnRenamed("component", "final"), found["component"] == merged["node"], "left").select(
            found["node"], F.coalesce("final", found["component"]).alias("component")
        )
        fresh = merged.join(found.select("node"), "node", "left_anti")
        found = materialise(renamed.unionByName(fresh))
    named = materialise(classes.select("fp", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    ))
    return rows.select("id", "n", "fp"), named
