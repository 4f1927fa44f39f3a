"""Packing of documents into training sequences along a space-filling curve.

Every document gets a vector: the sum of a pseudo-random direction per word, scaled to unit variance.
Its few coordinates are cut into cells, and the cells are put in the order of a Hilbert curve, on
which neighbours are alike.  Spark sorts the documents by that order into ranges; within a range they
are tokenised and laid end to end, and the stream is cut every ``length`` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import erf
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.hashing import SLICE_BYTES, WHITE, byte_set, mix, split_words
from caseweave.llm.shared import bounded, whole_text

DIMENSIONS, CELL_BITS = 4, 12
LINE_BLANK = byte_set(b" \n")
#: Token sequences that a worker remembers by the piece of text between two blanks.
REMEMBERED = 400_000
SLOT_BITS = 20
#: Sequence numbers of one range start this far apart.
RANGE_STEP = 1 << 40
#: Documents per range whose places are looked at to cut the curve into ranges of like size.
SAMPLED = 100

_grid = np.linspace(-4, 4, 1601)
_normal = np.array([0.5 * (1 + erf(x / 2**0.5)) for x in _grid])


def vectors(texts: pa.Array) -> np.ndarray:
    """One row of DIMENSIONS numbers per text, of about unit variance; zero without a word."""
    out = np.zeros((len(texts), DIMENSIONS))
    for words in split_words(texts, WHITE, lower=True):
        count = np.maximum(1, np.diff(words.first))
        owner, spread = words.owner(), mix(words.hashes, 11)
        for d in range(DIMENSIONS):
            # 16 bits of the hash as a number between -1 and 1, of variance 1/3.
            step = ((spread >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(float) / 32767.5 - 1
            sums = np.bincount(owner, step, words.texts)
            out[words.row : words.row + words.texts, d] = sums / np.sqrt(count / 3)
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer points (rows), ``bits`` per coordinate.

    Gray-code walk from the highest bit down: at each level the part of the cube is found, and the
    remaining coordinates are reflected and exchanged so that parts join end to end.
    """
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    n, one = len(x), np.uint64(1)
    level = 1 << (bits - 1)
    while level > 1:
        low, q = np.uint64(level - 1), np.uint64(level)
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        level >>= 1
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    fix = np.zeros(len(x[0]), np.uint64)
    level = 1 << (bits - 1)
    while level > 1:
        fix = np.where((x[n - 1] & np.uint64(level)) != 0, fix ^ np.uint64(level - 1), fix)
        level >>= 1
    x = [v ^ fix for v in x]
    key = np.zeros(len(x[0]), np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Vectors, by the normal distribution cut into cells of equal share, as places on the curve."""
    share = np.interp(vectors(texts), _grid, _normal)
    cells = np.minimum((share * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)
    return hilbert_keys(cells, CELL_BITS)


@lru_cache(maxsize=1)
def load_tokenizer(path: str) -> Any:
    """Read once in a worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole texts, remembering the ids of blank-separated pieces.

    For the tokenizer used here the ids of a text are those of its pieces in order: it drops white space
    and never joins across it.  Only blanks and line feeds cut; a piece with any other character
    outside Latin letters, digits and marks is given to the tokenizer as it is.  The distinct pieces of a
    slice of texts are found by their hashes, and the ids are put together by index.
    """

    #: What the fast way takes: characters that normalisation leaves alone, but for the case.
    PLAIN = regex.compile("[\\x21-\\x7e\\xa1-\\u024f]+")
    #: The tokenizer's own rule for the parts of a piece (a fixed value).
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.marks = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
        other = [b for b in range(256) if b not in own]
        self.alphabet = {b: b for b in own} | {b: 256 + k for k, b in enumerate(other)}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0
        # A direct-mapped table in front of ``known``: the hash and the place that own each slot.
        self.slot_keys, self.slot_places = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)

    def part_ids(self, part: str) -> tuple[int, ...]:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > REMEMBERED // 2:
                self.parts.clear()
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            found = self.parts[part] = tuple([t.id for t in self.tokenizer.model.tokenize(shown)])
        return found

    def piece_ids(self, piece: str) -> list[int]:
        if not self.PLAIN.fullmatch(piece) or not self.marks.isdisjoint(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [i for part in self.PARTS.findall(piece.lower()) for i in self.part_ids(part)]

    def remember(self, key: int, ids: list[int]) -> int:
        place, end = len(self.known), self.used + len(ids)
        if place >= len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = ids
        self.starts[place], self.lengths[place], self.used = self.used, len(ids), end
        self.known[key] = place
        slot = key & ((1 << SLOT_BITS) - 1)
        if not self.slot_keys[slot]:
            self.slot_keys[slot], self.slot_places[slot] = key, place
        return place

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for words in split_words(texts, LINE_BLANK, lower=False, slice_bytes=4 * SLICE_BYTES):
            slots = words.hashes & np.uint64((1 << SLOT_BITS) - 1)
            places = self.slot_places[slots]
            other = np.flatnonzero(self.slot_keys[slots] != words.hashes)
            keys, at, which = np.unique(words.hashes[other], return_index=True, return_inverse=True)
            if len(self.known) + len(keys) > REMEMBERED:
                self.forget()
                other = np.arange(len(words.hashes))
                places = np.zeros(len(other), np.int64)
                keys, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
            known, found = self.known, np.zeros(len(keys), np.int64)
            for k, key in enumerate(keys.tolist()):
                place = known.get(key)
                if place is None:
                    word = other[at[k]]
                    piece = words.data[words.starts[word] : words.ends[word]].tobytes().decode()
                    place = self.remember(key, self.piece_ids(piece))
                found[k] = place
            places[other] = found[which]
            lengths = self.lengths[places]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.flat[np.repeat(self.starts[places] - ends[:-1], lengths) + np.arange(ends[-1])]
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                yield ids[ends[a] : ends[b]]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, ranges: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of a document are those of its text (null: empty) without special tokens, then
    ``end_id``.  Sequences hold exactly ``length`` tokens; the rest at the end of a range is cut into
    sequences whose lengths are powers of two, so nothing needs padding.  A piece never crosses two
    sequences; a document of n tokens makes at most n / length + 2 pieces, and more only at the end of a
    range.  Equal documents, however many, are told apart by id and may go to several ranges; rows that
    are equal throughout are packed as often as they occur.  A number of a sequence is its range's
    number times 2**40 plus its place in the range.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = dict(docs.dtypes)["doc_id"]
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select("doc_id", whole_text().alias("text"), F.xxhash64("doc_id", "text").alias("tie"))

    def placed(batch: pa.RecordBatch) -> np.ndarray:
        # 48 bits of the curve, then 15 of the tie: equal texts make many places.
        return (curve_keys(batch.column("text")) << 15) | (batch.column("tie").to_numpy().astype(np.int64) & 0x7FFF)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(placed(batch))], names=["key"])

    sample = bounded(own, "tie", SAMPLED * ranges).select("text", "tie").mapInArrow(sampled, "key long")
    keys = np.sort(np.array([r["key"] for r in sample.collect()], dtype=np.int64))
    cuts = keys[(np.arange(1, ranges) * len(keys)) // ranges] if len(keys) else keys

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = placed(batch)
            slot = np.searchsorted(cuts, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(key), pa.array(slot)], names=["doc_id", "text", "tie", "key", "slot"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        sequence, filled = TaskContext.get().partitionId() * RANGE_STEP, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        # The pieces of the sequence being filled wait, because its end may have to be cut anew.
        waiting: list[tuple] = []
        id_type = pa.int64()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            table = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), t, q, o) for d, s, x, t, q, o in found]
            columns = list(zip(*table, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            done: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                start = 0
                while start < len(ids):
                    piece = ids[start : start + length - filled]
                    waiting.append((doc, start, piece, len(ids), sequence, filled))
                    start, filled = start + len(piece), filled + len(piece)
                    if filled == length:
                        done += waiting
                        waiting, sequence, filled = [], sequence + 1, 0
                if len(done) >= 2000:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
        if waiting:
            # The rest: sequences of falling powers of two.
            done, left, used = [], filled, 0
            room = 1 << (left.bit_length() - 1)
            for doc, start, ids, total, _, _ in waiting:
                at = 0
                while at < len(ids):
                    piece = ids[at : at + room - used]
                    done.append((doc, start + at, piece, total, sequence, used))
                    at, used = at + len(piece), used + len(piece)
                    if used == room:
                        left -= room
                        sequence, used, room = sequence + 1, 0, 1 << (max(1, left).bit_length() - 1)
            yield rows(done)

    return (
        own.mapInArrow(keyed, f"doc_id {kind}, text string, tie long, key long, slot int")
        .repartitionById(ranges, F.col("slot")).sortWithinPartitions("key", "tie", "doc_id").drop("tie", "key", "slot")
        .mapInArrow(
            packed, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        )
    )
