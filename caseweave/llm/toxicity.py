"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words and their stems, of neighbouring pairs, and of pairs with
one word between them; each counts once however often it occurs, so the length of a text doesn't dilute it.
FTRL keeps two sums per feature, which give every feature its own learning rate, and its L1 term
leaves most weights at zero: the model is a short list of (feature, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.hashing import NOT_ALNUM, Words, pair, split_words
from caseweave.llm.shared import bounded, fold, labelled


#: Words longer than that count by their first bytes, too, so that forms of one word share a feature.
STEM_BYTES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Settings:
    bits: int = 20  # 2**bits features: this bounds the model
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.1
    passes: int = 4
    shards: int = 1  # learned apart and averaged
    max_rows: int = 12_000  # labelled rows learned from


@dataclass(frozen=True)
class Model:
    bias: float
    features: np.ndarray  # sorted
    weights: np.ndarray


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all n-grams, skip-grams and stems, with repeats."""
    h, owner = words.hashes, words.owner()
    shift = np.uint64(64 - bits)
    near, far = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    stems = [words.prefixes(n) for n in STEM_BYTES]
    parts = [
        (owner, h), (owner[1:][near], pair(h[:-1], h[1:])[near]),
        (owner[2:][far], pair(h[:-2] + np.uint64(1), h[2:])[far]), *[(owner[at], s) for s, at in stems],
    ]
    return (
        np.concatenate([o for o, _ in parts]), (np.concatenate([x for _, x in parts]) >> shift).astype(np.int64)
    )


def text_features(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    for words in split_words(texts, NOT_ALNUM, lower=True):
        owner, found = features(words, bits)
        order = np.argsort(owner, kind="stable")
        found, cuts = found[order], np.searchsorted(owner[order], np.arange(words.texts + 1))
        for i in range(words.texts):
            yield np.unique(found[cuts[i] : cuts[i + 1]]).astype(np.int32)


def learn_shard(examples: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    """FTRL-proximal over the examples, ``passes`` times, each time in another fixed order."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, without L1
    s = settings

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    def bias() -> float:
        return -z[size] / ((s.beta + np.sqrt(n[size])) / s.alpha)

    for k in range(s.passes):
        for i in np.random.default_rng(k).permutation(len(examples)):
            at, label = examples[i]
            w, b = weights(at), bias()
            margin = np.clip(w.sum() + b, -35, 35)
            g = 1 / (1 + np.exp(-margin)) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            sigma = (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / s.alpha
            z[size] += g - sigma * b
            n[size] += g * g
    found = np.flatnonzero(np.abs(z[:size]) > s.l1)
    return Model(float(bias()), found, weights(found))


def learn(rows: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learn on each shard of ``rows`` (_key, _text, _label) and average; None without both classes.

    The rows are a bounded sample, so a shard is bounded too.  A shard's rows are put in the order
    of a hash of their key, so a repeated task learns the same.
    """

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            labels = batch.column("_label").to_pylist()
            examples += list(zip(text_features(batch.column("_text"), settings.bits), labels, strict=True))
        if examples:
            model = learn_shard(examples, settings)
            yield pa.RecordBatch.from_pydict({
                "rows": [len(examples)], "bias": [model.bias],
                "features": [model.features.tolist()], "weights": [model.weights.tolist()],
            }, schema=schema)

    schema = pa.schema([
        ("rows", pa.int64()), ("bias", pa.float64()),
        ("features", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())),
    ])
    counts = {r["_label"] for r in rows.groupBy("_label").count().collect()}
    if counts != {0, 1}:
        return None
    parts = (
        rows.repartition(settings.shards, "_key").sortWithinPartitions(F.xxhash64("_key", F.lit(7)), "_key", "_text")
        .mapInArrow(learned, "rows long, bias double, features array<long>, weights array<double>").collect()
    )
    total = sum(p["rows"] for p in parts)
    dense = np.zeros(1 << settings.bits)
    for p in parts:
        dense[p["features"]] += np.array(p["weights"]) * (p["rows"] / total)
    found = np.flatnonzero(dense)
    return Model(sum(p["bias"] * p["rows"] for p in parts) / total, found, dense[found])


def margins(texts: pa.Array, model: Model, bits: int) -> np.ndarray:
    """The sum of bias and weights of every text's distinct features."""
    out = np.full(len(texts), model.bias)
    known = np.zeros(1 << bits, dtype=bool)
    known[model.features] = True
    for words in split_words(texts, NOT_ALNUM, lower=True):
        owner, found = features(words, bits)
        hit = known[found]
        # Only the few features with a weight are made distinct.
        both = np.unique(owner[hit] << bits | found[hit])
        weights = model.weights[np.searchsorted(model.features, both & ((1 << bits) - 1))]
        out[words.row : words.row + words.texts] += np.bincount(both >> bits, weights, words.texts)
    return out


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, folds: int = 3, threshold: float = 0.7,
    settings: Settings = Settings(),
) -> DataFrame:
    """Per document: doc_id, held_out, score (higher: toxic likelier), predicted.

    Labels of the held-out fold (crc32 of the id as text, modulo ``folds``) are never read; of the
    others at most about ``max_rows`` are learned from, chosen by a hash of the id.  A null text counts
    as empty and gets the bias as its score.  With labels of one class or none every score is 0.5.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("_text")).withColumn(
        "held_out", fold("doc_id", folds) == held_out_fold
    )
    usable = labels.where((fold("doc_id", folds) != held_out_fold) & F.col("toxic").isNotNull())
    rows = labelled(own, bounded(usable, "doc_id", settings.max_rows), "toxic").select(
        F.col("doc_id").alias("_key"), "_text", "_label"
    )
    model = learn(rows, settings)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            m = margins(batch.column("_text"), model, settings.bits) if model else np.zeros(n)
            score = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                pa.array((score >= threshold).astype(np.int32)),
            ], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return own.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
