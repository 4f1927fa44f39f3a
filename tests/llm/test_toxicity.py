import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caseweave.llm.hashing import NOT_ALNUM, WHITE, shingle_sets, split_words, windows
from caseweave.llm.toxicity import Model, Settings, learn_shard, margins, score_toxicity, text_features

TEXTS = ["the cat sat", "", None, "The  Cat,\nsat", "cat", " the cat sat ", "Ünï x", "x" * 5000, "sat cat the"]


def test_equal_words_have_equal_hashes():
    for slice_bytes in (1, 7, 1 << 20):
        found = {}
        for words in split_words(pa.array(TEXTS), WHITE, lower=True, slice_bytes=slice_bytes):
            for i in range(words.texts):
                found[words.row + i] = words.hashes[words.first[i] : words.first[i + 1]].tolist()
        for i, text in enumerate(TEXTS):
            assert len(found[i]) == len((text or "").split())
        assert found[0] == found[5] == found[8][::-1] and found[4] == [found[0][1]]
    sliced = pa.array(["skip", *TEXTS]).slice(1)
    assert next(split_words(sliced, WHITE, True)).hashes.tolist() == next(split_words(pa.array(TEXTS), WHITE, True)).hashes.tolist()


def test_windows_stay_within_a_text():
    words = next(split_words(pa.array(["a b c d", "a b", "", "b c d"]), WHITE, lower=True))
    hashes, places = windows(words, 3)
    assert places.tolist() == [0, 1, 6] and hashes[1] == hashes[2]
    assert [len(s) for s in shingle_sets(words, 3)] == [2, 1, 0, 1]


def test_margin_counts_a_feature_once():
    (features,) = text_features(pa.array(["bad thing"]), 20)
    model = Model(-1.0, features, np.array([1.0] * len(features)))
    assert np.allclose(margins(pa.array(["bad thing", "bad thing", "", None]), model, 20), [3.0, 3.0, -1, -1])
    assert margins(pa.array(["bad thing bad bad"]), model, 20)[0] == 3.0


def test_learning_finds_the_word_and_stays_sparse():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 40)) + (" horrid" if k % 5 == 0 else "") for k in range(600)]
    examples = list(zip(text_features(pa.array(texts), 20), [int(k % 5 == 0) for k in range(600)], strict=True))
    model = learn_shard(examples, Settings())
    m = margins(pa.array(["calm words", "such horrid words"]), model, 20)
    assert m[0] < 0 < m[1] and len(model.features) < 600


def test_documents(labels, odd, odd_labels, none, no_labels, spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id", "left_semi")
    out = score_toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    caught = [r.predicted for r in held if toxic[r.doc_id] == 1]
    assert sum(caught) >= 0.8 * len(caught)
    assert sum(r.predicted for r in held if toxic[r.doc_id] == 0) <= 0.02 * len(held)
    turned = labels.withColumn("toxic", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")
    ).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in out} == {r.doc_id: r.score for r in score_toxicity(docs, turned).collect()}
    for docs_, labels_ in ((odd, odd_labels), (odd, no_labels), (none, no_labels), (odd, labels)):
        assert score_toxicity(docs_, labels_).count() == docs_.count()
