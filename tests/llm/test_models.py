"""Learned scores on held-out labels, and the edges of their inputs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyglass.llm import quality_model, ragged, toxicity
from tallyglass.llm.labelled import held_out, labelled_sample
from tallyglass.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    ones = labels == 1
    pairs = ones.sum() * (~ones).sum()
    return (ranks[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / pairs


def held_out_scores(spark, name, label):
    rows = QUERIES[name](spark, LARGER).where("held_out")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    found = rows.join(labels.where("y IS NOT NULL"), "doc_id").select("score", "predicted", "y")
    return (np.array(c) for c in zip(*found.collect(), strict=True))


def test_quality_on_held_out_documents(spark):
    scores, predicted, labels = held_out_scores(spark, "op10_quality_model", "quality")
    assert area(scores, labels) > 0.98 and (predicted == labels).mean() > 0.97


def test_toxicity_on_held_out_documents(spark):
    scores, predicted, labels = held_out_scores(spark, "op7_toxicity", "toxic")
    assert area(scores, labels) > 0.94
    assert labels[predicted == 1].mean() > 0.9 and predicted[labels == 1].mean() > 0.7


def test_noisy_or_points_at_the_sentence():
    texts = ["Good day. You awful brute! See you", "All is well.\nGood day", "awful brute", "well. day"]
    data, offsets = ragged.flat(pa.array(texts * 8))
    _, _, first, sentence, bucket = toxicity.sentences(data, offsets)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    model = toxicity.train(
        sentence, bucket, document, np.array([1, 0, 1, 0] * 8), toxicity.Settings(epochs=200)
    )
    odds = np.full(first[1], model.bias)
    np.add.at(odds, sentence[sentence < first[1]], model.weights[bucket[sentence < first[1]]])
    assert int(odds.argmax()) == 1 and odds[1] > 0 > odds[0]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, None, None), (None, 1, 1)]])
def test_too_few_labels_give_constant_scores(spark, make_docs, labels):
    docs = make_docs(["one two", "", None, "one two"], [1, 2, None, 1])
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, label in ((quality_model, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, frame, label)
        rows = module.score(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["text"] == "one two"}) == 1
        assert module.score(docs.limit(0), model).count() == 0
        assert module.fit(docs.limit(0), frame, label).bias is not None


def test_spans_are_in_characters(spark, make_docs):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    data = np.frombuffer(b"brute", np.uint8)
    _, _, _, _, buckets = toxicity.sentences(data, np.array([0, 5]))
    weights[buckets] = 40
    model = toxicity.Model(weights, -8.0)
    text = "\u00c9t\u00e9 \u6f22. Du BRUTE!\nNein."
    rows = toxicity.score(make_docs([text, text + "x" * 200_000, None]), model).collect()
    for row in rows:
        if row["text"]:
            (span,) = row["offending"]
            assert row["text"][span["start"] : span["end"]] == " Du BRUTE" and row["score"] > 0.99
        else:
            assert row["offending"] == [] and row["score"] == 0


def test_length_alone_is_not_toxic(spark, make_docs):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    _, _, _, _, buckets = toxicity.sentences(np.frombuffer(b"brute", np.uint8), np.array([0, 5]))
    weights[buckets] = 40
    clean = "Good day. " * 10_000
    texts = ["Good day", clean, clean + "You brute!", "You brute!", clean + "You brute! " + clean]
    rows = toxicity.score(make_docs(texts), toxicity.Model(weights, -8.0)).collect()
    scores = [r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert scores[0] == pytest.approx(scores[1]) and scores[1] < 0.001
    assert min(scores[2:]) > 0.99 and sum(len(r["offending"]) for r in rows) == 3


def test_training_does_not_count_sentences_without_evidence():
    sentence, bucket = np.arange(8), np.array([1, 2, 1, 2, 1, 2, 1, 3])
    labels = np.array([1, 0] * 4)
    short = toxicity.train(sentence, bucket, np.arange(8), labels)
    padded = np.concatenate((np.arange(8), np.repeat(np.arange(8), 10_000)))
    long = toxicity.train(sentence, bucket, padded, labels)
    assert short.weights[1] > 0 and np.allclose(short.weights, long.weights)


def test_sample_is_bounded_and_reads_one_label_per_id(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(40)])
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(50)] + [(3, 0), (4, 1), (5, None)], "doc_id long, toxic int"
    )
    sample = labelled_sample(docs, labels, "toxic", "doc_id", "text", 10)
    assert sample.count() <= 10
    whole = {r["text"]: r["label"] for r in labelled_sample(docs, labels, "toxic", "doc_id", "text", 99).collect()}
    assert len(whole) == 40 and whole["t3"] == 1 and whole["t4"] == 1


def test_sample_has_one_row_per_id(spark, make_docs):
    texts = [f"t{i}" for i in range(8)] + ["one", "two", None] * 50
    docs = make_docs(texts, [*range(8)] + [3] * 150, parts=5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    runs = [
        sorted(map(str, labelled_sample(d, labels, "toxic", "doc_id", "text", 8).collect()))
        for d in (docs, docs.repartition(2), docs.orderBy("text"))
    ]
    assert len(runs[0]) == 8 and runs[0] == runs[1] == runs[2]
    assert all(any(f"'t{i}'" in r for r in runs[0]) for i in (0, 1, 2, 4, 5, 6, 7))


def test_held_out_rows_are_never_learned_from(spark, sf_dir):
    import zlib

    rows = spark.range(200).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert re.match("op10", "op10_quality_model")
