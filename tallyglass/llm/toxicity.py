"""Toxicity by multiple-instance learning.

Only documents have labels, so a document is a bag of sentences: each sentence gets
a probability from its hashed words and character n-grams, and the document's is
their noisy-or, one minus the chance that no sentence is toxic.  Sentences without
evidence are left out, in training and in scoring, so that length alone never makes a
document toxic.  Training follows the gradient of the document labels through that
combination, and the learned sentence scores then point at the offending sentences.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallyglass.session import stored

from . import ragged
from .labelled import labelled_sample

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SIZES = (4, 6)
# Documents the model is fitted on, at most; the ones with the smallest hashed ids.
MAX_LABELLED = 20_000
OFFENDING = 0.5


class Model(NamedTuple):
    """Log-odds that the presence of a bucket adds to a sentence, and their constant part."""

    weights: np.ndarray
    bias: float


class Settings(NamedTuple):
    epochs: int = 60
    rate: float = 1.0
    sparsity: float = 1e-4  # larger values leave fewer buckets with a weight
    bias: float = -8.0  # a sentence without evidence is almost surely clean
    least_documents: int = 3  # toxic documents that a bucket needs
    least_odds: float = 2.0  # how much more often a bucket must be in toxic documents


def sentence_bytes() -> np.ndarray:
    """A sentence ends at a full stop, exclamation or question mark, or a line break."""
    inside = np.ones(256, bool)
    inside[list(b".!?\n")] = False
    return inside


def sentences(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence starts, ends and row offsets; then (sentence, bucket) pairs, each once."""
    low = ragged.lower_bytes()[data]
    starts, ends, first = ragged.word_spans(low, offsets, sentence_bytes())
    words, word_ends, _ = ragged.word_spans(low, offsets, ragged.letter_bytes())
    places, hashes = [words], [ragged.rolling_hashes(low, words, word_ends)]
    for size in SIZES:
        at, found = ragged.ngram_hashes(low, words, word_ends, size)
        places.append(at)
        hashes.append(found)
    sentence = np.searchsorted(starts, np.concatenate(places), side="right") - 1
    bucket = np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)
    return starts, ends, first, sentence, bucket.astype(np.int64)


def doubt(odds: np.ndarray, told: np.ndarray, document: np.ndarray, documents: int) -> np.ndarray:
    """Minus the logarithm of the chance that a document has no toxic sentence.

    Only sentences with evidence for it (``told``) count; the constant part alone is none,
    so the number of the others does not add up.
    """
    return np.bincount(document, np.where(told, np.logaddexp(0, odds), 0), documents)


def train(
    sentence: np.ndarray,
    bucket: np.ndarray,
    document: np.ndarray,
    labels: np.ndarray,
    settings: Settings = Settings(),  # noqa: B008 - immutable
) -> Model:
    """Fit by gradient descent with steps scaled per bucket and weights pulled to zero.

    ``bucket`` holds the buckets present in each ``sentence`` (numbers into
    ``document``, the document of each sentence); ``labels`` are the documents'.
    Sentences without a bucket change nothing.  Without documents of both labels every
    sentence keeps the constant part.
    """
    weights = np.zeros(BUCKETS, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(weights, settings.bias)
    used, at = np.unique(bucket, return_inverse=True)
    count, documents = len(document), len(labels)
    learned = np.zeros(len(used))
    seen = np.full(len(used), 1e-6)
    told = np.bincount(sentence, minlength=count) > 0
    toxic = labels[document] == 1
    for _ in range(settings.epochs):
        odds = np.bincount(sentence, learned[at], count) + settings.bias
        chance = 1 / (1 + np.exp(-odds))
        counted = told & (odds >= settings.bias)
        clean = np.exp(-doubt(odds, counted, document, documents))
        pull = (clean / np.maximum(1 - clean, 1e-12))[document]
        slope = np.where(toxic, -chance * pull, chance) * counted / documents
        change = np.bincount(at, slope[sentence], len(used))
        seen += change * change
        step = settings.rate / np.sqrt(seen)
        learned -= step * change
        learned = np.sign(learned) * np.maximum(np.abs(learned) - step * settings.sparsity, 0)
    weights[used] = learned
    return Model(weights, settings.bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    id: str = "doc_id",
    text: str = "text",
    max_labelled: int = MAX_LABELLED,
    settings: Settings = Settings(),  # noqa: B008 - immutable
) -> Model:
    """Fit on at most ``max_labelled`` labelled documents (those with the smallest hashed ids).

    The sample's whole texts are written once.  Spark counts in how many documents of
    either label a bucket occurs; buckets that are not clearly commoner in label 1 get no
    weight, and only what is left of the sample, a few numbers a document, reaches the
    driver.  Rows without id or label are left out.
    """
    sample = stored(labelled_sample(docs, labels, label, id, text, max_labelled), "labelled")
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return train(*[np.zeros(0, np.int64)] * 4, settings)

    def make_buckets() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            _, _, first, sentence, bucket = sentences(data, offsets)
            row = np.searchsorted(first, sentence, side="right") - 1
            keys = np.unique(row * BUCKETS + bucket)
            ends = np.searchsorted(keys, np.arange(len(offsets)) * BUCKETS)
            return [ragged.list_column(keys % BUCKETS, ends, pa.int32())]

        return work

    numbers = T.ArrayType(T.IntegerType())
    found = ragged.with_columns(
        sample, ["text"], T.StructType([T.StructField("b", numbers)]), make_buckets, ["label"]
    )
    # At most BUCKETS rows, whatever the sample.
    told = (
        found.select("label", F.explode("b").alias("b"))
        .groupBy("b")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
        .where(F.col("toxic") >= settings.least_documents)
        .where(
            (F.col("toxic") + 0.5) / totals[1]
            > settings.least_odds * (F.col("clean") + 0.5) / totals[0]
        )
    )
    kept = np.sort(told.select("b").toArrow()["b"].to_numpy().astype(np.int64))

    def make_evidence() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            _, _, first, sentence, bucket = sentences(data, offsets)
            told = np.isin(bucket, kept)
            keys = np.unique(sentence[told] * BUCKETS + bucket[told])
            number, bucket = keys // BUCKETS, keys % BUCKETS
            row = np.searchsorted(first, number, side="right") - 1
            ends = np.searchsorted(row, np.arange(len(offsets)))
            return [
                pa.array(np.diff(first).astype(np.int32)),
                ragged.list_column(number - first[row], ends, pa.int32()),
                ragged.list_column(bucket, ends, pa.int32()),
            ]

        return work

    adds = T.StructType(
        [
            T.StructField("sentences", T.IntegerType()),
            T.StructField("sentence", numbers),
            T.StructField("bucket", numbers),
        ]
    )
    evidence = ragged.with_columns(sample, ["text"], adds, make_evidence, ["order", "label"])
    rows = evidence.orderBy("order", F.hash("sentence", "bucket")).toArrow()
    bucket, offsets = ragged.lists_of(rows["bucket"])
    inside, _ = ragged.lists_of(rows["sentence"])
    counts = rows["sentences"].to_numpy().astype(np.int64)
    begins = np.repeat(np.cumsum(counts) - counts, np.diff(offsets))
    document = np.repeat(np.arange(len(counts)), counts)
    flags = rows["label"].to_numpy().astype(np.int64)
    return train(inside + begins, bucket.astype(np.int64), document, flags, settings)


def score(
    df: DataFrame,
    model: Model,
    text: str = "text",
    out: str = "score",
    spans: str = "offending",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the document's score and its offending sentences.

    ``out`` is the noisy-or of the scores of sentences whose buckets raise them above the
    constant part, 0 to 1; without such a sentence it is 0, however long the text is, and
    so for null, empty and wordless texts and for a model without weights.  ``spans`` lists
    the sentences scoring at least one half: ``start`` and ``end`` in characters of the
    text, ``score``.  Whole texts are read, repeated rows score alike, empty tables stay
    empty, and columns with the added names are replaced.
    """
    weights, bias = model
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def make() -> ragged.Work:
        told = weights != 0

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            starts, ends, first, sentence, bucket = sentences(data, offsets)
            some = told[bucket]
            keys = np.unique(sentence[some] * BUCKETS + bucket[some])
            odds = np.bincount(keys // BUCKETS, weights[keys % BUCKETS], len(starts)) + bias
            chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            score = -np.expm1(-doubt(odds, odds > bias, owner, len(first) - 1))
            bad = np.flatnonzero(chance >= OFFENDING)
            row = np.searchsorted(first, bad, side="right") - 1
            characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base = characters[offsets[row]]
            values = pa.StructArray.from_arrays(
                [
                    pa.array(characters[starts[bad]] - base, pa.int64()),
                    pa.array(characters[ends[bad]] - base, pa.int64()),
                    pa.array(chance[bad]),
                ],
                fields=list(place),
            )
            cuts = np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)
            return [
                pa.array(np.clip(score, 0, 1)),
                pa.ListArray.from_arrays(pa.array(cuts), values),
            ]

        return work

    item = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    adds = T.StructType(
        [T.StructField(out, T.DoubleType()), T.StructField(spans, T.ArrayType(item))]
    )
    return ragged.with_columns(df, [text], adds, make, keep)
