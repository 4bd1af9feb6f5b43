"""Supervised quality classifier over subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams, and a softmax over a linear layer gives the label.  Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of
labelled documents; every document is scored by one pass without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from .labelled import labelled_sample

BUCKETS = 1 << 16
SIZES = (3, 4)
# Documents the model is fitted on, at most; the ones with the smallest hashed ids.
MAX_LABELLED = 4000


class Model(NamedTuple):
    """Log-odds of label 1 that each bucket adds to the average, and the constant part."""

    weights: np.ndarray
    bias: float


class Settings(NamedTuple):
    width: int = 4
    epochs: int = 4
    rate: float = 30.0
    layer_rate: float = 0.1
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and n-grams (spaces around the word included), and their rows.

    Words are runs of anything but ASCII white space, with their case and punctuation.
    A word that repeats the one before it adds one more bucket, the same for all words.
    """
    data, offsets = ragged.padded(data, offsets)
    starts, ends, _ = ragged.word_spans(data, offsets, ragged.visible_bytes())
    data = np.where(ragged.visible_bytes()[data], data, 0x20).astype(np.uint8)
    words = ragged.rolling_hashes(data, starts, ends)
    same = (words[1:] == words[:-1]) & (np.diff(_row_of(starts, offsets)) == 0)
    again = np.flatnonzero(same) + 1
    places = [starts, starts[again]]
    hashes = [words, np.full(len(again), ragged.mix(len(SIZES))[0], np.uint64)]
    for size in SIZES:
        at, found = ragged.ngram_hashes(data, starts - 1, ends, size, beyond=1)
        places.append(at)
        hashes.append(found)
    place = np.concatenate(places)
    row = _row_of(place, offsets)
    bucket = (np.concatenate(hashes) >> np.uint64(64 - 16)).astype(np.int64)
    return bucket, row


def _row_of(place: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each place; the space before a row belongs to it."""
    return np.searchsorted(offsets - 1, place, side="right") - 1


def train(
    buckets: np.ndarray,
    counts: np.ndarray,
    offsets: np.ndarray,
    labels: np.ndarray,
    settings: Settings = Settings(),  # noqa: B008 - immutable
) -> Model:
    """Fit by minibatch gradient descent; rows are documents of distinct buckets with counts.

    Without rows of both labels the model is constant: the share of label 1, or one half
    without any row.
    """
    rows = len(labels)
    share = labels.mean() if rows else 0.5
    if rows == 0 or share in (0.0, 1.0):
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    random = np.random.default_rng(settings.seed)
    width = settings.width
    vectors = random.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    layer = np.zeros((width, 2), np.float32)
    constant = np.log([1 - share, share]).astype(np.float32)
    total = np.maximum(ragged.sums(counts, offsets), 1)
    part = (counts / np.repeat(total, np.diff(offsets))).astype(np.float32)
    steps, step = settings.epochs * rows, 0
    for _ in range(settings.epochs):
        for row in random.permutation(rows).tolist():
            here = slice(offsets[row], offsets[row + 1])
            left = 1 - step / steps
            step += 1
            # A document's buckets are distinct, so its update needs no accumulation.
            mine, weight = vectors[buckets[here]], part[here]
            hidden = weight @ mine
            scores = hidden @ layer + constant
            odds = np.exp(scores - scores.max())
            wrong = odds / odds.sum()
            wrong[labels[row]] -= 1
            back = layer @ wrong
            layer -= settings.layer_rate * left * np.outer(hidden, wrong)
            constant -= settings.layer_rate * left * 0.1 * wrong
            vectors[buckets[here]] = mine - settings.rate * left * np.outer(weight, back)
    side = layer[:, 1] - layer[:, 0]
    return Model((vectors @ side).astype(np.float32), float(constant[1] - constant[0]))


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

    Executors reduce the whole texts of the sample to bucket counts; only these reach
    the driver, at most ``max_labelled`` times ``BUCKETS`` numbers whatever the corpus.
    Rows without id or label are left out, as are ids that the documents lack.
    """

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            bucket, row = features(data, offsets)
            keys, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(offsets)) * BUCKETS)
            kinds = ((keys % BUCKETS, pa.int32()), (counts, pa.int32()))
            return [ragged.list_column(v, ends, kind) for v, kind in kinds]

        return work

    adds = T.StructType(
        [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("buckets", "counts")]
    )
    sample = labelled_sample(docs, labels, label, id, text, max_labelled)
    reduced = ragged.with_columns(sample, ["text"], adds, make, ["order", "label"])
    rows = reduced.orderBy("order", F.hash("buckets")).toArrow()
    buckets, offsets = ragged.lists_of(rows["buckets"])
    counts, _ = ragged.lists_of(rows["counts"])
    return train(buckets, counts, offsets, rows["label"].to_numpy().astype(np.int64), settings)


def score(
    df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Add the probability of label 1, from 0 to 1, computed from the whole text.

    A null text counts as empty; a text without a word gets the model's constant part.
    Repeated rows get equal scores, an empty table stays empty, and a column named like
    ``out`` is replaced.  Other columns never enter the score.
    """
    weights, bias = model

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            bucket, row = features(data, offsets)
            rows = len(offsets) - 1
            total = np.bincount(row, weights[bucket], rows)
            odds = total / np.maximum(np.bincount(row, minlength=rows), 1) + bias
            return [pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))]

        return work

    return ragged.with_columns(
        df, [text], T.StructType([T.StructField(out, T.DoubleType())]), make, keep
    )
