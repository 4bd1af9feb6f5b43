"""Token counts without the tokens.

The pre-tokens of a batch are one ragged array of symbols; in each round every
sequence applies its lowest-rank pair at the same time, and the symbols that
survive are counted.  Only distinct pre-tokens are merged, and only their counts
are kept between batches.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, ragged


class Counts:
    """Surviving symbols of the pre-tokens met so far in a task."""

    def __init__(self, rule: bpe.Rules):
        self.rule = rule
        self.known: dict[bytes, int] = {}

    def survivors(self, words: list[str]) -> np.ndarray:
        encoded = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        data = np.frombuffer(b"".join(encoded), np.uint8)
        symbols, ends = self.rule.first[data], np.cumsum(lengths)
        symbols[ends - 1] = self.rule.last[data[ends - 1]]
        return self.rule.pairs.merge(symbols, lengths)[1]

    def look_up(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        which, distinct = ragged.span_ids(codes, starts, ends)
        words = distinct.to_pylist()
        if len(self.known) > bpe.KNOWN_WORDS:
            self.known.clear()
        counts = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(counts < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            counts[new] = self.survivors([bpe.plain(w) for w in fresh])
            self.known.update(zip(fresh, counts[new].tolist(), strict=True))
        return counts[which]


_counts: dict[str, Counts] = {}


def count_texts(path: str, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    rule = bpe.rules(path)
    known = _counts.setdefault(path, Counts(rule))
    out = np.zeros(len(texts), np.int64)
    for owners, parts in bpe.stretches(rule, texts):
        joined = bpe.END.join(parts) + bpe.END
        codes, starts, ends, cuts = bpe.pre_tokens(rule, joined)
        counts = np.ones(len(starts), np.int64)
        ordinary = ~bpe.is_special(codes[starts])
        long = ends - starts > bpe.KNOWN_LENGTH
        easy, rare = ordinary & ~long, ordinary & long
        if easy.any():
            counts[easy] = known.look_up(codes, starts[easy], ends[easy])
        if rare.any():
            spans = zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)
            counts[rare] = known.survivors([joined[a:b] for a, b in spans])
        per_part = ragged.sums(counts, np.concatenate(([0], np.searchsorted(starts, cuts))))
        np.add.at(out, owners, per_part)
    return out


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    limit: int = 512,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Counts equal the length of the tokenizers library's encoding with the file at
    ``path``, without added special tokens, truncation or padding; special tokens'
    strings inside a text count as one.  Null and empty texts have 0 bytes and 0
    tokens.  Texts of any length are counted whole, repeated rows stay, empty tables
    stay empty, and columns with the added names are replaced.
    """
    split = bpe.rules(path).single_numbers
    changes = bpe.class_changes(split)

    def make() -> ragged.Work:
        bpe.use_classes(split, changes)

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            sizes = np.diff(ragged.flat(columns[0])[1])
            counts = count_texts(path, ragged.texts(columns[0]))
            return [pa.array(sizes), pa.array(counts)]

        work.close = lambda: _counts.pop(path, None)
        return work

    adds = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != "over_limit"]
    counted = ragged.with_columns(df, [text], adds, make, kept)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
