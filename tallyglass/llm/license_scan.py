"""Licence texts found by diagonal voting.

Every pair of neighbouring words of a text is a hash.  Joined to the same hashes of
the templates, each hit lies on a diagonal: its place in the text minus its place in
the template.  A text that contains a template has many hits on one diagonal, and on
neighbouring ones where a word was put in or left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

GRAM = 2
# Diagonals this far apart belong to one span, if the span is not much longer than the template.
NEAR = 2
LEAST_COVERAGE = 0.75
# One bit of a 64-bit number per word pair.
MOST_WORDS = 64


class Template(NamedTuple):
    """Words of a licence; an exact one must stand word by word."""

    label: str
    words: str
    exact: bool = False


# The phrases whose places are counted.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
# Sentences of public licences and usual notices.
NOTICES = (
    Template("agpl", "gnu affero general public license"),
    Template("all-rights-reserved", "copyright all rights reserved"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    Template("cc-by", "licensed under a creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("lgpl", "gnu lesser general public license"),
    Template(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
    ),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = ragged.lower_bytes()[data]
    starts, ends, first = ragged.word_spans(low, offsets, ragged.letter_bytes())
    return ragged.span_hashes(low, starts, ends), first


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rolling word pairs, their row offsets, and the words of each row."""
    words, first = _word_hashes(data, offsets)
    counts = np.diff(first)
    ends = ragged.offsets_of(np.maximum(counts - (GRAM - 1), 0))
    at = ragged.gather(np.arange(len(words)), first[:-1], np.diff(ends))
    return ragged.mix(ragged.mix(words[at]) + words[at + GRAM - 1]), ends, counts


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row per word pair of each template; the templates are a fixed list."""
    rows = []
    for number, t in enumerate(templates):
        data = np.frombuffer(t.words.encode(), np.uint8)
        found, _, (words,) = grams(data, np.array([0, len(data)]))
        if not GRAM <= words <= MOST_WORDS:
            raise ValueError(f"a template has {GRAM} to {MOST_WORDS} words: {t.words}")
        rows += [
            (int(h), number, place, t.label, int(words), t.exact)
            for place, h in enumerate(found.astype(np.int64).tolist())
        ]
    return spark.createDataFrame(
        rows, "gram long, template int, place int, label string, size int, exact boolean"
    )


def votes(
    df: DataFrame, templates: Sequence[Template], text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Hits per text, template and diagonal; a text without hits has one row without template.

    All word pairs of all texts are joined to the templates' pairs, whose fixed list is
    broadcast.  Counting starts before the shuffle: a task sends one row per text and
    diagonal.
    """

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            found, ends, words = grams(*ragged.flat(columns[0]))
            hashes = ragged.list_column(found.view(np.int64), ends, pa.int64())
            return [pa.array(words.astype(np.int64)), hashes]

        return work

    adds = T.StructType(
        [T.StructField("_words", T.LongType()), T.StructField("_grams", T.ArrayType(T.LongType()))]
    )
    names = [f"_k{i}" for i in range(len(keep))]
    source = df.select(
        *[F.col(ragged.quoted(c)).alias(n) for c, n in zip(keep, names, strict=True)],
        F.col(ragged.quoted(text)).alias("_text"),
    )
    rows = ragged.with_columns(source, ["_text"], adds, make, names)
    rows = rows.withColumn(
        "_row", F.monotonically_increasing_id()
    )
    each = rows.select(
        "_row", *names, "_words", F.posexplode_outer("_grams").alias("_at", "gram")
    )
    hits = each.join(F.broadcast(template_grams(df.sparkSession, templates)), "gram", "left")
    return hits.groupBy(
        "_row", *names, "_words", "template", "label", "size", "exact",
        (F.col("_at") - F.col("place")).alias("diagonal"),
    ).agg(
        F.when(F.col("template").isNotNull(), F.count(F.lit(1))).alias("votes"),
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"),
        F.min("_at").alias("low"),
        F.max("_at").alias("high"),
    )


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans from the votes: merged neighbouring diagonals that cover the template.

    An exact template needs all its pairs on one diagonal.  Of the others, diagonals at
    most ``NEAR`` apart are merged; together they must hold ``LEAST_COVERAGE`` of the
    template's pairs, each pair counted once.  The span reaches from the first word of the
    first pair that stands in the text, ``first``, to the last word of the last one, ``last``,
    so it lies inside the text.  Rows of texts without hits stay, without a template.
    """
    pairs = F.col("size") - F.lit(GRAM - 1)
    own = [c for c in votes.columns if c.startswith("_")]
    window = W.partitionBy("_row", "template", "exact").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(window)
    begins = F.col("exact") | gap.isNull() | (gap > NEAR)
    merged = (
        votes.withColumn("_begins", begins.cast("int"))
        .withColumn("_span", F.sum("_begins").over(window))
        .groupBy(*own, "template", "label", "size", "exact", "_span")
        .agg(
            F.min("low").alias("first"),
            (F.max("high") + GRAM - 1).alias("last"),
            F.sum("votes").alias("votes"),
            (F.max("diagonal") - F.min("diagonal")).alias("shift"),
            F.max(F.bit_count("places")).alias("best"),
            F.bit_count(F.bit_or("places")).alias("merged"),
        )
        # A long chain of neighbours counts by its best diagonal alone.
        .withColumn(
            "covered",
            F.when(F.col("shift") * 2 <= F.col("size"), F.col("merged")).otherwise(F.col("best")),
        )
        .withColumn("coverage", F.col("covered") / pairs)
    )
    enough = F.when(F.col("exact"), F.col("covered") == pairs)
    enough = enough.otherwise(F.col("coverage") >= LEAST_COVERAGE)
    return merged.withColumn("found", F.coalesce(enough, F.lit(False))).drop("_span")


def scan(
    df: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per text: its licences and where they stand.

    ``n_words``; ``n_base`` places of exact templates; ``first_word`` and ``last_word``,
    the smallest and largest start of one (null without any); ``base_labels`` and
    ``labels`` (with the other templates), distinct, sorted, joined by commas; ``score``,
    the largest share of a template that was found, 0 to 1; ``spans``, the found
    (label, first word, last word, coverage).  Words are lower-cased runs of ASCII letters, digits
    and all characters beyond ASCII.  Null and empty texts have no words and score 0; a
    text of any length is looked at whole; repeated rows each give a row; an empty table
    gives none; kept columns whose name clashes with a result's are dropped.
    """
    results = (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans",
    )
    keep = [c for c in keep if c.lower() not in results]
    found = spans(votes(df, templates, text, keep))
    base = F.col("found") & F.col("exact")
    joined = lambda when: F.array_join(
        F.sort_array(F.collect_set(F.when(when, F.col("label")))), ","
    )
    place = F.struct(
        "label",
        F.col("first").cast("long").alias("first_word"),
        F.col("last").cast("long").alias("last_word"),
        "coverage",
    )
    own = [f"_k{i}" for i in range(len(keep))]
    summary = found.groupBy("_row", *own, "_words").agg(
        F.count(F.when(base, F.lit(1))).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("found"), place))).alias("spans"),
    )
    return summary.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_words").alias("n_words"),
        *[F.col(c) for c in results[1:]],
    )
