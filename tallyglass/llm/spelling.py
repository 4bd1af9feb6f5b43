"""Spelling variants: words one edit apart, each led to a much more frequent form.

Two words one edit apart are found by pivotal grams.  All bigrams have one order, rare
ones first.  Of a word's three rarest bigrams (with those tied to the third) a dynamic
program chooses two that do not overlap and are rarest together: its pivots.  One edit
breaks at most one of them, and whatever lies on the far side of the edit stays as it is:
either the word up to and with the first pivot, or the word from the second pivot on.  The
word whose third bigram is the later one must have that pivot among its own rarest ones,
at the same distance from the untouched end.  So pivots with the text on their untouched
side are looked up among the other words' rarest bigrams with theirs, in one equi-join
whose pairs are verified before they leave it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallyglass.functions.skew import lookup_join
from tallyglass.session import stored

from . import ragged

LEAST_LENGTH = 6
LEAST_COUNT = 5
# A form occurs at least so many times as often as its variant.
RATIO = 5
# Letters of words: A-Z, a-z and the characters from U+00C0 to U+00FF.
LETTERS = r"A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, id: Column, every: int = 199) -> Column:
    """The run without one of its characters where ``every`` divides a checksum.

    The checksum h is the CRC-32 of ``<id>:<run>``; character h % length goes.
    """
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, shorter).otherwise(run)


def word_counts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", every: int | None = 199
) -> DataFrame:
    """``word`` and ``n`` of the runs of at least six letters, capitals A-Z made small.

    ``every`` (None: never) takes characters out of some runs, see :func:`damaged`.  Runs are
    counted in part before the shuffle, so a frequent word costs a row a task.
    """
    body = F.col(ragged.quoted(text))
    runs = docs.select(
        F.col(ragged.quoted(id)).alias("id"),
        F.explode(
            F.regexp_extract_all(body, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
        ).alias("run"),
    )
    runs = runs.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    word = F.col("run") if every is None else damaged(F.col("run"), F.col("id"), every)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pivots(places: Sequence[int], weights: Sequence[int]) -> tuple[int, int]:
    """Places of two bigrams that do not overlap with the least weight together.

    ``places`` grow.  For every second bigram in turn the best first one among those that end
    before it is known from the bigrams passed so far.
    """
    best, before = None, None  # lightest pair; lightest bigram that ends before this one
    passed = 0
    for place, weight in zip(places, weights, strict=True):
        while places[passed] + 2 <= place:
            if before is None or weights[passed] < before[0]:
                before = (weights[passed], places[passed])
            passed += 1
        if before is not None and (best is None or before[0] + weight < best[0]):
            best = (before[0] + weight, before[1], place)
    return best[1], best[2]


def _order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank and number of words of each bigram: at most 8,100, as there are 90 letters."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2))))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r["n"], r["gram"]) for r in counts.collect())
    rank, weight = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for place, (n, gram) in enumerate(found):
        a, b = gram.encode("latin-1")
        rank[a << 8 | b], weight[a << 8 | b] = place, n
    return rank, weight


def _keys(sides: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of untouched sides together with the length of the word that has them."""
    return ragged.mix((sides ^ ragged.mix(lengths.ravel()).reshape(lengths.shape)).ravel()).view(
        np.int64
    ).reshape(sides.shape)


def _marks(words: DataFrame) -> DataFrame:
    """Words with the rank of their third bigram, and hashes to look up and to be found by.

    Each rare bigram has two hashes: of the word up to it and of the word from it on, each
    with the word's length; a word looks for its own length and those next to it.  A hash that
    two texts share costs a comparison and nothing else.
    """
    rank, weight = _order(words)

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            joined = "".join(ragged.texts(columns[0])).encode("latin-1")
            data = np.frombuffer(joined, np.uint8)
            lengths = np.array([len(w) for w in columns[0].to_pylist()], np.int64)
            offsets = ragged.offsets_of(lengths)
            at = ragged.gather(np.arange(len(data)), offsets[:-1], lengths - 1)
            owner = np.repeat(np.arange(len(lengths)), lengths - 1)
            gram = data[at].astype(np.int64) << 8 | data[at + 1]
            place = rank[gram]
            third = place[np.lexsort((place, owner))][ragged.offsets_of(lengths - 1)[:-1] + 2]
            rare = place <= third[owner]
            at, owner, gram = at[rare], owner[rare], gram[rare]
            starts, ends = offsets[owner], offsets[owner + 1]
            upto = ragged.rolling_hashes(data, starts, at + 2)
            since = ~ragged.rolling_hashes(data, at, ends)
            cuts = np.searchsorted(owner, np.arange(len(lengths) + 1))
            texts = np.stack((upto, since), axis=1)
            found = _keys(texts, lengths[owner, None])
            sides = np.empty((len(lengths), 2), np.uint64)
            steps, heavy = at.tolist(), weight[gram].tolist()
            for i, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                first, second = pivots(steps[low:high], heavy[low:high])
                sides[i, 0] = texts[low + steps[low:high].index(first), 0]
                sides[i, 1] = texts[low + steps[low:high].index(second), 1]
            asked = [_keys(sides, lengths[:, None] + longer) for longer in (-1, 0, 1)]
            asked = np.concatenate(asked, axis=1)
            return [
                pa.array(third),
                ragged.list_column(asked.ravel(), np.arange(len(lengths) + 1) * 6, pa.int64()),
                ragged.list_column(found.ravel(), cuts * 2, pa.int64()),
            ]

        return work

    adds = T.StructType(
        [
            T.StructField("third", T.LongType()),
            T.StructField("asked", T.ArrayType(T.LongType())),
            T.StructField("found", T.ArrayType(T.LongType())),
        ]
    )
    return ragged.with_columns(words, ["word"], adds, make, ["word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``n_a``, ``b``, ``n_b``), a before b, of words exactly one edit apart.

    ``words`` has distinct words of at least six letters (``word``, ``n``).
    """
    marked = stored(_marks(words), "grams")
    asking = marked.select("word", "n", "third", F.explode("asked").alias("key"))
    rare = marked.select(
        F.col("word").alias("other"),
        F.col("n").alias("other_n"),
        F.col("third").alias("other_third"),
        F.explode("found").alias("key"),
    )
    near = (
        (F.col("asking.key") == F.col("rare.key"))
        & (F.col("third") <= F.col("other_third"))
        & (F.levenshtein("word", "other", 1) == 1)
    )
    pairs = asking.alias("asking").join(rare.alias("rare"), near)
    first = F.col("word") < F.col("other")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select(
        either("word", "other").alias("a"),
        either("n", "other_n").alias("n_a"),
        either("other", "word").alias("b"),
        either("other_n", "n").alias("n_b"),
    ).distinct()


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """The last form of every word that has one; chains have at most ``steps`` forms.

    Each round doubles the distance a word looks ahead.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = lookup_join(roots, ahead, ["root"], "left")
        roots = stored(moved.select("word", F.coalesce("far", "root").alias("root")), "roots")
    return roots


def variants(words: DataFrame) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``.

    ``words`` has distinct words of at least six letters of :data:`LETTERS` with their
    counts, as :func:`frequent_words` gives them.  Two words are near if one inserted, deleted
    or replaced character makes one the other.  A word's form is its near word of the largest
    count (of equal ones the first in code-point order) if that is at least five times the
    word's own; without one ``form`` and ``form_n`` are null.  ``root`` follows forms to the
    last one, the word itself if it has none.  ``n_near`` is 0 for a word by itself.  An empty
    table gives no rows, and other columns play no part.  No pair is lost to a limit; the
    words of one key are compared in parts when adaptive execution finds them too many.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    nearest = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(nearest, "word", "left")
    leads = -F.col("best.n") >= RATIO * F.col("n")
    judged = stored(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, F.col("best.near")).alias("form"),
            F.when(leads, -F.col("best.n")).alias("form_n"),
        ),
        "judged",
    )
    forms = judged.where(F.col("form").isNotNull())
    # Counts grow fivefold with every form, so chains are short.
    low, high = forms.agg(F.min("n"), F.max("form_n")).first()
    steps = 0 if low is None else math.ceil(math.log(high / max(1, low), RATIO)) + 1
    roots = _roots(forms, steps)
    out = judged.join(roots, "word", "left")
    return out.withColumn("root", F.coalesce("root", "word"))


def frequent_words(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least: int = LEAST_COUNT,
    every: int | None = None,
) -> DataFrame:
    """Words of at least six letters that occur at least ``least`` times, with their counts.

    A word is a maximal run of letters of a whole text, capitals A-Z made small; null and
    empty texts have none, repeated rows count each, a null id counts as an empty one.
    """
    return word_counts(docs, id, text, every).where(F.col("n") >= least)
