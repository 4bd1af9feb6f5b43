"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger holds the measurements and
one bit per failed rule; a policy is a mask over those bits, so that another
version of the policy, or the effect of leaving a rule out, needs no second look
at the texts.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"

# A document fails a rule when its expression over the measurements is true; the bit
# of a rule is its place.  New rules are added at the end, so stored bits stay valid.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "n_symbols > 50 AND 100 * n_symbols > 40 * n_words",
    "repeated_lines": "n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
# Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2": tuple(RULES),
}


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = ragged.word_spans(data, offsets, ragged.visible_bytes())
    rows = len(offsets) - 1
    visible = ragged.visible_bytes()[data]
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS.encode())] = True
    characters = visible & ((data & 0xC0) != 0x80)
    words, _ = ragged.span_ids(data, starts, ends)
    lines, repeated = _lines(data, offsets, visible, rows)
    return {
        "n_words": np.diff(first),
        "word_chars": ragged.sums(characters, offsets),
        "n_symbols": ragged.sums(symbols[data], offsets),
        "n_dup_lines": repeated,
        "n_repeat_words": _repeated_words(words, first, rows),
        "n_lines": lines,
    }


def _lines(
    data: np.ndarray, offsets: np.ndarray, visible: np.ndarray, rows: int
) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    row = np.searchsorted(offsets[1:], ends, side="left")
    # A row that ends where the next begins shares that offset; sorted starts and ends still pair.
    seen = np.concatenate(([0], np.cumsum(visible)))
    worded = seen[ends] > seen[starts]
    starts, ends, row = starts[worded], ends[worded], row[worded]
    line, distinct = ragged.span_ids(data, starts, ends)
    different = np.unique(row * max(1, len(distinct)) + line) // max(1, len(distinct))
    lines = np.bincount(row, minlength=rows)
    return lines, lines - np.bincount(different, minlength=rows)


def _repeated_words(words: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    """Words that lie in a window of three words found at least twice in the row."""
    row = np.repeat(np.arange(rows), np.diff(first))
    if len(words) < 3:
        return np.zeros(rows, np.int64)
    inside = np.flatnonzero(row[2:] == row[:-2])
    # Numbers of words, pairs and triples stay below the number of words of the batch.
    kinds = int(words.max()) + 1
    _, pairs = np.unique(words[inside] * kinds + words[inside + 1], return_inverse=True)
    _, triples = np.unique(pairs * kinds + words[inside + 2], return_inverse=True)
    _, windows, counts = np.unique(
        triples * rows + row[inside], return_inverse=True, return_counts=True
    )
    at = inside[counts[windows] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[at + k] = True
    return ragged.sums(covered, first)


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the measurements of a text column (see :func:`ledger`)."""

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            found = _measure(*ragged.flat(columns[0]))
            return [pa.array(found[m].astype(np.int64)) for m in MEASURES]

        return work

    adds = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return ragged.with_columns(df, [text], adds, make, keep)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask_of(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(bit(n) for n in set(names))


def ledger(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "failed_bits"
) -> DataFrame:
    """Add the measurements and ``failed_bits``, one bit per rule of ``RULES``.

    Words are runs of anything but ASCII white space; ``word_chars`` their code
    points; ``n_symbols`` the characters of ``SYMBOLS``; ``n_dup_lines`` the lines
    with a word that equal an earlier line of the text and ``n_lines`` all lines with a
    word; ``n_repeat_words`` the words inside three-word windows that occur at least twice in the text, the first
    occurrence included.  A null text counts as empty: all measurements are 0.  Texts
    are measured whole, repeated rows each get their own entry, an empty table gives an
    empty ledger, and columns with the added names are replaced.  Words and lines are
    compared byte by byte.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits + F.when(F.expr(failed), F.lit(bit(name))).otherwise(F.lit(0))
    return measure(df, text, kept).withColumn(out, bits.cast("long"))


def fails(policy: str | tuple[str, ...], bits: str = "failed_bits") -> Column:
    """Does the ledger row fail a rule of the policy?"""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) != 0


def ablations(
    ledger_rows: DataFrame, policies: Mapping[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Effect of each rule of each policy, from the bits alone.

    Per policy and rule: ``failed`` documents, ``only`` those that no other rule of
    the policy rejects (kept again if the rule were left out) and ``rejected`` by the
    whole policy.  One count per distinct bit pattern is all that is shuffled.
    """
    patterns = ledger_rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [
        (policy, name, bit(name), mask_of(names))
        for policy, names in (POLICIES if policies is None else policies).items()
        for name in names
    ]
    schema = "policy string, rule string, bit long, mask long"
    rules = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                         F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask"))
                for p, r, b, m in rows
            ]
        ).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    )
    each = patterns.select("failed_bits", "n", rules.alias("r")).select("failed_bits", "n", "r.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(hit == F.col("bit")).alias("only"),
        count(hit != 0).alias("rejected"),
    )
