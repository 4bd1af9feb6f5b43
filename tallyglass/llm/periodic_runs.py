"""Periodic runs of words by internal pattern matching.

The suffix array of a batch of texts is made by doubling; the class of every block of
2**k words falls out on the way and gives exact common extensions to both sides.  A run
of period q and at least four periods contains a block of 2**k words, aligned to 2**k,
with 2**k the largest power of two up to (3q + 1) / 2, and the block's copy q words on.
So each aligned block asks a wavelet tree over the suffix array for its next occurrences
in the window where such copies lie.  Three occurrences or more are a progression (a
block that is periodic itself) and give one candidate, the distance between the ends of
the two short-period stretches; one or two occurrences are candidates themselves.  Every
candidate is extended to both sides and kept if it is long enough, so there are at most
two candidates a block and about as many blocks as words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

MIN_WORDS = 6
MIN_PERIODS = 4
_VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
)


class Suffixes:
    """Suffix array of several rows of symbols, suffixes of a row compared within it.

    ``classes[k][i]`` is the number of suffixes before the first one that begins with the
    same 2**k symbols as suffix i: equal for equal blocks, and the low end of the block's
    interval in the suffix array.  Blocks cut off by the row's end are equal to no other.
    Rounds end as soon as all suffixes differ and sort only those that do not yet.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        n = len(symbols)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.row_starts = offsets[:-1][row]
        self.row_ends = offsets[1:][row]
        keys = row * (int(symbols.max(initial=0)) + 1) + symbols
        rank = self._ranked(np.zeros(n, np.int64), keys, np.arange(n), np.zeros(n, np.int64))
        self.classes = [rank]
        width = 1
        while True:
            sizes = np.bincount(rank, minlength=n)
            tied = np.flatnonzero(sizes[rank] > 1)
            if not len(tied):
                break
            follower = np.full(len(tied), -1, np.int64)
            inside = tied + width < self.row_ends[tied]
            follower[inside] = rank[tied[inside] + width]
            base = rank[tied].astype(np.int64)
            rank = self._ranked(rank, base * (n + 1) + follower + 1, tied, base)
            self.classes.append(rank)
            width *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    @staticmethod
    def _ranked(
        rank: np.ndarray, keys: np.ndarray, places: np.ndarray, base: np.ndarray
    ) -> np.ndarray:
        """New ranks of the places by key; equal bases are neighbours in key order."""
        out = rank.astype(np.int32)
        order = np.argsort(keys, kind="stable")
        key, group = keys[order], base[order]
        count = np.arange(len(order))
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(fresh, count, 0))
        opens = np.ones(len(order), bool)
        opens[1:] = group[1:] != group[:-1]
        out[places[order]] = group + first - np.maximum.accumulate(np.where(opens, count, 0))
        return out

    def forward(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of equal symbols from two different places of a row on."""
        common = np.zeros(len(left), np.int64)
        last = len(self.order) - 1
        limit = self.row_ends[left] - np.maximum(left, right)
        for k in range(len(self.classes) - 1, -1, -1):
            of = self.classes[k]
            a, b = np.minimum(left + common, last), np.minimum(right + common, last)
            common += ((common < limit) & (of[a] == of[b])).astype(np.int64) << k
        return common

    def backward(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of equal symbols before two different places of a row."""
        common = np.zeros(len(left), np.int64)
        room = np.minimum(left, right) - self.row_starts[left]
        for k in range(len(self.classes) - 1, -1, -1):
            of = self.classes[k]
            step = common + (1 << k)
            fits = step <= room
            a, b = np.where(fits, left - step, 0), np.where(fits, right - step, 0)
            common += (fits & (of[a] == of[b])).astype(np.int64) << k
        return common


class WaveletTree:
    """Order statistics of ranges of an array of different numbers below its length."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(values) - int(before[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers of each range are below its limit."""
        found = np.zeros(len(low), np.int64)
        whole = np.where(limit >> len(self.levels) > 0, high - low, 0)
        for bit, ones, zeros in self.levels:
            one_low, one_high = ones[low], ones[high]
            up = (limit >> bit) & 1 == 1
            found += np.where(up, (high - low) - (one_high - one_low), 0)
            low, high = (
                np.where(up, zeros + o, at - o) for at, o in ((low, one_low), (high, one_high))
            )
        return np.where(whole > 0, whole, found)  # a limit beyond every number takes all

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number with ``n`` smaller ones in each range."""
        value = np.zeros(len(low), np.int64)
        n = n.copy()
        for bit, ones, zeros in self.levels:
            one_low, one_high = ones[low], ones[high]
            small = (high - low) - (one_high - one_low)
            up = n >= small
            n -= np.where(up, small, 0)
            value |= up.astype(np.int64) << bit
            low, high = (
                np.where(up, zeros + o, at - o) for at, o in ((low, one_low), (high, one_high))
            )
        return value

    def successors(
        self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rank in its range of the smallest number from ``first`` on, and how many up to ``last``."""
        before = self.below(low, high, first)
        return before, self.below(low, high, last + 1) - before


def find_runs(
    symbols: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs, by start and period."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    suffixes = Suffixes(symbols, offsets)
    n = len(symbols)
    tree = WaveletTree(suffixes.order)
    left, gap = [none], [none]
    for k in range(1, len(suffixes.classes)):
        block, of = 1 << k, suffixes.classes[k]
        at = np.arange(0, n, block)
        low = of[at].astype(np.int64)
        size = np.bincount(of, minlength=n)[low]
        at, low, size = (x[size > 1] for x in (at, low, size))
        # The shift of a copy: the periods this block size answers for.
        nearest, farthest = (2 * block + 1) // 3, (4 * block - 2) // 3
        skip, count = tree.successors(low, low + size, at + nearest, at + farthest)
        some = count > 0
        at, low, size, skip, count = (x[some] for x in (at, low, size, skip, count))
        first = tree.nth(low, low + size, skip)
        again = count > 1
        second = tree.nth(low[again], (low + size)[again], skip[again] + 1)
        few = count < 3
        left += [at[few], at[count == 2]]
        gap += [(first - at)[few], second[count[again] == 2] - at[count == 2]]
        many = count > 2
        if many.any():
            x, y = at[many], first[many]
            step = second[count[again] > 2] - y
            x_end = x + step + suffixes.forward(x, x + step)
            y_end = y + step + suffixes.forward(y, y + step)
            apart = y_end > x_end  # else the block and its copies are one stretch
            left.append(x[apart])
            gap.append((y_end - x_end)[apart])
    x, period = np.concatenate(left), np.concatenate(gap)
    start = x - suffixes.backward(x, x + period)
    end = x + period + suffixes.forward(x, x + period)
    long = end - start >= np.maximum(min_words, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    # A multiple of a run's smallest period gives the same stretch.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _joined(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int
) -> pa.Array:
    """Words of each row joined by one space."""
    lengths = ends - starts
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    slots = lengths + ~last
    begins = np.cumsum(slots) - slots
    out = np.full(int(slots.sum()), 0x20, np.uint8)
    out[ragged.gather(np.arange(len(out)), begins, lengths)] = ragged.gather(data, starts, lengths)
    per_row = np.bincount(row, weights=slots, minlength=rows).astype(np.int64)
    return ragged.binaries(out, ragged.offsets_of(per_row)).cast(pa.large_string())


def periodic_runs(
    df: DataFrame, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to every text.

    Words are what lies between ASCII white space.  A run is a stretch of consecutive
    words with smallest period q (words q apart are equal), at least six words and four
    periods long, that no neighbouring word extends.  ``runs`` lists (start, length,
    period) by start, then period, words counted from 0; ``collapsed`` has the words that
    no run holds after its first period, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed``; repeated rows
    stay, an empty table gives an empty one, kept columns with the added names are
    replaced.  Texts are looked at whole, about a megabyte at a time; a longer one is a
    piece of its own and takes some 150 bytes of memory a word.
    """

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            rows = len(offsets) - 1
            starts, ends, first = ragged.word_spans(data, offsets, ragged.visible_bytes())
            begin, end, period = find_runs(ragged.span_ids(data, starts, ends)[0], first)
            of = np.searchsorted(first, begin, side="right") - 1
            cuts = np.searchsorted(of, np.arange(rows + 1))
            parts = [begin - first[of], end - begin, period]
            runs = pa.StructArray.from_arrays([pa.array(p) for p in parts], ["start", "length", "period"])
            depth = np.zeros(len(starts) + 1, np.int64)
            np.add.at(depth, begin + period, 1)
            np.add.at(depth, end, -1)
            kept = np.cumsum(depth[:-1]) == 0
            row = np.repeat(np.arange(rows), np.diff(first))[kept]
            return [
                pa.array(np.diff(first)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs),
                _joined(data, starts[kept], ends[kept], row, rows),
            ]

        return work

    adds = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", RUNS),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return ragged.with_columns(df, [text], adds, make, keep)


def with_repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with words of every tenth text, by its id's checksum, made to repeat.

    With h the checksum (CRC-32) of the decimal id, g = h // 10 and n words, a text with
    h % 10 = 0 gets for each word i from a = g % n on the word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8); its words are then joined by one space.  Other texts,
    texts without words and rows without an id stay as they are.
    """

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            out = []
            for body, key in zip(ragged.texts(columns[0]), columns[1].to_pylist(), strict=True):
                g, rest = divmod(zlib.crc32(str(key).encode()), 10)
                words = [] if rest or key is None else _VISIBLE.findall(body)
                if words:
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    body = " ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)])
                out.append(body)
            return [pa.array(out, pa.large_string())]

        return work

    adds = T.StructType([T.StructField(text, T.StringType())])
    return ragged.with_columns(df, [text, id], adds, make, [c for c in df.columns if c != text])


def digests(runs: str = "runs", collapsed: str = "collapsed") -> dict[str, Column]:
    """Columns that sum up a text's runs: their number, the longest, and two checksums."""
    longest = F.array_min(
        F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform(runs, lambda r: F.concat(line(r), F.lit("\n")))
    return {
        "n_runs": F.size(runs).cast("long"),
        "start": longest["s"],
        "length": -longest["l"],
        "period": longest["p"],
        "exponent_milli": F.floor(-longest["l"] * 1000 / longest["p"]),
        "runs_sha256": F.sha2(F.array_join(lines, ""), 256),
        "collapsed_sha256": F.sha2(collapsed, 256),
    }
