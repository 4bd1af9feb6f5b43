"""Best-fit decreasing packing of token sequences into windows.

To best fit, documents differ only by their length and open windows only by the room
they have left.  One count per length is all the plan needs: lengths are taken from the
longest down, a segment tree over remaining capacities finds the tightest window that
fits, and a run of equal windows takes a run of equal documents in one step, which gives
the windows that placing one document after the other gives.  The plan is a short list
of ranges whatever the table's size; a document finds its place in it by its rank among
the documents of its length, so only counts cross the network before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tallyglass.functions.skew import small_side
from tallyglass.session import ship, stored

from . import ragged

WINDOW = 2048
_TOKEN = 4  # bytes
# Ranks of a length below this number; lengths above it in one 64-bit key.
_RANKS = 1 << 48
_LONGEST = 1 << 14


class Capacities:
    """Segment tree over remaining capacities: which have an open window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        """Open ``count`` windows, numbered from ``first``, with ``room`` left."""
        if room and count:
            self.ranges[room].append((first, count))
            self._mark(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        """One run of windows with exactly this room."""
        found = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, 0)
        return found

    def _mark(self, room: int, value: int) -> None:
        node = room + self.leaves
        self.any[node] = value
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that a window has."""
        node = length + self.leaves
        if not self.any[node]:
            # Up to the first right neighbour that has a window, then down its left side.
            while node > 1 and not (node % 2 == 0 and self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves


class Step(NamedTuple):
    """Documents of one length from ``rank`` on go to windows from ``first`` on."""

    length: int
    rank: int
    first: int
    each: int  # documents a window takes
    offset: int  # tokens the windows held before


def plan(counts: dict[int, int], window: int = WINDOW) -> list[Step]:
    """Best fit in order of falling length, for so many documents of each length.

    The number of steps depends on the window's size, not on the number of documents.
    """
    rooms, opened, steps = Capacities(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                fresh = -(-left // (window // length))
                rooms.push(window, opened, fresh)
                opened, room = opened + fresh, window
            first, windows = rooms.pop(room)
            each = room // length
            taken = min(left, each * windows)
            steps.append(Step(length, rank, first, each, window - room))
            full, part = divmod(taken, each)
            rooms.push(room - each * length, first, full)
            if part:
                rooms.push(room - part * length, first + full, 1)
            used = full + (part > 0)
            rooms.push(room, first + used, windows - used)
            rank, left = rank + taken, left - taken
    return steps


def places(steps: list[Step], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the documents with these lengths and ranks."""
    ordered = np.array(sorted(steps), np.int64).reshape(-1, len(Step._fields))
    keys = ordered[:, 0] * _RANKS + ordered[:, 1]
    at = np.searchsorted(keys, lengths * _RANKS + ranks, side="right") - 1
    _, rank, first, each, offset = ordered[at].T
    window, turn = np.divmod(ranks - rank, each)
    return first + window, offset + turn * lengths


def _cut(
    df: DataFrame, ids: str, end_id: int, window: int, kept: list[str]
) -> DataFrame:
    """Pieces of all rows, each with its task and its place among that task's equal lengths."""
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    fields += [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("task", T.LongType()),
        T.StructField("nth", T.LongType()),
    ]
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    tail = np.array([end_id], "<u4").view(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(window + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in ragged.pieces(batch, len(kept), ragged.PIECE_BYTES):
                data, offsets = ragged.flat(part.columns[-1])
                tokens = np.diff(offsets) // _TOKEN + 1
                row_ends = ragged.offsets_of(tokens)
                whole = np.empty(row_ends[-1] * _TOKEN, np.uint8)
                last = (row_ends[1:, None] - 1) * _TOKEN + np.arange(_TOKEN)
                body = np.ones(len(whole), bool)
                body[last.ravel()] = False
                whole[body] = data
                whole[last] = tail
                number = -(-tokens // window)
                row = np.repeat(np.arange(len(tokens)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * window
                length = np.minimum(tokens[row] - start, window)
                order = np.argsort(length, kind="stable")
                begins = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - begins
                nth += seen[length]
                seen += np.bincount(length, minlength=window + 1)
                made = [
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    ragged.binaries(whole, ragged.offsets_of(length) * _TOKEN),
                    pa.array(np.full(len(row), task)),
                    pa.array(nth),
                ]
                taken = [c.take(pa.array(row)) for c in part.columns[: len(kept)]]
                columns = [c.cast(t) for c, t in zip([*taken, *made], arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    ship(df.sparkSession)
    source = df.select(
        *[F.col(ragged.quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)],
        F.col(ragged.quoted(ids)).alias("ids"),
    )
    return source.mapInArrow(run, schema)


def pack(
    df: DataFrame,
    ids: str = "ids",
    end_id: int = 0,
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """Pack rows of packed ids (little-endian 32-bit) into windows by best-fit decreasing.

    Every row gets ``end_id`` at its end, also an empty or null one.  Rows of more than
    ``window`` tokens, however long, are cut into pieces of ``window``, the last one may be
    shorter; no other row is cut.  One row per piece: the kept columns, ``piece`` (from 0),
    ``start`` and ``length`` in the row's tokens, ``sequence_id`` (from 0, over the whole
    table), ``offset`` in the sequence, the piece's packed ``ids`` and their ``ids_crc32``.
    Among equal lengths the order of rows decides; repeated rows are packed each by itself,
    an empty table gives no piece, kept columns that clash with the added names are dropped.

    The pieces are written once below the shared work folder.  The driver sees one count
    per length, and the plan sent to the tasks has a size that depends on ``window`` alone.
    A reader that does not ask for ``ids`` moves only numbers.
    """
    if not 1 <= window < _LONGEST:
        raise ValueError(f"window must be at least 1 and below {_LONGEST}")
    added = ["piece", "start", "length", "sequence_id", "offset", "ids", "ids_crc32"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added and c != ids]
    cut = _cut(df, ids, end_id, window, kept).withColumn("ids_crc32", F.crc32("ids"))
    cut = stored(cut, "pieces")
    counts = stored(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))  # at most ``window`` rows
    steps = plan({r["length"]: r["n"] for r in totals.collect()}, window)
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(
        "length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place_type = T.StructType(
        [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    @F.arrow_udf(place_type)
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        if not len(length):
            return pa.array([], pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())]))
        found = places(steps, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    ranked = cut.join(small_side(before), ["length", "task"])
    out = ranked.withColumn("place", placed("length", F.col("before") + F.col("nth")))
    columns = {"sequence_id": "place.sequence_id", "offset": "place.offset"}
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        *[F.col(columns.get(c, c)).alias(c) for c in added],
    )
