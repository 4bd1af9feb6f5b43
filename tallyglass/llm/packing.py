"""Packing of token sequences by online sum of squares.

A level array counts the open windows at each fill level.  A piece goes to the level
that leaves the sum of squared counts smallest, which keeps the counts of all levels
low and so finds partners for every size.  Each task packs its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tallyglass.session import ship

from . import ragged

WINDOW = 4096
# Windows a task holds open at most, so that its memory is bounded: 64 MB of ids.  When one
# more would be open, all are filled up by cutting pieces, as at the end of the task.
MAX_OPEN = 4096
_TOKEN = 4  # bytes
_FAR = np.int64(1) << 60
_BATCH_BYTES = 1 << 20


class Window:
    """Pieces (row, start, ids) of one sequence and the tokens they fill."""

    __slots__ = ("level", "pieces")

    def __init__(self) -> None:
        self.pieces: list[tuple[object, int, memoryview]] = []
        self.level = 0

    def add(self, row: object, start: int, ids: memoryview) -> None:
        self.pieces.append((row, start, ids))
        self.level += len(ids) // _TOKEN


class Packer:
    """Open windows by fill level, with the change of the sum of squares kept per level."""

    def __init__(self, size: int = WINDOW, max_open: int = MAX_OPEN):
        self.size, self.max_open = size, max_open
        self.open: list[list[Window]] = [[] for _ in range(size + 1)]
        self.count = 0
        # Change of the sum when a window leaves a level (no window: impossible) or reaches it.
        self.leave = np.full(size + 1, _FAR)
        self.leave[0] = 0  # a new window may always be opened
        self.reach = np.ones(size + 1, np.int64)
        self.reach[size] = 0  # full windows are closed and not counted

    def _moved(self, level: int, by: int) -> None:
        n = len(self.open[level])
        self.count += by
        self.leave[level] = 1 - 2 * n if n else _FAR
        self.reach[level] = 2 * n + 1

    def place(self, row: object, start: int, ids: memoryview) -> Iterator[Window]:
        """Put a piece of at most one window; gives the windows that are full by it."""
        size = len(ids) // _TOKEN
        change = self.leave[: self.size - size + 1] + self.reach[size:]
        # At equal change the fullest window is taken.
        level = self.size - size - int(np.argmin(change[::-1]))
        window = self.open[level].pop() if level else Window()
        if level:
            self._moved(level, -1)
        window.add(row, start, ids)
        if window.level == self.size:
            yield window
            return
        self.open[window.level].append(window)
        self._moved(window.level, 1)
        if self.count > self.max_open:
            *full, last = self.fill_up()
            yield from full
            if last.level == self.size:
                yield last
            else:
                self.open[last.level].append(last)
                self._moved(last.level, 1)

    def fill_up(self) -> Iterator[Window]:
        """Close all open windows: the emptiest give their pieces, cut, to the fullest.

        Only the last window given may have room left.
        """
        windows = [w for level in self.open for w in level]
        for level, some in enumerate(self.open):
            if some:
                some.clear()
                self._moved(level, 0)
        self.count = 0
        low, high = 0, len(windows) - 1
        while high > low:
            full, empty = windows[high], windows[low]
            row, start, ids = empty.pieces.pop()
            room = (self.size - full.level) * _TOKEN
            full.add(row, start, ids[:room])
            empty.level -= len(ids[:room]) // _TOKEN
            if len(ids) > room:
                empty.pieces.append((row, start + room // _TOKEN, ids[room:]))
            if full.level == self.size:
                yield full
                high -= 1
            if not empty.pieces:
                low += 1
        yield from windows[low : high + 1]


def in_powers(window: Window) -> Iterator[Window]:
    """The window's pieces, cut, as sequences of falling powers of two without padding."""
    pieces = list(window.pieces)
    for power in range(window.level.bit_length() - 1, -1, -1):
        if not window.level >> power & 1:
            continue
        part = Window()
        while part.level < 1 << power:
            row, start, ids = pieces.pop(0)
            room = ((1 << power) - part.level) * _TOKEN
            part.add(row, start, ids[:room])
            if len(ids) > room:
                pieces.insert(0, (row, start + room // _TOKEN, ids[room:]))
        yield part


def pack(
    df: DataFrame,
    ids: str = "ids",
    end_id: int = 2,
    window: int = WINDOW,
    keep: list[str] | None = None,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """Pack rows of packed ids (little-endian 32-bit) into windows of ``window`` tokens.

    Every row gets ``end_id`` at its end, also an empty or null one.  Whole windows are
    cut off long rows and the rest is placed by the sum-of-squares rule; when a task's
    rows end, the windows still open are filled up by cutting pieces of the emptiest, and
    the one that may have room left becomes sequences of powers of two.  So every sequence
    has ``window`` tokens or a smaller power of two, and none needs padding.  The same
    filling up happens when a task would hold more than ``max_open`` open windows.

    One row per piece: the kept columns, ``start`` and ``length`` in the row's tokens,
    ``doc_tokens``, ``sequence_id`` (unique over the table), ``offset`` in the sequence, and
    the piece's packed ``ids``.  Of levels that are equally good the fullest is taken; rows go
    in the order in which a task reads them.  A row of any length is packed whole, repeated
    rows each by itself, an empty table gives no piece, kept columns that clash with the added
    names are dropped.
    """
    added = {
        "start": T.LongType(), "length": T.LongType(), "doc_tokens": T.LongType(),
        "sequence_id": T.LongType(), "offset": T.LongType(), "ids": T.BinaryType(),
    }
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added and c != ids]
    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
        + [T.StructField(n, t) for n, t in added.items()]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    tail = np.array([end_id], "<u4").tobytes()

    def rows_of(closed: Window, number: int) -> list[tuple]:
        offset, out = 0, []
        for (values, tokens), start, piece in closed.pieces:
            length = len(piece) // _TOKEN
            out.append((*values, start, length, tokens, number, offset, bytes(piece)))
            offset += length
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Window]:
        packer = Packer(window, max_open)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            values = zip(*columns, strict=True) if columns else iter([()] * batch.num_rows)
            for row, packed in zip(values, batch.columns[-1], strict=True):
                data = memoryview((packed.as_py() or b"") + tail)
                tokens = len(data) // _TOKEN
                whole = tokens - tokens % window
                for start in range(0, whole, window):
                    full = Window()
                    full.add((row, tokens), start, data[start * _TOKEN : (start + window) * _TOKEN])
                    yield full
                if tokens > whole:
                    yield from packer.place((row, tokens), whole, data[whole * _TOKEN :])
        for closed in packer.fill_up():
            yield from [closed] if closed.level == window else in_powers(closed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        out, size = [], 0
        for number, closed in enumerate(windows(batches)):
            out += rows_of(closed, first + number)
            size += closed.level * _TOKEN
            if size >= _BATCH_BYTES:
                yield _batch(out, arrow)
                out, size = [], 0
        if out:
            yield _batch(out, arrow)

    ship(df.sparkSession)
    source = df.select(
        *[F.col(ragged.quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)],
        F.col(ragged.quoted(ids)).alias("ids"),
    )
    return source.mapInArrow(run, schema).toDF(*kept, *added)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
