"""Helpers shared by the text operators: row batches, flat text, hashes of spans.

A batch of texts is handled as one flat numpy array with offsets, so that the
work of a task is a few array operations and not a loop over words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tallyglass.session import give_back, ship

# Bytes of text handled at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

Work = Callable[[list[pa.Array]], list[pa.Array]]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_columns(
    df: DataFrame,
    uses: Sequence[str],
    adds: T.StructType,
    make: Callable[[], Work],
    keep: Sequence[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Add columns computed in Python from ``uses`` (strings or binaries first).

    ``make`` runs once per task and returns the function that turns the used
    arrays of some rows into the added arrays; its ``close``, if it has one, is called
    when the task's rows are through.  ``keep`` (default: all columns)
    names the input columns that stay; one whose name clashes with an added
    column, in any case of letters, is replaced by it.  Nothing is shuffled,
    and rows go through in pieces of about ``piece_bytes``.
    """
    taken = {f.name.lower() for f in adds}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    kept_types = [df.schema[c] for c in kept]
    source = df.select(
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)],
        *[F.col(quoted(c)).alias(f"u{i}") for i, c in enumerate(uses)],
    )
    inner = T.StructType(
        [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept_types)]
        + [T.StructField(f"a{i}", f.dataType) for i, f in enumerate(adds)]
    )
    ship(df.sparkSession)
    count, width = len(kept), len(uses)
    names = inner.fieldNames()
    types = [to_arrow_type(f.dataType) for f in adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch, count, piece_bytes):
                columns = piece.columns[count : count + width]
                made = [a.cast(t) for a, t in zip(work(columns), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:count], *made], names=names)
        # Worker processes are used again: what the task remembered must not stay in them.
        if close := getattr(work, "close", None):
            close()
        give_back()

    out = source.mapInArrow(run, inner)
    return out.toDF(*kept, *[f.name for f in adds])


def where_made(df: DataFrame, column: str, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows and columns of ``df`` for which ``make`` keeps a row.

    ``make`` gets the table with its columns renamed, so that what it adds cannot clash,
    and the new name of ``column``; what it adds is dropped again.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    made = make(df.toDF(*names), names[df.columns.index(column)])
    return made.select(*names).toDF(*df.columns)


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` bytes in one column."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(np.diff(flat(batch.column(column))[1]))
    low = 0
    while low < batch.num_rows:
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and the offsets of its rows; null is empty."""
    binary = pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type)
    array = array.cast(pa.large_binary() if binary else pa.large_string())
    if array.null_count:
        array = array.fill_null(b"" if binary else "")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def texts(array: pa.Array) -> list[str]:
    """Rows as Python strings; null is empty."""
    return ["" if t is None else t for t in array.to_pylist()]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array from flat bytes and row offsets."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)],
    )


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[start:start+length]`` of all spans."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[shift + np.arange(total)]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of the public splitmix generator)."""
    x = np.atleast_1d(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE_BYTES), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 4 * PIECE_BYTES:  # a rare long text does not stay in memory
            _powers[base] = known
    return known[:n]


@functools.cache
def symbol_table(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_STEP))


def rolling_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of small numbers, whose cost does not grow with its length.

    A polynomial over scrambled symbols modulo 2**64: equal spans get equal hashes wherever
    they stand.  Long different spans with the same hash can be constructed, so this is for
    uses where such a pair costs a comparison or a shared model weight and nothing else.
    """
    table = symbol_table(256 if symbols.dtype == np.uint8 else 0x110000)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(table[symbols] * _powers_of(_BASE, len(symbols)), out=total[1:])
    value = (total[ends] - total[starts]) * _powers_of(_BASE_INVERSE, len(symbols) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_STEP))


def span_ids(
    symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, pa.Array]:
    """Numbers from 0, equal for equal spans, and the bytes of the distinct spans by number.

    Spans are compared byte by byte.
    """
    lengths = ends - starts
    size = symbols.itemsize
    if (lengths > 0).all() and (starts[1:] >= ends[:-1]).all():
        # Spans in order that do not overlap: a mask is much less than the places of all symbols.
        steps = np.zeros(len(symbols) + 1, np.int8)
        steps[starts] += 1
        steps[ends] -= 1
        data = symbols[np.cumsum(steps[:-1], dtype=np.int8) > 0].view(np.uint8)
    else:
        data = gather(symbols, starts, lengths).view(np.uint8)
    coded = binaries(data, offsets_of(lengths) * size).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each span; each distinct span is digested once.

    No way is known to construct spans that collide other than trying: two of n different
    spans do with odds of about n*n / 2**65.
    """
    ids, distinct = span_ids(symbols, starts, ends)
    digests = [hashlib.blake2b(x, digest_size=8).digest() for x in distinct.to_pylist()]
    return np.frombuffer(b"".join(digests), np.uint64)[ids]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: runs of bytes whose entry in ``inside`` (256 flags) is true.

    Returns starts, ends and the row offsets into them; a run that reaches over
    the end of a row is cut there.
    """
    mask = inside[data]
    starts, ends = runs(mask)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[mask[cuts] & mask[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        starts = np.sort(np.concatenate((starts, cuts)))
        ends = np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(starts, offsets)


@functools.cache
def letter_bytes() -> np.ndarray:
    """Bytes of words made of ASCII letters, digits and all other characters of Unicode."""
    inside = np.zeros(256, bool)
    inside[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
    return inside


@functools.cache
def visible_bytes() -> np.ndarray:
    """Bytes of words separated by ASCII white space."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


@functools.cache
def lower_bytes() -> np.ndarray:
    """ASCII capitals to small letters, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def ngram_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, beyond: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``size`` bytes that begin inside a span.

    A run may reach over the span's end by ``beyond`` bytes.
    """
    lengths = ends - starts
    places = gather(np.arange(len(data)), starts, lengths)
    places = places[np.repeat(ends + beyond, lengths) - places >= size]
    value = np.full(len(places), size, np.uint64)
    table = symbol_table(256)
    for k in range(size):
        value = value * np.uint64(_BASE) + table[data[places + k]]
    return places, mix(value)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a space before the first, between all, and after the last."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows + 1, 0x20, np.uint8)
    shift = np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, offsets + np.arange(1, rows + 2)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array column from flat values and row offsets."""
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(values, kind)
    )


def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a collected array column without nulls."""
    chunks = [c for c in column.chunks if len(c)]
    if not chunks:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks])
    lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in chunks])
    return values, offsets_of(lengths)
