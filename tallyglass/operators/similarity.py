"""Vectors of texts and cosine similarity search."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.skew import SMALL_ROWS, lookup_join, newest_rows, salted_join
from ..session import give_back, stored

MAX_BROADCAST_QUERIES = 4_096
_CORPUS_BLOCK = 10_000
_ROWS_AT_ONCE = 1_024
# From this similarity on, vectors are matched within cells of some of their projections.
_CLOSE = 0.999
_DIRECTIONS = 4
_LEAST_REACH = 1e-3
# Queries that tell in which directions to look.
_SAMPLED = 512
# Numbers in the vectors of one side of a block of a crowded cell; narrow vectors count as 256.
_CELL_NUMBERS = 1 << 22
# Bytes of texts given to a model at once; a longer text goes alone.
_TEXT_BYTES = 1 << 20
HITS = "query_id string, id string, similarity double"


class _Vectors(NamedTuple):
    """Ids and a matrix of all vectors of one width; null vectors belong to no width."""

    ids: pa.Array
    rows: np.ndarray


def _by_width(ids: pa.Array, vectors: pa.Array) -> dict[int, _Vectors]:
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(widths[widths > 0]).tolist():
        at = pa.array(np.flatnonzero(widths == width))
        numbers = vectors.take(at).flatten().cast(pa.float64()).fill_null(np.nan)
        found[width] = _Vectors(ids.take(at), numbers.to_numpy().reshape(-1, width))
    return found


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    norms = np.outer(np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1))
    return (left @ right.T) / np.maximum(norms, 1e-8)


def _some_queries(
    corpus: dict[int, _Vectors], wanted: dict[int, _Vectors]
) -> Iterator[tuple[_Vectors, _Vectors]]:
    """Vectors with queries of the same width, so many queries at a time."""
    for width, queries in wanted.items():
        if width in corpus:
            for start in range(0, len(queries.rows), MAX_BROADCAST_QUERIES):
                some = slice(start, start + MAX_BROADCAST_QUERIES)
                yield corpus[width], _Vectors(queries.ids[some], queries.rows[some])


def _hits(
    corpus: dict[int, _Vectors], wanted: dict[int, _Vectors], threshold: float, top: int | None
) -> Iterator[pa.RecordBatch]:
    """Pairs of equal width at least as similar as the threshold.

    With ``top``, only what can be among a query's best: hits at least as similar as the
    query's hit number ``top`` so far.
    """
    for own, queries in _some_queries(corpus, wanted):
        best = np.full((0, len(queries.rows)), -np.inf)
        for start in range(0, len(own.rows), _ROWS_AT_ONCE):
            scores = _cosines(own.rows[start : start + _ROWS_AT_ONCE], queries.rows)
            scores[~(scores >= threshold)] = -np.inf  # not a number is no hit
            least = -np.inf
            if top is not None:
                best = np.concatenate((best, scores))
                best = -np.sort(-best, axis=0)[:top]
                least = best[-1] if len(best) == top else -np.inf
            at, which = np.nonzero((scores >= least) & (scores > -np.inf))
            yield pa.RecordBatch.from_arrays(
                [
                    queries.ids.take(pa.array(which)),
                    own.ids.take(pa.array(at + start)),
                    pa.array(scores[at, which]),
                ],
                names=["query_id", "id", "similarity"],
            )


def _close_hits(
    corpus: dict[int, _Vectors], wanted: dict[int, _Vectors], threshold: float
) -> Iterator[pa.RecordBatch]:
    """The same pairs where hits are rare: single precision tells where to look for them."""
    for own, queries in _some_queries(corpus, wanted):
        # More than rounding can take from the similarity of two unit vectors.
        least = threshold - (own.rows.shape[1] + 8) * 2.0**-23
        asked = _unit(queries.rows).astype(np.float32)
        for start in range(0, len(own.rows), _ROWS_AT_ONCE):
            rows = own.rows[start : start + _ROWS_AT_ONCE]
            near = _unit(rows).astype(np.float32) @ asked.T >= least
            some, those = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            found = _Vectors(own.ids.take(pa.array(some + start)), rows[some])
            those = _Vectors(queries.ids.take(pa.array(those)), queries.rows[those])
            yield from _hits({0: found}, {0: those}, threshold, None)


def similar_code(
    vectors: DataFrame, queries: DataFrame, threshold: float = 0.8, top: int | None = None
) -> DataFrame:
    """Vectors with cosine similarity of at least ``threshold`` to each query.

    ``vectors`` is ``(id, embedding)``, ``queries`` ``(query_id, embedding)``.
    Up to ``MAX_BROADCAST_QUERIES`` queries travel with the tasks and the corpus
    is scanned once without a shuffle; more are matched block by block, at a threshold
    near 1 only where they lie close enough to each other.  Only
    hits leave a task, and with ``top`` only those that can be among the query's best
    (at equal similarity the smaller ids).  A null vector, a missing number in one, or
    another width than the query's is no hit.
    """
    vectors = vectors.select(F.col("id").cast("string").alias("id"), "embedding")
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    few = queries.limit(MAX_BROADCAST_QUERIES + 1).toArrow().combine_chunks()
    if len(few) <= MAX_BROADCAST_QUERIES:
        batches = few.to_batches()
        wanted = _by_width(*batches[0].columns) if batches else {}
        hits = _by_scan(vectors, wanted, threshold, top)
    elif threshold >= _CLOSE:
        hits = _by_cells(vectors, queries, threshold, top)
    else:
        hits = _by_blocks(vectors, queries, threshold, top)
    if top is None:
        return hits
    return newest_rows(hits, ["query_id"], [F.desc("similarity"), F.col("id")], top)


def _by_scan(
    vectors: DataFrame, wanted: dict[int, _Vectors], threshold: float, top: int | None
) -> DataFrame:
    packed = {w: (v.ids.to_pylist(), v.rows) for w, v in wanted.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {w: _Vectors(pa.array(ids, pa.string()), rows) for w, (ids, rows) in shared.value.items()}
        for batch in batches:
            yield from _hits(_by_width(*batch.columns), wanted, threshold, top)

    return vectors.mapInArrow(scan, HITS)


def _by_blocks(
    vectors: DataFrame, queries: DataFrame, threshold: float, top: int | None
) -> DataFrame:
    """Grid of corpus and query blocks; a cell multiplies two bounded matrices."""
    q_blocks = math.ceil(queries.count() / MAX_BROADCAST_QUERIES)
    v_blocks = max(1, math.ceil(vectors.count() / _CORPUS_BLOCK))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = vectors.withColumn("_v", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int"))
    left = left.withColumn("_q", every(q_blocks))
    # A name of its own: both sides may come from one table.
    right = queries.withColumnRenamed("embedding", "asked")
    right = right.withColumn("asked", F.transform("asked", lambda x: x))
    right = right.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    right = right.withColumn("_v", every(v_blocks))

    return _matched(left, right, ["_v", "_q"], partial(_hits, threshold=threshold, top=top))


def _matched(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    find: Callable[[dict[int, _Vectors], dict[int, _Vectors]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    """Hits of each block of vectors with the block of queries (``asked``) of the same keys."""
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("similarity", pa.float64())])

    def cell(corpus: pa.Table, wanted: pa.Table) -> pa.Table:
        if not corpus.num_rows or not wanted.num_rows:
            return schema.empty_table()
        own = _by_width(*(corpus[c].combine_chunks() for c in ("id", "embedding")))
        asked = _by_width(*(wanted[c].combine_chunks() for c in ("query_id", "asked")))
        return pa.Table.from_batches(find(own, asked), schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, HITS)


def _reach(threshold: float) -> float:
    """How far apart projections of two unit vectors can be that are this similar.

    Unit vectors with cosine c lie sqrt(2 - 2c) apart; what is added covers rounding.
    """
    return max(math.sqrt(max(0.0, 2 - 2 * threshold)), _LEAST_REACH) + 1e-6


class _Spread(NamedTuple):
    """Directions to cut vectors of one width along, and the place cells are centred on."""

    directions: np.ndarray
    middle: np.ndarray


def _any_spread(width: int) -> _Spread:
    random = np.random.default_rng(width).normal(size=(width, min(_DIRECTIONS, width)))
    directions = np.linalg.qr(random)[0]
    return _Spread(directions, np.zeros(directions.shape[1]))


def _spread_of(rows: np.ndarray) -> _Spread:
    """The directions in which some vectors differ most, when they are unit vectors."""
    unit = _unit(rows)
    unit = unit[np.isfinite(unit).all(axis=1)]
    if len(unit) < 2:
        return _any_spread(rows.shape[1])
    middle = unit.mean(axis=0)
    directions = np.linalg.svd(unit - middle, full_matrices=False)[2][:_DIRECTIONS].T
    return _Spread(directions, middle @ directions)


def _cells(
    rows: np.ndarray, reach: float, around: bool, spread: _Spread | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the cells they lie in, or with ``around`` all cells within reach.

    A cell is four times the reach wide in each direction; the directions are the same for
    all vectors of a width.  Rows without a direction (zeros, not a number) are in no cell.
    """
    width = rows.shape[1]
    spread = spread or _any_spread(width)
    size = 4 * reach
    with np.errstate(all="ignore"):
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        at = (rows @ spread.directions / norms - spread.middle) / size + 0.5
    which = np.flatnonzero(np.isfinite(at).all(axis=1))
    at, count = at[which], 2 * math.ceil(2 / size) + 5
    own, cells = np.arange(len(which)), np.full(len(which), width, np.int64)
    # Squared distance, in cells, from the row to the cells so far.
    away = np.zeros(len(which))
    for d in range(at.shape[1]):
        cell = np.floor(at[own, d])
        inside = at[own, d] - cell
        cells = cells * count + cell.astype(np.int64) + count // 2
        if around:
            steps = [(0, away), (-1, away + inside**2), (1, away + (1 - inside) ** 2)]
            kept = [(step, far, np.flatnonzero(far <= (reach / size) ** 2)) for step, far in steps]
            own = np.concatenate([own[those] for _, _, those in kept])
            cells = np.concatenate([cells[those] + step for step, _, those in kept])
            away = np.concatenate([far[those] for _, far, those in kept])
    return which[own], cells


def _placed(
    vectors: DataFrame, reach: float, around: bool, spreads: dict[int, _Spread], whole: bool = True
) -> DataFrame:
    """``(id, vector)`` with each ``cell`` of the vector, see :func:`_cells`.

    Without ``whole`` only the cells and the vector's ``width``.
    """
    names = vectors.columns if whole else []

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            for width, some in _by_width(ids, batch.column(batch.num_columns - 1)).items():
                which, cells = _cells(some.rows, reach, around, spreads.get(width))
                columns = batch.take(some.ids.take(pa.array(which))).columns if whole else []
                wide = pa.array(np.full(len(cells), width, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cells), wide], names=[*names, "cell", "width"]
                )

    fields = vectors.schema.fields if whole else []
    shape = [*fields, T.StructField("cell", T.LongType()), T.StructField("width", T.IntegerType())]
    source = vectors if whole else vectors.select(vectors.columns[-1])
    return source.mapInArrow(place, T.StructType(shape))


def _by_cells(
    vectors: DataFrame, queries: DataFrame, threshold: float, top: int | None
) -> DataFrame:
    """Only vectors and queries whose projections on some directions agree are compared.

    A vector lies in one cell, a query goes to every cell within reach, so each hit comes
    out once.  Crowded cells are cut into blocks of bounded size, each with each.  The
    directions are those in which a sample of the queries differs most: they decide how
    much is compared, not what is found.  Vectors in no query's cell stay where they are,
    unless there are too many cells to send them to the tasks.
    """
    reach = _reach(threshold)
    sample = queries.orderBy(F.xxhash64("query_id")).limit(_SAMPLED).toArrow().combine_chunks()
    sampled = _by_width(*(sample[name].combine_chunks() for name in ("query_id", "embedding")))
    spreads = {width: _spread_of(some.rows) for width, some in sampled.items()}
    # A name of its own: both sides may come from one table.
    queries = queries.withColumnRenamed("embedding", "asked")

    def blocks(rows: DataFrame, around: bool, name: str) -> DataFrame:
        places = _placed(rows, reach, around, spreads, whole=False)
        numbers = F.sum(F.greatest("width", F.lit(256)))
        return places.groupBy("cell").agg(F.ceil(numbers / _CELL_NUMBERS).cast("int").alias(name))

    cells = blocks(vectors, False, "_vs").join(blocks(queries, True, "_qs"), "cell", "full")
    cells = stored(cells, "cells")
    shared = cells.where("_vs > 0 and _qs > 0")
    few = shared.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    # A crowded cell has more rows than fit a block, so these cells are few.
    known = F.broadcast(shared if few else cells.where("_vs > 1 or _qs > 1"))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def numbered(rows: DataFrame, around: bool) -> DataFrame:
        rows = _placed(rows, reach, around, spreads).drop("width")
        if few:
            return rows.join(known, "cell")
        # Of a crowded cell on one side only nothing is left, as its other count is null.
        rows = rows.join(known.withColumn("_crowded", F.lit(True)), "cell", "left")
        counts = {n: F.when(F.col("_crowded"), F.col(n)).otherwise(1) for n in ("_vs", "_qs")}
        return rows.withColumns(counts).drop("_crowded")

    left = numbered(vectors, False)
    left = left.withColumn("_v", F.pmod(F.xxhash64("id"), F.col("_vs")).cast("int"))
    left = left.withColumn("_q", every("_qs")).drop("_vs", "_qs")
    right = numbered(queries, True)
    right = right.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qs")).cast("int"))
    right = right.withColumn("_v", every("_vs")).drop("_vs", "_qs")
    if top is None:
        find = partial(_close_hits, threshold=threshold)
    else:
        find = partial(_hits, threshold=threshold, top=top)
    return _matched(left, right, ["cell", "_v", "_q"], find)


def describe_hits(hits: DataFrame, measured: DataFrame) -> DataFrame:
    """Hits with the purpose, complexity, lines and maintainability of their nodes.

    The hits are found once and stored, as the join looks at them more than once.
    """
    kind = F.col("kind")
    title = F.when(kind == "func", "Function").otherwise(F.initcap(kind))
    named = F.when(kind == "file", F.col("path")).otherwise(F.col("name"))
    facts = measured.select(
        F.col("code_id").alias("id"),
        F.concat_ws(": ", title, named).alias("purpose"),
        "cyclomatic",
        "loc",
        "maintainability",
    )
    return lookup_join(stored(hits, "hits"), facts, ["id"], "left")


# Words whose place and sign a worker remembers, and their greatest length.
_KNOWN_WORDS = 100_000
_KNOWN_LENGTH = 64


def hashing_model(width: int = 256) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model without weights: signed token counts hashed into a unit vector.

    A text without tokens, or whose counts cancel each other, gives zeros.
    """

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        token = re.compile(r"\w+|\W")
        known: dict[str, tuple[int, int]] = {}

        def place(word: str) -> tuple[int, int]:
            if found := known.get(word):
                return found
            digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
            found = int.from_bytes(digest[:4]) % width, 1 if digest[4] < 128 else -1
            if len(word) <= _KNOWN_LENGTH:
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                known[word] = found
            return found

        def predict(texts: np.ndarray) -> np.ndarray:
            vectors = np.zeros((len(texts), width))
            for vector, text in zip(vectors, texts):
                for word, count in Counter(token.findall(text)).items():
                    at, sign = place(word)
                    vector[at] += sign * count
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return vectors / np.where(norms > 0, norms, 1)

        return predict

    return make_predict


# The model a Python worker has loaded last, by the encoding it belongs to.
_loaded: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def _model(key: str, make_predict: Callable[[], Callable]) -> Callable[[np.ndarray], np.ndarray]:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make_predict()
    return _loaded[key]


def _some_texts(texts: pa.Array, most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of at most ``most`` texts and about ``most_bytes``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + most_bytes, side="right"))
        stop = min(max(stop, start + 1), start + most)
        yield start, stop - start
        start = stop


def encode_model(
    docs: DataFrame,
    id_: str,
    text: str,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]] = hashing_model(),
    batch_size: int = 32,
    element: T.DataType = T.FloatType(),
) -> DataFrame:
    """``(id, embedding)`` from any model; the default needs no download.

    ``make_predict`` loads the model once per Python worker and returns a
    function from a batch of texts to a two-dimensional float array.  A null text counts as
    empty.  Texts become Python strings, and vectors leave the task, ``batch_size`` or about
    a megabyte at a time, so a worker's memory does not grow with the rows of an Arrow batch.
    """
    key, number = uuid.uuid4().hex, to_arrow_type(element)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _model(key, make_predict)
        for batch in batches:
            ids, texts = batch.columns
            for start, count in _some_texts(texts, batch_size, _TEXT_BYTES):
                some = [t or "" for t in texts.slice(start, count).to_pylist()]
                found = np.asarray(predict(np.array(some, dtype=object)))
                ends = pa.array(np.arange(count + 1, dtype=np.int32) * found.shape[1])
                flat = pa.array(np.ascontiguousarray(found).reshape(-1)).cast(number)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, count), pa.ListArray.from_arrays(ends, flat)],
                    names=["id", "embedding"],
                )
        give_back()

    source = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    shape = T.StructType(
        [
            T.StructField("id", source.schema["id"].dataType),
            T.StructField("embedding", T.ArrayType(element)),
        ]
    )
    return source.mapInArrow(run, shape).withColumnRenamed("id", id_)


def snippet_key(model: str, text: str):
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.concat(F.lit(f"{model}:"), F.substring(F.sha2(whole, 256), 1, 16))


def encode_incremental(
    snippets: DataFrame,
    store: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    model: str,
    id_: str = "id",
    text: str = "code",
) -> tuple[DataFrame, DataFrame]:
    """Vectors for all snippets, encoding only texts whose key is not in the store.

    ``encode`` maps ``(key, code)`` to ``(key, embedding)``.  Returns the vectors
    and the rows to append to the store.  Copies of a text are encoded once, and what was
    encoded is written and read again, so the model sees each text one time.  Every snippet
    gets its vector: a null text counts as empty.  Of store rows with the same key one counts.
    """
    code = F.coalesce(F.col(text), F.lit("")).alias("code")
    keyed = snippets.select(id_, code, snippet_key(model, text).alias("key"))
    store = store.dropDuplicates(["key"])
    once = keyed.groupBy("key").agg(F.any_value("code").alias("code"))
    unknown = once.join(store.select("key"), "key", "left_anti")
    fresh = stored(encode(unknown).select("key", "embedding"), "encoded")
    known = store.select("key", "embedding", F.lit(True).alias("reused")).unionByName(
        fresh.withColumn("reused", F.lit(False))
    )
    vectors = salted_join(keyed.select(id_, "key"), known, ["key"])
    return vectors.select(id_, "key", "embedding", "reused"), fresh
