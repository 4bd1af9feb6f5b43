"""Near-duplicate classes of documents by MinHash signatures and exact checks.

Documents with the same words are one node.  Signatures are cut into bands; nodes
that share a band are candidates.  In each round a few leaders per band are compared
with its other members, and what is found merges classes; a band is done when its
members are in one class or all have been leaders.  Bands that stay crowded with
different classes are regrouped by rare shingles.  So a large group costs its size in
comparisons, not its square, and no candidate link between classes is left out.
Large bands, classes and keys are the left sides of equi-joins of narrow rows, which
adaptive execution splits; nothing gathers a group in one task.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallyglass.functions.skew import SMALL_ROWS, lookup_join
from tallyglass.session import work_folder

from . import ragged
from .dart_minhash import band_keys, signatures

# Candidate rows that may be broadcast: two numbers each.
_MOST_BROADCAST = 5 * SMALL_ROWS


# One in so many bands is looked at first.
FIRST_BANDS = 8
# Members of a band from which on they are regrouped by rare shingles.
CROWD = 32


class Settings(NamedTuple):
    """A pair at the threshold shares no band with odds (1 - 0.8**5)**32, 3 in a million."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows_per_band: int = 5
    counted: bool = False  # weigh a shingle by its count instead of by its presence
    piece_bytes: int = 1 << 18


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed runs of ``size`` words per row, their counts, and row offsets.

    Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  A
    row of fewer words has one shingle of all its words; a row without words has none.
    """
    low = ragged.lower_bytes()[data]
    starts, ends, first = ragged.word_spans(low, offsets, ragged.letter_bytes())
    words = ragged.span_hashes(low, starts, ends)
    counts = np.diff(first)
    width = np.minimum(counts, size)
    number = np.where(counts > 0, counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), number)
    at = ragged.gather(np.arange(len(words)), first[:-1], number)
    value = ragged.mix(width[row])
    for k in range(size):
        inside = k < width[row]
        value = np.where(inside, ragged.mix(value + words[np.minimum(at + k, len(words) - 1)]), value)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(fresh)
    times = np.diff(np.append(place, len(value)))
    return value[place], times, np.searchsorted(row[place], np.arange(len(counts) + 1))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digest of the words of each row."""
    low = ragged.lower_bytes()[data]
    inside = ragged.letter_bytes()[low]
    starts, ends, first = ragged.word_spans(low, offsets, ragged.letter_bytes())
    plain = np.where(inside, low, 0x20).astype(np.uint8).tobytes()
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = plain[a:b].split()
        out.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
    return out


def _staged(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Write the documents once with locator, key of their words and band hashes."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    own_text = names[docs.columns.index(text)]

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            elements, times, ends = shingles(data, offsets, settings.words)
            weights = times.astype(float) if settings.counted else np.ones(len(times))
            k = settings.bands * settings.rows_per_band
            signature = signatures(elements, weights, ends, k)
            keys = band_keys(signature, settings.rows_per_band).view(np.int64)
            # A row without words has no bands; it is only ever equal to others.
            worded = np.diff(ends) > 0
            cuts = ragged.offsets_of(np.where(worded, settings.bands, 0))
            bands = ragged.list_column(keys[worded].ravel(), cuts, pa.int64())
            sizes = pa.array(np.add.reduceat(np.append(weights, 0), ends[:-1]) * worded)
            return [pa.array(word_keys(data, offsets), pa.binary()), bands, sizes]

        return work

    adds = T.StructType(
        [
            T.StructField("key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("size", T.DoubleType()),
        ]
    )
    made = ragged.with_columns(inner, [own_text], adds, make, names, settings.piece_bytes)
    made = made.withColumn("row", F.monotonically_increasing_id())
    return _written(made, "near-staged")


def _written(df: DataFrame, purpose: str) -> DataFrame:
    folder = work_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _small(df: DataFrame, most: int = _MOST_BROADCAST) -> bool:
    return df.limit(most + 1).count() <= most


def bitmaps(elements: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set in 64-bit words, and the rows' offsets into them.

    Bit (hash modulo width) is set for every element; a set of n elements has the smallest
    width of 1024, 4096, 16384 ... bits that holds 3/4 n.
    """
    sizes = np.diff(ends)
    width = np.full(len(sizes), 1024, np.int64)
    while (tight := width * 4 < sizes * 3).any():
        width[tight] *= 4
    starts = ragged.offsets_of(width)
    bits = np.zeros(starts[-1], bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bits[starts[row] + (elements % width[row].astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8"), starts // 64


def _sets(rows: DataFrame, wanted: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Shingles and bitmap of the wanted nodes, from their whole texts."""

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            elements, times, ends = shingles(*ragged.flat(columns[0]), settings.words)
            lists = [ragged.list_column(elements.view(np.int64), ends, pa.int64())]
            lists.append(ragged.list_column(times, ends, pa.int32()))
            lists.append(ragged.list_column(*bitmaps(elements, ends), pa.int64()))
            return lists

        return work

    some = F.broadcast(wanted) if _small(wanted) else wanted
    texts = rows.select(F.col("row").alias("node"), F.col(text).alias("text")).join(some, "node")
    adds = T.StructType(
        [
            T.StructField("items", T.ArrayType(T.LongType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
            T.StructField("bits", T.ArrayType(T.LongType())),
        ]
    )
    return ragged.with_columns(texts, ["text"], adds, make, ["node"], settings.piece_bytes)


def _joined_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both sets; only sets that are in a pair move."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = sets.join(F.broadcast(ends) if _small(ends) else ends, "node", "left_semi")
    left = needed.toDF("a", *[f"{c}_a" for c in needed.columns[1:]])
    right = needed.toDF("b", *[f"{c}_b" for c in needed.columns[1:]])
    return pairs.join(left, "a").join(right, "b")


def _possible(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs that their bitmaps allow to be similar enough: none of the others is.

    Every bit that one set has and the other has not stands for an element of its own that
    the other set lacks.  Sets whose bitmaps have different widths stay in.
    """
    both = _joined_sets(pairs, sets.select("node", F.size("items").alias("size"), "bits"))
    lacking = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    total = F.col("size_a") + F.col("size_b")
    needed = F.ceil(total * settings.similarity / (1 + settings.similarity) - 1e-9)
    fits = (F.col("size_a") - lacking("bits_a", "bits_b") >= needed) & (
        F.col("size_b") - lacking("bits_b", "bits_a") >= needed
    )
    return both.where((F.size("bits_a") != F.size("bits_b")) | fits).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    if not settings.counted:
        pairs = _written(_possible(pairs, sets, settings), "possible")
        sets = sets.drop("times")
    sets = sets.drop("bits")
    both = _joined_sets(pairs, sets)
    size = lambda s: F.size(f"items_{s}")
    if settings.counted:
        count = lambda s: F.map_from_arrays(f"items_{s}", f"times_{s}")
        merged = F.map_zip_with(
            count("a"), count("b"), lambda _, x, y: F.struct(
                F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("low"),
                F.greatest(x, y).alias("high"),
            )
        )
        total = lambda f: F.aggregate(
            F.map_values(merged), F.lit(0).cast("long"), lambda sum, x: sum + x[f]
        )
        scored = both.select("a", "b", (total("low") / total("high")).alias("similarity"))
    else:
        # Sets whose sizes differ too much cannot be similar enough.
        least = F.least(size("a"), size("b")) / F.greatest(size("a"), size("b"))
        shared = F.size(F.array_intersect("items_a", "items_b"))
        scored = both.where(least >= settings.similarity).select(
            "a", "b", (shared / (size("a") + size("b") - shared)).alias("similarity")
        )
    return scored.where(F.col("similarity") >= settings.similarity).select("a", "b")


def _merge(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, class) after links between classes; the smallest node names a class.

    In each round a class takes the smallest name among its neighbours and then the one
    that this name has taken, so chains get shorter by half or more.  Links keep joining
    what has not met yet until both ends have one name.  Rows are two numbers; a class with
    very many links is split by adaptive execution.
    """
    names = classes.select("node", "class")
    edges = links.select("u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v"))
        hooks = hooks.select(F.col("u").alias("from"), F.least("u", "v").alias("to"))
        far = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
        hooks = hooks.join(far, "to").select("from", F.col("far").alias("to"))
        hooks = _written(hooks, "hooks")
        names = names.select("node", F.col("class").alias("from")).join(hooks, "from", "left")
        names = _written(names.select("node", F.coalesce("to", "from").alias("class")), "classes")
        for old, new in (("u", "v"), ("v", "u")):
            edges = edges.select(F.col(old).alias("from"), new).join(hooks, "from")
            edges = edges.select(F.col("to").alias(old), new)
        edges = _written(edges.where("u != v").distinct(), "edges")
        if not edges.limit(1).count():
            return names


def _nodes(rows: DataFrame, id: str) -> DataFrame:
    """One row per key: its first row by id (null last) is the node."""
    order = F.struct(F.col(id).isNull().alias("nameless"), F.col(id).alias("id"), F.col("row"))
    best = rows.groupBy("key").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
    return best.select(
        "key", F.col("best.row").alias("node"), F.col("best.id").alias("id"), "size"
    )


def classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """The staged documents, and one row per document: ``row``, ``id`` and its class.

    See :func:`near_duplicates` for the rules; ``keep_row`` is the locator of the class's
    first document.
    """
    rows = _staged(docs, text, settings)
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own_id, own_text = place[id], place[text]
    nodes = _written(_nodes(rows.select("key", own_id, "row"), own_id), "nodes")
    # Rows with the words of another row that is the node; there are fewer of them than nodes.
    several = nodes.where("size > 1").select("key", "node")
    alike = rows.select("key", "row").join(F.broadcast(several) if _small(several) else several, "key")
    copies = _written(alike.where("row != node").select(F.col("row").alias("node")), "copies")
    merged = _components(rows, copies, own_text, settings)
    named = nodes.join(merged, "node", "left").select(
        "key", "node", "id", "size", F.coalesce("class", "node").alias("class")
    )
    named = _written(named, "named")
    first = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("node"))
    whole = named.groupBy("class").agg(F.min(first).alias("f"), F.sum("size").alias("class_size"))
    whole = whole.select(
        "class", F.col("f.id").alias("class_id"), F.col("f.node").alias("keep_row"), "class_size"
    )
    per_key = named.select("key", "class").join(whole, "class").drop("class")
    narrow = rows.select("row", F.col(own_id).alias("id"), "key")
    return rows, narrow.join(per_key, "key").drop("key")


def _components(rows: DataFrame, copies: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Class of every node that shares a band with another; nodes are the rows but the copies."""
    gone = F.broadcast(copies) if _small(copies) else copies
    banded = rows.select(F.col("row").alias("node"), "bands", "size").join(gone, "node", "left_anti")
    members = banded.select("node", "size", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_bands = _written(crowded.select("band"), "crowded")
    if _small(open_bands):
        open_bands = F.broadcast(open_bands)
    members = members.join(open_bands, "band").select(
        "band", "node", "size", F.lit(1).alias("rank")
    )
    members = _written(members, "members")
    merged = _written(members.select("node", F.col("node").alias("class")).distinct(), "classes")
    if not merged.limit(1).count():
        return merged
    sets = _written(_sets(rows, merged.select("node"), text, settings), "sets")

    def compared(
        members: DataFrame, merged: DataFrame, leaders: DataFrame, tested: DataFrame | None
    ) -> tuple[DataFrame, DataFrame]:
        """Classes after comparing leaders with the other members, and all pairs tested."""
        # What similar sets of these sizes share; the ranks of a shared shingle tell how
        # many can be shared from there on, and a band (rank 1) only compares the sizes.
        share = settings.similarity / (1 + settings.similarity)
        least = F.ceil((F.col("size") + F.col("leader_size")) * share - 1e-9)
        near = (F.col("rank") <= F.col("size") - least + 1) & (
            F.col("leader_rank") <= F.col("leader_size") - least + 1
        )
        pairs = (
            lookup_join(members, leaders, ["band"])
            .where(near & (F.col("class") != F.col("leads")))
            .select(
                F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
            )
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _written(_similar(pairs, sets, settings), "links")
        if links.limit(1).count():
            class_of = lambda n: merged.select(F.col("node").alias(n), F.col("class"))
            edges = links.join(class_of("a"), "a").select("b", F.col("class").alias("u"))
            edges = edges.join(class_of("b"), "b").select("u", F.col("class").alias("v"))
            merged = _merge(merged, _written(edges.distinct(), "edges"))
        return merged, tested

    # A part of the bands merges most copies, so that few pairs of the others are left.
    part = members.where(F.pmod("band", F.lit(FIRST_BANDS)) == 0).withColumn("class", F.col("node"))
    merged, tested = compared(part, merged, _leaders(part, 1, 0, settings), None)
    members = _still_open(members, merged)
    turn = 0
    while members.limit(1).count():
        leaders = _written(_leaders(members, 16**turn, turn, settings), "leaders")
        merged, tested = compared(members, merged, leaders, tested)
        # A leader has met all members it could be similar to.
        done = leaders.select("band", F.col("leader").alias("node"))
        members = members.drop("class").join(done, ["band", "node"], "left_anti")
        members = _still_open(members, merged)
        if turn == 0 and not settings.counted:
            members = _thinned(members, merged, sets, settings)
        turn += 1
    return merged


def _thinned(
    members: DataFrame, merged: DataFrame, sets: DataFrame, settings: Settings
) -> DataFrame:
    """The open members, those of crowded bands regrouped by their rarest shingles.

    What still crowds a band in many classes shares a passage, not the text.  Two sets of
    the wanted similarity have one of their rarest shingles in common, if each brings as
    many as it may lack and one more; so nothing similar is lost, and a shared passage
    that is the commonest part of its texts brings nobody together.
    """
    count = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    crowded = count.where(F.col("n") > CROWD).select("band")
    crowd = members.join(crowded, "band")
    if not crowd.limit(1).count():
        return members
    nodes = crowd.select("node", "size").distinct()
    own = sets.select("node", "items").join(F.broadcast(nodes) if _small(nodes) else nodes, "node")
    own = _written(own.select("node", "size", F.explode("items").alias("band")), "items")
    # Partial counts: a common shingle reaches the shuffle once per task.
    shared = own.groupBy("band").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    spread = own.join(shared, "band", "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    place = F.row_number().over(W.partitionBy("node").orderBy("texts", "band"))
    kept = lambda least: F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    rare = spread.withColumn("rank", place).where(
        (F.col("rank") <= kept(settings.similarity)) & (F.col("texts") > 1)
    )
    # The smaller set of a pair shares more than the larger: its shingle stands earlier.
    early = 2 * settings.similarity / (1 + settings.similarity)
    rare = _written(rare.select("band", "node", "size", "rank"), "rare")
    useful = rare.where(F.col("rank") <= kept(early)).select("band").distinct()
    rare = rare.join(useful, "band", "left_semi")
    calm = members.join(crowded, "band", "left_anti").select("band", "node", "size", "rank")
    return _still_open(calm.unionByName(rare), merged)


def _leaders(members: DataFrame, most: int, turn: int, settings: Settings) -> DataFrame:
    """At most ``most`` nodes of each band and step of size.

    The same nodes lead in many bands, so a pair is seldom compared twice.
    """
    step = F.floor(F.log("size") / F.log(F.lit(1 / settings.similarity)))
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(most))
    first = F.xxhash64("node", F.lit(-turn)) if turn else F.lit(0)
    rank = F.struct(first.alias("first"), "node", "class", "size", "rank")
    found = members.groupBy("band", step.alias("step"), slot.alias("slot"))
    found = found.agg(F.min(rank).alias("l"))
    return found.select(
        "band",
        F.col("l.node").alias("leader"),
        F.col("l.class").alias("leads"),
        F.col("l.size").alias("leader_size"),
        F.col("l.rank").alias("leader_rank"),
    )


def _still_open(members: DataFrame, merged: DataFrame) -> DataFrame:
    """Members, with their class, of the bands whose members are in several classes."""
    members = members.join(merged, "node")
    classes = members.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    several = classes.where("low < high").select("band")
    return _written(lookup_join(members, several, ["band"]), "members")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> DataFrame:
    """One row per document: ``id``, ``class_id``, ``class_size`` and ``kept``.

    Two texts are linked when the Jaccard similarity of their shingles of five words is
    at least 0.8 (exact, for all pairs that share a band); classes are the connected
    groups.  ``class_id`` is the smallest id of the class, a null id last; exactly one
    document of a class is kept, the one of that id.  Texts with the same words, case and
    punctuation aside, are one class; so are all texts without words, null among them.
    Repeated rows are copies.  Whole texts of any length count, an empty table gives no
    rows, other columns play no part.
    """
    needed = docs.select(
        F.col(ragged.quoted(id)).alias("id"), F.col(ragged.quoted(text)).alias("text")
    )
    _, decided = classes(needed, "id", "text", settings)
    return decided.select(
        "id", "class_id", "class_size", (F.col("row") == F.col("keep_row")).alias("kept")
    )


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns.

    Nulls, empty and very long texts, ties and repeated rows are decided as there; an empty
    table gives an empty one.
    """
    rows, decided = classes(docs, id, text, settings)
    gone = decided.where(F.col("row") != F.col("keep_row")).select("row")
    if _small(gone):
        gone = F.broadcast(gone)
    kept = rows.join(gone, "row", "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
