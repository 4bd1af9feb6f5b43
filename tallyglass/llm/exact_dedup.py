"""Exact de-duplication with streaming state.

Documents are written once with a digest of their normalised text.  A stream reads
the digests; its state, kept on disk by RocksDB and never expired, holds per digest
the document that stays (its length, id and locator) and the number of copies.  Then
every copy is compared byte by byte with the text that stays, found by its locator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallyglass.functions.skew import SMALL_ROWS, salted_join
from tallyglass.session import work_folder

from .ragged import quoted

# Copies compared with one copy of the kept text in the same task.
COPIES_PER_TASK = 500
# A digest with this share of all rows is joined by broadcast: at most so many digests.
HOT_SHARE = 1000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def staged(docs: DataFrame, text: str, digest=sha256) -> tuple[DataFrame, str]:
    """Write the documents once, each with a locator; returns them and their folder.

    Input columns become ``_c0``, ``_c1`` and so on, so that no name can clash.
    """
    body = normalised(F.col(quoted(text)))
    points = F.coalesce(F.char_length(F.col(quoted(text))), F.lit(0))
    inner = docs.select(
        *[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(docs.columns)],
        digest(body).alias("digest"),
        points.cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )
    folder = work_folder(docs.sparkSession, "staged")
    inner.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(inner.schema).parquet(folder), folder


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that the stream's settings touch no other query."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    prefix = "spark.sql.streaming.stateStore"
    session.conf.set(f"{prefix}.providerClass", _ROCKSDB)
    # A store is open only while its task runs: executors hold few at a time, however many
    # partitions there are, and none once the stream has ended.
    session.conf.set(f"{prefix}.unloadOnCommit", "true")
    session.conf.set(f"{prefix}.rocksdb.changelogCheckpointing.enabled", "true")
    # A store is small where partitions are many: no disk space is set aside in advance.
    session.conf.set(f"{prefix}.rocksdb.allowFAllocate", "false")
    session.conf.set(f"{prefix}.rocksdb.boundedMemoryUsage", "true")
    session.conf.set(f"{prefix}.rocksdb.maxMemoryUsageMB", "200")
    return session


def first_seen(spark: SparkSession, folder: str, id: str, files_per_batch: int = 1000) -> DataFrame:
    """One row per digest from the streaming state: what stays, and how many rows share it.

    Of equal texts the row with the most code points stays, then the smallest id (a null
    id last), then the smallest locator.  Batches write only the digests they touched; the
    newest state of a digest counts.  The stream restarts from its checkpoint.
    """
    session = _stream_session(spark)
    schema = session.read.parquet(folder).select("digest", "points", quoted(id), "row").schema
    rows = (
        session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    order = F.struct(
        (-F.col("points")).alias("shorter"),
        F.col(quoted(id)).isNull().alias("nameless"),
        F.col(quoted(id)).alias("id"),
        F.col("row"),
    )
    # Partial aggregation sends one row per digest and task, whatever the copies.
    state = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
    out = work_folder(spark, "first-seen")
    # The folder exists even if the stream has nothing to read.
    spark.createDataFrame([], state.schema).write.parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", work_folder(spark, "dedup-state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    shape = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    touched = spark.read.schema(shape).option("basePath", out).parquet(out)
    newest = touched.groupBy("digest").agg(F.max_by(F.struct("best", "size"), "batch").alias("s"))
    return newest.select(
        "digest",
        F.col("s.best.id").alias("keep_id"),
        F.col("s.best.row").alias("keep_row"),
        F.col("s.size").alias("size"),
    )


def _written(df: DataFrame, purpose: str) -> DataFrame:
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _compared(rows: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """Locators of the copies whose bytes differ from the kept text of their digest.

    Only texts of digests met more than once move.  The kept text goes along once per
    ``COPIES_PER_TASK`` copies, so no task gets a whole large group.
    """
    salts = F.ceil(F.col("size") / F.lit(COPIES_PER_TASK)).cast("int")
    several = groups.where(F.col("size") > 1).select("digest", "keep_row", salts.alias("salts"))
    if several.count() <= SMALL_ROWS:
        several = F.broadcast(several)
        found = rows.join(several, "digest")
    else:
        found = salted_join(rows, several, ["digest"])
    found = found.select(
        "digest", "row", "keep_row", "salts", normalised(F.col(text)).alias("body")
    )
    copies = found.where(F.col("row") != F.col("keep_row")).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    )
    kept = found.where(F.col("row") == F.col("keep_row")).select(
        "digest",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("body").alias("kept_body"),
    )
    pairs = copies.join(kept, ["digest", "salt"])
    return pairs.where(F.col("body") != F.col("kept_body")).select("digest", "row")


def _by_bytes(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Groups of equal normalised texts among rows whose digests collide."""
    order = F.struct(
        (-F.col("points")).alias("shorter"),
        F.col(id).isNull().alias("nameless"),
        F.col(id).alias("id"),
        F.col("row"),
    )
    body = normalised(F.col(text))
    keyed = rows.select("digest", "row", body.alias("body"), order.alias("o"))
    best = keyed.groupBy("digest", "body").agg(
        F.min("o").alias("best"), F.count(F.lit(1)).alias("size")
    )
    return keyed.join(best, ["digest", "body"]).select(
        "row", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "size"
    )


def decisions(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    files_per_batch: int = 1000,
    digest=sha256,
) -> tuple[DataFrame, DataFrame]:
    """The staged documents, and one row per document with what was decided.

    Decisions have ``row`` (the locator), ``id``, ``digest``, ``keep_id``, ``keep_row``
    and ``size``.  See :func:`dedup` for the rules.
    """
    rows, folder = staged(docs, text, digest)
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own_id, own_text = place[id], place[text]
    groups = _written(
        first_seen(docs.sparkSession, folder, own_id, files_per_batch), "groups"
    )
    differing = _written(_compared(rows, groups, own_text), "differing")
    narrow = rows.select("row", F.col(own_id).alias("id"), "digest")
    split = None
    if differing.limit(1).count():  # a digest stands for several texts: decide by the texts
        bad = differing.select("digest").distinct()
        split = narrow.join(
            _by_bytes(salted_join(rows, bad, ["digest"]), own_id, own_text), "row"
        ).select("row", "id", "digest", "keep_id", "keep_row", "size")
        narrow = narrow.join(bad, "digest", "left_anti")
        groups = groups.join(bad, "digest", "left_anti")
    total = groups.agg(F.sum("size")).first()[0] or 0
    is_hot = F.col("size") * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(groups.where(is_hot).withColumn("hot", F.lit(True)))
    marked = narrow.join(hot, "digest", "left")
    columns = ["row", "id", "digest", "keep_id", "keep_row", "size"]
    warm = marked.where("hot").select(*columns)
    cold = marked.where(F.col("hot").isNull()).select("row", "id", "digest")
    decided = warm.unionByName(
        cold.join(groups.where(~is_hot), "digest").select(*columns)
    )
    return rows, decided if split is None else decided.unionByName(split)


def dedup(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    files_per_batch: int = 1000,
    digest=sha256,
) -> DataFrame:
    """One row per document: ``id``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Texts are equal when they are without ASCII white space; null counts as empty, so
    empty, blank and null texts are one group.  Of equal texts the one with the most code
    points stays, then the smallest id; repeated rows with the same id are copies of each
    other and one of them stays.  A null id comes last.  Whole texts of any length count.
    An empty table gives no rows; other columns play no part.
    """
    needed = docs.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).alias("text"))
    _, decided = decisions(needed, "id", "text", files_per_batch, digest)
    return decided.select(
        "id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay by the rules of :func:`dedup`, with all their columns.

    Nulls, empty and very long texts, ties and repeated rows are decided as there; an empty
    table gives an empty one.
    """
    rows, decided = decisions(docs, id, text)
    gone = decided.where(F.col("row") != F.col("keep_row")).select("row")
    if gone.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        gone = F.broadcast(gone)
    kept = rows.join(gone, "row", "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
