"""Running sums, previous values and ranks along keys of any size.

A plain window sorts a whole key in one task.  Here rows are first dealt to parts of
equal size by key and order, so that a large key lies in several neighbouring parts.
Inside a part a window does the work; what a key brings along from earlier parts is one
row a part, because only the first key of a part can have begun before it.  Keys are
compared as structs, so a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows with ``_key`` (the keys as one struct) and ``_part``, written once.

    Parts follow each other by key and order and hold about as many rows each; rows equal in
    both lie in one part.  Later reads see the same parts, whatever becomes of the tasks.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*keys))
    placed = keyed.repartitionByRange(parts, "_key", *order)
    return stored(placed.withColumn("_part", F.spark_partition_id()), "dealt")


def _carried(rows: DataFrame, value: Column, along: Column) -> DataFrame:
    """``_part``, ``_first`` (its first key) and ``_before``: at most one row a part."""
    each = rows.groupBy("_key", "_part").agg(value.alias("_here"))
    earlier = W.partitionBy("_key").orderBy("_part")
    before = along.over(earlier.rowsBetween(W.unboundedPreceding, -1))
    continues = F.lag("_part").over(earlier).isNotNull()
    found = each.select("_part", F.col("_key").alias("_first"), before.alias("_before"), continues.alias("_c"))
    return F.broadcast(found.where("_c").drop("_c"))


def _inside(order: Sequence[str]) -> W:
    return W.partitionBy("_part", "_key").orderBy(*order)


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the key up to ``order``.

    ``(keys, order)`` must be unique.  Null keys make a key, and a null order comes first.
    """
    rows = dealt(df, keys, [order], parts)
    carried = _carried(rows, F.sum(value), F.sum("_here"))
    here = F.sum(value).over(_inside([order]).rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.when(F.col("_first") == F.col("_key"), F.col("_before"))
    joined = rows.join(carried, "_part", "left")
    total = joined.withColumn(out, F.coalesce(before, F.lit(0)) + here)
    return total.drop("_key", "_part", "_first", "_before")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, parts: int | None = None
) -> DataFrame:
    """``lag(value)`` along a key; same contract as :func:`running_total`."""
    rows = dealt(df, keys, [order], parts)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(order))
    carried = _carried(rows, last, F.last("_here"))
    inside = _inside([order])
    before = F.when(F.col("_first") == F.col("_key"), F.col("_before.v"))
    first_here = F.row_number().over(inside) == 1
    joined = rows.join(carried, "_part", "left")
    previous = F.when(first_here, before).otherwise(F.lag(value).over(inside))
    return joined.withColumn(out, previous).drop("_key", "_part", "_first", "_before")


def values_at_ranks(
    freq: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    wanted: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """The values that stand at wanted ranks (from 0) of each key's values in order.

    ``freq`` has one row per key and distinct value with its ``count``.  ``wanted`` maps
    names to ranks, expressions over ``_count``, the key's number of values.  Only the parts
    that hold a wanted rank are sorted.
    """
    rows = dealt(freq.select(*keys, value, F.col(count).alias("_n")), keys, [value], parts)
    each = rows.groupBy("_key", "_part").agg(F.sum("_n").alias("_here"))
    whole = W.partitionBy("_key")
    upto = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("_count", F.sum("_here").over(whole))
    each = each.withColumn("_from", F.sum("_here").over(upto) - F.col("_here"))

    def holds(rank: Column, first: str, size: str) -> Column:
        return (F.col(first) <= rank) & (rank < F.col(first) + F.col(size))

    some = F.lit(False)
    for rank in wanted.values():
        some = some | holds(rank, "_from", "_here")
    targets = each.where(some).select("_key", "_part", "_from", "_count")
    here = F.sum("_n").over(_inside([value]).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = rows.join(targets, ["_key", "_part"])
    ranked = ranked.withColumn("_at", F.col("_from") + here - F.col("_n"))
    picks = [
        F.max(F.when(holds(rank, "_at", "_n"), F.col(value))).alias(name)
        for name, rank in wanted.items()
    ]
    found = ranked.groupBy("_key").agg(F.max("_count").alias("_count"), *picks)
    return found.select("_key.*", "_count", *wanted)
