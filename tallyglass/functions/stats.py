"""Exact grouped statistics that never hold a group in one task.

Groups of up to ``DIRECT_ROWS`` rows are held in memory by one aggregation.  Of larger ones
equal values merge before they move; their values are dealt to parts of equal size by group
and value, so that a group lies in several parts however close its values are; counts per
part tell which parts hold a wanted rank, and only those are sorted.  Each group goes its own
way and the rows are the same by either; a null key is a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .scans import values_at_ranks

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


# Rows of a group that one aggregation may hold in memory.
DIRECT_ROWS = 100_000

# Rows of distinct values that one task sorts, whatever the size of the table.
TASK_ROWS = 400_000


def frequency(points: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count of each distinct value per group; equal values merge map-side."""
    return points.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def moments(value: str = "value") -> list[Column]:
    """count (of values that are not null), sum, avg, min, max and population std."""
    return [
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
    ]


def by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which any may be null; null matches null.

    A plain join, because both sides are results that a look at their size would compute
    twice; adaptive execution sends a small one along and splits a large key.
    """
    keys = list(keys)
    lone = lambda df: df.withColumn("_key", F.struct(*keys)).drop(*keys)
    joined = lone(left).join(lone(right), "_key", how)
    return joined.select("_key.*", *[c for c in joined.columns if c != "_key"])


def weighted_moments(freq: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The same moments from distinct values with their count ``n``.

    Squares are taken about the group's mean in a second pass, which stays exact
    for large values close together.
    """
    weighted = F.col("n") * F.col(value)
    first = freq.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.sum(weighted).alias("sum"),
        (F.sum(weighted) / F.sum("n")).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    off = F.col(value) - F.col("avg")
    around = by_key(freq.select(*keys, value, "n"), first.select(*keys, "avg"), keys)
    second = around.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("std")
    )
    return by_key(first, second, keys)


def exact_percentiles(
    freq: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    percentiles: dict[str, float] = PERCENTILES,
    parts: int | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group.

    ``freq`` has one row per (group, distinct value) with its count ``n``; a null value is
    no value.  ``parts`` is the number of parts the values are dealt to.
    """
    position = {
        name: (F.col("_count") - 1).cast("double") * F.lit(q) for name, q in percentiles.items()
    }
    wanted = {}
    for name, at in position.items():
        wanted[f"_{name}_lo"], wanted[f"_{name}_hi"] = F.floor(at), F.ceil(at)
    found = values_at_ranks(freq.where(F.col(value).isNotNull()), keys, value, "n", wanted, parts)
    between = {
        name: F.col(f"_{name}_lo")
        + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (at - F.floor(at))
        for name, at in position.items()
    }
    return found.select(*keys, *[c.alias(name) for name, c in between.items()])


def by_size(
    rows: DataFrame,
    keys: Sequence[str],
    size: Column,
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    direct: int,
    seen: Observation | None = None,
) -> DataFrame:
    """What ``small`` makes of groups of at most ``direct`` rows and ``large`` of the others.

    ``size`` adds up the rows of a group.  One light pass finds the large groups; of n rows in
    all there are at most n / ``direct``.  ``seen`` learns the number of ``rows`` by that pass.
    """
    sizes = rows.groupBy(*keys).agg(size.alias("_size"))
    if seen is not None:
        sizes = sizes.observe(seen, F.sum("_size").alias("rows"))
    big = stored(sizes.where(F.col("_size") > direct).select(F.struct(*keys).alias("_key")), "large")
    if not big.limit(1).count():
        return small(rows)
    keyed = rows.withColumn("_key", F.struct(*keys))
    rest = small(keyed.join(big, "_key", "left_anti").drop("_key"))
    return rest.unionByName(large(keyed.join(big, "_key", "left_semi").drop("_key")))


def _unpacked(df: DataFrame) -> DataFrame:
    """The array of percentiles as columns."""
    return df.withColumns({name: F.col("_p")[i] for i, name in enumerate(PERCENTILES)}).drop("_p")


def grouped_stats(
    points: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    parts: int | None = None,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """Moments and percentiles of plain rows; null values count nowhere."""
    keys = list(keys)

    def small(rows: DataFrame) -> DataFrame:
        wanted = F.percentile(value, list(PERCENTILES.values())).alias("_p")
        return _unpacked(rows.groupBy(*keys).agg(*moments(value), wanted))

    def large(rows: DataFrame) -> DataFrame:
        found = exact_percentiles(frequency(rows, keys, value), keys, value, parts=parts)
        return by_key(rows.groupBy(*keys).agg(*moments(value)), found, keys)

    valued = points.where(F.col(value).isNotNull())
    return by_size(valued, keys, F.count(F.lit(1)), small, large, direct)


def direct_percentiles(freq: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Percentiles of distinct values with their count ``n``, each group in memory."""
    wanted = F.percentile(value, list(PERCENTILES.values()), F.col("n")).alias("_p")
    return _unpacked(freq.groupBy(*keys).agg(wanted))


def direct_stats(freq: DataFrame, keys: Sequence[str], value: str, parts: int) -> DataFrame:
    """Moments and percentiles of distinct values with their count ``n``, each group in memory.

    The rows move once, to ``parts`` parts.  Squares are taken about the group's mean, which
    a window over the part's rows puts beside them.
    """
    rows = freq.select(F.struct(*keys).alias("_key"), F.col(value).alias("_value"), "n")
    rows = rows.repartition(parts, "_key")
    weighted = F.col("n") * F.col("_value")
    whole = W.partitionBy("_key")
    rows = rows.withColumn("_avg", F.sum(weighted).over(whole) / F.sum("n").over(whole))
    off = F.col("_value") - F.col("_avg")
    found = rows.groupBy("_key").agg(
        F.sum("n").alias("count"),
        F.sum(weighted).alias("sum"),
        F.first("_avg").alias("avg"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
        F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("std"),
        F.percentile("_value", list(PERCENTILES.values()), F.col("n")).alias("_p"),
    )
    return _unpacked(found.select("_key.*", *[c for c in found.columns if c != "_key"]))


def weighted_stats(
    freq: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    parts: int | None = None,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """The same from distinct values with their count ``n``; null values count nowhere.

    Groups of at most ``direct`` values share tasks of about ``TASK_ROWS`` rows.
    """
    keys = list(keys)
    seen = Observation()
    freq = freq.where(F.col(value).isNotNull())

    def small(rows: DataFrame) -> DataFrame:
        shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return direct_stats(rows, keys, value, max(shuffled, -(-(seen.get["rows"] or 0) // TASK_ROWS)))

    def large(rows: DataFrame) -> DataFrame:
        found = exact_percentiles(rows, keys, value, parts=parts)
        return by_key(weighted_moments(rows, keys, value), found, keys)

    return by_size(freq, keys, F.count(F.lit(1)), small, large, direct, seen)
