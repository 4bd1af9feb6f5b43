"""Statistics of overlapping windows from panes.

Time is cut into panes that no window cuts.  Each point is counted in its one pane, by
value; a window's numbers come from the panes it covers.  Moments of panes merge.  For
percentiles the values of a key fall into bins of about equal count, the same bins for all
windows; counts per pane and bin tell in which bin of a window a wanted rank lies, and only
the values of those bins are looked at again.  So neither points nor values are copied into
every window that holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .scans import running_total
from .skew import small_side
from .stats import DIRECT_ROWS, PERCENTILES, by_key, by_size, direct_percentiles

# Bins of a key's values; a window looks at one of them for each percentile.
BINS = 256


def pane_counts(points: DataFrame, keys: Sequence[str], pane: Column, value: str = "value") -> DataFrame:
    """``n`` points of each distinct value per key and ``pane``; null values count nowhere."""
    valued = points.where(F.col(value).isNotNull())
    placed = valued.select(*keys, pane.alias("pane"), F.col(value).alias("value"))
    return placed.groupBy(*keys, "pane", "value").agg(F.count(F.lit(1)).alias("n"))


def merged_panes(counts: DataFrame, keys: Sequence[str], pane: Column) -> DataFrame:
    """Counts of coarser panes from those of finer ones; ``pane`` is made from the column ``pane``."""
    placed = counts.select(*keys, pane.alias("pane"), "value", "n")
    return placed.groupBy(*keys, "pane", "value").agg(F.sum("n").alias("n"))


def pane_moments(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``count``, ``sum``, ``min``, ``max``, mean and squares about it of each key and pane."""
    keys = [*keys, "pane"]
    weighted = F.col("n") * F.col("value")
    first = counts.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.sum(weighted).alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    first = first.withColumn("mean", F.col("sum") / F.col("count"))
    off = F.col("value") - F.col("mean")
    around = by_key(counts, first.select(*keys, "mean"), keys)
    squares = around.groupBy(*keys).agg(F.sum(F.col("n") * off * off).alias("squares"))
    return by_key(first, squares, keys)


def point_moments(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from points that have their ``pane``, in one pass."""
    return placed.groupBy(*keys, "pane").agg(
        F.count("value").alias("count"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("squares"),
    )


def window_moments(panes: DataFrame, keys: Sequence[str], cover: DataFrame) -> DataFrame:
    """The usual moments of each key and ``window`` from the moments of its panes.

    ``cover`` lists the panes of every window.  Squares are moved to the window's mean, so
    large values close together stay exact.
    """
    both = panes.join(small_side(cover), "pane")
    keys = [*keys, "window"]
    whole = W.partitionBy(*keys)
    mean = F.sum("sum").over(whole) / F.sum("count").over(whole)
    off = F.col("mean") - F.col("avg")
    return (
        both.withColumn("avg", mean)
        .groupBy(*keys)
        .agg(
            F.sum("count").alias("count"),
            F.sum("sum").alias("sum"),
            F.first("avg").alias("avg"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.sqrt(F.sum(F.col("squares") + F.col("count") * off * off) / F.sum("count")).alias("std"),
        )
    )


def _binned(counts: DataFrame, keys: Sequence[str], bins: int, parts: int | None) -> DataFrame:
    """The counts with ``bin``, which never falls with the value and splits a key evenly."""
    keys = list(keys)
    values = counts.groupBy(*keys, "value").agg(F.sum("n").alias("all"))
    ranked = running_total(values, keys, "value", "all", "upto", parts)
    totals = values.groupBy(*keys).agg(F.sum("all").alias("total"))
    share = (F.col("upto") - F.col("all")) * bins / F.col("total")
    ranked = by_key(ranked, totals, keys).select(*keys, "value", F.floor(share).cast("int").alias("bin"))
    return stored(by_key(counts, ranked, [*keys, "value"]), "binned")


def window_percentiles(
    counts: DataFrame,
    keys: Sequence[str],
    cover: DataFrame,
    percentiles: dict[str, float] = PERCENTILES,
    bins: int = BINS,
    parts: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles of each key and ``window``."""
    keys = list(keys)
    cover = small_side(cover)
    binned = _binned(counts, keys, bins, parts)
    per_pane = binned.groupBy(*keys, "pane", "bin").agg(F.sum("n").alias("n"))
    of_window = [*keys, "window"]
    per_bin = per_pane.join(cover, "pane").groupBy(*of_window, "bin").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*of_window)
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    per_bin = per_bin.select(
        *of_window,
        "bin",
        "n",
        F.sum("n").over(whole).alias("_count"),
        (F.sum("n").over(upto) - F.col("n")).alias("_from"),
    )
    position = {name: (F.col("_count") - 1).cast("double") * F.lit(q) for name, q in percentiles.items()}

    def holds(rank: Column, first: str) -> Column:
        return (F.col(first) <= rank) & (rank < F.col(first) + F.col("n"))

    some = F.lit(False)
    for at in position.values():
        some = some | holds(F.floor(at), "_from") | holds(F.ceil(at), "_from")
    # The panes of the windows that want a value of the bin.
    targets = per_bin.where(some).drop("n").join(cover, "window")
    near = by_key(binned, targets, [*keys, "pane", "bin"])
    near = near.groupBy(*of_window, "bin", "_count", "_from", "value").agg(F.sum("n").alias("n"))
    inside = W.partitionBy(*of_window, "bin").orderBy("value")
    here = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    near = near.withColumn("_at", F.col("_from") + here - F.col("n"))
    picks = []
    for name, at in position.items():
        for edge, tag in ((F.floor, "lo"), (F.ceil, "hi")):
            picks.append(F.max(F.when(holds(edge(at), "_at"), F.col("value"))).alias(f"_{name}_{tag}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    found = near.groupBy(*of_window).agg(*picks)
    between = {
        name: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
        for name in percentiles
    }
    return found.select(*of_window, *[c.alias(name) for name, c in between.items()])


def window_stats(
    counts: DataFrame,
    keys: Sequence[str],
    cover: DataFrame,
    panes: DataFrame | None = None,
    bins: int = BINS,
    parts: int | None = None,
    direct: int = DIRECT_ROWS,
) -> DataFrame:
    """Moments and percentiles of each key and ``window``; a window without values has no row.

    ``counts`` has ``keys``, ``pane``, ``value`` and ``n`` (see :func:`pane_counts`), ``cover``
    a row for every ``window`` and ``pane`` it holds, ``panes`` the moments of the panes if
    they are known (else they are made from the counts).  A null key is a key.  Windows of a key
    whose values, all together, are at most ``direct`` are put together in memory.
    """
    keys = list(keys)
    of_window = [*keys, "window"]
    near = small_side(cover)

    def small(rows: DataFrame) -> DataFrame:
        return direct_percentiles(rows.join(near, "pane"), of_window)

    def large(rows: DataFrame) -> DataFrame:
        return window_percentiles(rows, keys, cover, bins=bins, parts=parts)

    found = by_size(counts, keys, F.count(F.lit(1)), small, large, direct)
    panes = pane_moments(counts, keys) if panes is None else panes
    return by_key(window_moments(panes, keys, cover), found, of_window)
