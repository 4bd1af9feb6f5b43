"""Building blocks that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Rows up to which a checked side is broadcast.
SMALL_ROWS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = 1000) -> DataFrame:
    """Keys holding at least ``1/share`` of all rows: at most ``share`` of them."""
    counts = df.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    counts = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n"))
    return counts.where(F.col("_n") * share >= total.scalar()).select(*keys)


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind)
    return isinstance(kind, T.MapType | T.VariantType)


def _hashable(df: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed: those with maps inside as JSON."""
    columns = [(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema]
    return [F.to_json(F.struct(c)) if _unhashable(kind) else c for c, kind in columns]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 32,
    share: int = 1000,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Rows of hot keys are spread over ``salts`` join keys by a hash of the whole
    row (repeatable when a task is retried) and the right rows of those keys
    are repeated.  Rows with a null key match nothing and are spread as well.  The list
    of hot keys is broadcast: it has at most ``share`` rows whatever the data size.
    ``how`` keeps left rows (inner, left, anti).  Columns of any type may come along.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys, share).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*_hashable(left)), F.lit(salts)).cast("int")
    nameless = F.lit(False)
    for key in keys:
        nameless = nameless | F.col(key).isNull()
    salted = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | nameless, spread).otherwise(F.lit(0))
    )
    repeats = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(repeats))
    return salted.drop("_hot").join(repeated.drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def _is_small(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The table marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if _is_small(df, most) else df


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    most: int = SMALL_ROWS,
) -> DataFrame:
    """Join rows to a lookup table, safe when most rows look up the same key.

    A lookup of at most ``most`` (narrow) rows is broadcast and the left side does
    not move; a larger one is joined with salted hot keys.
    """
    if _is_small(right, most):
        return left.join(F.broadcast(right), list(keys), how)
    return salted_join(left, right, keys, how)


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int = 1
) -> DataFrame:
    """First ``count`` rows per key in the given order.

    The rank filter is applied before the shuffle as well (WindowGroupLimit),
    so a map task sends at most ``count`` rows of a key.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")
