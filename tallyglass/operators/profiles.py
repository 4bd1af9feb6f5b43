"""Run profiles and cache logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_rate(hits: str, misses: str):
    return F.col(hits) / F.greatest(F.col(hits) + F.col(misses), F.lit(1))


def profile_summary(profiles: DataFrame, last: int | None = None) -> DataFrame:
    """Per operation count, durations, memory and cache hit rate.

    ``last`` keeps the newest profiles only, as a bounded profiler would.
    """
    if last is not None:
        profiles = profiles.orderBy(F.desc("end_time"), "operation", "duration").limit(last)
    return profiles.groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        F.min("duration").alias("min_duration"),
        F.avg("memory_usage").alias("avg_memory"),
        F.avg(hit_rate("cache_hits", "cache_misses")).alias("avg_cache_hit_rate"),
    )


def cache_hit_rate(log: DataFrame) -> DataFrame:
    """Hits over accesses per cache."""
    return log.groupBy("cache").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
    )
