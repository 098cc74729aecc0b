"""The probe cache: a table keyed by path, size and time of change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "size", "modified"]
CACHE_FORMAT = "strongroom-probe/1"


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose cached probe still stands: same path, size and time, and a known format."""
    return files.join(cache.where(F.col("format") == CACHE_FORMAT).drop("format"), KEY)


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that have to be probed."""
    return files.join(cache.where(F.col("format") == CACHE_FORMAT), KEY, "left_anti")


def refreshed(cache: DataFrame, probed: DataFrame) -> DataFrame:
    """The cache with new probes in, one row per path; a new probe replaces what the path had."""
    fresh = probed.withColumn("format", F.lit(CACHE_FORMAT))
    kept = cache.where(F.col("format") == CACHE_FORMAT).join(fresh.select("path"), "path", "left_anti")
    return kept.unionByName(fresh)
