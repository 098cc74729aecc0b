"""Accounting of byte ranges read: overlap, totals, and the budget of an inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.operators.running import running_totals

# Fixed value: the most bytes a structural inspection may read.
BUDGET = 256 * 1024
POSITIONS_PER_BLOCK = 1 << 16


def overlaps(offset: Column, length: Column, start: Column, end: Column) -> Column:
    """Whether a half-open read shares a byte with ``[start, end)``."""
    return (offset < end) & (start < offset + length)


def touch_counts(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """How many reads touch each range, without pairing reads with ranges.

    A read misses a range by starting at or after its end, or by ending at or before its start. So
    the count is the reads starting before the end less those ending by the start: two running
    totals over positions. ``reads(file_id, offset, length)``, ``ranges(file_id, range_id, start, end)``.
    """
    zero = F.lit(0).cast("bigint")
    points = (
        reads.select("file_id", F.col("offset").alias("position"), F.lit(1).alias("starts"), F.lit(0).alias("ends"))
        .unionByName(
            reads.select(
                "file_id",
                (F.col("offset") + F.col("length")).alias("position"),
                F.lit(0).alias("starts"),
                F.lit(1).alias("ends"),
            )
        )
        # Folded per position first, so the rows of a block are bounded by its width.
        .groupBy("file_id", "position")
        .agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"))
    )
    none = F.lit(None).cast("bigint")
    asked = ranges.select("file_id", F.col("end").alias("position"), "range_id", F.lit(1).alias("sign")).unionByName(
        ranges.select("file_id", F.col("start").alias("position"), "range_id", F.lit(-1).alias("sign"))
    )
    # At one position: questions about an end come before the reads there, about a start after them.
    swept = points.select(
        "file_id", "position", F.lit(1).alias("turn"), "starts", "ends", none.alias("range_id"), F.lit(0).alias("sign")
    ).unionByName(
        asked.select(
            "file_id",
            "position",
            (F.lit(1) - F.col("sign")).alias("turn"),
            zero.alias("starts"),
            zero.alias("ends"),
            F.col("range_id").cast("bigint").alias("range_id"),
            "sign",
        )
    )
    block = F.floor(F.col("position") / POSITIONS_PER_BLOCK)
    totals = running_totals(
        swept,
        ["file_id"],
        ["position", "turn", "range_id"],
        block,
        {"started": F.col("starts"), "ended": F.col("ends")},
    )
    passed = F.when(F.col("sign") > 0, F.col("started")).otherwise(-F.col("ended"))
    return (
        totals.where("sign <> 0")
        .groupBy("file_id", "range_id")
        .agg(F.sum(passed).alias("touching"))
    )


def touched(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges any read touched."""
    return touch_counts(reads, ranges).where("touching > 0").select("file_id", "range_id")


def bytes_read(reads: DataFrame) -> DataFrame:
    """Reads and bytes per file."""
    return reads.groupBy("file_id").agg(F.count(F.lit(1)).alias("reads"), F.sum("length").alias("bytes_read"))


def budget(reads: DataFrame, media: DataFrame, limit: int = BUDGET) -> DataFrame:
    """Per file: bytes read, whether the media was touched, and whether the inspection kept to its bound."""
    hit = touched(reads, media).select("file_id").distinct().withColumn("hit", F.lit(True))
    media_touched = F.coalesce("hit", F.lit(False))
    return (
        bytes_read(reads)
        .join(hit, "file_id", "left")
        .select(
            "file_id",
            "bytes_read",
            media_touched.alias("media_touched"),
            ((F.col("bytes_read") < limit) & ~media_touched).alias("bounded"),
        )
    )
