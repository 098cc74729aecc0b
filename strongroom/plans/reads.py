"""Read accounting: events are reads of their user's file, orders are ranges of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import reads as L
from strongroom.plans.registry import query, table

READS = """r AS (SELECT user_id AS file_id, (value * 1000)::BIGINT AS "offset", (length(props) * 40 + event_id % 700)::BIGINT AS length FROM events)"""
RANGES = """g AS (SELECT o_custkey AS file_id, o_orderkey AS range_id, (o_totalprice / 10)::BIGINT AS "start", (o_totalprice / 10)::BIGINT + 1 + length(o_orderpriority) * 50 AS "end" FROM orders)"""


def reads(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("file_id"),
        F.round(F.col("value") * 1000).cast("bigint").alias("offset"),
        (F.length("props") * 40 + F.col("event_id") % 700).cast("bigint").alias("length"),
    )


def ranges(spark, d):
    start = F.round(F.col("o_totalprice") / 10).cast("bigint")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("file_id"),
        F.col("o_orderkey").alias("range_id"),
        start.alias("start"),
        (start + 1 + F.length("o_orderpriority") * 50).alias("end"),
    )


@query(
    "l1_overlap_counts",
    f"""WITH {READS}, {RANGES} SELECT g.file_id, range_id, count(r.file_id) AS touching FROM g LEFT JOIN r
        ON r.file_id = g.file_id AND r."offset" < g."end" AND g."start" < r."offset" + r.length GROUP BY ALL""",
)
def overlap_counts(spark, d):
    return L.touch_counts(reads(spark, d), ranges(spark, d))


@query("l2_bytes_read", f"WITH {READS} SELECT file_id, count(*) AS reads, sum(length)::BIGINT AS bytes_read FROM r GROUP BY 1")
def bytes_read(spark, d):
    return L.bytes_read(reads(spark, d))


@query(
    "l3_touched_ranges",
    f"""WITH {READS}, {RANGES} SELECT file_id, range_id FROM g WHERE EXISTS (SELECT 1 FROM r
        WHERE r.file_id = g.file_id AND r."offset" < g."end" AND g."start" < r."offset" + r.length)""",
)
def touched_ranges(spark, d):
    return L.touched(reads(spark, d), ranges(spark, d))


@query(
    "l4_budget",
    f"""WITH {READS}, {RANGES}, t AS (SELECT DISTINCT g.file_id FROM g JOIN r ON r.file_id = g.file_id AND r."offset" < g."end" AND g."start" < r."offset" + r.length),
        b AS (SELECT file_id, sum(length)::BIGINT AS bytes_read FROM r GROUP BY 1)
        SELECT b.file_id, bytes_read, t.file_id IS NOT NULL AS media_touched, bytes_read < 65536 AND t.file_id IS NULL AS bounded FROM b LEFT JOIN t ON t.file_id = b.file_id""",
)
def budget(spark, d):
    return L.budget(reads(spark, d), ranges(spark, d), limit=65536)
