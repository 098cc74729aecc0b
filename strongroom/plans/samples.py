"""Sample-table queries: an order is a track, its lines are samples, its line numbers are chunks."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.operators import samples as S
from strongroom.operators.running import numbered, small_keys
from strongroom.plans.registry import query, table
from strongroom.sources.stored import stored

LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_shipdate",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


@lru_cache(maxsize=8)
def small_orders(spark, d) -> bool:
    """Whether a task takes any order's lines whole: then they meet once, in windows; else in blocks and joins."""
    return small_keys(table(spark, d, "lineitem"), ["l_orderkey"])


def placed(by, name: str):
    """The zero-based position in a window, as a column of that name."""
    return (F.row_number().over(by).cast("bigint") - 1).alias(name)


def lines(spark, d):
    """Lines with their zero-based index in the order; the blocks follow line number and part."""
    given, small = table(spark, d, "lineitem"), small_orders(spark, d)
    rows = (given.repartition("l_orderkey") if small else given).withColumns(
        {"file_id": F.col("l_orderkey"), "track_index": F.lit(0), "ln": F.col("l_linenumber").cast("bigint")}
    )
    if small:
        return rows.select("*", placed(Window.partitionBy(*S.TRACK).orderBy(*LINE_ORDER), "idx"))
    block = F.col("ln") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / 1024)
    return numbered(rows, S.TRACK, LINE_ORDER, block, "idx")


def per_number(spark, d):
    """One row per line number of an order: at most as many per order as there are line numbers."""
    given = table(spark, d, "lineitem")
    if small_orders(spark, d):
        # The lines of an order meet for its numbers and for what is worked out along them.
        given = given.repartition("l_orderkey")
    rows = given.groupBy(
        F.col("l_orderkey").alias("file_id"),
        F.lit(0).alias("track_index"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
    )
    grouped = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_partkey").alias("part"),
        F.min("l_shipdate").alias("shipped"),
        F.count(F.when(F.col("l_discount") > 0.02, 1)).alias("discounted"),
        F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("filled"),
    )
    return grouped.withColumn("run", F.row_number().over(Window.partitionBy(*S.TRACK).orderBy("ln")).cast("bigint") - 1)


def consistent(spark, d, keep=lambda df: df):
    """Run tables that agree with each other, as a recorder writes them.

    ``keep`` is applied to the numbered lines, which sizes and sync numbers both come from.
    """
    runs = per_number(spark, d)
    stts = runs.select(*S.TRACK, "run", "n", (F.col("ln") * 10).alias("delta"))
    ctts = runs.select(*S.TRACK, "run", "n", (F.col("ln") - 4).alias("offset"))
    stco = runs.select(
        *S.TRACK, (F.col("run") + 1).alias("chunk"), (F.col("ln") * 1000000 + F.col("part")).alias("offset")
    )
    by_track = Window.partitionBy(*S.TRACK).orderBy("run")
    changed = runs.withColumn("before", F.lag("n").over(by_track)).where("before IS NULL OR before <> n")
    stsc = changed.select(
        *S.TRACK,
        (F.row_number().over(by_track).cast("bigint") - 1).alias("run"),
        (F.col("run") + 1).alias("first_chunk"),
        F.col("n").alias("per_chunk"),
        F.lit(1).alias("description"),
    )
    indexed = keep(
        lines(spark, d).select(*S.TRACK, "ln", "idx", F.col("l_quantity").cast("bigint").alias("size"), "l_returnflag")
    )
    stsz = indexed.select(*S.TRACK, "idx", "size")
    returned = indexed.where("l_returnflag = 'R'").select(*S.TRACK, "ln", "idx", (F.col("idx") + 1).alias("sample_number"))
    if small_orders(spark, d):
        stss = returned.select(*S.TRACK, placed(Window.partitionBy(*S.TRACK).orderBy("idx"), "position"), "sample_number")
    else:
        stss = numbered(returned, S.TRACK, ["idx"], F.col("ln"), "position").select(*S.TRACK, "position", "sample_number")
    return stts, stsc, stsz, stco, stss, ctts


# The same tables in SQL. Windows run per order, which is the plain way to say it.
BASE = """
b AS (SELECT l_orderkey AS file_id, 0 AS track_index, l_linenumber::BIGINT AS ln, l_quantity::BIGINT AS size, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
          l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS idx,
        dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS chunk,
        min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS part FROM lineitem),
s AS (SELECT file_id, track_index, idx, size, ln * 10 AS duration, ln - 4 AS composition_offset, chunk,
        (sum(ln * 10) OVER w - ln * 10)::BIGINT AS decode_time,
        (ln * 1000000 + part + sum(size) OVER (PARTITION BY file_id, chunk ORDER BY idx) - size)::BIGINT AS "offset",
        count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY file_id) = 0 OR l_returnflag = 'R' AS sync
      FROM b WINDOW w AS (PARTITION BY file_id ORDER BY idx))"""


@query("d6_sync_flags", f"WITH {BASE} SELECT file_id, idx, sync FROM s")
def sync_flags(spark, d):
    _, _, stsz, _, stss, _ = consistent(spark, d)
    return S.sync_flags(stsz, stss).drop("track_index")


@query(
    "d8_cross_checks",
    """WITH g AS (SELECT l_orderkey AS file_id, l_linenumber::BIGINT AS ln, count(*) AS n, min(l_shipdate) AS shipped,
                    count(*) FILTER (l_discount > 0.02) AS discounted, count(*) FILTER (l_linestatus = 'F') AS filled
                  FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY shipped, ln) - 1 AS run FROM g),
    x AS (SELECT *, lag(ln) OVER w AS previous, lead(ln) OVER w AS following,
            count(*) OVER (PARTITION BY file_id) AS chunks FROM r WINDOW w AS (PARTITION BY file_id ORDER BY run)),
    t AS (SELECT file_id, sum(n) AS sized, sum(filled) FILTER (filled > 0) AS timed, max(chunks) AS chunks,
            sum(greatest(coalesce(following, chunks + 1) - ln, 0) * discounted) AS placed,
            sum(n) FILTER (ln <> 3) AS composed FROM x GROUP BY file_id),
    y AS (SELECT l_orderkey AS file_id, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS position
          FROM lineitem WHERE l_returnflag = 'R'),
    z AS (SELECT y.file_id, y.position, number, lag(number, 1, 0) OVER (PARTITION BY y.file_id ORDER BY position) AS previous, sized
          FROM y JOIN t ON t.file_id = y.file_id),
    v AS (SELECT file_id, 1 AS rule, 0 AS run FROM t WHERE coalesce(timed, 0) <> sized
      UNION ALL SELECT file_id, 2, run FROM x WHERE ln <= previous UNION ALL SELECT file_id, 3, run FROM x WHERE ln > chunks
      UNION ALL SELECT file_id, 4, run FROM x WHERE discounted = 0 UNION ALL SELECT file_id, 6, run FROM x WHERE run = 0 AND ln <> 1
      UNION ALL SELECT file_id, 7, 0 FROM t WHERE placed <> sized
      UNION ALL SELECT file_id, 8, position FROM z WHERE number <= previous OR number > sized
      UNION ALL SELECT file_id, 9, 0 FROM t WHERE composed <> sized),
    a AS (SELECT file_id, rule, run, row_number() OVER (PARTITION BY file_id ORDER BY
            CASE WHEN rule IN (3, 4) THEN 2 ELSE rule END, run, rule) AS place FROM v)
    SELECT file_id, min(rule) FILTER (place = 1) AS first_rule, min(run) FILTER (place = 1) AS first_run,
           count(DISTINCT rule) AS rules_broken FROM a GROUP BY file_id""",
)
def cross_checks(spark, d):
    """Tables read from the lines as they stand: runs in shipping order, line numbers as chunks."""
    runs = per_number(spark, d).drop("run")
    shipped = Window.partitionBy(*S.TRACK).orderBy("shipped", "ln")
    runs = runs.withColumn("run", F.row_number().over(shipped).cast("bigint") - 1)
    stts = runs.where("filled > 0").select(*S.TRACK, "run", F.col("filled").alias("n"), F.lit(1).alias("delta"))
    stsc = runs.select(*S.TRACK, "run", F.col("ln").alias("first_chunk"), F.col("discounted").alias("per_chunk"))
    stco = runs.select(*S.TRACK, (F.col("run") + 1).alias("chunk"), F.lit(0).alias("offset"))
    stsz = lines(spark, d).select(*S.TRACK, "idx")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("file_id"),
        F.lit(0).alias("track_index"),
        F.col("l_linenumber").cast("bigint").alias("sample_number"),
        *LINE_ORDER[1:6],
    )
    small = small_orders(spark, d)
    if small:
        stss = returned.select("*", placed(Window.partitionBy(*S.TRACK).orderBy(*LINE_ORDER[1:6]), "position"))
    else:
        stss = numbered(returned, S.TRACK, LINE_ORDER[1:6], F.floor(F.col("l_partkey") / 1024), "position")
    ctts = runs.where("ln <> 3").select(*S.TRACK, "run", "n", F.lit(0).alias("offset"))
    first = S.first_violation((S.violations_whole if small else S.violations)(stts, stsc, stsz, stco, stss, ctts))
    return first.select(
        "file_id",
        F.col("at.rule_rank").alias("first_rule"),
        F.col("at.run").alias("first_run"),
        "rules_broken",
    )


@query(
    "d9_placed_samples",
    f"WITH {BASE} SELECT file_id, count(*) AS placed FROM b GROUP BY file_id",
)
def placed_samples(spark, d):
    _, stsc, _, stco, _, _ = consistent(spark, d)
    return S.placed_samples(stsc, stco).drop("track_index")


@query("d10_run_expansion", f"WITH {BASE} SELECT file_id, idx, duration, composition_offset FROM s")
def run_expansion(spark, d):
    stts, _, _, _, _, ctts = consistent(spark, d)
    return (
        S.expand_durations(stts)
        .join(S.expand_compositions(ctts), [*S.TRACK, "idx"])
        .select("file_id", "idx", "duration", "composition_offset")
    )


@query("d11_chunk_assignment", f"WITH {BASE} SELECT file_id, idx, chunk FROM s")
def chunk_assignment(spark, d):
    _, stsc, _, stco, _, _ = consistent(spark, d)
    return S.assign_chunks(stsc, stco).select("file_id", "idx", "chunk")


def located(spark, d):
    return S.locate_whole if small_orders(spark, d) else S.locate


@query("d12_sample_offsets", f'WITH {BASE} SELECT file_id, idx, size, "offset" FROM s')
def sample_offsets(spark, d):
    _, stsc, stsz, stco, _, _ = consistent(spark, d)
    return located(spark, d)(stsc, stco, stsz).select("file_id", "idx", "size", "offset")


@query("d13_decode_times", f"WITH {BASE} SELECT file_id, idx, decode_time FROM s")
def decode_times(spark, d):
    stts, *_ = consistent(spark, d)
    return S.expand_durations(stts).select("file_id", "idx", "decode_time")


@query("d10_d13_sample_table", f"WITH {BASE} SELECT * EXCLUDE (track_index) FROM s")
def sample_table(spark, d):
    if small_orders(spark, d):
        return S.samples_whole(*consistent(spark, d)).drop("track_index")
    return S.samples(*consistent(spark, d, stored)).drop("track_index")


@query(
    "d14_track_totals",
    """SELECT l_orderkey AS file_id, count(*) AS sample_count, sum(l_quantity)::BIGINT AS sample_bytes,
              CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN count(*) FILTER (l_returnflag = 'R')
                   ELSE count(*) END AS sync_sample_count,
              max(CASE WHEN l_linenumber <> 4 THEN 1 ELSE 0 END) = 1 AS composition_offsets
       FROM lineitem GROUP BY 1""",
)
def track_totals(spark, d):
    _, _, stsz, _, stss, ctts = consistent(spark, d)
    return S.totals(stsz, stss, ctts).drop("track_index")
