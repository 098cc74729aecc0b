"""Manifest queries over orders and their lines, and over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import digests as E
from strongroom.operators import library as L
from strongroom.operators import manifest as M
from strongroom.operators.running import running_totals
from strongroom.plans.digests import PAYLOADS, media_places
from strongroom.plans.headers import CONFIGURATION, TRACKS
from strongroom.plans.recordings import SAMPLES, files
from strongroom.plans.registry import query, table
from strongroom.plans.samples import BASE, LINE_ORDER
from strongroom.plans.sources import JSON, order_documents


@query(
    "f1_track_records",
    f"""WITH {TRACKS}, {SAMPLES}, {PAYLOADS}
        SELECT t.file_id, t.track_index, track_id, kind, CASE kind WHEN 'video' THEN 'avc1' ELSE 'mp4a' END AS coding, CASE kind WHEN 'video' THEN 'avc1.640028' END AS codec_string,
          CASE kind WHEN 'video' THEN 64 END AS width, CASE kind WHEN 'video' THEN 48 END AS height, CASE kind WHEN 'audio' THEN 44100 END AS sample_rate, CASE kind WHEN 'audio' THEN 2 END AS channels,
          timescale, ticks AS duration_ticks, ticks * 1000 // timescale AS duration_ms, n AS sample_count, CASE kind WHEN 'video' THEN mv ELSE n END AS sync_sample_count,
          kind = 'video' AND ct > 0 AS composition_offsets, 3 AS flags, true AS enabled, CASE WHEN kind = 'video' AND ed > 0 THEN 1 ELSE 0 END AS edits,
          CASE kind WHEN 'video' THEN vb ELSE ab END * 8000 // (ticks * 1000 // timescale) AS average_bit_rate, payload_sha256, 'payload/1' AS payload_version, sha256(unhex({CONFIGURATION})) AS configuration_sha256
        FROM t JOIN pd ON pd.file_id = t.file_id AND pd.track_index = t.track_index""",
)
def track_records(spark, d):
    return M.track_records(media_places(files(spark, d), *M.RECORD_PARTS))


@query(
    "f2_average_bit_rate",
    """WITH g AS (SELECT l_orderkey AS file_id, sum(l_quantity)::BIGINT AS bytes, (count(*) FILTER (l_returnflag = 'R') * 37)::BIGINT AS ms FROM lineitem GROUP BY 1)
       SELECT file_id, bytes, ms, CASE WHEN ms <> 0 THEN bytes * 8000 // ms END AS bit_rate FROM g""",
)
def average_bit_rate(spark, d):
    summed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("bytes"), (F.count_if(F.col("l_returnflag") == "R") * 37).alias("ms")
    )
    return summed.withColumn("bit_rate", M.bit_rate(F.col("bytes"), F.col("ms")))


@query(
    "f3_first_seen_tags",
    """WITH t AS (SELECT l_orderkey AS file_id, l_returnflag || l_linestatus AS tag, min((l_linenumber, l_partkey, l_suppkey)) AS first_at FROM lineitem WHERE l_discount > 0 GROUP BY ALL)
       SELECT file_id, string_agg(tag, ' ' ORDER BY first_at, tag) AS tags FROM t GROUP BY 1""",
)
def first_seen_tags(spark, d):
    tags = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(F.col("l_discount") > 0, F.concat("l_returnflag", "l_linestatus")).otherwise("").alias("tag"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    seen = L.first_seen(tags.where("tag <> ''"), ["file_id"], "tag", ["l_linenumber", "l_partkey", "l_suppkey"])
    return seen.select("file_id", F.array_join("tags", " ").alias("tags"))


@query(
    "f4_vendor_records",
    """WITH b AS (SELECT s_nationkey AS file_id, CASE WHEN s_acctbal > 4000 THEN 'meta' ELSE 'zvnd' END AS kind, s_suppkey * 20 AS "offset", s_acctbal::BIGINT AS size, sha256(s_name) AS sha256, 'user_data' AS location FROM supplier
         UNION ALL SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'meta' ELSE 'zzzz' END, c_custkey * 20 + 1, c_acctbal::BIGINT, sha256(c_name), 'top_level' FROM customer)
       SELECT *, location = 'user_data' AND kind = 'meta' AS standard, row_number() OVER (PARTITION BY file_id ORDER BY "offset") - 1 AS position FROM b""",
)
def vendor_records(spark, d):
    under = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("file_id"),
        F.when(F.col("s_acctbal") > 4000, "meta").otherwise("zvnd").alias("kind"),
        (F.col("s_suppkey") * 20).alias("offset"),
        F.rint("s_acctbal").cast("bigint").alias("size"),
        E.sha256("s_name").alias("sha256"),
    )
    above = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("file_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "meta").otherwise("zzzz").alias("kind"),
        (F.col("c_custkey") * 20 + 1).alias("offset"),
        F.rint("c_acctbal").cast("bigint").alias("size"),
        E.sha256("c_name").alias("sha256"),
    )
    return M.vendor_records(under, above)


@query(
    "f5_structure_records",
    f"""WITH {BASE}, x AS (SELECT file_id, idx AS ord, CASE l_returnflag WHEN 'A' THEN 'ftyp' WHEN 'N' THEN 'mdat' ELSE 'moov' END AS kind, size,
          sum(size) OVER (PARTITION BY file_id ORDER BY idx) - size AS "offset", ln = 7 AS clipped FROM b)
        SELECT file_id, string_agg(kind, ' ' ORDER BY ord) AS top_level, min(ord) FILTER (kind = 'moov') < min(ord) FILTER (kind = 'mdat') AS moov_before_mdat,
          arg_min("offset", ord) FILTER (kind = 'moov')::BIGINT AS moov_offset, arg_min(size, ord) FILTER (kind = 'moov') AS moov_size,
          CASE WHEN arg_max(clipped, ord) THEN arg_max(size, ord) END AS clipped_tail_bytes FROM x GROUP BY 1""",
)
def structure_records(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), *LINE_ORDER, F.col("l_quantity").cast("bigint").alias("size")
    )
    block = F.col("l_linenumber") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / 1024)
    placed = running_totals(
        rows, ["file_id"], LINE_ORDER, block, {"ord": F.lit(1).cast("bigint"), "offset": F.col("size")}
    )
    kind = F.when(F.col("l_returnflag") == "A", "ftyp").when(F.col("l_returnflag") == "N", "mdat").otherwise("moov")
    return M.structure_records(
        placed.select("file_id", "ord", kind.alias("kind"), "offset", "size", (F.col("l_linenumber") == 7).alias("clipped"))
    )


@query(
    "f6_scope",
    """SELECT doc_id AS file_id, 'full' AS scope, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id, 'structure', NULL FROM documents""",
)
def scope(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    return M.scoped(files, "full").unionByName(M.scoped(files, "structure"))


CLOCKS = """k AS (SELECT o_orderkey AS file_id, [strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') END,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') END, NULL] AS v FROM orders),
t AS (SELECT file_id, unnest(range(4))::INT AS rank, unnest(['container_clock', 'satellite_clock', 'file_name', 'system_clock_at_manifest']) AS source,
  unnest(['the container clock', 'the satellite clock', 'the file name', 'the system clock at the time of the manifest']) AS words, unnest(v) AS value FROM k)"""


def clocks(spark, d):
    when = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        M.civil_1904(when + M.EPOCH_1904).alias("container_clock"),
        F.when(F.col("o_orderpriority") == "5-LOW", M.civil(when + 90)).alias("satellite_clock"),
        F.when(F.col("o_orderstatus") == "F", M.civil(when - 3600)).alias("file_name"),
        F.lit(None).cast("string").alias("system_clock_at_manifest"),
    )


@query("f7_times", f"WITH {CLOCKS} SELECT file_id, rank, source, value FROM t WHERE value IS NOT NULL")
def times(spark, d):
    return M.times(clocks(spark, d))


@query(
    "f8_civil_time",
    """SELECT o_orderkey, strftime(TIMESTAMP '1904-01-01' + to_seconds(o_orderkey * 200003), '%Y-%m-%dT%H:%M:%S') AS container_time,
              strftime(TIMESTAMP '1970-01-01' + to_seconds(o_custkey * 1000003 - 500000000), '%Y-%m-%dT%H:%M:%S') || 'Z' AS unix_time FROM orders""",
)
def civil_time(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        M.civil_1904(F.col("o_orderkey") * 200003).alias("container_time"),
        M.utc(M.civil(F.col("o_custkey") * 1000003 - 500000000)).alias("unix_time"),
    )


@query(
    "f9_clock_disagreement",
    f"""WITH {CLOCKS} SELECT file_id, count(*) AS clocks, string_agg(words || ' says ' || value, ', ' ORDER BY rank) AS list,
          (epoch(max(value::TIMESTAMP)) - epoch(min(value::TIMESTAMP)))::BIGINT AS spread_seconds FROM t WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def clock_disagreement(spark, d):
    return M.clock_disagreement(M.times(clocks(spark, d)))


@query(
    "f10_nested_document",
    f"""WITH {JSON} SELECT o_orderkey AS file_id, coalesce(c.n, 0) AS tracks, coalesce(c.list, '') AS codings, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS times
        FROM orders LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(i || coding || n || coalesce(left(p, 8), ''), ' ' ORDER BY i) AS list FROM b GROUP BY 1) c ON c.file_id = o_orderkey""",
)
def nested_document(spark, d):
    tracks = F.col("manifest.tracks")
    shown = F.transform(
        tracks,
        lambda t: F.concat_ws(
            "", t["index"], t["coding"], t["sample_count"], F.substring(F.coalesce(t["payload_sha256"], F.lit("")), 1, 8)
        ),
    )
    return order_documents(spark, d).select(
        "file_id",
        F.size(tracks).cast("bigint").alias("tracks"),
        F.array_join(shown, " ").alias("codings"),
        F.size("manifest.times").alias("times"),
    )
