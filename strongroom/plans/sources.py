"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import boxes as B
from strongroom.operators import library as L
from strongroom.operators import manifest as M
from strongroom.operators import media
from strongroom.plans.digests import media_places
from strongroom.plans.recordings import FAULTS, LAYOUT, SAMPLES, damaged, files
from strongroom.plans.registry import query, table
from strongroom.plans.samples import lines
from strongroom.sources import archive, cache


@query("a1_discovery")
def discovery(spark, d):
    """The files of the given folder; no oracle, as SQL here does not see the folder."""
    found = archive.discover(spark, d)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length").orderBy("name")


@query(
    "a3_range_reads",
    f"""WITH {LAYOUT}, {SAMPLES}, p AS (SELECT file_id, 0 AS track_index, i, (media + sum(size) OVER (PARTITION BY file_id ORDER BY i) - size)::BIGINT AS "offset", size FROM sm
          UNION ALL SELECT file_id, 1, i, media + vb + 8 * i, 8 FROM sm WHERE st <> 'P')
        SELECT file_id, track_index, i AS range_id, "offset", size, size AS got, NULL::VARCHAR AS problem FROM p
        UNION ALL SELECT file_id, NULL, -1, length - 4, 8, NULL, 'out of bounds' FROM f""",
)
def range_reads(spark, d):
    """Every sample of every track by its place in the file, and one range past the end of each file."""
    f = files(spark, d)
    got = media.samples(media_places(f)).withColumnRenamed("sample_idx", "range_id").drop("width")
    ends = F.struct(F.lit(-1).cast("bigint").alias("range_id"), (F.col("length") - 4).alias("offset"), F.lit(8).cast("bigint").alias("size"))
    past = archive.cut_ranges(f, F.array(ends)).withColumn("track_index", F.lit(None).cast("int"))
    return got.unionByName(past).select(
        "file_id", "track_index", "range_id", "offset", "size", F.length("bytes").cast("bigint").alias("got"), "problem"
    )


def order_documents(spark, d):
    """One manifest per order: lines are tracks, dates are clocks, the total is the size."""
    o = table(spark, d, "orders")
    facts = o.select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(F.lit('clip "'), F.col("o_orderkey").cast("string"), F.lit('".mp4')).alias("name"),
        F.round("o_totalprice").cast("bigint").alias("size"),
        F.when(F.col("o_orderstatus") != "O", F.sha2(F.col("o_orderpriority"), 256)).alias("sha256"),
    )
    clocks = o.select(
        F.col("o_orderkey").alias("file_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("container_clock"),
        F.lit(None).cast("string").alias("satellite_clock"),
        F.when(F.col("o_orderstatus") == "F", "2001-02-03T04:05:06").alias("file_name"),
        F.lit(None).cast("string").alias("system_clock_at_manifest"),
    )
    tracks = lines(spark, d).select(
        "file_id",
        F.col("idx").alias("index"),
        F.concat("l_returnflag", "l_linestatus").alias("coding"),
        F.col("l_quantity").cast("bigint").alias("sample_count"),
        F.when(F.col("l_discount") > 0.05, F.sha2(F.col("l_partkey").cast("string"), 256)).alias("payload_sha256"),
    )
    return M.documents(facts, tracks, M.times(clocks))


JSON = """
b AS (SELECT l_orderkey AS file_id, l_returnflag || l_linestatus AS coding, l_quantity::BIGINT AS n, CASE WHEN l_discount > 0.05 THEN sha256(l_partkey::VARCHAR) END AS p,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
tr AS (SELECT file_id, string_agg('    {' || chr(10) || '      "index": ' || i || ',' || chr(10) || '      "coding": "' || coding || '",' || chr(10) || '      "sample_count": ' || n || ',' || chr(10)
         || '      "payload_sha256": ' || coalesce('"' || p || '"', 'null') || chr(10) || '    }', ',' || chr(10) ORDER BY i) AS t FROM b GROUP BY 1),
js AS (SELECT o_orderkey AS file_id, '{' || chr(10) || '  "format": "strongroom-manifest/1",' || chr(10) || '  "file": {' || chr(10) || '    "name": "clip \\"' || o_orderkey || '\\".mp4",' || chr(10)
         || '    "size": ' || round(o_totalprice)::BIGINT || ',' || chr(10) || '    "sha256": ' || CASE WHEN o_orderstatus <> 'O' THEN '"' || sha256(o_orderpriority) || '"' ELSE 'null' END || chr(10) || '  },' || chr(10)
         || '  "tracks": ' || CASE WHEN t IS NULL THEN '[]' ELSE '[' || chr(10) || t || chr(10) || '  ]' END || ',' || chr(10) || '  "times": [' || chr(10)
         || '    {' || chr(10) || '      "value": "' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '",' || chr(10) || '      "source": "container_clock"' || chr(10) || '    }'
         || CASE WHEN o_orderstatus = 'F' THEN ',' || chr(10) || '    {' || chr(10) || '      "value": "2001-02-03T04:05:06",' || chr(10) || '      "source": "file_name"' || chr(10) || '    }' ELSE '' END
         || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS json
       FROM orders LEFT JOIN tr ON tr.file_id = o_orderkey)"""


@query("a4_canonical_json", f"WITH {JSON} SELECT file_id, json FROM js")
def canonical_json(spark, d):
    return M.to_canonical_json(order_documents(spark, d))


VARIANT = """CASE o_orderpriority WHEN '1-URGENT' THEN '{"format":"strongroom-manifest/1","file":{"name":"a","size":' || o_orderkey || ',"sha256":null},"tracks":[],"times":[]}'
  WHEN '2-HIGH' THEN '{"format":"strongroom-manifest/1","file":{"name":"a","size":1,"sha256":null,"owner":"x"},"tracks":[{"index":0,"coding":"avc1","sample_count":3,"payload_sha256":null,"note":1}],"times":[],"extra":' || o_orderkey || '}'
  WHEN '3-MEDIUM' THEN '{"format":"other/' || o_orderkey || '","file":{"name":"a","size":1,"sha256":null},"tracks":[],"times":[]}'
  WHEN '5-LOW' THEN '{"format":"strongroom-manifest/1","file":{"name":"a","size":1,"sha256":null},"tracks":[{"index":' || o_orderkey || ',"coding":"avc1","sample_count":3,"payload_sha256":null}],"times":[]}'
  ELSE '{"format":"strongroom-manifest/1","file":' || o_orderkey END"""


@query(
    "a5_strict_json",
    """SELECT o_orderkey AS file_id, CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey WHEN '5-LOW' THEN 1 END AS size, CASE o_orderpriority WHEN '5-LOW' THEN o_orderkey END AS first_index,
         CASE o_orderpriority WHEN '2-HIGH' THEN 'unknown field extra, file.owner, tracks.note' WHEN '3-MEDIUM' THEN 'another format' WHEN '4-NOT SPECIFIED' THEN 'malformed' END AS reason FROM orders""",
)
def strict_json(spark, d):
    texts = table(spark, d, "orders").selectExpr("o_orderkey AS file_id", f"{VARIANT} AS json")
    return M.from_json(texts).select(
        "file_id",
        F.col("manifest.file.size").alias("size"),
        F.get("manifest.tracks", F.lit(0))["index"].alias("first_index"),
        "reason",
    )


def cached(spark, d):
    """Documents as files: the cache knows the labelled ones, some at another size or in another format."""
    docs = table(spark, d, "documents")
    found = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.length("source").alias("modified"))
    known = docs.join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("path"),
        F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"),
        F.length("source").alias("modified"),
        F.when(F.col("toxic") == 1, "older/0").otherwise(cache.CACHE_FORMAT).alias("format"),
        F.concat(F.lit("old "), "source").alias("probe"),
    )
    return found, known


CACHED = """c AS (SELECT d.doc_id AS path, n_chars + (lang = 'fr')::INT AS size, length(source) AS modified, 'old ' || source AS probe FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic <> 1),
n AS (SELECT doc_id AS path, n_chars AS size, length(source) AS modified, lang FROM documents)"""


@query(
    "a6_probe_cache",
    f"""WITH {CACHED} SELECT path, size, modified, c.probe IS NULL AS missed, coalesce(c.probe, 'new ' || lang) AS probe FROM n LEFT JOIN c USING (path, size, modified)""",
)
def probe_cache(spark, d):
    found, known = cached(spark, d)
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "lang")
    probed = cache.misses(found, known).join(langs, "path").select(*cache.KEY, F.concat(F.lit("new "), "lang").alias("probe"))
    merged = cache.refreshed(known, probed).drop("format")
    return merged.join(found, cache.KEY, "left_semi").select(
        *cache.KEY, F.col("probe").startswith("new ").alias("missed"), "probe"
    )


@query(
    "a7_unreadable_rows",
    f"""WITH {LAYOUT}, {FAULTS} SELECT file_id, e.code AS reason, e.code IS NULL AS readable FROM e""",
)
def unreadable_rows(spark, d):
    w = B.walk_boxes(B.whole_files(damaged(spark, d)))
    found = B.errors(w).select("file_id", F.col("code").alias("reason"))
    return (
        damaged(spark, d)
        .select("file_id")
        .join(found, "file_id", "left")
        .select("file_id", "reason", F.col("reason").isNull().alias("readable"))
    )


@query("a8_corpus", f"WITH {LAYOUT} SELECT file_id, length, sha256('ftyp') AS opening FROM f")
def corpus_files(spark, d):
    return files(spark, d).select(
        "file_id", "length", F.sha2(F.substring("content", F.lit(5), F.lit(4)), 256).alias("opening")
    )


def probe_boxes(w):
    """The top-level boxes and the children of user data of each file."""
    held = B.held_bytes(w)
    place = (
        F.when(F.col("path").startswith("moov/udta/"), "user_data")
        .when((F.col("depth") == 0) & ~B.one_of(F.col("kind"), B.KNOWN_TOP_LEVEL) & ~F.col("clipped"), "unknown")
        .when(F.col("depth") == 0, "top_level")
    )
    return held.select(
        "file_id",
        place.alias("place"),
        B.shown(F.col("kind")).alias("kind"),
        "offset",
        B.is_standard(F.col("kind")).alias("standard"),
        F.when(place == "user_data", F.col("bytes")).alias("content"),
    ).where("place IS NOT NULL")


@query(
    "h4_probe_summary",
    f"""WITH {LAYOUT} SELECT file_id, 1 AS video_tracks, (ta > 0)::INT AS audio_tracks, 1 AS enabled_video_tracks, moov_at < mdat_at AS moov_before_mdat,
          CASE WHEN pr = '3-MEDIUM' THEN 0 ELSE 1 END + (st = 'F')::INT AS vendor_boxes,
          'camera,VideoHandler' || CASE WHEN ta > 0 THEN ',SoundHandler' ELSE '' END AS encoder_tags, 64 AS width, 48 AS height,
          greatest((n * 1000 - 500) * 1000 // 30000, CASE WHEN ta > 0 THEN n * 1024 * 1000 // 44100 ELSE 0 END) AS duration_ms,
          strftime(to_timestamp(created - 2082844800) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS container_time,
          CASE WHEN st = 'P' AND pr <> '3-MEDIUM' THEN 'Lavf' ELSE '' END AS foreign_muxer_tags FROM f""",
)
def probe_summary(spark, d):
    found = L.probe_summary(B.walk_held(files(spark, d), "path", "header", tracks=L.SUMMED))
    return found.withColumns(
        {name: F.array_join(name, ",") for name in ("encoder_tags", "foreign_muxer_tags")}
    )


@query("h5_foreign_tags", f"WITH {LAYOUT} SELECT file_id, 'Lavf' AS tags FROM f WHERE st = 'P' AND pr <> '3-MEDIUM'")
def foreign_tags(spark, d):
    boxes = probe_boxes(B.walk_held(files(spark, d), "path"))
    found = L.foreign_tags(boxes.where("place = 'user_data'"))
    return found.select("file_id", F.array_join("foreign_muxer_tags", ",").alias("tags"))


@query(
    "h6_vendor_count",
    f"""WITH {LAYOUT} SELECT file_id, CASE WHEN pr = '3-MEDIUM' THEN 0 ELSE 1 END + (st = 'F')::INT AS vendor_boxes FROM f""",
)
def vendor_count(spark, d):
    boxes = probe_boxes(B.walk_held(files(spark, d), "path"))
    counted = ((F.col("place") == "user_data") & ~F.col("standard")) | (F.col("place") == "unknown")
    return boxes.groupBy("file_id").agg(F.count_if(counted).alias("vendor_boxes"))
