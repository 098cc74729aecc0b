"""Typed header and run-table queries: the corpus decoded, against the columns it was encoded from."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from strongroom.operators import boxes as B
from strongroom.operators import headers as C
from strongroom.operators import media
from strongroom.plans.recordings import LAYOUT, REFUSED, SAMPLES, faulty, files
from strongroom.plans.registry import query, table


@lru_cache(maxsize=32)
def parts(spark, d, *names):
    """The tracks of the corpus with the named columns, which are all that the walk cuts and sends."""
    return C.track_parts(B.walk_tracks(files(spark, d), *names))


ENTRY = ("stsd", "entry_kind", "entry_header", "entry", "configuration")


TRACKS = f"""{LAYOUT}, t AS (
  SELECT *, 0 AS track_index, 1 AS track_id, 'video' AS kind, 30000 AS timescale, n * 1000 - 500 AS ticks FROM f
  UNION ALL SELECT *, 1, 2, 'audio', 44100, n * 1024 FROM f WHERE ta > 0)"""


@query(
    "c1_file_type",
    "SELECT o_orderkey AS file_id, 'isom' AS major_brand, 512 AS minor_version, 'isom avc1' AS compatible_brands FROM orders",
)
def file_type(spark, d):
    return C.file_types(B.walk_types(files(spark, d))).withColumn("compatible_brands", F.array_join("compatible_brands", " "))


@query(
    "c2_movie_header",
    f"WITH {LAYOUT} SELECT file_id, 0 AS version, created AS creation_time, 60000 AS timescale, n * 2000 AS duration, 3 AS next_track_id FROM f",
)
def movie_header(spark, d):
    found = C.movie_headers(B.walk_held(files(spark, d), "path", "header")).where("error IS NULL")
    return found.select("file_id", "version", "creation_time", "timescale", "duration", "next_track_id")


@query(
    "c3_track_header",
    f"""WITH {TRACKS} SELECT file_id, track_index, 3 AS flags, true AS enabled, track_id, n * 2000 AS duration, -1 AS layer, 0 AS alternate_group,
          256 AS volume, CASE kind WHEN 'video' THEN 64 * 65536 ELSE 0 END AS width_fixed, CASE kind WHEN 'video' THEN 48 * 65536 ELSE 0 END AS height_fixed FROM t""",
)
def track_header(spark, d):
    return C.track_headers(parts(spark, d, "tkhd")).drop("creation_time", "modification_time", "error")


@query("c4_media_header", f"WITH {TRACKS} SELECT file_id, track_index, timescale, ticks AS duration_ticks, 'und' AS language FROM t")
def media_header(spark, d):
    return C.media_headers(parts(spark, d, "mdhd")).drop("error")


@query(
    "c5_handler",
    f"""WITH {TRACKS} SELECT file_id, track_index, CASE kind WHEN 'video' THEN 'vide' ELSE 'soun' END AS handler_type,
          CASE kind WHEN 'video' THEN 'VideoHandler' ELSE 'SoundHandler' END AS handler_name FROM t""",
)
def handler(spark, d):
    return C.handlers(parts(spark, d, "hdlr")).select("file_id", "track_index", "handler_type", "handler_name")


@query(
    "c6_sample_entry",
    f"""WITH {TRACKS}, x AS (SELECT *, kind = 'video' AS v FROM t) SELECT file_id, track_index, CASE WHEN v THEN 'avc1' ELSE 'mp4a' END AS coding,
          1 AS declared_entries, 1 AS data_reference_index, CASE WHEN v THEN 64 END AS width, CASE WHEN v THEN 48 END AS height,
          CASE WHEN v THEN 1 END AS frame_count, CASE WHEN v THEN 'camera' END AS compressor, CASE WHEN v THEN 24 END AS depth,
          CASE WHEN NOT v THEN 0 END AS entry_version, CASE WHEN NOT v THEN 2 END AS channels, CASE WHEN NOT v THEN 16 END AS sample_size,
          CASE WHEN NOT v THEN 44100 END AS sample_rate FROM x""",
)
def sample_entry(spark, d):
    return C.sample_entries(parts(spark, d, *ENTRY)).drop("configuration_kind", "configuration_payload", "codec_string", "nal_length_size")


AVC = "'01640028' || CASE w WHEN 4 THEN 'FF' ELSE 'FD' END || 'E100046764002801000368EE3C'"
CONFIGURATION = f"CASE kind WHEN 'video' THEN {AVC} ELSE '000000000380' END"


@query(
    "c7_decoder_configuration",
    f"WITH {TRACKS} SELECT file_id, track_index, CASE kind WHEN 'video' THEN 'avcC' ELSE 'esds' END AS configuration_kind, {CONFIGURATION} AS payload FROM t",
)
def decoder_configuration(spark, d):
    return C.sample_entries(parts(spark, d, *ENTRY)).select(
        "file_id", "track_index", "configuration_kind", F.hex("configuration_payload").alias("payload")
    )


@query(
    "c8_avc_configuration",
    f"WITH {TRACKS} SELECT file_id, track_index, '67640028' AS sps, '68EE3C' AS pps, w AS nal_length_size FROM t WHERE kind = 'video'",
)
def avc_configuration(spark, d):
    joined = lambda c: F.array_join(F.transform(c, F.hex), " ")
    return C.parameter_sets(parts(spark, d, "configuration")).select(
        "file_id", "track_index", joined("sps").alias("sps"), joined("pps").alias("pps"), "nal_length_size"
    )


@query(
    "c9_codec_string",
    f"WITH {TRACKS} SELECT file_id, track_index, CASE kind WHEN 'video' THEN 'avc1.640028' END AS codec_string FROM t",
)
def codec_string(spark, d):
    return C.sample_entries(parts(spark, d, *ENTRY)).select("file_id", "track_index", "codec_string")


@query(
    "c10_edit_list",
    f"WITH {LAYOUT} SELECT file_id, 0 AS track_index, 0 AS ord, n * 2000 AS segment_duration, -1 AS media_time, 65536 AS media_rate FROM f WHERE ed > 0",
)
def edit_list(spark, d):
    return C.edit_lists(parts(spark, d, "elst"))


@query("c11_track_kind", f"WITH {TRACKS} SELECT file_id, track_index, kind FROM t")
def track_kind(spark, d):
    return C.handlers(parts(spark, d, "hdlr")).select("file_id", "track_index", "kind")


@query(
    "c12_duration",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_suppkey <> 0 THEN (l_extendedprice::DECIMAL(20,0)::HUGEINT * 1000 // l_suppkey)::BIGINT END AS duration_ms FROM lineitem",
)
def duration(spark, d):
    """A price as ticks of a timescale that is sometimes zero."""
    ticks = F.round(F.col("l_extendedprice")).cast("decimal(20,0)")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", C.duration_ms(ticks, F.col("l_suppkey")).alias("duration_ms")
    )


@query(
    "c13_track_assembly",
    f"""WITH {TRACKS} SELECT file_id, track_index, track_id, kind, CASE kind WHEN 'video' THEN 'avc1' ELSE 'mp4a' END AS coding, timescale, ticks AS duration_ticks,
          ticks * 1000 // timescale AS duration_ms, w AS length_or_channels, CASE WHEN kind = 'video' THEN 'tkhd' || CASE WHEN ed > 0 THEN ' edts' ELSE '' END
          || CASE WHEN tr > 0 THEN ' tref' ELSE '' END || ' mdia' ELSE 'tkhd mdia' END AS track_children FROM (SELECT * REPLACE (CASE kind WHEN 'video' THEN w ELSE 2 END AS w) FROM t)""",
)
def track_assembly(spark, d):
    return C.tracks(parts(spark, d, "tkhd", "mdhd", "hdlr", *ENTRY, "track_children", "table_children", "entry_children")).select(
        "file_id",
        "track_index",
        "track_id",
        "kind",
        "coding",
        "timescale",
        "duration_ticks",
        "duration_ms",
        F.coalesce("nal_length_size", "channels").alias("length_or_channels"),
        "track_children",
    )


@query(
    "d1_time_runs",
    f"""WITH {LAYOUT} SELECT file_id, 0 AS track_index, 0 AS run, 1 AS n, 500 AS delta FROM f UNION ALL SELECT file_id, 0, 1, n - 1, 1000 FROM f
        UNION ALL SELECT file_id, 1, 0, n, 1024 FROM f WHERE ta > 0""",
)
def time_runs(spark, d):
    return C.stts(parts(spark, d, "stts"))


@query(
    "d2_chunk_runs",
    f"""WITH {LAYOUT} SELECT file_id, 0 AS track_index, 0 AS run, 1 AS first_chunk, 3 AS per_chunk, 1 AS description FROM f
        UNION ALL SELECT file_id, 0, 1, mv, n - 3 * (mv - 1), 1 FROM f UNION ALL SELECT file_id, 1, 0, 1, n, 1 FROM f WHERE ta > 0""",
)
def chunk_runs(spark, d):
    return C.stsc(parts(spark, d, "stsc"))


@query(
    "d3_sizes",
    f"""WITH {LAYOUT}, {SAMPLES} SELECT file_id, 0 AS track_index, i AS idx, size FROM sm WHERE pr <> '2-HIGH'
        UNION ALL SELECT file_id, 1, i, 8 FROM sm WHERE st <> 'P'""",
)
def sizes(spark, d):
    return C.stsz(parts(spark, d, "stsz", "stz2").where("stsz IS NOT NULL"))


@query("d4_compact_sizes", f"WITH {LAYOUT}, {SAMPLES} SELECT file_id, 0 AS track_index, i AS idx, size FROM sm WHERE pr = '2-HIGH'")
def compact_sizes(spark, d):
    return C.stsz(parts(spark, d, "stsz", "stz2").where("stz2 IS NOT NULL"))


@query(
    "d5_chunk_offsets",
    f"""WITH {LAYOUT}, {SAMPLES}, s AS (SELECT file_id, i // 3 + 1 AS chunk, media, sum(size) AS bytes FROM sm GROUP BY ALL)
        SELECT file_id, 0 AS track_index, chunk, (media + sum(bytes) OVER (PARTITION BY file_id ORDER BY chunk) - bytes)::BIGINT AS "offset" FROM s
        UNION ALL SELECT file_id, 1, 1, mdat_at + 8 + vb FROM f WHERE ta > 0""",
)
def chunk_offsets(spark, d):
    return C.stco(parts(spark, d, "stco", "co64"))


@query(
    "d7_composition_runs",
    f"""WITH {LAYOUT} SELECT file_id, 0 AS track_index, 0 AS run, 1 AS n, 0 AS "offset" FROM f WHERE ct > 0
        UNION ALL SELECT file_id, 0, 1, n - 1, -5 FROM f WHERE ct > 0""",
)
def composition_runs(spark, d):
    return C.ctts(parts(spark, d, "ctts"))


@query(
    "c13_table_problems",
    f"""WITH {LAYOUT} SELECT file_id, 0 AS track_index, 'stts is truncated' AS problem FROM f WHERE pr = '1-URGENT' AND st = 'F'""",
)
def table_problems(spark, d):
    """Run tables that are shorter than they say, over a corpus with faults."""
    return C.table_problems(C.track_parts(B.walk_tracks(B.whole_files(faulty(spark, d)), *C.TABLES)))


@query(
    "d8_refused_tracks",
    f"""WITH {LAYOUT}, r AS (SELECT file_id, 0 AS track_index, {REFUSED} AS reason FROM f)
        SELECT * FROM r WHERE reason IS NOT NULL AND reason <> 'out of bounds'""",
)
def refused_tracks(spark, d):
    """Tracks that have no samples, digests or totals, as their tables are short or contradict each other."""
    return media.refusals(C.track_parts(B.walk_tracks(B.whole_files(faulty(spark, d)), *C.TABLES)))


@query(
    "d14_gated_totals",
    f"""WITH {TRACKS}, r AS (SELECT *, CASE WHEN track_index = 0 THEN {REFUSED} END AS reason FROM t)
        SELECT file_id, track_index, n AS sample_count, CASE kind WHEN 'video' THEN vb ELSE ab END AS sample_bytes, CASE kind WHEN 'video' THEN mv ELSE n END AS sync_sample_count
        FROM r WHERE reason IS NULL OR reason = 'out of bounds'""",
)
def gated_totals(spark, d):
    """Totals of the tracks that say nothing wrong, from their tables alone."""
    return C.totals(C.track_parts(B.walk_tracks(B.whole_files(faulty(spark, d)), *C.TABLES))).drop("composition_offsets")
