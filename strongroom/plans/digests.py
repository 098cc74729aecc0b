"""Digest queries over documents, conversations, events and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import boxes as B
from strongroom.operators import digests as E
from strongroom.operators import headers as C
from strongroom.operators import media as M
from strongroom.plans.headers import CONFIGURATION, ENTRY, TRACKS, parts
from strongroom.plans.recordings import LAYOUT, REFUSED, ROWS, SAMPLES, SPLITS_NOT, faulty, files
from strongroom.plans.registry import by_moment, query, table


@query(
    "e1_whole_file",
    "SELECT doc_id AS file_id, sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents",
)
def whole_file(spark, d):
    docs = table(spark, d, "documents")
    return E.file_digests(docs.select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content")))


@query(
    "e2_digest_text",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN sha256(text) END AS shown FROM documents""",
)
def digest_text(spark, d):
    """Digests as given: upper case, one digit too many, one that is none, and plain."""
    digest = E.sha256("text")
    given = (
        F.when(F.col("lang") == "en", F.upper(digest))
        .when(F.col("lang") == "fr", F.concat(digest, F.lit("a")))
        .when(F.col("lang") == "es", F.concat(F.substring(digest, 1, 63), F.lit("g")))
        .otherwise(digest)
    )
    docs = table(spark, d, "documents").select("doc_id", given.alias("given"))
    return docs.select("doc_id", E.checked_digest(F.col("given")).alias("shown"))


def spoken(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), F.encode("text", "UTF-8").alias("bytes")
    )


@query(
    "e3_track_payload",
    """SELECT conv_id AS file_id, sha256(string_agg(text, '' ORDER BY turn)) AS sha256, count(*) AS count,
              sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY 1""",
)
def track_payload(spark, d):
    return E.ordered_digests(spoken(spark, d), ["file_id"], ["idx"], "bytes")


@query(
    "e3_tree_digest",
    """SELECT conv_id AS file_id, sha256(sha256(sha256(string_agg(sha256(text), '' ORDER BY turn)))) AS tree_sha256, 'tree/1' AS tree_version
       FROM conversations GROUP BY 1""",
)
def tree_digest(spark, d):
    return E.tree_digests(spoken(spark, d), ["file_id"], "idx", "bytes")


@query("e4_configuration", f"WITH {TRACKS} SELECT file_id, track_index, sha256(unhex({CONFIGURATION})) AS configuration_sha256 FROM t")
def configuration(spark, d):
    return C.sample_entries(parts(spark, d, *ENTRY)).select(
        "file_id", "track_index", E.sha256("configuration_payload").alias("configuration_sha256")
    )


@query(
    "e5_structural_listing",
    """SELECT user_id AS file_id, sha256(string_agg(event_type || ' ' || props, chr(10) ORDER BY ts, event_id)) AS sha256, count(*) AS lines
       FROM events GROUP BY 1""",
)
def structural_listing(spark, d):
    lines = table(spark, d, "events").select(
        F.col("user_id").alias("file_id"), "ts", "event_id", F.concat_ws(" ", "event_type", "props").alias("line")
    )
    return E.listing_digests(lines, ["file_id"], ["ts", "event_id"], "line").select(
        "file_id", "sha256", F.col("count").alias("lines")
    )


@query(
    "e5_structural_fingerprint",
    f"""WITH {TRACKS}, {ROWS.split(LAYOUT + ', ')[1]}, k AS (SELECT file_id, string_agg(path, ' ' ORDER BY "offset") AS tops FROM b WHERE NOT contains(path, '/') GROUP BY 1),
        l AS (SELECT f.file_id, 0 AS r, 0 AS s, 'brand isom' AS line FROM f UNION ALL SELECT file_id, 1, 0, 'compatible isom avc1' FROM f
          UNION ALL SELECT file_id, 2, 0, 'top-level ' || tops FROM k UNION ALL SELECT file_id, 3, 0, 'top-level-unknown zzzz 10' FROM f WHERE st = 'F'
          UNION ALL SELECT file_id, 4, 0, 'top-level-clipped \\x00\\x00\\x00\\x00 5' FROM f WHERE tail > 0 UNION ALL SELECT file_id, 5, 0, 'movie-timescale 60000' FROM f
          UNION ALL SELECT file_id, 6, 0, 'moov mvhd trak' || CASE WHEN ta > 0 THEN ' trak' ELSE '' END || CASE WHEN ud > 0 THEN ' udta' ELSE '' END FROM f
          UNION ALL SELECT file_id, 7, "offset", 'udta ' || regexp_extract(path, '[^/]*$') || ' ' || size FROM b WHERE starts_with(path, 'moov/udta/')
          UNION ALL SELECT file_id, 8, track_index, CASE kind WHEN 'video' THEN 'track 0 video avc1 [avcC] compressor "camera" handler "VideoHandler" flags 0x3 timescale 30000 trak [tkhd'
              || CASE WHEN ed > 0 THEN ' edts' ELSE '' END || CASE WHEN tr > 0 THEN ' tref' ELSE '' END || ' mdia] stbl [stsd stts stsc ' || CASE pr WHEN '2-HIGH' THEN 'stz2' ELSE 'stsz' END
              || CASE pr WHEN '4-NOT SPECIFIED' THEN ' co64' ELSE ' stco' END || ' stss' || CASE WHEN ct > 0 THEN ' ctts' ELSE '' END || ']'
              ELSE 'track 1 audio mp4a [esds] compressor "" handler "SoundHandler" flags 0x3 timescale 44100 trak [tkhd mdia] stbl [stsd stts stsc stsz stco]' END FROM t)
        SELECT file_id, sha256(string_agg(line, chr(10) ORDER BY r, s)) AS sha256, count(*) AS lines FROM l GROUP BY 1""",
)
def structural_fingerprint(spark, d):
    return E.structural_fingerprints(B.walk_held(files(spark, d), tracks=C.TYPED)).select(
        "file_id", "sha256", F.size("observations").cast("bigint").alias("lines")
    )


def media_places(recordings, *more):
    """The tracks of whole files with what their tables place, and more parts by name, beside the content; narrow."""
    parts = C.track_parts(B.walk_tracks(B.whole_files(recordings), *C.TABLES, "configuration", *more), "length", "segments")
    content = F.get("segments", F.lit(0))["bytes"]
    return M.places(parts.withColumn("content", content).drop("segments"))


UNITS = f"""{LAYOUT}, {SAMPLES},
u AS (SELECT file_id, i AS sample_idx, 0 AS unit, '6742000A' AS h FROM sm WHERE inner_set
  UNION ALL SELECT file_id, i, inner_set::INT, CASE WHEN sync THEN '6588' ELSE '419A' END || tail FROM sm
  UNION ALL SELECT file_id, i, 1 + inner_set::INT, CASE WHEN sync THEN '6500' ELSE '4100' END || tail FROM sm WHERE m = 2)"""


@query(
    "e6_unit_split",
    f"""WITH {UNITS} SELECT file_id, 0 AS track_index, sample_idx, unit, h AS bytes, CASE left(h, 2) WHEN '67' THEN 7 WHEN '65' THEN 5 ELSE 1 END AS type,
          substr(h, 3, 2) IN ('88', '9A') AS opens_picture FROM u""",
)
def unit_split(spark, d):
    held = M.samples(media_places(files(spark, d))).where("width IS NOT NULL").withColumnRenamed("width", "nal_length_size")
    return E.units(held).where("NOT broken").select(
        "file_id", "track_index", "sample_idx", "unit", F.hex("bytes").alias("bytes"), "type", "opens_picture"
    )


@query(
    "e6_malformed_samples",
    "SELECT conv_id AS file_id, turn AS sample_idx FROM conversations WHERE octet_length(encode(text)) <> 300",
)
def malformed_samples(spark, d):
    """Texts behind a prefix that says 300 bytes: all but those of that length are malformed."""
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("file_id"),
        F.lit(0).alias("track_index"),
        F.col("turn").alias("sample_idx"),
        F.concat(F.lit(bytes.fromhex("0000012C")), F.encode("text", "UTF-8")).alias("bytes"),
        F.lit(4).alias("nal_length_size"),
        F.octet_length("text").alias("n"),
    )
    # A longer text leaves bytes behind the first unit that read as a prefix past the end.
    return E.malformed_samples(c).select("file_id", "sample_idx")


EVENT_UNITS = """
q AS (SELECT user_id AS file_id, ts::DATE AS day, ts, event_id, CASE event_type WHEN 'error' THEN 7 WHEN 'signup' THEN 8 WHEN 'purchase' THEN 1 ELSE 5 END AS type, value > 10 AS opens FROM events),
g AS (SELECT *, sum(CASE WHEN type IN (7, 8) OR (type = 5 AND opens) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY ts, event_id) AS segment,
        coalesce(max(CASE WHEN type = 7 THEN 1 ELSE 0 END) OVER w, 0) AS s7, coalesce(max(CASE WHEN type = 8 THEN 1 ELSE 0 END) OVER w, 0) AS s8 FROM q
      WINDOW w AS (PARTITION BY file_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN type = 5 AND s7 = 0 AND s8 = 0 THEN row_number() OVER (PARTITION BY file_id, segment, type = 5 AND s7 = 0 AND s8 = 0 ORDER BY ts, event_id) END AS nth FROM g),
m AS (SELECT *, CASE WHEN nth = 1 THEN 'both' WHEN type = 5 AND s7 = 1 AND s8 = 0 THEN 'pictures' END AS inserted FROM h)"""


def event_units(spark, d):
    """Events as units: a user is a track, a day a sample, the kind of event a unit type."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", 7).when(F.col("event_type") == "signup", 8).when(F.col("event_type") == "purchase", 1).otherwise(5)
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return e.select(
        F.col("user_id").alias("file_id"),
        F.lit(0).alias("track_index"),
        day.alias("sample_idx"),
        F.struct("ts", "event_id").alias("unit"),
        kind.alias("type"),
        (F.col("value") > 10).alias("opens_picture"),
    )


@query("e7_insertion_points", f"WITH {EVENT_UNITS} SELECT event_id, file_id, segment::BIGINT AS segment, inserted FROM m")
def insertion_points(spark, d):
    block = by_moment(spark, d, "unit.ts")
    marked = E.parameter_set_insertions(event_units(spark, d), block, block)
    return marked.select("unit.event_id", "file_id", "segment", "inserted")


PAYLOADS = """
ph AS (SELECT file_id, i, CASE WHEN inner_set THEN lpad('4', w * 2, '0') || '6742000A' ELSE '' END || lpad('8', w * 2, '0') || CASE WHEN sync THEN '6588' ELSE '419A' END || tail
           || CASE WHEN m = 2 THEN lpad('8', w * 2, '0') || CASE WHEN sync THEN '6500' ELSE '4100' END || tail ELSE '' END AS h FROM sm),
pd AS (SELECT file_id, 0 AS track_index, sha256(unhex(string_agg(h, '' ORDER BY i))) AS payload_sha256, (sum(length(h)) // 2)::BIGINT AS bytes, count(*) AS samples FROM ph GROUP BY 1
       UNION ALL SELECT file_id, 1, sha256(unhex(string_agg(printf('%08X', file_id) || printf('%08X', i), '' ORDER BY i))), (8 * count(*))::BIGINT, count(*) FROM sm WHERE st <> 'P' GROUP BY 1)"""


@query(
    "e3_media_payload",
    f"""WITH {LAYOUT}, {SAMPLES}, {PAYLOADS},
        faults AS (SELECT file_id, CASE WHEN pr = '1-URGENT' AND st = 'O' THEN '7FFFFFFF' END AS over, {REFUSED} AS refused FROM f),
        mended AS (SELECT ph.file_id, sha256(unhex(string_agg(CASE WHEN i = 0 AND over IS NOT NULL THEN over || substr(h, 9) ELSE h END, '' ORDER BY i))) AS over_sha256
                   FROM ph JOIN faults ON faults.file_id = ph.file_id GROUP BY 1)
        SELECT pd.file_id, track_index, CASE WHEN track_index = 1 OR refused IS NULL OR refused = 'out of bounds' THEN samples END AS samples,
          CASE WHEN track_index = 1 OR refused IS NULL THEN bytes END AS bytes,
          CASE WHEN track_index = 1 THEN payload_sha256 WHEN refused IS NULL THEN over_sha256 END AS payload_sha256,
          CASE WHEN track_index = 0 THEN refused END AS payload_reason, 'payload/1' AS payload_version
        FROM pd JOIN faults ON faults.file_id = pd.file_id JOIN mended ON mended.file_id = pd.file_id""",
)
def media_payload(spark, d):
    """Payload digests of every track of a corpus with faults, audio too, each NULL with its reason."""
    return M.digests(media_places(faulty(spark, d)), stream=False).select(
        "file_id", "track_index", "samples", "bytes", "payload_sha256", "payload_reason", "payload_version"
    )


@query(
    "e8_elementary_stream",
    f"""WITH {UNITS}, x AS (SELECT u.*, sync, inner_set, m,
            CASE WHEN sync AND NOT inner_set AND unit = 0 THEN '0000000167640028' || '0000000168EE3C' WHEN inner_set AND left(h, 2) = '65' THEN '0000000168EE3C' ELSE '' END AS ins
          FROM u JOIN sm ON sm.file_id = u.file_id AND sm.i = u.sample_idx),
        y AS (SELECT *, ins || CASE WHEN unit = 0 AND ins = '' THEN '00000001' ELSE '000001' END || h AS coded FROM x),
        s AS (SELECT file_id, sha256(unhex(string_agg(coded, '' ORDER BY sample_idx, unit))) AS stream_sha256, (sum(length(coded)) // 2)::BIGINT AS stream_bytes,
          count(DISTINCT sample_idx) AS access_units, count(*) FILTER (sync AND NOT inner_set AND unit = 0) AS insertions FROM y GROUP BY 1),
        r AS (SELECT file_id, coalesce({REFUSED}, {SPLITS_NOT}) AS stream_reason FROM f)
        SELECT s.file_id, 0 AS track_index, CASE WHEN stream_reason IS NULL THEN stream_sha256 END AS stream_sha256, CASE WHEN stream_reason IS NULL THEN stream_bytes END AS stream_bytes,
          CASE WHEN stream_reason IS NULL THEN access_units END AS access_units, CASE WHEN stream_reason IS NULL THEN insertions END AS insertions, stream_reason, 'stream/1' AS stream_version
        FROM s JOIN r ON r.file_id = s.file_id""",
)
def elementary_stream(spark, d):
    """Streams of a corpus with faults: a track with one has no digest and the reason."""
    made = M.digests(media_places(faulty(spark, d)).where("track_index = 0 OR avc IS NOT NULL"), payload=False)
    return made.select(
        "file_id", "track_index", "stream_sha256", "stream_bytes", "access_units", "insertions", "stream_reason", "stream_version"
    )


@query(
    "e9_vendor_digest",
    f"""WITH {ROWS} SELECT file_id, path, "offset", sha256(unhex(CASE WHEN path = 'zzzz' THEN '0000000A7A7A7A7A6350' WHEN path = 'moov/udta/name' THEN '0000000B6E616D6563616D'
          WHEN path = 'moov/udta/zvnd' THEN '0000000C7A766E64' || printf('%08X', file_id) ELSE '00000014A9746F6F4C61766636302E332E313030' END)) AS sha256
        FROM b WHERE path = 'zzzz' OR starts_with(path, 'moov/udta/')""",
)
def vendor_digest(spark, d):
    held = B.held_bytes(B.walk_held(files(spark, d), "path")).where("path LIKE 'moov/udta/%' OR path = 'zzzz'")
    return held.select("file_id", "path", "offset", E.sha256("bytes").alias("sha256"))
