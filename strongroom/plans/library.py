"""Library queries: names made from events, populations made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import library as L
from strongroom.operators.running import numbered
from strongroom.plans.registry import query, table


def named_files(spark, d):
    """One file per event, named by one of the shapes a library holds."""
    e = table(spark, d, "events")
    compact, dashed = F.date_format("ts", "yyyyMMdd_HHmmss"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    low = F.col("value") < 5
    trip = F.concat(F.lit("trip"), F.col("user_id").cast("string"))
    name = (
        F.when(F.col("event_type") == "click", F.concat(compact, F.when(low, "E").otherwise("N"), F.lit(".MP4")))
        .when(F.col("event_type") == "view", F.concat(compact, F.when(low, "_FH").otherwise("_R"), F.lit(".mp4")))
        .when(F.col("event_type") == "purchase", F.concat(dashed, F.when(low, "i").otherwise("_Q"), F.lit(".mov")))
        .when(F.col("event_type") == "signup", F.concat(trip, F.when(low, "-Front").otherwise("_back"), F.lit(".MOV")))
        .otherwise(F.concat(F.lit("IMG."), F.col("event_id").cast("string"), F.when(low, ".jpg").otherwise(".3gp")))
    )
    return e.select(
        F.concat(F.lit("card/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.col("event_id").cast("string"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.when((F.col("event_type") != "error") & (F.col("value") > 60), "the file does not start with a box").alias("unreadable"),
    )


NAMES = """
x AS (SELECT *, strftime(ts, '%Y%m%d_%H%M%S') AS c, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS dd, value < 5 AS low FROM events),
f AS (SELECT *, CASE event_type
    WHEN 'click' THEN c || CASE WHEN low THEN 'E' ELSE 'N' END || '.MP4'
    WHEN 'view' THEN c || CASE WHEN low THEN '_FH' ELSE '_R' END || '.mp4'
    WHEN 'purchase' THEN dd || CASE WHEN low THEN 'i' ELSE '_Q' END || '.mov'
    WHEN 'signup' THEN 'trip' || user_id || CASE WHEN low THEN '-Front' ELSE '_back' END || '.MOV'
    ELSE 'IMG.' || event_id || CASE WHEN low THEN '.jpg' ELSE '.3gp' END END AS name,
    CASE WHEN event_type <> 'error' AND value > 60 THEN 'the file does not start with a box' END AS unreadable FROM x),
p AS (SELECT *, 'card/' || strftime(ts, '%Y-%m-%d') || '/' || event_id || '/' || name AS path,
    CASE WHEN event_type = 'click' THEN 'timestamp_event_letter' WHEN event_type = 'view' THEN 'stem_camera_letter'
         WHEN event_type = 'purchase' AND low THEN 'stem_camera_letter' WHEN event_type = 'signup' THEN 'stem_camera_word' END AS grammar,
    CASE WHEN event_type IN ('click', 'view') THEN c WHEN event_type = 'purchase' AND low THEN dd
         WHEN event_type = 'signup' THEN 'trip' || user_id END AS stem,
    CASE WHEN event_type = 'click' THEN 'all' WHEN event_type = 'purchase' AND low THEN 'interior'
         WHEN event_type IN ('view', 'signup') THEN CASE WHEN low THEN 'front' ELSE 'rear' END END AS camera,
    CASE WHEN event_type = 'click' THEN CASE WHEN low THEN 'event' ELSE 'normal' END END AS event,
    CASE WHEN event_type IN ('click', 'view') OR (event_type = 'purchase' AND low) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS time
  FROM f)"""


@query(
    "a2_admission",
    f"""WITH {NAMES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'error' OR NOT low) AS opened,
          count(*) FILTER (event_type = 'error' AND low) AS skipped_by_extension FROM p GROUP BY 1""",
)
def admission(spark, d):
    opened = L.worth_opening(F.col("name"))
    return (
        named_files(spark, d)
        .groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("day"))
        .agg(F.count_if(opened).alias("opened"), F.count_if(~opened).alias("skipped_by_extension"))
    )


@query("h1_name_grammars", f"WITH {NAMES} SELECT path, grammar, stem, camera, event, time FROM p")
def name_grammars(spark, d):
    parsed = named_files(spark, d).withColumn("p", L.parse_name(F.col("name")))
    return parsed.select("path", "p.grammar", "p.stem", "p.camera", "p.event", "p.time")


@query(
    "h2_name_timestamps",
    """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') || lpad((o_custkey % 40)::VARCHAR, 2, '0') || '_'
                   || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || lpad((o_custkey % 61)::VARCHAR, 2, '0') || '09x' AS text,
                 o_custkey % 40 AS dd, o_orderkey % 30 AS hh, o_custkey % 61 AS mi, year(o_orderdate) AS yy FROM orders)
       SELECT o_orderkey, text, CASE WHEN yy >= 2000 AND dd BETWEEN 1 AND 31 AND hh < 24 AND mi < 60
         THEN substr(text, 1, 4) || '-' || substr(text, 5, 2) || '-' || substr(text, 7, 2) || 'T' || substr(text, 10, 2) || ':'
              || substr(text, 12, 2) || ':09' END AS time FROM t""",
)
def name_timestamps(spark, d):
    """Days to 39, hours to 29, minutes to 60: the bounds decide, not a calendar."""
    two = lambda e: F.lpad((e).cast("string"), 2, "0")
    text = F.concat(
        F.date_format("o_orderdate", "yyyyMM"),
        two(F.col("o_custkey") % 40),
        F.lit("_"),
        two(F.col("o_orderkey") % 30),
        two(F.col("o_custkey") % 61),
        F.lit("09x"),
    )
    o = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", "text", L.timestamp(F.col("text")).alias("time"))


@query(
    "h3_split_extension",
    f"""WITH {NAMES} SELECT path, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS extension,
          CASE WHEN event_type <> 'error' THEN regexp_replace(name, '\\.[^.]*$', '') END AS stem FROM p""",
)
def split_extension(spark, d):
    return named_files(spark, d).select(
        "path", L.extension(F.col("name")).alias("extension"), L.split_extension(F.col("name")).alias("stem")
    )


RECORDINGS = f"""{NAMES},
k AS (SELECT *, CASE WHEN unreadable IS NOT NULL THEN 'unreadable' WHEN grammar IS NULL THEN 'unrecognised'
                     WHEN camera = 'all' THEN 'single_file' END AS alone FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY stem, alone IS NULL) AS n FROM k),
g AS (SELECT coalesce(alone, CASE WHEN n > 1 THEN 'paired' ELSE 'unpaired' END) AS kind,
        CASE WHEN alone IS NULL OR alone = 'single_file' THEN stem END AS stem,
        CASE WHEN alone IS NULL OR alone = 'single_file' THEN camera END AS camera,
        CASE WHEN alone IS NULL THEN CASE camera WHEN 'front' THEN 0 WHEN 'rear' THEN 1 ELSE 2 END ELSE 0 END AS rank,
        path, CASE WHEN alone IS NULL THEN n ELSE 1 END AS members FROM r)"""


def probes(spark, d):
    return named_files(spark, d).select("path", L.parse_name(F.col("name")).alias("parsed"), "unreadable")


@query("h7_recordings", f"WITH {RECORDINGS} SELECT * FROM g")
def recordings(spark, d):
    return L.recordings(probes(spark, d))


@query(
    "h8_member_order",
    f"""WITH {RECORDINGS} SELECT stem, camera, path, row_number() OVER (PARTITION BY stem ORDER BY rank, path) - 1 AS position
        FROM g WHERE kind = 'paired'""",
)
def member_order(spark, d):
    paired = L.recordings(probes(spark, d)).where("kind = 'paired'")
    # Paths sort by their day first, so rank and day make a block that follows the order.
    day = F.datediff(F.to_date(F.split_part("path", F.lit("/"), F.lit(2))), F.lit("1970-01-01").cast("date"))
    block = F.col("rank") * 1000000 + day
    return numbered(paired, ["stem"], ["rank", "path"], block, "position").select("stem", "camera", "path", "position")


def part_probes(spark, d):
    """Parts as probed files: the brand is the grammar, the type stands for the time in the name."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    grammar = F.when(F.col("p_brand") == "Brand#7", L.MEASURED_GRAMMAR).when(
        F.col("p_brand") != "Brand#3", F.col("p_brand")
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("path"),
        F.col("p_name").alias("name"),
        grammar.alias("grammar"),
        F.when(size < 12, F.concat("p_type", F.lit("@"), size.cast("string"))).alias("time"),
        F.when(F.length("p_name") > 10, 2).when(size > 40, 0).otherwise(1).cast("bigint").alias("video_tracks"),
        F.greatest(size - 30, F.lit(0)).cast("bigint").alias("vendor_boxes"),
        F.when(size <= 45, size * 10).cast("int").alias("width"),
        F.when(size <= 45, F.floor(price)).cast("int").alias("height"),
        F.when(size != 20, F.col("p_type") != "PROMO").alias("moov_before_mdat"),
        F.when(size == 33, F.array(F.lit("Lavf"), F.lit("Lavc")))
        .when(size == 34, F.array(F.lit("Lavc")))
        .otherwise(F.array().cast("array<string>"))
        .alias("foreign_muxer_tags"),
        F.coalesce(~((size == 50) & (F.col("p_type") == "LARGE")), F.lit(True)).alias("readable"),
    )


PARTS = """
q AS (SELECT p_partkey AS path, p_name AS name, p_size,
    CASE p_brand WHEN 'Brand#7' THEN 'timestamp_event_letter' WHEN 'Brand#3' THEN NULL ELSE p_brand END AS grammar,
    CASE WHEN p_size < 12 THEN p_type || '@' || p_size END AS time,
    CASE WHEN length(p_name) > 10 THEN 2 WHEN p_size > 40 THEN 0 ELSE 1 END AS video_tracks,
    greatest(p_size - 30, 0) AS vendor_boxes,
    CASE WHEN p_size <= 45 THEN p_size * 10 END AS width,
    CASE WHEN p_size <= 45 THEN floor(p_retailprice)::INT END AS height,
    CASE WHEN p_size <> 20 THEN p_type <> 'PROMO' END AS moov_before_mdat,
    CASE WHEN p_size = 33 THEN ['Lavf', 'Lavc'] WHEN p_size = 34 THEN ['Lavc'] ELSE [] END AS tags,
    NOT (p_size = 50 AND p_type = 'LARGE') AS readable FROM part),
m AS (SELECT grammar, time, name, max(video_tracks) AS vt, max(vendor_boxes) AS vb,
             max(CASE WHEN width IS NOT NULL THEN (width, height) END) AS wh
      FROM q WHERE readable AND grammar IS NOT NULL GROUP BY ALL),
sib AS (SELECT q.path, coalesce(bool_or(m.vt >= 2), false) AS sibling_has_two, coalesce(bool_or(m.vb > 0), false) AS sibling_has_vendor,
               max(m.wh) AS largest
        FROM q LEFT JOIN m ON q.grammar IS NOT NULL AND q.name <> m.name AND (q.grammar = m.grammar OR q.time = m.time)
        GROUP BY q.path),
a AS (SELECT q.*, s.sibling_has_two, s.sibling_has_vendor, s.largest[1]::INT AS lw, s.largest[2]::INT AS lh FROM q JOIN sib s ON s.path = q.path),
sg AS (
  SELECT path, name, 0 AS rank, 'moov_after_mdat' AS sign, NULL::VARCHAR AS detail FROM a WHERE readable AND moov_before_mdat = false
  UNION ALL SELECT path, name, 1, 'foreign_muxer_tag', unnest(tags) FROM a WHERE readable
  UNION ALL SELECT path, name, 2, 'single_video_track_where_sibling_has_two', NULL FROM a WHERE readable AND video_tracks = 1 AND sibling_has_two
  UNION ALL SELECT path, name, 3, 'vendor_boxes_absent', NULL FROM a
    WHERE readable AND vendor_boxes = 0 AND (coalesce(grammar = 'timestamp_event_letter', false) OR sibling_has_vendor)
  UNION ALL SELECT path, name, 4, 'resolution_below_siblings', width || 'x' || height || ' below ' || lw || 'x' || lh
    FROM a WHERE readable AND (width < lw OR height < lh))"""


def assessed(spark, d):
    return L.with_siblings(part_probes(spark, d))


@query(
    "h9_sibling_population",
    f"WITH {PARTS} SELECT path, sibling_has_two, sibling_has_vendor, lw AS sibling_width, lh AS sibling_height FROM a",
)
def sibling_population(spark, d):
    return assessed(spark, d).select(
        "path",
        "sibling_has_two",
        "sibling_has_vendor",
        F.col("largest.width").alias("sibling_width"),
        F.col("largest.height").alias("sibling_height"),
    )


def _sign(rank: int):
    def run(spark, d):
        return L.signs(assessed(spark, d)).where(F.col("rank") == rank).select("path", "sign", "detail")

    return run


for _rank, _key in enumerate(
    (
        "h10_movie_after_media",
        "h11_foreign_tag",
        "h12_single_video",
        "h13_vendor_absent",
        "h14_resolution_below",
    )
):
    query(_key, f"WITH {PARTS} SELECT path, sign, detail FROM sg WHERE rank = {_rank}")(_sign(_rank))


@query(
    "h15_origin",
    f"""WITH {PARTS}, li AS (SELECT path, count(*) AS n, string_agg(sign || coalesce(' ' || detail, ''), '; ' ORDER BY rank, detail) AS signs FROM sg GROUP BY path)
        SELECT a.path, coalesce(grammar = 'timestamp_event_letter', false) AS layout_known, coalesce(n, 0) AS sign_count,
          coalesce(signs, '') AS signs, CASE WHEN NOT readable THEN 'unreadable' WHEN n > 0 THEN 'signs_found'
          WHEN coalesce(grammar = 'timestamp_event_letter', false) THEN 'no_sign_found' ELSE 'layout_unknown' END AS reading
        FROM a LEFT JOIN li ON li.path = a.path""",
)
def origin(spark, d):
    a = assessed(spark, d)
    return L.origins(a, L.signs(a)).withColumn("signs", F.concat_ws("; ", "signs"))


@query(
    "h16_scan_verdict",
    f"WITH {PARTS} SELECT count(*) AS files, count(*) FILTER (NOT readable) AS unreadable, count(*) FILTER (NOT readable) > 0 AS negative FROM q",
)
def scan_verdict(spark, d):
    return L.scan_verdict(part_probes(spark, d))
