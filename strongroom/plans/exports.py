"""Export-planning queries: a user's events are tracks and samples, an order's lines a selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.operators import export_plan as X
from strongroom.operators import samples as S
from strongroom.operators.digests import sha256
from strongroom.operators.running import numbered
from strongroom.plans.comparison import text_id
from strongroom.plans.registry import by_moment, query, table
from strongroom.plans.samples import BASE, consistent, located, small_orders

# Timescale of each event type when it stands for a track.
SCALES = (("click", 30000), ("error", 1000), ("purchase", 44100), ("signup", 48000), ("view", 90000))
ORIGIN = "2024-01-01"


def tracks(spark, d):
    """Every event is a track of its user; the index follows time."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    placed = numbered(e, ["user_id"], ["ts", "event_id"], by_moment(spark, d), "track_index")
    kind = F.when(F.col("event_type") == "purchase", "audio").when(F.col("value") > 15, "video").otherwise("other")
    return placed.select(
        F.col("user_id").alias("file_id"), "track_index", kind.alias("kind"), "ts", F.col("event_id").alias("source_track_id"), "props"
    )


TRACKS = """
t AS (SELECT user_id AS file_id, event_id AS source_track_id, props, ts,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS track_index,
        CASE WHEN event_type = 'purchase' THEN 'audio' WHEN value > 15 THEN 'video' ELSE 'other' END AS kind FROM events),
v AS (SELECT *, row_number() OVER (PARTITION BY file_id, kind ORDER BY track_index) - 1 AS k,
        count(*) FILTER (kind = 'video') OVER (PARTITION BY file_id) AS videos FROM t)"""


@query(
    "i1_track_selection",
    f"""WITH {TRACKS} SELECT 'front' AS selection, file_id, track_index, kind FROM v WHERE videos >= 1 AND (kind = 'audio' OR (kind = 'video' AND k = 0))
        UNION ALL SELECT 'rear', file_id, track_index, kind FROM v WHERE videos >= 2 AND (kind = 'audio' OR (kind = 'video' AND k = 1))
        UNION ALL SELECT 'both', file_id, track_index, kind FROM v
        UNION ALL SELECT DISTINCT 'refused front', file_id, NULL::BIGINT, '{X.NO_VIDEO}' FROM v WHERE videos < 1
        UNION ALL SELECT DISTINCT 'refused rear', file_id, NULL::BIGINT, '{X.NO_REAR}' FROM v WHERE videos < 2""",
)
def track_selection(spark, d):
    t, block = tracks(spark, d), by_moment(spark, d)
    kept = None
    for selection in ("front", "rear", "both"):
        rows = X.select_camera(t, selection, block).select(
            F.lit(selection).alias("selection"), "file_id", "track_index", "kind"
        )
        kept = rows if kept is None else kept.unionByName(rows)
        refused = X.refused_camera(t, selection).select(
            F.lit(f"refused {selection}").alias("selection"),
            "file_id",
            F.lit(None).cast("bigint").alias("track_index"),
            F.col("reason").alias("kind"),
        )
        kept = kept.unionByName(refused)
    return kept


@query(
    "i1_listed_tracks",
    f"""WITH {TRACKS}, w AS (SELECT DISTINCT o_custkey AS file_id, length(o_orderpriority) + o_orderkey % 150 AS track_index FROM orders)
        SELECT w.file_id, w.track_index, t.kind, CASE WHEN t.file_id IS NULL THEN 'the recording has no track ' || w.track_index END AS reason
        FROM w LEFT JOIN t ON t.file_id = w.file_id AND t.track_index = w.track_index""",
)
def listed_tracks(spark, d):
    wanted = table(spark, d, "orders").select(
        F.col("o_custkey").alias("file_id"),
        (F.length("o_orderpriority") + F.col("o_orderkey") % 150).alias("track_index"),
    )
    t = tracks(spark, d).select("file_id", "track_index", "kind")
    none = F.lit(None).cast("string")
    return (
        X.select_listed(t, wanted)
        .withColumn("reason", none)
        .unionByName(X.missing_listed(t, wanted).withColumn("kind", none))
    )


@query(
    "i2_two_file_join",
    f"""WITH {TRACKS}, p AS (SELECT DISTINCT file_id // 2 AS export_id, file_id // 2 * 2 AS first_id, file_id // 2 * 2 + 1 AS second_id FROM t)
        SELECT export_id, 0 AS input, file_id, track_index, kind FROM p JOIN v ON v.file_id = p.first_id AND (kind = 'audio' OR (kind = 'video' AND k = 0)) AND videos >= 1
        UNION ALL SELECT export_id, 1, file_id, track_index, kind FROM p JOIN v ON v.file_id = p.second_id AND kind = 'video' AND k = 0""",
)
def two_file_join(spark, d):
    half = F.expr("user_id DIV 2")
    pairs = (
        table(spark, d, "events")
        .select(half.alias("export_id"), (half * 2).alias("first_id"), (half * 2 + 1).alias("second_id"))
        .distinct()
    )
    return X.join_two(pairs, tracks(spark, d), by_moment(spark, d)).select("export_id", "input", "file_id", "track_index", "kind")


@query(
    "i3_selection_problems",
    """WITH s AS (SELECT l_orderkey AS export_id, l_linenumber::BIGINT AS i, count(*) AS n FROM lineitem WHERE l_discount > 0.04 GROUP BY 1, 2),
       k AS (SELECT DISTINCT l_orderkey AS export_id, l_linenumber::BIGINT AS i FROM lineitem WHERE l_linestatus = 'F')
       SELECT o_orderkey AS export_id, 'nothing_selected' AS problem, NULL::BIGINT AS track_index FROM orders WHERE o_orderkey NOT IN (SELECT export_id FROM s)
       UNION ALL SELECT export_id, 'no_such_track', i FROM s ANTI JOIN k USING (export_id, i)
       UNION ALL SELECT export_id, 'selected_twice', i FROM s WHERE n > 1""",
)
def selection_problems(spark, d):
    exports = table(spark, d, "orders").select(F.col("o_orderkey").alias("export_id"))
    picked = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("export_id"),
        F.col("l_linenumber").alias("track_index"),
        "l_discount",
        "l_linestatus",
    )
    held = picked.where("l_linestatus = 'F'").select("export_id", "track_index")
    return X.selection_problems(exports, held, picked.where("l_discount > 0.04").select("export_id", "track_index"))


KEPT_ORDER = ["input", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]


def kept_lines(spark, d):
    """Lines as selected tracks: the line status is the input, the part the old identifier."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("export_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("input"),
        F.col("l_partkey").alias("source_track_id"),
        *KEPT_ORDER[1:],
        "l_returnflag",
    )


def kept_block():
    return F.col("input") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / 1024)


KEPT = """
r AS (SELECT l_orderkey AS export_id, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS input, l_partkey AS source_track_id, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS output_index,
        count(DISTINCT l_linestatus) OVER (PARTITION BY l_orderkey) > 1 AS renumbered FROM lineitem),
ids AS (SELECT *, CASE WHEN renumbered THEN output_index + 1 ELSE source_track_id END AS track_id FROM r)"""


@query(
    "i4_renumbering",
    f"WITH {KEPT} SELECT export_id, input, source_track_id, output_index, renumbered, track_id FROM ids",
)
def renumbering(spark, d):
    return X.renumber(kept_lines(spark, d), KEPT_ORDER, kept_block()).select(
        "export_id", "input", "source_track_id", "output_index", "renumbered", "track_id"
    )


def export_samples(spark, d):
    """Events as samples: a user is an export, a type a track, a quarter of a day a chunk number."""
    e = table(spark, d, "events")
    scale = F.create_map(*[F.lit(part) for pair in SCALES for part in pair])[F.col("event_type")].cast("bigint")
    micros = F.expr(f"unix_micros(cast(ts AS timestamp)) - unix_micros(timestamp '{ORIGIN} 00:00:00')")
    slots = F.create_map(*[F.lit(part) for i, (name, _) in enumerate(SCALES) for part in (name, i)])
    rows = e.select(
        F.col("user_id").alias("export_id"),
        slots[F.col("event_type")].alias("slot"),
        "ts",
        "event_id",
        F.expr("hour(ts) DIV 6").cast("bigint").alias("chunk"),
        (F.round(F.col("value") * 100).cast("bigint") + 1).alias("size"),
        scale.alias("timescale"),
        micros.alias("micros"),
    )
    placed = numbered(rows, ["export_id", "slot"], ["ts", "event_id"], by_moment(spark, d), "idx")
    return placed.select(
        "export_id",
        "slot",
        "idx",
        "chunk",
        "size",
        F.expr("micros * timescale DIV 1000000").alias("decode_time"),
        "timescale",
    )


CHUNKS = f"""
sc(kind, slot, timescale) AS (VALUES {", ".join(f"('{n}', {i}, {s}::BIGINT)" for i, (n, s) in enumerate(SCALES))}),
es AS (SELECT user_id AS export_id, slot, hour(ts) // 6 AS chunk, round(value * 100)::BIGINT + 1 AS size, timescale,
         (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) * timescale // 1000000 AS decode_time,
         row_number() OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) - 1 AS idx
       FROM events JOIN sc ON sc.kind = event_type),
fl AS (SELECT *, CASE WHEN lag(chunk) OVER w = chunk THEN 0 ELSE 1 END AS starts FROM es WINDOW w AS (PARTITION BY export_id, slot ORDER BY idx)),
il AS (SELECT *, sum(starts) OVER (PARTITION BY export_id, slot ORDER BY idx) AS run FROM fl),
ch AS (SELECT export_id, slot, min(chunk) AS chunk, min(idx) AS "first", count(*) AS count, sum(size)::BIGINT AS bytes,
         min(decode_time) AS time, min(timescale) AS timescale FROM il GROUP BY export_id, slot, run),
pl AS (SELECT *, row_number() OVER w - 1 AS place, (sum(bytes) OVER w - bytes)::BIGINT AS bytes_before FROM ch
       WINDOW w AS (PARTITION BY export_id ORDER BY time::HUGEINT * (635040000000 // timescale), slot, "first"))"""


def runs(spark, d):
    return X.chunk_runs(export_samples(spark, d))


@query("i5_chunk_runs", f"WITH {CHUNKS} SELECT * FROM ch")
def chunk_runs(spark, d):
    return runs(spark, d)


@query("i6_interleave_order", f'WITH {CHUNKS} SELECT export_id, slot, "first", place FROM pl')
def interleave_order(spark, d):
    return X.interleave(runs(spark, d)).select("export_id", "slot", "first", "place")


BASE_OFFSET = 1024


@query(
    "i7_new_offsets",
    f"""WITH {CHUNKS} SELECT export_id, slot, "first", bytes, {BASE_OFFSET} + bytes_before AS "offset",
          row_number() OVER (PARTITION BY export_id, slot ORDER BY "first") - 1 AS position FROM pl""",
)
def new_offsets(spark, d):
    return X.new_offsets(X.interleave(runs(spark, d)), F.lit(BASE_OFFSET))


@query(
    "i8_layout_widths",
    f"""WITH {CHUNKS}, m AS (SELECT export_id, sum(bytes * 50000)::BIGINT AS media_bytes, count(*) AS chunks FROM ch GROUP BY 1),
        w AS (SELECT *, media_bytes + 8 > 4294967295 AS wide_header FROM m),
        x AS (SELECT *, {BASE_OFFSET} + CASE WHEN wide_header THEN 16 ELSE 8 END + media_bytes AS media_end FROM w)
        SELECT *, media_end > 4294967295 AS wide_offsets FROM x""",
)
def layout_widths(spark, d):
    scaled = runs(spark, d).withColumn("bytes", F.col("bytes") * 50000)
    return X.layout(scaled, F.lit(BASE_OFFSET))


REFS = f"""{KEPT}, m AS (SELECT DISTINCT export_id, input, source_track_id, track_id FROM ids WHERE l_returnflag <> 'R'),
u AS (SELECT export_id, input, source_track_id, min(track_id) AS track_id FROM m GROUP BY ALL),
f AS (SELECT l_orderkey AS export_id, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS input, l_linenumber AS slot, l_shipdate AS ord,
        CASE WHEN l_tax > 0.04 THEN 'cdsc' ELSE 'hint' END AS type, l_partkey AS target, l_suppkey FROM lineitem),
rw AS (SELECT f.*, u.track_id AS new_id FROM f LEFT JOIN u ON u.export_id = f.export_id AND u.input = f.input AND u.source_track_id = f.target)"""


def rewritten(spark, d):
    """Each line refers to its part; returned parts are not kept."""
    ids = (
        X.renumber(kept_lines(spark, d), KEPT_ORDER, kept_block())
        .where("l_returnflag <> 'R'")
        .groupBy("export_id", "input", "source_track_id")
        .agg(F.min("track_id").alias("track_id"))
    )
    references = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("export_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("input"),
        F.col("l_linenumber").alias("slot"),
        F.when(F.col("l_tax") > 0.04, "cdsc").otherwise("hint").alias("type"),
        F.col("l_partkey").alias("target"),
        F.col("l_suppkey").alias("ord"),
    )
    return X.rewrite_references(references, ids)


@query(
    "i9_references_rewritten",
    f"WITH {REFS} SELECT export_id, slot, type, l_suppkey AS ord, target, new_id FROM rw WHERE new_id IS NOT NULL",
)
def references_rewritten(spark, d):
    return X.kept_references(rewritten(spark, d)).select("export_id", "slot", "type", "ord", "target", "new_id")


@query(
    "i9_references_dropped",
    f"""WITH {REFS} SELECT export_id, slot, type, count(new_id) AS kept, count(*) FILTER (new_id IS NULL) AS dropped
        FROM rw GROUP BY ALL""",
)
def references_dropped(spark, d):
    return X.dropped_references(rewritten(spark, d))


@query(
    "i10_preserved_boxes",
    """WITH b AS (SELECT s_nationkey AS file_id, s_name AS kind, s_suppkey AS "offset", 0 AS rank, 'user_data' AS placement FROM supplier
         UNION ALL SELECT c_nationkey, c_mktsegment, c_custkey, 1, 'top_level' FROM customer)
       SELECT file_id, kind, "offset", placement, row_number() OVER (PARTITION BY file_id ORDER BY rank, "offset") - 1 AS position FROM b""",
)
def preserved_boxes(spark, d):
    suppliers = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("file_id"), F.col("s_name").alias("kind"), F.col("s_suppkey").alias("offset")
    )
    customers = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("file_id"), F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("offset")
    )
    return X.preserved_boxes(suppliers, customers)


SCALE = 400000


@query(
    "i11_read_plan",
    f"""WITH {BASE},
        g AS (SELECT file_id, chunk, idx, "offset" * {SCALE} + CASE WHEN size >= 49 THEN 1 ELSE 0 END AS "offset", size * {SCALE} AS size FROM s),
        n AS (SELECT *, lead("offset") OVER (PARTITION BY file_id, chunk ORDER BY idx) AS following FROM g),
        c AS (SELECT file_id, chunk, bool_and(following IS NULL OR "offset" + size = following) AND sum(size) <= {X.COPY_BUFFER} AS whole,
                sum(size)::BIGINT AS bytes, min(idx) AS i, arg_min("offset", idx) AS start FROM n GROUP BY ALL)
        SELECT file_id, chunk, i AS "first", start AS "offset", bytes AS length FROM c WHERE whole
        UNION ALL SELECT g.file_id, g.chunk, g.idx, g."offset", g.size FROM g JOIN c ON c.file_id = g.file_id AND c.chunk = g.chunk AND NOT whole""",
)
def read_plan(spark, d):
    """Sizes scaled up to the buffer's order; a gap opens behind the largest lines."""
    _, stsc, stsz, stco, _, _ = consistent(spark, d)
    samples = located(spark, d)(stsc, stco, stsz).withColumns(
        {
            "offset": F.col("offset") * SCALE + F.when(F.col("size") >= 49, 1).otherwise(0),
            "size": F.col("size") * SCALE,
        }
    )
    return X.read_plan(samples, whole=small_orders(spark, d)).drop("track_index")


@query(
    "i12_track_report",
    f"""WITH {CHUNKS}, k AS (SELECT DISTINCT user_id AS export_id, slot FROM events JOIN sc ON kind = event_type)
        SELECT export_id, slot, count(*) AS samples, sum(size)::BIGINT AS bytes FROM es GROUP BY ALL""",
)
def track_report(spark, d):
    samples = export_samples(spark, d)
    kept = samples.select("export_id", "slot").distinct()
    return X.track_report(kept, samples)


@query(
    "i13_export_class",
    f"""WITH {TRACKS} SELECT file_id AS export_id, count(*) FILTER (kind = 'video') AS videos,
          CASE WHEN count(*) FILTER (kind = 'video') > 1 THEN 'two_track_archive' ELSE 'extraction' END AS class FROM t GROUP BY 1""",
)
def export_class(spark, d):
    return X.export_class(tracks(spark, d).withColumnRenamed("file_id", "export_id"))


@query(
    "i14_source_records",
    f"""WITH {TRACKS}, k AS (SELECT file_id AS export_id, file_id, track_index,
          row_number() OVER (PARTITION BY file_id ORDER BY track_index) - 1 AS output_index FROM v
          WHERE videos >= 1 AND (kind = 'audio' OR (kind = 'video' AND k = 0)))
        SELECT export_id, k.file_id, k.track_index, output_index, sha256(props) AS payload_sha256 FROM k
        JOIN t ON t.file_id = k.file_id AND t.track_index = k.track_index""",
)
def source_records(spark, d):
    t = tracks(spark, d)
    kept = X.select_camera(t, "front", by_moment(spark, d)).withColumn("export_id", F.col("file_id"))
    placed = numbered(kept, ["export_id"], ["track_index"], by_moment(spark, d), "output_index")
    prints = t.select("file_id", "track_index", sha256("props").alias("payload_sha256"))
    return X.source_records(placed.select("export_id", "file_id", "track_index", "output_index"), prints)


@query(
    "i15_lineage",
    """WITH c AS (SELECT conv_id AS export_id, turn, text <> replace(text, chr(10), ' ') OR length(text) >= 1800 AS differs FROM conversations)
       SELECT export_id, min(turn) FILTER (differs) AS first_mismatch, count(*) FILTER (differs) AS mismatches FROM c GROUP BY 1""",
)
def lineage(spark, d):
    """Turns as tracks; the output lost its line breaks, and the longest turns have no source record."""
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("export_id"), F.col("turn").alias("output_index"), "role", "text"
    )
    keep = ["export_id", "output_index", sha256("role").alias("configuration_sha256")]
    written = c.select(*keep, sha256(F.replace("text", F.lit("\n"), F.lit(" "))).alias("payload_sha256"))
    sources = c.where(F.length("text") < 1800).select(*keep, sha256("text").alias("payload_sha256"))
    return X.lineage(written, sources)


@query(
    "i16_output_is_input",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, url FROM pages),
       i AS (SELECT DISTINCT host, lower(regexp_replace(path, '/$', '')) AS canonical FROM u),
       o AS (SELECT page_id, host, path, lower(regexp_replace(regexp_replace(path, '/$', ''), '\\.html$', '')) AS canonical FROM u)
       SELECT host AS export_id, page_id, upper(regexp_replace(path, '\\.html$', '')) || '/.//' AS path FROM o SEMI JOIN i USING (host, canonical)""",
)
def output_is_input(spark, d):
    """Pages of a host are its inputs; the output is spelled in capitals, with empty steps, without a suffix."""
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    u = table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("export_id"), path.alias("path")
    )
    outputs = u.withColumn("path", F.concat(F.upper(F.regexp_replace("path", r"\.html$", "")), F.lit("/.//")))
    return X.output_is_input(outputs, u).select("export_id", "page_id", "path")
