"""Box inventory queries over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strongroom.functions.bytes import shown, slice_
from strongroom.operators import boxes as B
from strongroom.plans.recordings import FAULTS, LAYOUT, ROWS, damaged, files
from strongroom.plans.registry import query, table


def rows(spark, d, *names):
    """The boxes of the corpus with the named columns, which are all that the walk makes."""
    return B.boxes(B.list_boxes(files(spark, d), *names))


def top(spark, d):
    """The top level alone, which is walked without what lies below."""
    return B.boxes(B.walk_top(files(spark, d)))


@query(
    "b1_header_decode",
    f"WITH {ROWS} SELECT file_id, regexp_extract(path, '[^/]*$') AS kind, \"offset\", size, header FROM b WHERE header > 0",
)
def header_decode(spark, d):
    found = rows(spark, d, "kind", "size", "header").where("header > 0")
    return found.select("file_id", shown(F.col("kind")).alias("kind"), "offset", "size", "header")


@query(
    "b2_top_level_walk",
    f"""WITH {ROWS} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY "offset") - 1 AS ord, path, "offset", size FROM b WHERE NOT contains(path, '/')""",
)
def top_level_walk(spark, d):
    return top(spark, d).select("file_id", "ord", "path", "offset", "size")


@query(
    "b3_nested_enumeration",
    f"""WITH {ROWS} SELECT file_id, path, "offset", size, length(path) - length(replace(path, '/', '')) AS depth FROM b""",
)
def nested_enumeration(spark, d):
    return rows(spark, d, "path", "size", "depth").select("file_id", "path", "offset", "size", "depth")


@query("b4_fixed_fields", f"WITH {ROWS} SELECT file_id, path, \"offset\", fields FROM b WHERE fields > 0")
def fixed_fields(spark, d):
    return rows(spark, d, "path", "fields").where("fields > 0").select("file_id", "path", "offset", "fields")


@query("b6_clipped_tails", f"WITH {LAYOUT} SELECT file_id, length - tail AS \"offset\", tail AS size FROM f WHERE tail > 0")
def clipped_tails(spark, d):
    return B.clipped_tail(top(spark, d)).select("file_id", "offset", "size")


@query(
    "b9_paths_in_file_order",
    f"""WITH {ROWS} SELECT file_id, path, "offset", row_number() OVER (PARTITION BY file_id ORDER BY "offset") - 1 AS place FROM b""",
)
def paths_in_file_order(spark, d):
    return B.boxes_in_file_order(B.whole_files(files(spark, d))).select("file_id", "path", "offset", "place")


@query(
    "b10_descend",
    f"""WITH {ROWS} SELECT file_id, min("offset") AS "offset" FROM b WHERE path = 'moov/trak/mdia/minf/stbl/stsd' GROUP BY 1""",
)
def descend(spark, d):
    path = ["moov", "trak", "mdia", "minf", "stbl", "stsd"]
    return B.descend(B.list_boxes(files(spark, d), path="/".join(path)), path[0], path[1:]).select("file_id", "offset")


@query(
    "b11_tiling",
    f"""WITH {ROWS}, p AS (SELECT file_id, "offset" AS parent FROM b WHERE path IN ('moov', 'moov/trak', 'moov/trak/mdia', 'moov/trak/mdia/minf',
          'moov/trak/mdia/minf/stbl', 'moov/trak/mdia/minf/stbl/stsd', 'moov/trak/mdia/minf/stbl/stsd/avc1', 'moov/trak/mdia/minf/stbl/stsd/mp4a',
          'moov/trak/edts', 'moov/trak/tref', 'moov/udta') UNION ALL SELECT file_id, -1 FROM f)
        SELECT file_id, parent, 0 AS breaks, true AS tiles FROM p""",
)
def tiling(spark, d):
    return B.tilings(files(spark, d))


RANGES = """
r AS (SELECT l_orderkey AS file_id, 0 AS parent, ((l_linenumber - 1) * 20 + l_partkey % 7)::BIGINT AS "offset", (l_quantity % 25)::BIGINT AS size FROM lineitem),
p AS (SELECT o_orderkey AS file_id, 0 AS parent, 3 AS start, 60 + o_orderkey % 90 AS "end" FROM orders),
w AS (SELECT r.file_id, r.parent, "offset", "offset" + size AS until, greatest(start, coalesce(max("offset" + size) OVER (PARTITION BY r.file_id ORDER BY "offset", size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS reach FROM r JOIN p ON p.file_id = r.file_id),
l AS (SELECT p.file_id, p.parent, "end", greatest(start, coalesce(max(r."offset" + size), start)) AS last FROM p LEFT JOIN r ON r.file_id = p.file_id GROUP BY p.file_id, p.parent, start, "end")"""


@query(
    "b11_coverage",
    f"""WITH {RANGES}
        SELECT file_id, parent, 'gap' AS kind, reach AS "offset", "offset" - reach AS size FROM w WHERE "offset" > reach
        UNION ALL SELECT file_id, parent, 'overlap', "offset", least(reach, until) - "offset" FROM w WHERE "offset" < reach AND least(reach, until) > "offset"
        UNION ALL SELECT file_id, parent, 'short', last, "end" - last FROM l WHERE last < "end"
        UNION ALL SELECT file_id, parent, 'past', "end", last - "end" FROM l WHERE last > "end" """,
)
def coverage(spark, d):
    """Lines as ranges of an order that leave gaps, lie on each other and end short of it or past it."""
    parent = F.lit(0).alias("parent")
    offset = ((F.col("l_linenumber") - 1) * 20 + F.col("l_partkey") % 7).cast("bigint")
    ranges = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), parent, offset.alias("offset"), (F.col("l_quantity") % 25).cast("bigint").alias("size")
    )
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("file_id"), parent, F.lit(3).alias("start"), (60 + F.col("o_orderkey") % 90).alias("end")
    )
    return B.coverage(ranges, orders, F.floor(F.col("offset") / 64))


@query("b12_movie_before_media", f"WITH {LAYOUT} SELECT file_id, moov_at < mdat_at AS moov_before_mdat FROM f")
def movie_before_media(spark, d):
    return B.movie_before_media(top(spark, d))


@query("b13_unknown_top_level", f"WITH {ROWS} SELECT file_id, \"offset\", size FROM b WHERE path = 'zzzz'")
def unknown_top_level(spark, d):
    return B.unknown_top_level(top(spark, d)).select("file_id", "offset", "size")


@query("b14_user_data_children", f"WITH {ROWS} SELECT file_id, path, \"offset\", size FROM b WHERE starts_with(path, 'moov/udta/')")
def user_data_children(spark, d):
    return B.children_at(B.list_boxes(files(spark, d)), "moov/udta").select("file_id", "path", "offset", "size")


@query(
    "b15_standard_kinds",
    f"WITH {ROWS} SELECT file_id, \"offset\", path = 'moov/udta/name' AS standard FROM b WHERE starts_with(path, 'moov/udta/')",
)
def standard_kinds(spark, d):
    found = rows(spark, d, "kind", "path").where("path LIKE 'moov/udta/%'")
    return found.select("file_id", "offset", B.is_standard(F.col("kind")).alias("standard"))


@query(
    "b16_kind_display",
    f"WITH {ROWS} SELECT regexp_extract(path, '[^/]*$') AS kind, count(*) AS boxes FROM b GROUP BY 1",
)
def kind_display(spark, d):
    return rows(spark, d, "kind").groupBy(shown(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("boxes"))


@query(
    "b17_held_bytes",
    f"""WITH {ROWS} SELECT file_id, path, "offset", CASE WHEN path = 'mdat' OR header = 0 THEN NULL ELSE size END AS held FROM b""",
)
def held_bytes(spark, d):
    return B.held_bytes(B.walk_held(files(spark, d), "path")).select("file_id", "path", "offset", F.length("bytes").cast("bigint").alias("held"))


@query(
    "b17_ranges_of_holds",
    """WITH t AS (SELECT doc_id AS file_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
        r AS (SELECT *, (k * 97) % (n + 20) AS "offset", 1 + (k * 41) % 60 AS size FROM (SELECT *, unnest(range(6)) AS k FROM t))
        SELECT file_id, "offset", size, CASE WHEN "offset" + size <= n // 2 THEN substr(h, 2 * "offset" + 1, 2 * size)
          WHEN "offset" >= n // 2 + 16 AND "offset" + size <= n + 16 THEN substr(h, 2 * ("offset" - 16) + 1, 2 * size) END AS bytes
        FROM r""",
)
def ranges_of_holds(spark, d):
    """Six ranges of each text, of which both halves are held with a hole of 16 bytes between: some lie across a border."""
    held = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("all"))
    n = F.length("all").cast("bigint")
    half = F.floor(n / 2)
    parts = F.array(
        F.struct(F.lit(0).cast("bigint").alias("hold_offset"), slice_(F.col("all"), 0, half).alias("bytes")),
        F.struct((half + 16).alias("hold_offset"), slice_(F.col("all"), half, n - half).alias("bytes")),
    )
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("k")
    asked = held.select("file_id", n.alias("n"), k).select(
        "file_id", ((F.col("k") * 97) % (F.col("n") + 20)).alias("offset"), (1 + (F.col("k") * 41) % 60).alias("size")
    )
    found = B.bytes_of(asked, held.select("file_id", F.inline(parts)))
    return found.select("file_id", "offset", "size", F.hex("bytes").alias("bytes"))


def broken(spark, d):
    return B.walk_boxes(B.whole_files(damaged(spark, d)))


@query(
    "b5_opening_check",
    f"WITH {LAYOUT}, {FAULTS} SELECT file_id, coalesce(e.code <> 'not_a_container', true) AS opens FROM e",
)
def opening_check(spark, d):
    return damaged(spark, d).select("file_id", B.opens_a_file(slice_(F.col("content"), 0, 16)).alias("opens"))


@query(
    "b7_caps",
    f"WITH {LAYOUT}, {FAULTS} SELECT file_id, e.code AS code, e.at::BIGINT AS \"offset\" FROM e WHERE e.code = 'too_deep'",
)
def caps(spark, d):
    found = B.errors(broken(spark, d)).where(F.col("code").isin("too_deep", "too_many", "oversized"))
    return found.select("file_id", "code", "offset")


@query(
    "b8_one_movie_box",
    f"WITH {LAYOUT}, {FAULTS} SELECT file_id, e.code AS code, e.at::BIGINT AS \"offset\" FROM e WHERE e.code IN ('no_movie_box', 'two_movie_boxes')",
)
def one_movie_box(spark, d):
    found = B.errors(broken(spark, d)).where(F.col("code").isin("no_movie_box", "two_movie_boxes"))
    return found.select("file_id", "code", "offset")


@query(
    "b18_errors",
    f"WITH {LAYOUT}, {FAULTS} SELECT file_id, e.code AS code, e.kind AS kind, e.at::BIGINT AS \"offset\" FROM e WHERE e.code IS NOT NULL",
)
def errors(spark, d):
    return B.errors(broken(spark, d))
