"""The corpus the byte queries share: one recording per order, its shape told by the order's columns.

``LAYOUT`` is the same corpus in SQL, worked out from the columns before anything is encoded.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.functions.bytes import big_endian, code, slice_, u32
from strongroom.operators import boxes as B
from strongroom.sources import corpus
from strongroom.plans.registry import table
from strongroom.sources.stored import stored

# Files that one task writes and reads again, at most or about.
FILES_A_TASK = 1 << 16


def specifications(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + corpus.EPOCH_1904
    specs = corpus.specifications(
        o,
        F.col("o_orderkey"),
        F.col("o_orderkey"),
        status,
        priority,
        samples=F.length(priority) + 2,
        width=F.when(priority == "2-HIGH", 2).otherwise(4),
        created=created,
        slices=F.when(priority == "1-URGENT", 2).otherwise(1),
        inner_set=status == "F",
        audio=status != "P",
        moov_first=status != "P",
        wide_offsets=priority == "4-NOT SPECIFIED",
        compact_bits=F.when(priority != "2-HIGH", 0).when(status == "O", 4).when(status == "P", 8).otherwise(16),
        edit_list=priority == "1-URGENT",
        composition=priority == "3-MEDIUM",
        references=status == "O",
        user_data=F.when(priority == "3-MEDIUM", "none")
        .when(status == "F", "vendor")
        .when(status == "O", "both")
        .otherwise("foreign"),
        top_vendor=status == "F",
        tail=F.when((status == "O") & (priority == "5-LOW"), 5).otherwise(0),
    )
    # A row of a few numbers becomes a file: the rows are spread before they grow, into tasks of a bounded number of files
    # however many cores there are, or are known of yet.
    tasks = max(spark.sparkContext.defaultParallelism, -(-o.count() // FILES_A_TASK))
    return specs.repartition(tasks, "file_id")


@lru_cache(maxsize=8)
def files(spark, d: str) -> DataFrame:
    return corpus.build(specifications(spark, d))


@lru_cache(maxsize=8)
def walked(spark, d: str) -> DataFrame:
    return B.walk(B.whole_files(files(spark, d)))


@lru_cache(maxsize=8)
def listed(spark, d: str) -> DataFrame:
    """The walk for what needs no track."""
    return B.walk_boxes(B.whole_files(files(spark, d)))


@lru_cache(maxsize=8)
def inventory(spark, d: str) -> DataFrame:
    """The walk with headers and small boxes only, written once for queries that read it several times."""
    return stored(B.held_only(walked(spark, d)))


@lru_cache(maxsize=8)
def faulty(spark, d: str) -> DataFrame:
    """The corpus with a fault in the media or in the run tables of some files, which one told by status and priority.

    A unit prefix that runs past its sample, a chunk outside the file, a table shorter than it says, and tables that
    contradict each other. Only urgent and low orders have one.
    """
    c, st, pr = F.col("content"), F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.decode(c, "ISO-8859-1")

    def over(kind: str, at: int, data: Column) -> Column:
        """The content with bytes put over those that lie so far behind the first box code of a kind."""
        start = F.instr(text, kind) + (4 + at)
        return F.overlay(c, data, start)

    past = F.lit(bytes.fromhex("7FFFFFFF"))
    fault = (
        F.when((pr == "1-URGENT") & (st == "O"), over("mdat", 0, past))
        .when((pr == "1-URGENT") & (st == "P"), over("stco", 8, past))
        .when((pr == "1-URGENT") & (st == "F"), over("stts", 4, F.lit(bytes.fromhex("000003E8"))))
        .when((pr == "5-LOW") & (st == "O"), over("stts", 8, past))
        .when((pr == "5-LOW") & (st == "P"), over("stss", 8, F.lit(bytes.fromhex("00000000"))))
        .otherwise(c)
    )
    told = corpus.build(specifications(spark, d), "o_orderstatus", "o_orderpriority")
    broken = told.select("file_id", fault.alias("content"))
    return broken.select("file_id", F.length("content").cast("bigint").alias("length"), "content")


LAYOUT = """
o1 AS (SELECT o_orderkey AS file_id, o_orderstatus AS st, o_orderpriority AS pr, length(o_orderpriority) + 2 AS n,
         CASE o_orderpriority WHEN '2-HIGH' THEN 2 ELSE 4 END AS w, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS m,
         (epoch(o_orderdate) + 2082844800)::BIGINT AS created FROM orders),
o2 AS (SELECT *, (n + 2) // 3 AS mv, n * (w + 8) * m + CASE st WHEN 'F' THEN w + 4 ELSE 0 END AS vb, CASE st WHEN 'P' THEN 0 ELSE 8 * n END AS ab FROM o1),
o3 AS (SELECT *, 8 + vb + ab AS mdat,
         CASE WHEN pr <> '2-HIGH' THEN 20 + 4 * n ELSE 20 + CASE st WHEN 'O' THEN (n + 1) // 2 WHEN 'P' THEN n ELSE 2 * n END END AS sz,
         CASE pr WHEN '4-NOT SPECIFIED' THEN 16 + 8 * mv ELSE 16 + 4 * mv END AS co, 16 + 4 * mv AS ss, CASE pr WHEN '3-MEDIUM' THEN 32 ELSE 0 END AS ct,
         CASE pr WHEN '1-URGENT' THEN 36 ELSE 0 END AS ed, CASE st WHEN 'O' THEN 24 ELSE 0 END AS tr,
         CASE WHEN pr = '3-MEDIUM' THEN 0 WHEN st = 'F' THEN 20 WHEN st = 'O' THEN 31 ELSE 28 END AS ud, CASE st WHEN 'P' THEN 0 ELSE 359 END AS ta FROM o2),
o4 AS (SELECT *, 8 + 128 + 32 + 40 + sz + co + ss + ct AS stbl FROM o3),
o5 AS (SELECT *, 8 + 92 + ed + tr + 8 + 32 + 45 + 8 + stbl AS tv FROM o4),
o6 AS (SELECT *, 8 + 108 + tv + ta + ud AS moov, CASE st WHEN 'F' THEN 10 ELSE 0 END AS zz, CASE WHEN st = 'O' AND pr = '5-LOW' THEN 5 ELSE 0 END AS tail FROM o5),
f AS (SELECT *, CASE st WHEN 'P' THEN 24 + mdat ELSE 24 END AS moov_at, CASE st WHEN 'P' THEN 24 ELSE 24 + moov + zz END AS mdat_at,
        24 + moov + zz + mdat + tail AS length FROM o6)"""

SAMPLES = """
sm AS (SELECT file_id, st, pr, w, m, n, i, mdat_at + 8 AS media, vb, i % 3 = 0 AS sync, st = 'F' AND i = 3 AS inner_set,
         (w + 8) * m + CASE WHEN st = 'F' AND i = 3 THEN w + 4 ELSE 0 END AS size,
         printf('%08X', file_id) || printf('%04X', i) AS tail
       FROM (SELECT *, unnest(range(n)) AS i FROM f))"""

# Every box of the corpus: path, whether it is there, where it starts and how large it is.
_V = "moov_at + 116"
_MV = f"{_V} + 100 + ed + tr"
_SV = f"{_MV} + 8 + 32 + 45 + 8"
_A = f"{_V} + tv"
_SA = f"{_A} + 100 + 8 + 32 + 45 + 8"
_T = "moov/trak"
_M = "moov/trak/mdia"
_S = "moov/trak/mdia/minf/stbl"
_BOXES = (
    ("ftyp", "true", "0", "24", 8, 0),
    ("moov", "true", "moov_at", "moov", 8, 0),
    ("zzzz", "st = 'F'", "moov_at + moov", "10", 8, 0),
    ("mdat", "true", "mdat_at", "mdat", 8, 0),
    (r"\x00\x00\x00\x00", "tail > 0", "length - tail", "tail", 0, 0),
    ("moov/mvhd", "true", "moov_at + 8", "108", 8, 0),
    (_T, "true", _V, "tv", 8, 0),
    (f"{_T}/tkhd", "true", f"{_V} + 8", "92", 8, 0),
    (f"{_T}/edts", "ed > 0", f"{_V} + 100", "36", 8, 0),
    (f"{_T}/edts/elst", "ed > 0", f"{_V} + 108", "28", 8, 0),
    (f"{_T}/tref", "tr > 0", f"{_V} + 100 + ed", "24", 8, 0),
    (f"{_T}/tref/cdsc", "tr > 0", f"{_V} + 108 + ed", "16", 8, 0),
    (_M, "true", _MV, "93 + stbl", 8, 0),
    (f"{_M}/mdhd", "true", f"{_MV} + 8", "32", 8, 0),
    (f"{_M}/hdlr", "true", f"{_MV} + 40", "45", 8, 0),
    (f"{_M}/minf", "true", f"{_MV} + 85", "8 + stbl", 8, 0),
    (_S, "true", _SV, "stbl", 8, 0),
    (f"{_S}/stsd", "true", f"{_SV} + 8", "128", 8, 8),
    (f"{_S}/stsd/avc1", "true", f"{_SV} + 24", "112", 8, 78),
    (f"{_S}/stsd/avc1/avcC", "true", f"{_SV} + 110", "26", 8, 0),
    (f"{_S}/stts", "true", f"{_SV} + 136", "32", 8, 0),
    (f"{_S}/stsc", "true", f"{_SV} + 168", "40", 8, 0),
    (f"{_S}/stsz", "pr <> '2-HIGH'", f"{_SV} + 208", "sz", 8, 0),
    (f"{_S}/stz2", "pr = '2-HIGH'", f"{_SV} + 208", "sz", 8, 0),
    (f"{_S}/stco", "pr <> '4-NOT SPECIFIED'", f"{_SV} + 208 + sz", "co", 8, 0),
    (f"{_S}/co64", "pr = '4-NOT SPECIFIED'", f"{_SV} + 208 + sz", "co", 8, 0),
    (f"{_S}/stss", "true", f"{_SV} + 208 + sz + co", "ss", 8, 0),
    (f"{_S}/ctts", "ct > 0", f"{_SV} + 208 + sz + co + ss", "ct", 8, 0),
    (_T, "ta > 0", _A, "ta", 8, 0),
    (f"{_T}/tkhd", "ta > 0", f"{_A} + 8", "92", 8, 0),
    (_M, "ta > 0", f"{_A} + 100", "259", 8, 0),
    (f"{_M}/mdhd", "ta > 0", f"{_A} + 108", "32", 8, 0),
    (f"{_M}/hdlr", "ta > 0", f"{_A} + 140", "45", 8, 0),
    (f"{_M}/minf", "ta > 0", f"{_A} + 185", "174", 8, 0),
    (_S, "ta > 0", _SA, "166", 8, 0),
    (f"{_S}/stsd", "ta > 0", f"{_SA} + 8", "66", 8, 8),
    (f"{_S}/stsd/mp4a", "ta > 0", f"{_SA} + 24", "50", 8, 28),
    (f"{_S}/stsd/mp4a/esds", "ta > 0", f"{_SA} + 60", "14", 8, 0),
    (f"{_S}/stts", "ta > 0", f"{_SA} + 74", "24", 8, 0),
    (f"{_S}/stsc", "ta > 0", f"{_SA} + 98", "28", 8, 0),
    (f"{_S}/stsz", "ta > 0", f"{_SA} + 126", "20", 8, 0),
    (f"{_S}/stco", "ta > 0", f"{_SA} + 146", "20", 8, 0),
    ("moov/udta", "ud > 0", f"{_A} + ta", "ud", 8, 0),
    ("moov/udta/name", "ud = 31", f"{_A} + ta + 8", "11", 8, 0),
    ("moov/udta/zvnd", "ud = 31", f"{_A} + ta + 19", "12", 8, 0),
    ("moov/udta/zvnd", "ud = 20", f"{_A} + ta + 8", "12", 8, 0),
    (r"moov/udta/\xa9too", "ud = 28", f"{_A} + ta + 8", "20", 8, 0),
)
ROWS = LAYOUT + ", b AS (" + " UNION ALL ".join(
    f"""SELECT file_id, '{path}' AS path, ({at})::BIGINT AS "offset", ({size})::BIGINT AS size, {width} AS header, {own} AS fields, st, pr, moov_at FROM f WHERE {there}"""
    for path, there, at, size, width, own in _BOXES
) + ")"


@lru_cache(maxsize=8)
def damaged(spark, d: str) -> DataFrame:
    """The corpus with a fault in some files, which one told by status and priority."""
    c, st, pr = F.col("content"), F.col("o_orderstatus"), F.col("o_orderpriority")
    moov = u32(c, 24)
    rest = lambda at: F.substring(c, F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int"), F.length(c))
    nested = F.concat(*[F.concat(big_endian(8 * left, 4), code("moov")) for left in range(14, 0, -1)])
    fault = (
        F.when((pr == "1-URGENT") & (st == "O"), F.concat(F.lit(b"plain text"), rest(10)))
        .when((pr == "1-URGENT") & (st == "P"), F.concat(slice_(c, 0, moov + 28), code("free"), rest(moov + 32)))
        .when((pr == "1-URGENT") & (st == "F"), F.concat(c, slice_(c, 24, moov)))
        .when((pr == "2-HIGH") & (st == "P"), slice_(c, 0, 44))
        .when((pr == "2-HIGH") & (st == "O"), F.concat(slice_(c, 0, 24), big_endian(4, 4), code("free"), rest(24)))
        .when((pr == "2-HIGH") & (st == "F"), F.concat(slice_(c, 0, 24), big_endian(1, 4), code("free"), big_endian(0, 4)))
        .when(
            (pr == "3-MEDIUM") & (st == "O"),
            F.concat(slice_(c, 0, 24), big_endian(moov + 3, 4), slice_(c, 28, moov - 4), F.lit(b"\0\0\0"), rest(moov + 24)),
        )
        .when((pr == "3-MEDIUM") & (st == "F"), F.concat(slice_(c, 0, 32), big_endian(0x7FFFFFFF, 4), rest(36)))
        .when((pr == "3-MEDIUM") & (st == "P"), F.concat(slice_(c, 0, 24), nested))
        .otherwise(c)
    )
    told = corpus.build(specifications(spark, d), "o_orderstatus", "o_orderpriority")
    broken = told.select("file_id", fault.alias("content"))
    return broken.select("file_id", F.length("content").cast("bigint").alias("length"), "content")


FAULTS = """
e AS (SELECT file_id, length, CASE
    WHEN pr = '1-URGENT' AND st = 'O' THEN {'code': 'not_a_container', 'kind': NULL, 'at': 0}
    WHEN pr = '1-URGENT' AND st = 'P' THEN {'code': 'no_movie_box', 'kind': NULL, 'at': NULL}
    WHEN pr = '1-URGENT' AND st = 'F' THEN {'code': 'two_movie_boxes', 'kind': 'moov', 'at': length}
    WHEN pr = '2-HIGH' AND st = 'P' THEN {'code': 'overrun', 'kind': 'mdat', 'at': 24}
    WHEN pr = '2-HIGH' AND st = 'O' THEN {'code': 'undersized', 'kind': 'free', 'at': 24}
    WHEN pr = '2-HIGH' AND st = 'F' THEN {'code': 'truncated', 'kind': 'free', 'at': 24}
    WHEN pr = '3-MEDIUM' AND st = 'O' THEN {'code': 'truncated', 'kind': 'moov', 'at': 24}
    WHEN pr = '3-MEDIUM' AND st = 'F' THEN {'code': 'overrun', 'kind': 'mvhd', 'at': 32}
    WHEN pr = '3-MEDIUM' AND st = 'P' THEN {'code': 'too_deep', 'kind': NULL, 'at': 128} END AS e FROM f)"""

# What the planted faults of the first track are told as, and what the digests of its stream are refused for.
REFUSED = """CASE WHEN pr = '1-URGENT' AND st = 'P' THEN 'out of bounds' WHEN pr = '1-URGENT' AND st = 'F' THEN 'stts is truncated'
    WHEN pr = '5-LOW' AND st = 'O' THEN 'the time-to-sample table covers a different number of samples than the size table'
    WHEN pr = '5-LOW' AND st = 'P' THEN 'the sync sample table is not ascending within the sample count' END"""
SPLITS_NOT = "CASE WHEN pr = '1-URGENT' AND st = 'O' THEN 'a unit''s length prefix runs past the sample' END"
