"""Operators on small fixtures whose answers are known, and properties that must hold."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.functions import bytes as by
from strongroom.functions.markdown import lines_with_fences
from strongroom.operators import boxes as B
from strongroom.operators import compare, digests, export_plan, headers, library, manifest, reads, register, samples, textscan
from strongroom.operators.running import block_of, borders, numbered, running_totals
from strongroom.sources import archive, corpus
from strongroom.sources.stored import stored


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_running_totals_equal_one_window_under_skew(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id", (F.col("id") * 7 % 11).alias("v")
    )
    got = running_totals(df, ["k"], ["id"], F.floor(F.col("id") / 97), {"before": F.col("v"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"), F.count("v").over(w).alias("n"))
    assert rows(got, "k", "id", "before", "n") == rows(want, "k", "id", "before", "n")


NAMES = [
    ("20260604_122323E.MP4", "timestamp_event_letter", "20260604_122323", "all", "event", "2026-06-04T12:23:23"),
    ("2026-06-04_12-23-23N.mov", "timestamp_event_letter", "2026-06-04_12-23-23", "all", "normal", "2026-06-04T12:23:23"),
    ("20260231_101010_F.mp4", "stem_camera_letter", "20260231_101010", "front", None, "2026-02-31T10:10:10"),
    ("20260101_101010_RL.mp4", "stem_camera_letter", "20260101_101010", "rear", None, "2026-01-01T10:10:10"),
    ("20260101_101010i.mp4", "stem_camera_letter", "20260101_101010", "interior", None, "2026-01-01T10:10:10"),
    ("Trip-BACK.mp4", "stem_camera_word", "Trip", "rear", None, None),
    ("20260101_101010_front.mp4", "stem_camera_word", "20260101_101010", "front", None, "2026-01-01T10:10:10"),
]
UNNAMED = ["holiday.mp4", "20260101_101010H.mp4", "20261301_101010E.mp4", "19990101_101010E.mp4", "20260101_246010E.mp4", "-front.mp4", "20260101_101010E.avi", "20260101_101010E", "chefF.mp4"]


def test_name_grammars(spark):
    names = spark.createDataFrame([(n[0],) for n in NAMES] + [(n,) for n in UNNAMED], "name string")
    parsed = names.select("name", library.parse_name(F.col("name")).alias("p")).select("name", "p.*")
    got = {r[0]: tuple(r)[1:] for r in parsed.collect()}
    assert {n: got[n] for n in UNNAMED} == {n: (None,) * 5 for n in UNNAMED}
    for name, *want in NAMES:
        assert got[name] == tuple(want), name


def _fold(units):
    """Parameter-set insertion told as a fold, the definition the windows must equal."""
    marks, fresh = [], True
    for sample in units:
        sps = pps = False
        for kind, opens in sample:
            sps, pps = sps or kind == 7, pps or kind == 8
            if kind in (7, 8) or (kind == 5 and opens):
                fresh = True
            if fresh and kind == 5 and not sps and not pps:
                marks.append("both")
                fresh = False
            elif fresh and kind == 5 and sps and not pps:
                marks.append("pictures")
            else:
                marks.append(None)
    return marks


def test_insertion_points_equal_the_fold(spark):
    chance = random.Random(7)
    table, want = [], {}
    for track in range(400):
        samples_ = [[(chance.choice([1, 5, 5, 7, 8]), chance.random() < 0.4) for _ in range(chance.randint(1, 4))] for _ in range(chance.randint(1, 8))]
        marks = iter(_fold(samples_))
        for i, sample in enumerate(samples_):
            for u, (kind, opens) in enumerate(sample):
                table.append((track, 0, i, u, kind, opens))
                want[(track, i, u)] = next(marks)
    units = spark.createDataFrame(table, "file_id int, track_index int, sample_idx int, unit int, type int, opens_picture boolean")
    marked = digests.parameter_set_insertions(units, F.floor(F.col("sample_idx") / 3), F.floor(F.col("unit") / 2))
    got = {(r.file_id, r.sample_idx, r.unit): r.inserted for r in marked.collect()}
    assert got == want


def _tables(spark, sizes, chunks, runs, timed=None, sync=None):
    key = "file_id int, track_index int, "
    make = lambda data, ddl: spark.createDataFrame([(1, 0, *r) for r in data], key + ddl)
    return (
        make([(0, timed or len(sizes), 2000)], "run bigint, n bigint, delta bigint"),
        make([(i, *r) for i, r in enumerate(runs)], "run bigint, first_chunk bigint, per_chunk bigint, description bigint"),
        make(list(enumerate(sizes)), "idx bigint, size bigint"),
        make([(i + 1, o) for i, o in enumerate(chunks)], "chunk bigint, offset bigint"),
        make(list(enumerate(sync or [])), "position bigint, sample_number bigint"),
        make([], "run bigint, n bigint, offset bigint"),
    )


def test_samples_are_located(spark):
    got = samples.samples(*_tables(spark, [10, 20, 30, 40], [100, 500], [(1, 2, 1)]))
    assert rows(got, "idx", "offset", "decode_time", "sync", "chunk") == [
        (0, 100, 0, True, 1),
        (1, 110, 2000, True, 1),
        (2, 500, 4000, True, 2),
        (3, 530, 6000, True, 2),
    ]
    got = samples.assign_chunks(*[_tables(spark, [1] * 5, [0, 10, 20], [(1, 1, 1), (2, 2, 1)])[i] for i in (1, 3)])
    assert rows(got, "idx", "chunk") == [(0, 1), (1, 2), (2, 2), (3, 3), (4, 3)]


@pytest.mark.parametrize(
    ("sizes", "chunks", "runs", "timed", "sync", "rule"),
    [
        ([1, 1, 1], [0, 10], [(1, 2, 1)], None, None, 7),
        ([1, 1], [0], [(1, 1, 1), (2, 1, 1)], None, None, 3),
        ([1, 1], [0], [(1, 2, 1)], 3, None, 1),
        ([1, 1], [0], [(1, 2, 1)], None, [2, 2], 8),
        ([1, 1], [0, 5], [(2, 2, 1)], None, None, 6),
    ],
)
def test_tables_that_disagree_are_named(spark, sizes, chunks, runs, timed, sync, rule):
    broken = samples.violations(*_tables(spark, sizes, chunks, runs, timed, sync))
    assert samples.first_violation(broken).collect()[0]["at"]["rule_rank"] == rule


def test_long_runs_are_cut_into_spans(spark):
    stts = spark.createDataFrame([(1, 0, 0, 200000, 3), (1, 0, 1, 5, 7)], "file_id int, track_index int, run bigint, n bigint, delta bigint")
    got = samples.expand_durations(stts)
    assert got.count() == 200005
    assert got.agg(F.max("decode_time"), F.countDistinct("idx")).collect()[0][:] == (600000 + 28, 200005)


def test_streamed_digests_equal_those_in_a_row(spark):
    data = [(k, i, bytes([k, i % 251]) * (i % 5)) for k in range(3) for i in range(500)]
    df = spark.createDataFrame(data, "k int, i int, b binary")
    within, streamed = (digests.ordered_digests(df, ["k"], ["i"], "b", row_bytes=n) for n in (1 << 20, 0))
    assert rows(within, "k", "sha256", "count", "bytes") == rows(streamed, "k", "sha256", "count", "bytes")
    want = hashlib.sha256(b"".join(b for k, _, b in data if k == 1)).hexdigest()
    assert streamed.where("k = 1").collect()[0]["sha256"] == want


def _corpus(spark):
    specs = spark.createDataFrame([(i,) for i in range(6)], "i int")
    made = corpus.specifications(
        specs,
        F.concat(F.lit("f"), F.col("i").cast("string")),
        F.col("i"),
        samples=F.col("i") + 4,
        moov_first=F.col("i") != 1,
        wide_offsets=F.col("i") == 2,
        audio=F.col("i") != 3,
        top_vendor=F.col("i") == 4,
        tail=F.when(F.col("i") == 5, 5).otherwise(0),
    )
    return corpus.build(made)


def test_walk_reads_the_same_from_headers_only(spark, tmp_path):
    files = _corpus(spark).collect()
    for f in files:
        (tmp_path / f.file_id).write_bytes(bytes(f.content))
    whole = B.boxes(B.walk(B.whole_files(spark.createDataFrame(files))))
    paths = spark.createDataFrame([(str(tmp_path / f.file_id),) for f in files], "path string")
    segments = archive.header_segments(paths)
    sparse = B.boxes(B.walk(segments)).withColumn("file_id", F.substring_index("file_id", "/", -1))
    keep = ("file_id", "path", "offset", "size", "ord")
    assert rows(whole, *keep) == rows(sparse, *keep)
    media = segments.select(F.explode("segments").alias("s")).where(F.length("s.bytes") > 16)
    kinds = {bytes(r[0]) for r in media.select(F.substring("s.bytes", F.lit(5), F.lit(4))).collect()}
    assert b"mdat" not in kinds


def test_one_flipped_byte_is_one_finding(spark):
    files = {f.file_id: bytes(f.content) for f in _corpus(spark).collect()}
    target = files["f0"]
    at = target.index(b"zvnd") + 4
    flipped = target[:at] + bytes([target[at] ^ 1]) + target[at + 1 :]
    frame = lambda data: spark.createDataFrame([("f0", len(data), bytearray(data))], "file_id string, length bigint, content binary")

    def vendor(data):
        held = B.held_bytes(B.walk(B.whole_files(frame(data)))).where("path LIKE 'moov/udta/%'")
        return held.select("file_id", F.lit("user_data").alias("location"), by.shown(F.col("kind")).alias("kind"), "offset", F.sha2("bytes", 256).alias("sha256"))

    def shape(data):
        walked = B.walk(B.whole_files(frame(data)))
        return digests.structural_fingerprints(walked, headers.track_parts(walked)).select("file_id", "sha256")

    found = compare.all_findings(
        compare.whole_file_findings(digests.file_digests(frame(target)), digests.file_digests(frame(flipped))),
        compare.vendor_findings(vendor(target), vendor(flipped), F.floor(F.col("offset") / 4096)),
        compare.structure_findings(shape(target), shape(flipped)),
    )
    assert rows(found, "subject", "outcome") == [("structure", "identical"), ("vendor_box", "differs"), ("whole_file", "differs")]


def _errors(spark, *contents):
    df = spark.createDataFrame([(i, len(c), bytearray(c)) for i, c in enumerate(contents)], "file_id int, length bigint, content binary")
    return {r.file_id: r.code for r in B.errors(B.walk(B.whole_files(df))).collect()}


def test_broken_containers_are_told(spark):
    box = lambda kind, body=b"": (len(body) + 8).to_bytes(4, "big") + kind + body
    moov = box(b"moov", box(b"mvhd", bytes(100)))
    large = (1).to_bytes(4, "big") + b"mdat" + (24).to_bytes(8, "big") + bytes(8)
    got = _errors(
        spark,
        box(b"ftyp", bytes(16)) + moov,
        box(b"ftyp", bytes(70000)) + moov,
        box(b"ftyp", bytes(16)) + large + moov,
        b"hello, this is text",
        box(b"ftyp", bytes(16)) + moov + b"\0" * 40,
        box(b"ftyp", bytes(16)) + (0).to_bytes(4, "big") + b"mdat" + bytes(30),
        box(b"free") * 4096 + moov,
        box(b"ftyp", bytes(16)) + box(b"moov", box(b"udta", (99).to_bytes(4, "big") + b"zvndxx")),
    )
    assert got == {1: "oversized", 3: "not_a_container", 5: "no_movie_box", 6: "too_many"}


def test_many_children_and_clipped_user_data(spark):
    box = lambda kind, body=b"": (len(body) + 8).to_bytes(4, "big") + kind + body
    content = box(b"ftyp", bytes(16)) + box(b"moov", box(b"free") * 300 + box(b"udta", box(b"aaaa") + (99).to_bytes(4, "big") + b"zvndxx"))
    df = spark.createDataFrame([(0, len(content), bytearray(content))], "file_id int, length bigint, content binary")
    got = B.boxes(B.walk(B.whole_files(df)))
    assert got.where("path = 'moov/free'").count() == 300
    assert rows(got.where("path LIKE 'moov/udta/%'"), "path", "size", "clipped") == [("moov/udta/aaaa", 8, False), ("moov/udta/zvnd", 10, True)]


def test_bytes_round_trip(spark):
    values = [0, 1, 255, 65535, (1 << 31) - 1, (1 << 32) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", by.big_endian(F.col("v"), 8))
    assert [int(r[0]) for r in df.orderBy("v").select(by.u64(F.col("b"), 0)).collect()] == values
    one = spark.range(1)
    assert one.select(by.i32(F.lit(b"\xff\xff\xff\xfb"), 0), by.i64(F.lit(b"\xff" * 8), 0), by.u64(F.lit(b"\xff" * 8), 0)).collect()[0][:] == (-5, -1, (1 << 64) - 1)
    assert one.select(by.shown(F.lit(b"\xa9too")), by.shown(F.lit(b"\0mdt"))).collect()[0][:] == (r"\xa9too", r"\x00mdt")


def test_a_recording_describes_itself(spark):
    walked = B.walk(B.whole_files(_corpus(spark)))
    parts = stored(headers.track_parts(walked))
    tables = headers.run_tables(parts)
    assert samples.violations(*tables).count() == 0
    assert headers.table_problems(parts).count() == 0
    located = samples.samples(*tables)
    video = located.where("track_index = 0").groupBy("file_id").agg(F.count("*").alias("n"))
    assert rows(video, "file_id", "n") == [(f"f{i}", i + 4) for i in range(6)]


def test_library_signs(spark):
    schema = "path string, name string, grammar string, time string, video_tracks bigint, vendor_boxes bigint, width int, height int, moov_before_mdat boolean, foreign_muxer_tags array<string>, readable boolean"
    probes = spark.createDataFrame(
        [
            ("a", "a", "timestamp_event_letter", "t1", 2, 2, 64, 64, True, [], True),
            ("b", "b", "timestamp_event_letter", "t2", 1, 0, 64, 64, False, ["Lavf"], True),
            ("c", "c", "timestamp_event_letter", "t3", 2, 2, 32, 32, True, [], True),
            ("d", "d", "stem_camera_letter", "t1", 1, 1, 64, 64, True, [], True),
            ("e", "e", None, None, 1, 0, 16, 16, True, [], True),
            ("f", "f", None, None, None, None, None, None, None, None, False),
        ],
        schema,
    )
    assessed = library.with_siblings(probes)
    got = library.origins(assessed, library.signs(assessed))
    signs = {r.path: (r.signs, r.reading) for r in got.collect()}
    assert signs == {
        "a": ([], "no_sign_found"),
        "b": (["moov_after_mdat", "foreign_muxer_tag Lavf", "single_video_track_where_sibling_has_two", "vendor_boxes_absent"], "signs_found"),
        "c": (["resolution_below_siblings 32x32 below 64x64"], "signs_found"),
        "d": (["single_video_track_where_sibling_has_two"], "signs_found"),
        "e": ([], "layout_unknown"),
        "f": ([], "unreadable"),
    }


def test_fences(spark):
    text = "a\n```sh\n# no\n~~~\n````  \nb\n    ```\n``` x`y\n~~~~\nopen"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [s for _, s in rows(lines_with_fences(df, "t", ["id"]), "number", "state")]
    assert got == ["outside", "opens", "inside", "inside", "closes", "outside", "outside", "outside", "opens", "inside"]


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("This is Verified.", ["verified"]),
        ("unverified, non-verified, verified-ish", []),
        ("tamper-proof and SHA256", ["sha256", "tamper-proof"]),
        ("authenticated authentic", ["authentic", "authenticated"]),
        ("éoriginal originalé", []),
    ],
)
def test_forbidden_words(spark, text, words):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert [w for (w,) in rows(textscan.forbidden_words(df, "t", ["id"]), "word")] == words


def test_paths_resolve(spark):
    cases = [("/a/b.md", "../c", "/c"), ("/a/b.md", "./c/./d", "/a/c/d"), ("/a/b.md", "", "/a/b.md"), ("/a/b.md", "../../x", None), ("/a/", "/q", "/q")]
    df = spark.createDataFrame(cases, "doc string, path string, want string")
    assert all(r[0] == r[1] for r in df.select(textscan.resolve(F.col("doc"), F.col("path")), "want").collect())


def test_touch_counts_equal_pairs(spark):
    chance = random.Random(3)
    r = [(chance.randint(0, 2), chance.randint(0, 300), chance.randint(0, 40)) for _ in range(300)]
    g = [(chance.randint(0, 3), i, s := chance.randint(0, 300), s + chance.randint(1, 50)) for i in range(100)]
    reads_ = spark.createDataFrame(r, "file_id int, offset bigint, length bigint")
    ranges = spark.createDataFrame(g, "file_id int, range_id bigint, start bigint, end bigint")
    want = sorted((f, i, sum(1 for a, o, n in r if a == f and o < e and s < o + n)) for f, i, s, e in g)
    assert rows(reads.touch_counts(reads_, ranges), "file_id", "range_id", "touching") == want


def test_structure_scope_reads_no_content(spark, tmp_path):
    _corpus(spark).write.parquet(str(tmp_path / "c"))
    plan = manifest.scoped(spark.read.parquet(str(tmp_path / "c")), "structure")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "sha2(" not in physical and "content#" not in physical


def test_kth_match_is_not_one_task_per_key(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id", F.lit("x").alias("v"))
    matched = compare.kth_match(df, df.where("id <> 50"), ["k"], ["id"], F.floor(F.col("id") / 10))
    assert matched.where("in_observed IS NULL").count() == 1
    assert numbered(df, ["k"], ["id"], F.floor(F.col("id") / 10), "n").where("n <> id").count() == 0


def test_exact_interleaving(spark):
    chunks = spark.createDataFrame(
        [(1, 0, 0, 10, 1, 3), (1, 1, 0, 20, 33333333333, 100000000000), (1, 2, 0, 30, 0, 1)],
        "export_id int, slot int, first bigint, bytes bigint, time bigint, timescale bigint",
    )
    got = export_plan.interleave(chunks)
    assert rows(got, "place", "slot", "bytes_before") == [(0, 2, 0), (1, 1, 30), (2, 0, 50)]


def test_canonical_identifiers(spark):
    cases = {"P01": 1, "P10": 10, "P1": None, "P00": None, "P012": None, "P70000": None, "P65535": 65535}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", register.canonical(F.col("t"))).collect()} == cases


@pytest.mark.parametrize("row_bytes", [1 << 20, 0])
def test_an_unread_sample_leaves_no_digest(spark, row_bytes):
    rows = [("a", 0, b"x"), ("a", 1, None), ("a", 2, b"z"), ("b", 0, b"x"), ("b", 1, b"y"), ("c", 0, None)]
    samples = spark.createDataFrame(rows, "file_id string, idx int, value binary")
    got = {r.file_id: (r.sha256, r["count"], r.bytes) for r in digests.ordered_digests(samples, ["file_id"], ["idx"], "value", row_bytes).collect()}
    assert got == {"a": (None, 3, 2), "b": (hashlib.sha256(b"xy").hexdigest(), 2, 2), "c": (None, 1, 0)}


def test_a_recorded_file_that_is_gone_is_a_finding(spark):
    recorded = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file_id string, sha256 string")
    observed = spark.createDataFrame([("a", "1")], "file_id string, sha256 string")
    for findings, unrecorded in ((compare.whole_file_findings, "not_recorded"), (compare.structure_findings, "not_checkable")):
        got = {r.file_id: (r.outcome, r.reason) for r in findings(recorded, observed).collect()}
        assert got["a"] == ("identical", None)
        assert got["b"] == ("not_checkable", compare.NOT_THERE)
        assert got["c"][0] == unrecorded
    rolled = compare.roll_up(compare.whole_file_findings(recorded, observed)).collect()
    assert {r.file_id: r.every_compared_is_identical for r in rolled} == {"a": True, "b": False, "c": False}


def test_paths_are_resolved(spark):
    spelled = {
        "/a/b/../in.mp4": "/a/in.mp4",
        "/a/./b//c/": "/a/b/c",
        "/../x": "/x",
        "a/../../x": "../x",
        "../../X": "../../x",
        "/": "/",
        "": "",
    }
    df = spark.createDataFrame([(p,) for p in spelled], "path string")
    path = F.col("path")
    got = {r.path: r.c for r in df.select("path", export_plan.canonical_path(path).alias("c")).collect()}
    assert got == spelled
    kept = df.where("path = '../../X'").select(export_plan.canonical_path(path, False).alias("c")).first().c
    assert kept == "../../X"


def test_any_timescales_give_an_exact_order(spark):
    from fractions import Fraction

    scales = [1, 44100, 48000, 90000, 30000, 24000, 60000, 1001, 2**32 - 1, 2**32 - 2, 7919, 104729]
    rows = [(1, slot, i, 10, int(scale * 3 * i / 7) + i, scale) for slot, scale in enumerate(scales) for i in range(5)]
    chunks = spark.createDataFrame(rows, "export_id int, slot int, first int, bytes long, time long, timescale long")
    placed = sorted(export_plan.interleave(chunks).collect(), key=lambda r: r.place)
    want = sorted(rows, key=lambda r: (Fraction(r[4], r[5]), r[1], r[2]))
    assert [(r.slot, r.first) for r in placed] == [(r[1], r[2]) for r in want]


def test_unreadable_files_are_rows(spark, tmp_path):
    odd = tmp_path / "a b%20#é.mp4"
    odd.write_bytes((8).to_bytes(4, "big") + b"free")
    many = tmp_path / "many.mp4"
    many.write_bytes(((8).to_bytes(4, "big") + b"free") * 5000)
    paths = [str(odd), f"file://{odd}", str(many), str(tmp_path / "gone.mp4"), "nowhere://host/x"]
    got = {r.file_id: r for r in archive.header_segments(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [got[p].length for p in paths] == [8, 8, 40000, None, None]
    assert got[paths[2]].reason is None and len(got[paths[2]].segments) == B.MAX_TOP_LEVEL + 1
    assert all(got[p].reason and got[p].segments is None for p in paths[3:])


def test_a_short_table_lists_no_sample(spark):
    parts = stored(headers.track_parts(B.walk(B.whole_files(_corpus(spark)))))
    short = parts.withColumn(
        "stts",
        F.when((F.col("file_id") == "f0") & (F.col("track_index") == 0), F.expr("substring(stts, 1, length(stts) - 1)")).otherwise(
            F.col("stts")
        ),
    )
    assert rows(headers.table_problems(short), "file_id", "track_index", "problem") == [("f0", 0, "stts is truncated")]
    listed = samples.samples(*headers.run_tables(short)).select("file_id", "track_index").distinct()
    everyone = parts.select("file_id", "track_index").where("NOT (file_id = 'f0' AND track_index = 0)")
    assert rows(listed, "file_id", "track_index") == rows(everyone, "file_id", "track_index")
    assert headers.stts(short).where("file_id = 'f0' AND track_index = 0").count() == 0


def test_constant_sizes_are_listed_by_spans(spark):
    def table(size, count):
        return bytearray(bytes(4) + size.to_bytes(4, "big") + count.to_bytes(4, "big"))

    parts = spark.createDataFrame(
        [("a", 0, table(7, 150_000), None), ("b", 0, table(9, 0), None), ("c", 0, table(5, 2**32 - 1), None)],
        "file_id string, track_index int, stsz binary, stz2 binary",
    )
    got = headers.stsz(parts.where("file_id <> 'c'"))
    assert got.agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.sum("size")).first()[:] == (
        150_000,
        0,
        149_999,
        150_000,
        1_050_000,
    )
    assert headers.stsz(parts.where("file_id = 'c'")).limit(3).count() == 3


def test_structure_of_a_large_group_is_whole(spark):
    kind = F.when(F.col("id") == 9000, "moov").when(F.col("id") % 5 == 4, "mdat").otherwise("free")
    top = spark.range(10_000).select(
        F.lit(1).alias("file_id"), F.col("id").alias("ord"), kind.alias("kind"), (F.col("id") * 8).alias("offset"),
        F.lit(8).alias("size"), (F.col("id") == 9999).alias("clipped"),
    )
    small = top.where("ord < 3").withColumn("file_id", F.lit(2))
    want = " ".join("moov" if i == 9000 else "mdat" if i % 5 == 4 else "free" for i in range(10_000))
    assert rows(manifest.structure_records(top.unionByName(small)), "*") == [
        (1, want, False, 72_000, 8, 8), (2, "free free free", None, None, None, None)
    ]


def test_the_top_level_alone_is_the_walk_at_depth_zero(spark):
    whole = B.whole_files(_corpus(spark))
    keep = ("file_id", "path", "offset", "size", "ord", "clipped")
    assert rows(B.boxes(B.walk_top(whole)), *keep) == rows(B.boxes(B.walk(whole)).where("depth = 0"), *keep)


def test_coverage_tells_gaps_overlaps_and_ends(spark):
    draw = random.Random(6)
    ranges, want = [], []
    for parent in range(60):
        # The first parent holds nine tenths of the ranges.
        own = sorted((draw.randrange(400 if parent else 90_000), draw.randrange(30)) for _ in range(3000 if parent == 0 else 5))
        start, end = draw.randrange(20), draw.randrange(380, 430) if parent else 90_010
        reach = start
        for offset, size in own:
            if offset > reach:
                want.append((parent, "gap", reach, offset - reach))
            elif min(reach, offset + size) > offset:
                want.append((parent, "overlap", offset, min(reach, offset + size) - offset))
            reach = max(reach, offset + size)
        if reach != end:
            want.append((parent, "short" if reach < end else "past", min(reach, end), abs(end - reach)))
        ranges += [(1, parent, *r, start, end) for r in own]
    df = spark.createDataFrame(ranges, "file_id int, parent int, offset bigint, size bigint, start bigint, end bigint")
    parents = df.select("file_id", "parent", "start", "end").distinct()
    empty = spark.createDataFrame([(1, 99, 10, 30)], parents.schema)
    got = B.coverage(df.select("file_id", "parent", "offset", "size"), parents.unionByName(empty), F.floor(F.col("offset") / 50))
    assert rows(got, "parent", "kind", "offset", "size") == sorted([*want, (99, "short", 10, 20)])


def test_a_file_of_many_tracks_is_one_document(spark):
    tracks = spark.range(5000).select(
        F.lit(1).alias("file_id"), F.col("id").alias("index"), F.lit("avc1").alias("coding"), (F.col("id") * 3).alias("sample_count"),
        F.lit(None).cast("string").alias("payload_sha256"),
    ).repartition(7)
    files = spark.createDataFrame([(1, "a", 5, None), (2, "b", 6, None)], "file_id int, name string, size bigint, sha256 string")
    clocks = spark.createDataFrame([(1, "2020-01-01T00:00:00", None, None, None)], "file_id int, " + ", ".join(f"{c} string" for c, _ in manifest.CLOCKS))
    made = manifest.documents(files, tracks, manifest.times(clocks))
    got = {r.file_id: r.manifest for r in made.collect()}
    assert made.count() == 2 and got[2].tracks == [] and len(got[1].times) == 1
    assert [(t["index"], t.sample_count) for t in got[1].tracks] == [(i, 3 * i) for i in range(5000)]
    read = manifest.from_json(manifest.to_canonical_json(made)).where("file_id = 1").first()
    assert read.reason is None and len(read.manifest.tracks) == 5000


def test_blocks_hold_equal_rows_of_one_key_and_one_day(spark):
    """Nine tenths of the rows are one key's on one day; no block holds much more than its share of them."""
    hot = F.col("id") % 10 != 0
    day = 1_700_000_000_000_000
    df = stored(
        spark.range(20_000).select(
            F.when(hot, 0).otherwise(F.col("id") % 7).alias("k"),
            F.when(hot, day + F.col("id") * 3).otherwise(day + (F.col("id") % 900 - 450) * 86_400_000_000).alias("at"),
            "id",
            (F.col("id") % 13).alias("v"),
        )
    )
    cuts = borders(df, F.col("at"), rows=1000)
    block = block_of(cuts, F.col("at"))
    sizes = [r["count"] for r in df.groupBy(block.alias("b")).count().collect()]
    assert len(cuts) == 19 and max(sizes) < 1500
    want = df.where(F.col("id") % 997 == 0).collect()
    import bisect

    got = {r.id: r.b for r in df.select("id", block.alias("b")).collect()}
    assert all(got[r.id] == bisect.bisect_left(cuts, r.at) for r in want)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"))
    assert rows(running_totals(df, ["k"], ["at", "id"], block, {"before": F.col("v")}), "k", "id", "before") == rows(plain, "k", "id", "before")
    assert borders(df, F.col("at")) == [] and borders(df.where("false"), F.col("at"), rows=1) == []
