"""What keeps queries in proportion to their input, and results right where numbers are large."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strongroom import plans
from strongroom.operators import boxes as B
from strongroom.operators import digests, export_plan, headers, media, samples
from strongroom.operators import library as L
from strongroom.operators import manifest as M
from strongroom.operators.running import small_keys
from strongroom.plans import exports as exports_plan
from strongroom.plans import headers as headers_plan
from strongroom.plans import recordings
from strongroom.plans import samples as samples_plan
from strongroom.plans.digests import media_places
from strongroom.plans.registry import QUERIES
from strongroom.sources import corpus
from tests.test_queries import DIRECTORY

plans.load()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_years_past_9999_have_no_sign(spark):
    """a year of five digits was shown with a sign."""
    n = [0, 253402300799, 253402300800, 1_800_000_000_000, 8_000_000_000_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n bigint").select(M.civil(F.col("n"))).collect()]
    sql = "SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(?::BIGINT), '%Y-%m-%dT%H:%M:%S')"
    assert got == [duckdb.execute(sql, [x]).fetchone()[0] for x in n]


def test_tiling_sends_no_side_to_the_driver(spark):
    """sides were joined that Spark took to be small, as a generator's rows aren't counted."""
    found = executed(QUERIES["b11_tiling"](spark, DIRECTORY))
    assert "Broadcast" not in found and "Join" not in found


def test_gaps_tell_breaks_and_ends(spark):
    rows = [("a", 0, 0, 0, 5), ("a", 0, 1, 5, 5), ("b", 0, 0, 0, 4), ("b", 0, 1, 5, 5), ("b", 0, 2, 9, 1), ("c", 0, 0, 0, 9), ("e", 0, 0, 0, 1)]
    parents = [("a", 0, 0, 10), ("b", 0, 0, 10), ("c", 0, 0, 10), ("d", 0, 0, 10)]
    got = B.gaps(
        spark.createDataFrame(rows, "file_id string, parent bigint, ord int, offset bigint, size bigint"),
        spark.createDataFrame(parents, "file_id string, parent bigint, start bigint, end bigint"),
    )
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0, True), ("b", 0, 2, False), ("c", 0, 0, False)]


def test_children_of_user_data_need_no_exchange_of_boxes(spark):
    """all the boxes were shuffled to meet their parents."""
    assert "Join" not in plan(QUERIES["b14_user_data_children"](spark, DIRECTORY))


def test_the_walk_and_the_parts_of_tracks_are_not_folded_per_row(spark):
    """F3 to F10 and those that share the walk: every box was folded out of its row by interpreted lambdas."""
    shown = plan(QUERIES["c3_track_header"](spark, DIRECTORY))
    assert "ArrowEvalPython" in shown and "aggregate(sequence" not in shown


def test_files_with_faults_are_not_shuffled(spark):
    """whole files were joined with the orders that tell their faults."""
    for name in ("b8_one_movie_box", "d8_refused_tracks"):
        assert "Join" not in plan(QUERIES[name](spark, DIRECTORY))


def test_counting_vendor_boxes_stores_nothing(spark):
    """the inventory and the tracks were written first, and the tracks not used."""
    for name in ("h5_foreign_tags", "h6_vendor_count"):
        assert "Scan ExistingRDD" not in executed(QUERIES[name](spark, DIRECTORY))


def test_lists_of_different_lengths_are_walked_together(spark):
    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    first = box(b"ftyp", b"isom" + bytes(4))
    many = first + box(b"moov", box(b"trak", box(b"tkhd", b"abc")) * 40 + box(b"udta", box(b"zvnd") + b"\0\0\0\x07x"))
    data = [("many", many), ("cut", many[:-4]), ("none", first + box(b"mdat")), ("empty", b"")]
    files = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in data], "file_id string, length bigint, content binary")
    walked = B.walk(B.whole_files(files.coalesce(1)))
    told = {r.file_id: r.code for r in B.errors(walked).collect()}
    assert told == {"cut": "overrun", "none": "no_movie_box", "empty": "no_movie_box"}
    parts = headers.track_parts(walked).collect()
    assert [r.track_index for r in parts] == list(range(40)) and {bytes(r.tkhd) for r in parts} == {b"abc"}
    tail = B.boxes(walked).where("file_id = 'many' AND clipped").collect()
    assert [(r.path, r.size) for r in tail] == [(r"moov/udta/\x00\x00\x00\x07", 5)]


def test_recordings_of_one_shape_are_written_once(spark):
    """Every number of every file was folded through hex digits, row by row."""
    assert "transform(" not in plan(recordings.files(spark, DIRECTORY))
    rows = spark.range(200).withColumn("n", F.when(F.col("id") != 7, F.col("id") * 3_000_000_019))
    specs = corpus.specifications(rows, F.col("id"), F.col("n"), samples=(F.col("id") % 3 + 1).cast("int"), created=F.col("id") + 5, audio=F.col("id") % 2 == 0)
    got = {r.file_id: r.content for r in corpus.build(specs.coalesce(1)).collect()}
    assert len(got) == 200 and got[7] is None
    for k in (0, 1, 6, 199):
        seed, content = (k * 3_000_000_019 & 0xFFFFFFFF).to_bytes(4, "big"), bytes(got[k])
        n = k % 3 + 1
        assert content.count((k + 5).to_bytes(4, "big") * 2) >= 3
        assert b"zvnd" + seed in content and all(seed + i.to_bytes(2, "big") in content for i in range(n))
        assert content.endswith((seed + (n - 1).to_bytes(4, "big")) if k % 2 == 0 else (seed + (n - 1).to_bytes(2, "big")))


def test_the_walk_makes_only_what_is_asked(spark):
    """Every query had the boxes and all payloads of its files made and sent."""
    for name, made in (("c3_track_header", "tkhd"), ("d1_time_runs", "stts")):
        schema = headers_plan.parts(spark, DIRECTORY, made).schema.names
        assert schema == ["file_id", "track_index", made]
        assert "boxes" not in plan(QUERIES[name](spark, DIRECTORY))
    assert "tracks" not in B.walk_boxes(B.whole_files(recordings.files(spark, DIRECTORY))).columns


def test_parts_of_a_walk_equal_the_whole(spark):
    files = B.whole_files(recordings.damaged(spark, DIRECTORY))
    whole, names = B.walk(files), ("tkhd", "entry", "configuration", "table_children", "stsz", "stz2")
    some = headers.track_parts(B.walk_tracks(files, *names))
    want = headers.track_parts(whole).select(*some.columns)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, want.collect())) != []
    assert B.boxes(B.walk_boxes(files)).exceptAll(B.boxes(whole)).isEmpty()
    with pytest.raises(ValueError):
        B.walk_tracks(files, "tkhd", "none")


def test_units_of_many_samples_are_split_together(spark):
    """each sample was split by a fold of 32 steps or more, interpreted one by one."""
    draw = random.Random(3)
    data = [None, b"", b"\0", b"\0\0\0\1", b"\0\0\0\0", bytes(9), bytes.fromhex("7FFFFFFF") + bytes(20)]
    for _ in range(200):
        width, body = draw.choice((1, 2, 3, 4)), b""
        for _ in range(draw.randrange(5)):
            size = draw.randrange(20)
            body += size.to_bytes(width, "big") + draw.randbytes(size)
        data.append((body[: len(body) - draw.choice((0, 0, 0, 1, 3))], width))
    rows = [(k, *(d if isinstance(d, tuple) else (d, 4))) for k, d in enumerate(data)]

    def brute(sample, width):
        at, units = 0, []
        while at < len(sample):
            size = int.from_bytes(sample[at : at + width], "big")
            if at + width + size > len(sample):
                return units, True
            units.append((at + width, size))
            at += width + size
        return units, False

    given = spark.createDataFrame([(k, None if s is None else bytearray(s), w) for k, s, w in rows], "k int, s binary, w int").coalesce(1)
    made = given.select("k", digests.unit_places(F.col("s"), F.col("w")).alias("p"))
    assert "aggregate(" not in plan(made)
    got = {r.k: r.p and ([tuple(u) for u in r.p.units], r.p.broken) for r in made.collect()}
    assert got == {k: None if s is None else brute(s, w) for k, s, w in rows}


def test_a_digest_that_is_not_asked_for_is_not_made(spark):
    """Payloads and streams were both hashed, whichever a query showed, and each track was a batch."""
    placed = media_places(recordings.faulty(spark, DIRECTORY)).where("file_id < 400").coalesce(1).cache()
    both, payload, stream = (media.digests(placed, *asked).drop("payload_version", "stream_version") for asked in ((True, True), (True, False), (False, True)))
    keys, p, s = ["file_id", "track_index", "samples", "bytes"], ["payload_sha256", "payload_reason"], ["stream_sha256", "stream_bytes", "access_units", "insertions"]
    assert both.select(*keys, *p).exceptAll(payload.select(*keys, *p)).isEmpty() and payload.where("stream_sha256 IS NOT NULL").isEmpty()
    assert both.select(*keys, *s, "stream_reason").exceptAll(stream.select(*keys, *s, "stream_reason")).isEmpty()
    assert stream.where("payload_sha256 IS NOT NULL").isEmpty() and both.count() == placed.count() > 400


def test_totals_fingerprints_and_order_are_made_in_the_row(spark):
    """Samples and boxes were exchanged and stored, though the row of a file or track holds them."""
    for name, exchanges in (("b9_paths_in_file_order", 1), ("d14_gated_totals", 1), ("e5_structural_fingerprint", 5)):
        shown = executed(QUERIES[name](spark, DIRECTORY))
        assert shown.count("Exchange") <= exchanges and "Scan ExistingRDD" not in shown


def test_totals_of_tables_equal_those_of_samples(spark):
    parts = headers.track_parts(B.walk(B.whole_files(recordings.faulty(spark, DIRECTORY))).where("file_id < 600")).cache()
    _, _, stsz, _, stss, ctts = headers.run_tables(parts)
    want, got = samples.totals(stsz, stss, ctts), headers.totals(parts)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    files = B.whole_files(recordings.damaged(spark, DIRECTORY)).where("file_id < 200")
    columns = ["file_id", "path", "offset", "place"]
    assert B.boxes_in_file_order(files).select(*columns).exceptAll(B.in_file_order(B.boxes(B.walk_boxes(files))).select(*columns)).isEmpty()


NAMED = ("c1_file_type", "c3_track_header", "c6_sample_entry", "d5_chunk_offsets", "b3_nested_enumeration", "b10_descend", "b17_held_bytes")


@pytest.mark.parametrize("name", NAMED)
def test_files_are_walked_where_they_are_written(spark, name):
    """Every file was sent from the workers to Spark and back for its walk."""
    assert executed(QUERIES[name](spark, DIRECTORY)).count("ArrowEvalPython") == 1


def test_tasks_follow_the_number_of_files(spark, monkeypatch):
    """There was a task per core, or per core known at the time, whatever the number of files."""
    monkeypatch.setattr(recordings, "FILES_A_TASK", 100)
    assert recordings.specifications(spark, DIRECTORY).rdd.getNumPartitions() == 15


def odd(spark):
    """Files with faults, one that is NULL, and short and plain ones."""
    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    first = box(b"ftyp", b"isom" + bytes(4))
    entry = box(b"mp4a", bytes(16) + b"\0\1" + bytes(26) + box(b"esds", b"x")) + box(b"avc1", bytes(78) + box(b"avcC", b"y"))
    deep = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + entry) + box(b"stts", bytes(3)))))))
    wide = box(b"moov", (1).to_bytes(4, "big") + b"trak" + (40).to_bytes(8, "big") + box(b"tkhd", b"abc") * 2 + b"\0\0")
    given = [first + deep, first + wide, first + deep[:-3], first + box(b"moov", box(b"tr/k") + box(b"trak", deep)), first, first[:7], b"", None]
    made = spark.createDataFrame([(-1 - i, c and bytearray(c)) for i, c in enumerate(given)], "file_id bigint, content binary")
    faults = recordings.damaged(spark, DIRECTORY).union(recordings.faulty(spark, DIRECTORY).select(-F.col("file_id") - 100, "length", "content"))
    return faults.union(made.select("file_id", F.length("content").cast("bigint"), "content")).localCheckpoint()


def test_a_walk_by_what_is_asked_equals_the_whole(spark):
    """A walk enters only the containers on the way to what is asked, and takes contents as well as segments."""
    files = odd(spark)
    whole = B.walk(B.whole_files(files)).localCheckpoint()
    parts = headers.track_parts(whole)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    for name in [c for c in parts.columns if c not in ("file_id", "track_index")]:
        got = headers.track_parts(B.walk_tracks(files, name))
        assert same(got, parts.select("file_id", "track_index", name)), name
    assert same(B.boxes(B.list_boxes(files)), B.boxes(whole))
    assert same(B.errors(B.walk_held(files)), B.errors(whole))
    assert same(B.boxes(B.list_boxes(files, "size", "parent")), B.boxes(whole).select("file_id", "offset", "size", "parent"))
    path = ["moov", "trak", "mdia", "minf", "stbl", "stsd"]
    assert same(B.descend(B.list_boxes(files, path="/".join(path)), path[0], path[1:]), B.descend(whole, path[0], path[1:]))
    assert same(B.held_bytes(B.walk_held(files)), B.held_bytes(whole))
    assert same(headers.file_types(B.walk_types(files)), headers.file_types(whole))
    assert same(headers.movie_headers(B.walk_held(files, "path", "header")), headers.movie_headers(whole))


def test_payloads_let_go_of_their_batch():
    """F28, F29, and tracks with long payloads: Arrow kept every view it was given, so workers kept all the files they saw."""
    import sys

    import pyarrow as pa

    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    file = box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", box(b"trak", box(b"tkhd", bytes(4000))))
    track = pa.struct([("track_index", pa.int32()), ("tkhd", pa.binary())])
    for asked in ({"tracks": None, "holds": True}, {"tracks": track, "boxes": False}):
        walk, seen = B.walker(B.RULES, whole=True, **asked), bytearray(file)
        before = sys.getrefcount(seen)
        ends = pa.py_buffer(b"".join(n.to_bytes(4, "little") for n in (0, len(file))))
        walk(pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(seen)]))
        assert sys.getrefcount(seen) == before


def test_tiling_is_told_by_the_walk(spark):
    """the whole inventory was stored and every box exchanged, though the walk has the children of each."""
    shown = executed(QUERIES["b11_tiling"](spark, DIRECTORY))
    assert shown.count("Exchange") <= 1 and "Scan ExistingRDD" not in shown
    files = odd(spark)
    every = B.boxes(B.walk_boxes(B.whole_files(files)), "length").withColumn("parent", F.coalesce("parent", F.lit(-1).cast("bigint")))
    holders = every.select(
        "file_id", F.col("offset").alias("parent"), F.expr("offset + header + fields AS start"), F.expr("offset + size AS end")
    )
    top = every.where("ord = 0 AND depth = 0").selectExpr("file_id", "parent", "0L AS start", "length AS end")
    want, got = B.gaps(every, holders.unionByName(top)), B.tilings(files)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert not got.where("NOT tiles").isEmpty()


def test_fingerprints_join_no_tracks(spark):
    """the listings of all tracks were sent to the driver, as Spark took them to be small."""
    shown = executed(QUERIES["e5_structural_fingerprint"](spark, DIRECTORY))
    assert "Join" not in shown and shown.count("Exchange") <= 1
    files = odd(spark)
    walked = B.walk(B.whole_files(files)).localCheckpoint()
    want = digests.structural_fingerprints(walked, headers.track_parts(walked))
    got = digests.structural_fingerprints(B.walk_held(files, tracks=headers.TYPED))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_summaries_are_made_in_the_row(spark):
    """the inventory was stored, and its tracks and boxes met in joins that were planned as broadcasts."""
    shown = executed(QUERIES["h4_probe_summary"](spark, DIRECTORY))
    assert "Join" not in shown and "Scan ExistingRDD" not in shown and shown.count("Exchange") <= 1
    assert shown.count("ArrowEvalPython") == 1
    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    udta = box(b"udta", box(b"zvnd", b"Lavf") + box(b"name", b"Lavc, Lavf"))
    files = [
        ("tags", box(b"ftyp", b"isom" + bytes(4)) + box(b"mdat") + box(b"moov", udta) + box(b"zzzz")),
        ("later", box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", box(b"udta", box(b"name", b"Lavc")) + udta) + box(b"mdat")),
        ("none", box(b"ftyp", b"isom" + bytes(4))),
        ("unread", None),
    ]
    given = spark.createDataFrame([(n, c and bytearray(c)) for n, c in files], "file_id string, content binary")
    made = L.probe_summary(B.walk_held(given, "path", "header", tracks=L.SUMMED))
    got = {r.file_id: (r.moov_before_mdat, r.vendor_boxes, r.foreign_muxer_tags, r.video_tracks, r.encoder_tags, r.container_time) for r in made.collect()}
    assert got == {
        "tags": (False, 2, ["Lavf", "Lavc"], 0, [], None),
        "later": (True, 1, ["Lavc", "Lavf"], 0, [], None),
        "none": (None, 0, [], 0, [], None),
    }


def test_track_records_join_nothing(spark):
    """parts of all tracks were stored, and their digests and edits met in joins, some of them planned as broadcasts."""
    shown = executed(QUERIES["f1_track_records"](spark, DIRECTORY))
    assert "Join" not in shown and "Scan ExistingRDD" not in shown and shown.count("Exchange") <= 1
    files = recordings.faulty(spark, DIRECTORY).where("file_id < 400")
    parts = headers.track_parts(B.walk(B.whole_files(files))).localCheckpoint()
    got = M.track_records(media_places(files, *M.RECORD_PARTS)).localCheckpoint()
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    totals = ["file_id", "track_index", "sample_count", "sync_sample_count", "composition_offsets"]
    assert same(got.where("sample_count IS NOT NULL").select(*totals), headers.totals(parts).select(*totals))
    typed = ["file_id", "track_index", *M.RECORDED, "flags", "enabled"]
    assert same(got.select(*typed), headers.tracks(parts).select(*typed)) and got.count() > 400
    edits = headers.edit_lists(parts).groupBy("file_id", "track_index").count().withColumnRenamed("count", "edits")
    assert same(got.where("edits > 0").select("file_id", "track_index", "edits"), edits)
    assert not got.where("sample_count IS NULL AND payload_sha256 IS NULL").isEmpty()


SAMPLED = {"d10_d13_sample_table": 6, "i11_read_plan": 3, "d8_cross_checks": 6, "d12_sample_offsets": 3}


@pytest.mark.parametrize("name", list(SAMPLED))
def test_tables_of_a_track_meet_once(spark, name, monkeypatch):
    """Every step exchanged all samples or chunks again, for joins and for blocks as many as the lines."""
    shown = executed(QUERIES[name](spark, DIRECTORY))
    assert shown.count("Exchange") <= SAMPLED[name] and "Join" not in shown and "Scan ExistingRDD" not in shown
    got = sorted(map(repr, QUERIES[name](spark, DIRECTORY).collect()))
    monkeypatch.setattr(samples_plan, "small_orders", lambda spark, d: False)
    monkeypatch.setattr(exports_plan, "small_orders", lambda spark, d: False)
    assert got == sorted(map(repr, QUERIES[name](spark, DIRECTORY).collect())) != []


def test_small_keys_counts_every_row(spark):
    rows = spark.range(4000).select((F.col("id") % 50).alias("k"), F.lit(0).alias("t")).union(spark.range(9).select(F.lit(7), F.lit(0)))
    assert small_keys(rows, ["k", "t"], 89) and not small_keys(rows, ["k", "t"], 88)
    # Where keys share a hash, they are told apart.
    assert small_keys(rows, ["k", "t"], 89, buckets=2) and not small_keys(rows, ["k"], 88, buckets=1)


def test_tables_that_agree_are_placed_alike(spark):
    """Several tracks, long runs, empty chunks at the ends of runs, constant sync, gaps between tables' lengths."""
    draw, tables = random.Random(5), {n: [] for n in ("stts", "stsc", "stsz", "stco", "stss", "ctts")}
    for file in range(12):
        for track in range(2):
            per = [draw.randrange(1, 5) for _ in range(draw.randrange(1, 9))]
            key, n = (file, track), sum(per)
            tables["stco"] += [(*key, k + 1, 1000 * k + file) for k in range(len(per))]
            firsts = [k for k in range(len(per)) if k == 0 or per[k] != per[k - 1]]
            tables["stsc"] += [(*key, r, k + 1, per[k], 1) for r, k in enumerate(firsts)]
            tables["stsz"] += [(*key, k, draw.randrange(100)) for k in range(n)]
            cut = draw.randrange(1, n + 1)
            tables["stts"] += [(*key, 0, cut, 7), *([(*key, 1, n - cut, 9)] if n > cut else [])]
            if track:
                tables["stss"] += [(*key, r, s + 1) for r, s in enumerate(range(0, n, 3))]
                tables["ctts"] += [(*key, 0, max(n - 1, 1), -5)]
    names = {"stts": "run n delta", "stsc": "run first_chunk per_chunk description", "stsz": "idx size", "stco": "chunk offset", "stss": "position sample_number", "ctts": "run n offset"}
    frames = [
        spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in f"file_id track_index {names[n]}".split())) for n, rows in tables.items()
    ]
    stts, stsc, stsz, stco, stss, ctts = frames
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())) != []
    assert same(samples.locate_whole(stsc, stco, stsz), samples.locate(stsc, stco, stsz))
    assert same(samples.samples_whole(*frames), samples.samples(*frames))
    place = samples.locate(stsc, stco, stsz)
    assert same(export_plan.read_plan(place, 120, whole=True), export_plan.read_plan(place, 120))
    # Each table in turn loses or doubles rows, so every rule is broken somewhere.
    stco_less, wrong = stco.where("chunk <> 3 OR file_id % 2 = 0"), stsc.withColumns({"per_chunk": F.expr("IF(file_id % 5 = 1, 0, per_chunk)"), "first_chunk": F.expr("IF(file_id % 3 = 1 AND run = 0, 2, first_chunk)")})
    late = stss.withColumn("sample_number", F.expr("IF(file_id % 4 = 2, 4 - sample_number, sample_number)"))
    for given in (frames, (stts.where("run = 0"), stsc, stsz, stco_less, stss, ctts), (stts, wrong, stsz.where("file_id <> 3"), stco, late, ctts), (stts, stsc.where("file_id > 4"), stsz, stco, stss, ctts)):
        want, got = samples.violations(*given), samples.violations_whole(*given)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
