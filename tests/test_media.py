"""Media read where it lies: against the bytes, from content and from paths, and refused with a reason."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from strongroom.operators import boxes as B
from strongroom.operators import digests, headers, media, samples
from strongroom.sources import archive
from strongroom.sources.stored import stored
from tests.test_operators import _corpus, _fold, rows


def placed(files):
    parts = headers.track_parts(B.walk(B.whole_files(files)), "length", "segments")
    return media.places(parts.withColumn("content", F.get("segments", F.lit(0))["bytes"]).drop("segments"))


def table(records, head=b""):
    return bytearray(b"\0" * 4 + head + struct.pack(">I", len(records)) + b"".join(struct.pack(">%dI" % len(r), *r) for r in records))


PARTS = (
    "file_id long, track_index int, tkhd binary, mdhd binary, hdlr binary, stbl long, stsd binary, stts binary, stsc binary, "
    "stsz binary, stz2 binary, stco binary, co64 binary, stss binary, ctts binary, "
    "configuration struct<kind: binary, payload: binary>, content binary, length long"
)


def part(number, sizes, chunks, runs, timed=None, sync=None, composed=None, constant=0, content=b"", avc=None):
    x = bytearray(b"x")
    count = len(sizes) if isinstance(sizes, list) else sizes
    stsz = b"\0" * 4 + struct.pack(">II", constant, count) + b"".join(struct.pack(">I", s) for s in ([] if constant else sizes))
    stts = table([(n, 10) for n in ([count] if timed is None else timed)])
    return (
        number, 0, x, x, x, 1, x, stts, table([(*r, 1) for r in runs]), bytearray(stsz), None, table([(c,) for c in chunks]), None,
        table([(s,) for s in sync]) if sync is not None else None, table([(n, 3) for n in composed]) if composed is not None else None,
        (bytearray(b"avcC"), bytearray(avc)) if avc else None, bytearray(content), len(content),
    )


AVC = bytes.fromhex("01640028" + "FF" + "E1" + "0004" + "67640028" + "01" + "0003" + "68EE3C")


def test_contradictions_equal_the_rules_over_tables(spark):
    draw = random.Random(4)
    made = []
    for k in range(250):
        runs, first = [], 1
        for _ in range(draw.randrange(4)):
            runs.append((first, draw.randrange(1, 4)))
            first += draw.randrange(1, 3)
        chunks = [0] * (first - 1 + (draw.random() < 0.2))
        ends = [r[0] for r in runs[1:]] + [len(chunks) + 1]
        n = sum(max(e - r[0], 0) * r[1] for r, e in zip(runs, ends, strict=True)) if runs else 0
        sync = sorted(draw.sample(range(1, n + 1), min(n, 2)))
        timed, composed = ([n] if n else []), ([n] if n else None)
        for fault in draw.sample(range(9), draw.choice((0, 0, 1, 1, 2))):
            if fault == 0:
                timed = [n + 1]
            elif fault == 1 and runs:
                i = draw.randrange(len(runs))
                runs[i] = (draw.choice((0, 1, 1, 7, 2**32 - 1)), runs[i][1])
            elif fault == 2 and runs:
                runs[-1] = (runs[-1][0], draw.choice((0, 5, 2**32 - 1)))
            elif fault == 3:
                chunks = []
            elif fault == 4:
                runs = []
            elif fault == 5:
                sync = [n + 2]
            elif fault == 6:
                sync = [2, 1]
            elif fault == 7:
                composed = [n + 5]
            elif fault == 8:
                sync = [0, 1]
        made.append(part(k, [1] * n, chunks, runs, timed, sync, composed))
    parts = stored(spark.createDataFrame(made, PARTS))
    got = {r.file_id: r.reason for r in media.refusals(parts).collect()}
    tables = (headers.stts, headers.stsc, headers.stsz, headers.stco, headers.stss, headers.ctts)
    broken = stored(samples.violations(*(stored(t(parts)) for t in tables)))
    want = {r.file_id: r.what for r in samples.first_violation(broken).collect()}
    assert got == want and len(want) > 80 and len(set(want.values())) >= 7


def test_a_lying_count_is_refused_before_anything_is_listed(spark):
    """A constant size declared for 2^32 - 1 samples: no row of it, whatever asks."""
    parts = spark.createDataFrame([part(1, 2**32 - 1, [0], [(1, 4)], timed=[4], constant=8, content=b"0" * 32)], PARTS)
    assert [r.reason for r in media.refusals(parts).collect()] == [samples.RULES[0][1]]
    stts, _, stsz, *_ = headers.run_tables(parts)
    assert stsz.count() == stts.count() == 0
    (row,) = media.digests(media.places(parts)).collect()
    assert row.payload_sha256 is None and row.payload_reason == samples.RULES[0][1] and row.samples is None
    # A count that all tables agree on is believed, and then the file is too short.
    agreed = part(1, 2**32 - 1, [0], [(1, 2**32 - 1)], constant=8, content=b"0" * 32)
    (row,) = media.digests(media.places(spark.createDataFrame([agreed], PARTS))).collect()
    assert row.payload_sha256 is None and row.payload_reason == media.OUT_OF_BOUNDS


def test_payloads_are_read_in_decode_order(spark):
    content = bytes(range(100))
    made = [
        part(1, [3, 4, 5, 6], [50, 10], [(1, 2)], content=content),
        part(2, 6, [90, 0], [(1, 3)], constant=2, content=content),
        part(3, [], [], [], content=content),
        part(4, [3, 98], [0, 3], [(1, 1)], content=content),
        part(5, [60, 60], [0, 30], [(1, 1)], content=content),
    ]
    places = media.places(spark.createDataFrame(made, PARTS))
    got = {r.file_id: (r.samples, r.bytes, r.payload_sha256, r.payload_reason) for r in media.digests(places).collect()}
    joined = {1: content[50:57] + content[10:21], 2: content[90:96] + content[0:6], 3: b"", 5: content[0:60] + content[30:90]}
    counts = {1: 4, 2: 6, 3: 0, 5: 2}
    want = {k: (counts[k], len(v), hashlib.sha256(v).hexdigest(), None) for k, v in joined.items()}
    assert got == want | {4: (2, None, None, media.OUT_OF_BOUNDS)}
    read = {(r.file_id, r.sample_idx): (r.offset, r.size, r.bytes and bytes(r.bytes), r.problem) for r in media.samples(places).collect()}
    assert read[1, 3] == (15, 6, content[15:21], None) and read[2, 3] == (0, 2, content[0:2], None)
    assert read[4, 0] == (0, 3, content[0:3], None) and read[4, 1] == (3, 98, None, media.OUT_OF_BOUNDS)
    assert len(read) == 4 + 6 + 2 + 2
    bare = media.samples(places, with_bytes=False).where("problem IS NULL").select("bytes").distinct().collect()
    assert [r.bytes for r in bare] == [None]


def test_streams_equal_the_fold_and_refuse_malformed_samples():
    draw = random.Random(8)
    for _ in range(300):
        given = [[(draw.choice((1, 5, 5, 7, 8)), draw.random() < 0.4) for _ in range(draw.randint(1, 4))] for _ in range(draw.randint(1, 8))]
        marks = iter(_fold(given))
        width = draw.choice((1, 2, 4))
        stream, want, insertions = media.Stream(width, [b"S1", b"S2"], [b"P"]), b"", 0
        both, pictures = (b"".join(media.LONG_START + u for u in sets) for sets in ((b"S1", b"S2", b"P"), (b"P",)))
        for sample in given:
            stored_sample = b""
            for number, (kind, opens) in enumerate(sample):
                unit = bytes([kind, 0x80 if opens else 0]) + bytes(draw.randrange(5))
                stored_sample += len(unit).to_bytes(width, "big") + unit
                inserted = {"both": both, "pictures": pictures, None: b""}[next(marks)]
                insertions += inserted == both
                want += inserted + (media.SHORT_START if number or inserted else media.LONG_START) + unit
            stream.add(stored_sample)
        assert stream.state.hexdigest() == hashlib.sha256(want).hexdigest() and stream.size == len(want)
        assert (stream.access_units, stream.insertions, stream.reason) == (len(given), insertions, None)
    for broken in (b"\0\0\0\xff\1", b"\0\0\0\1\x65\0\0", b"\0"):
        stream = media.Stream(4, [], [])
        stream.add(b"\0\0\0\1\x65")
        stream.add(broken)
        stream.add(b"\0\0\0\1\x41")
        assert stream.reason == media.RUNS_PAST and stream.access_units == 1


def test_a_malformed_sample_leaves_no_stream_digest(spark):
    """The payload is what it is; the stream has no digest, as a part of it would prove nothing."""
    content = b"\0\0\0\2\x65\x80" + b"\0\0\0\xff\1"
    sets = {"width": 4, "sps": [bytes.fromhex("67640028")], "pps": [bytes.fromhex("68EE3C")]}
    places = media.places(spark.createDataFrame([part(1, [6, 5], [0], [(1, 2)], content=content, avc=AVC)], PARTS))
    assert places.select("avc.*").first().asDict() == sets
    (row,) = media.digests(places).collect()
    assert row.payload_sha256 == hashlib.sha256(content).hexdigest() and row.payload_reason is None
    assert row.stream_sha256 is None and row.stream_bytes is None and row.stream_reason == media.RUNS_PAST
    units = digests.units(media.samples(places).withColumnRenamed("width", "nal_length_size")).collect()
    assert [(u.sample_idx, bytes(u.bytes), u.broken) for u in units] == [(0, b"\x65\x80", False)]


def test_paths_give_what_contents_give(spark, tmp_path):
    files = _corpus(spark).collect()
    for f in files:
        (tmp_path / f.file_id).write_bytes(bytes(f.content))
    (tmp_path / "gone").write_bytes(bytes(files[0].content))
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*(f.file_id for f in files), "gone"]], "path string")
    parts = stored(headers.track_parts(B.walk(archive.header_segments(paths))))
    (tmp_path / "gone").unlink()
    by_path = media.digests(media.places(parts.withColumn("path", F.col("file_id"))))
    by_path = by_path.withColumn("file_id", F.substring_index("file_id", "/", -1))
    by_content = media.digests(placed(spark.createDataFrame(files)))
    read = by_path.where("file_id <> 'gone'")
    assert rows(read, *by_content.columns) == rows(by_content, *by_content.columns)
    assert by_content.where("payload_sha256 IS NOT NULL").count() == 11
    gone = by_path.where("file_id = 'gone'").collect()
    assert len(gone) == 2 and all(r.payload_sha256 is None and "FileNotFoundError" in r.payload_reason for r in gone)
    whole = {r.file_id.rsplit("/", 1)[1]: r for r in media.file_digests(paths).collect()}
    assert all(whole[f.file_id].sha256 == hashlib.sha256(bytes(f.content)).hexdigest() for f in files)
    assert whole["gone"].sha256 is None and "FileNotFoundError" in whole["gone"].reason


def test_no_exchange_holds_media(spark):
    plan = media.digests(placed(stored(_corpus(spark))))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_two_cameras_are_told_apart(spark):
    made = _corpus(spark)
    first = placed(made)
    # A second camera that lies on the same bytes as the first.
    second = first.where("track_index = 0").withColumn("track_index", F.lit(2).cast(first.schema["track_index"].dataType))
    got = media.digests(first.unionByName(second)).where("track_index <> 1")
    one = {(r.file_id, r.track_index): r.stream_sha256 for r in got.collect()}
    assert len(one) == 12 and all(one[f, 0] == one[f, 2] is not None for f, _ in one)
