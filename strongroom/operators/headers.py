"""Typed headers and run tables, projected from the payloads of the movie box.

The walk looks the parts of a track up, first match at each step, so a table of tracks costs one
generator and no join. Fields are fixed-offset expressions over the payloads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.functions.binding import let
from strongroom.functions.bytes import code, i16, i32, i64, one_of, shown, slice_, u8, u16, u32, u64, unsigned, versioned
from strongroom.operators.boxes import AUDIO, VISUAL, read
from strongroom.operators.samples import RULES, SPAN
from strongroom.operators.tree import RUN_TABLES

# The handlers of the two kinds of track, and the parts it needs.
HANDLERS = (("vide", "video"), ("soun", "audio"))
REQUIRED = (
    ("tkhd", "track header"),
    ("mdhd", "media header"),
    ("hdlr", "handler reference"),
    ("stbl", "sample table"),
    ("stsd", "sample description"),
    ("stts", "time-to-sample table"),
    ("stsc", "sample-to-chunk table"),
    ("sizes", "sample size table"),
    ("offsets", "chunk offset table"),
)
# The columns of a track that tell whether its tables are sound, and what they place.
TABLES = ("tkhd", "mdhd", "hdlr", "stbl", "stsd", *RUN_TABLES)


def _payload(box: Column, movie: Column) -> Column:
    return slice_(movie["bytes"], box["offset"] + box["header"] - movie["offset"], box["size"] - box["header"])


def track_parts(walked: DataFrame, *keep: str) -> DataFrame:
    """One row per track with the payload of every box its description needs, NULL where absent, beside columns of the
    file that are kept."""
    return walked.select("file_id", *keep, F.inline_outer("tracks")).where("track_index IS NOT NULL")


def file_type_payload() -> Column:
    """The payload of a file's type box, or NULL."""
    first = F.get(
        F.filter("boxes", lambda b: (b["depth"] == 0) & (b["kind"] == code("ftyp")) & b["error"].isNull() & ~b["clipped"]), F.lit(0)
    )
    return let(first, lambda b: read(F.col("segments"), b["offset"] + b["header"], b["size"] - b["header"]))


def brands(p: Column) -> tuple[Column, Column]:
    """The brand and the compatible brands that the payload of a file type box of at least eight bytes names."""
    listed = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(p) - 8) / 4).cast("int") - 1), lambda i: shown(slice_(p, i * 4 + 8, 4))
    )
    return shown(slice_(p, 0, 4)), F.when(F.length(p) < 12, F.array().cast("array<string>")).otherwise(listed)


def file_types(walked: DataFrame) -> DataFrame:
    """Brand, version and compatible brands of files that have a file type box."""
    rows = walked.select("file_id", F.inline_outer(F.array(F.struct(file_type_payload().alias("payload")))))
    p = F.col("payload")
    major, compatible = brands(p)
    return rows.where(F.length("payload") >= 8).select(
        "file_id", major.alias("major_brand"), u32(p, 4).alias("minor_version"), compatible.alias("compatible_brands")
    )


def movie_header_payload() -> Column:
    """The payload of a file's movie header, or NULL."""
    first = F.get(F.filter("boxes", lambda b: (b["path"] == "moov/mvhd") & b["error"].isNull()), F.lit(0))
    return let(first, lambda b: _payload(b, F.col("movie")))


def movie_headers(walked: DataFrame) -> DataFrame:
    """Times, timescale, duration and next identifier; versions 0 and 1 only."""
    rows = walked.select("file_id", F.inline_outer(F.array(F.struct(movie_header_payload().alias("payload")))))
    p, version = F.col("payload"), u8(F.col("payload"), 0)
    return rows.select(
        "file_id",
        version.alias("version"),
        versioned(p, version, 4, 4).alias("creation_time"),
        versioned(p, version, 8, 12).alias("modification_time"),
        F.when(version == 0, u32(p, 12)).when(version == 1, u32(p, 20)).alias("timescale"),
        versioned(p, version, 16, 24).alias("duration"),
        F.when(version == 0, u32(p, 96)).when(version == 1, u32(p, 108)).alias("next_track_id"),
        header_error(p, version, "mvhd", 100, 112).alias("error"),
    )


def header_error(payload: Column, version: Column, kind: str, narrow: int, wide: int) -> Column:
    """Why a versioned header cannot be read, or NULL."""
    return (
        F.when(payload.isNull(), F.lit(f"{kind} is missing"))
        .when(version.isNull(), F.lit(f"{kind} is truncated"))
        .when(~version.isin(0, 1), F.concat(F.lit(f"{kind} has the unknown version "), version.cast("string")))
        .when(F.length(payload) < F.when(version == 0, narrow).otherwise(wide), F.lit(f"{kind} is truncated"))
    )


def track_headers(parts: DataFrame, *keep: str) -> DataFrame:
    """Flags, identifier, times, duration, layer, group, volume and presentation size."""
    p, v = F.col("tkhd"), u8(F.col("tkhd"), 0)
    late = F.when(v == 1, 12).otherwise(0)
    flags = unsigned(p, 1, 3)
    return parts.select(
        "file_id",
        "track_index",
        *keep,
        flags.alias("flags"),
        (flags.bitwiseAND(1) == 1).alias("enabled"),
        versioned(p, v, 4, 4).alias("creation_time"),
        versioned(p, v, 8, 12).alias("modification_time"),
        u32(p, F.when(v == 1, 20).otherwise(12)).alias("track_id"),
        versioned(p, v, 20, 28).alias("duration"),
        i16(p, late + 32).alias("layer"),
        i16(p, late + 34).alias("alternate_group"),
        u16(p, late + 36).alias("volume"),
        u32(p, late + 76).alias("width_fixed"),
        u32(p, late + 80).alias("height_fixed"),
        header_error(p, v, "tkhd", 84, 96).alias("error"),
    )


def language(packed: Column) -> Column:
    """Three letters of five bits each."""
    letter = lambda shift: F.chr(F.shiftright(packed, shift).bitwiseAND(0x1F) + 0x60)
    return F.concat(letter(10), letter(5), letter(0))


def media_headers(parts: DataFrame) -> DataFrame:
    """Timescale, duration and language."""
    p, v = F.col("mdhd"), u8(F.col("mdhd"), 0)
    return parts.select(
        "file_id",
        "track_index",
        F.when(v == 0, u32(p, 12)).when(v == 1, u32(p, 20)).alias("timescale"),
        versioned(p, v, 16, 24).alias("duration_ticks"),
        language(u16(p, F.when(v == 1, 32).otherwise(20)).cast("int")).alias("language"),
        header_error(p, v, "mdhd", 22, 34).alias("error"),
    )


def without_trailing_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00+\z", "")


def lossy_text(data: Column) -> Column:
    """Bytes as UTF-8, what is not UTF-8 as replacement characters."""
    return F.make_valid_utf8(data.cast("string"))


def handlers(parts: DataFrame) -> DataFrame:
    """Handler code, name, and the kind of track it makes."""
    p = F.col("hdlr")
    kind = slice_(p, 8, 4)
    of_kind = F.when(kind == code(HANDLERS[0][0]), HANDLERS[0][1]).when(kind == code(HANDLERS[1][0]), HANDLERS[1][1])
    return parts.select(
        "file_id",
        "track_index",
        shown(kind).alias("handler_type"),
        without_trailing_zeros(lossy_text(slice_(p, 24, F.length(p) - 24))).alias("handler_name"),
        F.coalesce(of_kind, F.concat(F.lit("other:"), shown(kind))).alias("kind"),
        F.when(p.isNull(), "hdlr is missing").when(F.length(p) < 24, "hdlr is truncated").alias("error"),
    )


def sample_entries(parts: DataFrame) -> DataFrame:
    """Coding with its visual or audio fields, and the decoder configuration beside it."""
    e, at = F.col("entry"), F.col("entry_header")
    visual, audio = one_of(F.col("entry_kind"), VISUAL), one_of(F.col("entry_kind"), AUDIO)
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    named = F.least(or_zero(u8(e, at + 42)), F.lit(31))
    a = avc_fields(F.col("configuration.payload"))
    avc = F.col("configuration.kind") == code("avcC")
    return parts.select(
        "file_id",
        "track_index",
        F.coalesce(shown(F.col("entry_kind")), F.lit("none")).alias("coding"),
        u32(F.col("stsd"), 4).alias("declared_entries"),
        or_zero(u16(e, at + 6)).alias("data_reference_index"),
        F.when(visual, or_zero(u16(e, at + 24))).alias("width"),
        F.when(visual, or_zero(u16(e, at + 26))).alias("height"),
        F.when(visual, or_zero(u16(e, at + 40))).alias("frame_count"),
        F.when(visual, without_trailing_zeros(lossy_text(slice_(e, at + 43, named)))).alias("compressor"),
        F.when(visual, or_zero(u16(e, at + 74))).alias("depth"),
        F.when(audio, or_zero(u16(e, at + 8))).alias("entry_version"),
        F.when(audio, or_zero(u16(e, at + 16))).alias("channels"),
        F.when(audio, or_zero(u16(e, at + 18))).alias("sample_size"),
        F.when(audio, F.shiftright(or_zero(u32(e, at + 24)), 16)).alias("sample_rate"),
        shown(F.col("configuration.kind")).alias("configuration_kind"),
        F.col("configuration.payload").alias("configuration_payload"),
        F.when(
            avc & a["valid"],
            F.format_string("%s.%02X%02X%02X", shown(F.col("entry_kind")), a["profile"], a["compatibility"], a["level"]),
        ).alias("codec_string"),
        F.when(avc & a["valid"], a["length_size"]).alias("nal_length_size"),
    )


def avc_fields(payload: Column) -> dict[str, Column]:
    """The leading fields of an AVC decoder configuration."""
    return {
        "valid": (u8(payload, 0) == 1) & avc_sets(payload)["complete"],
        "profile": u8(payload, 1),
        "compatibility": u8(payload, 2),
        "level": u8(payload, 3),
        "length_size": u8(payload, 4).bitwiseAND(3) + 1,
    }


def avc_sets(payload: Column) -> Column:
    """Parameter sets of an AVC configuration, walked by their length prefixes."""
    none = F.array().cast("array<binary>")

    def take(state: Column, _: Column) -> Column:
        return let(
            u16(payload, state["at"]),
            lambda size: F.struct(
                (state["at"] + 2 + F.coalesce(size, F.lit(1 << 30))).cast("int").alias("at"),
                F.concat(state["sets"], F.array(slice_(payload, state["at"] + 2, size))).alias("sets"),
            ),
        )

    def listed(count: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), none.alias("sets"))
        return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count.cast("int")), zero, take)).otherwise(zero)

    sps = listed(u8(payload, 5).bitwiseAND(0x1F), F.lit(6))
    return let(
        sps,
        lambda s: let(
            listed(F.coalesce(u8(payload, s["at"]), F.lit(0)), s["at"] + 1),
            lambda p: F.struct(
                s["sets"].alias("sps"),
                p["sets"].alias("pps"),
                (u8(payload, s["at"]).isNotNull() & (p["at"] <= F.length(payload))).alias("complete"),
            ),
        ),
    )


def is_avc() -> Column:
    """Whether a track has an AVC configuration."""
    return F.coalesce(F.col("configuration.kind") == code("avcC"), F.lit(False))


def avc_tracks(parts: DataFrame) -> DataFrame:
    """The parts of the tracks with an AVC configuration."""
    return parts.where(is_avc())


def parameter_sets(parts: DataFrame) -> DataFrame:
    """Sequence and picture parameter sets of tracks with an AVC configuration."""
    avc = avc_tracks(parts)
    sets = avc_sets(F.col("configuration.payload"))
    return (
        avc.select("file_id", "track_index", F.col("configuration.payload").alias("payload"), F.inline_outer(F.array(sets)))
        .where("complete")
        .where(u8(F.col("payload"), 0) == 1)
        .select("file_id", "track_index", "sps", "pps", (u8(F.col("payload"), 4).bitwiseAND(3) + 1).alias("nal_length_size"))
    )


def _counted(payload: Column, head: int, width: int) -> Column:
    """How many records a counted table declares; NULL where its payload holds fewer."""
    declared = u32(payload, head - 4)
    return F.when(declared * width + head <= F.length(payload), declared).cast("int")


def _records(payload: Column, head: int, width: int, make) -> Column:
    """The records of a counted table as an array of structs."""
    count = _counted(payload, head, width)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: make(i * width + head)))


def edits() -> Column:
    """The entries of a track's edit list as an array, NULL where it lists none; the media time is signed."""
    p, v = F.col("elst"), u8(F.col("elst"), 0)
    narrow = _records(
        p,
        8,
        12,
        lambda at: F.struct(
            u32(p, at).cast("decimal(20,0)").alias("segment_duration"), i32(p, at + 4).alias("media_time"), u32(p, at + 8).alias("media_rate")
        ),
    )
    wide = _records(
        p,
        8,
        20,
        lambda at: F.struct(u64(p, at).alias("segment_duration"), i64(p, at + 8).alias("media_time"), u32(p, at + 16).alias("media_rate")),
    )
    return F.when(v == 0, narrow).when(v == 1, wide)


def edit_lists(parts: DataFrame) -> DataFrame:
    """Edit list entries, one row each."""
    return parts.where("elst IS NOT NULL").select("file_id", "track_index", F.posexplode(edits()).alias("ord", "e")).select(
        "file_id", "track_index", "ord", "e.*"
    )


def _table(parts: DataFrame, records: Column, index: str, first: int = 0) -> DataFrame:
    rows = parts.select("file_id", "track_index", F.posexplode_outer(records).alias("__i", "r")).where("r IS NOT NULL")
    return rows.select("file_id", "track_index", (F.col("__i").cast("bigint") + first).alias(index), "r.*")


def stts(parts: DataFrame) -> DataFrame:
    p = F.col("stts")
    return _table(parts, _records(p, 8, 8, lambda at: F.struct(u32(p, at).alias("n"), u32(p, at + 4).alias("delta"))), "run")


def chunk_runs() -> Column:
    """The sample-to-chunk table as an array, empty where it lists nothing."""
    p = F.col("stsc")
    make = lambda at: F.struct(
        u32(p, at).alias("first_chunk"), u32(p, at + 4).alias("per_chunk"), u32(p, at + 8).alias("description")
    )
    nothing = F.array().cast("array<struct<first_chunk:bigint,per_chunk:bigint,description:bigint>>")
    return F.coalesce(_records(p, 8, 12, make), nothing)


def stsc(parts: DataFrame) -> DataFrame:
    return _table(parts, chunk_runs(), "run")


def size_lists() -> tuple[Column, Column]:
    """The constant of a plain size table, and the sizes that a plain or compact table lists."""
    p, c = F.col("stsz"), F.col("stz2")
    constant = u32(p, 4)
    one = lambda value: F.struct(value.alias("size"))
    listed = _records(p, 12, 4, lambda at: one(u32(p, at)))
    bits = u8(c, 7)
    nibbles = F.when(
        (u32(c, 8) > 0) & (u32(c, 8) <= (F.length(c) - 12) * 2),
        F.transform(
            F.sequence(F.lit(0), u32(c, 8).cast("int") - 1),
            lambda i: one(
                let(
                    u8(c, F.floor(i / 2) + 12),
                    lambda b: F.when(i % 2 == 0, F.shiftright(b, 4)).otherwise(b.bitwiseAND(15)),
                )
            ),
        ),
    )
    compact = (
        F.when(bits == 4, nibbles)
        .when(bits == 8, _records(c, 12, 1, lambda at: one(u8(c, at))))
        .when(bits == 16, _records(c, 12, 2, lambda at: one(u16(c, at))))
    )
    return constant, F.when(p.isNull(), compact).when(constant == 0, listed)


def stsz(parts: DataFrame) -> DataFrame:
    """Sizes from the plain or the compact table; a constant size is repeated per sample.

    A constant is listed span by span, so no array is longer than a span, whatever count is declared.
    """
    p = F.col("stsz")
    declared = u32(p, 8).cast("bigint")
    constant, given = size_lists()
    one = lambda value: F.struct(value.alias("size"))
    start = lambda at: at.cast("bigint").alias("start")
    repeated = F.transform(
        F.sequence(F.lit(0), F.floor((declared - 1) / SPAN).cast("int")),
        lambda s: F.struct(start(s.cast("bigint") * SPAN), F.least(declared, (s.cast("bigint") + 1) * SPAN).cast("bigint").alias("end"), given.alias("sizes")),
    )
    whole = F.array(F.struct(start(F.lit(0)), F.lit(0).cast("bigint").alias("end"), given.alias("sizes")))
    spans = F.when(p.isNotNull() & (constant != 0), F.when(declared > 0, repeated)).otherwise(whole)
    cut = parts.select("file_id", "track_index", constant.alias("__constant"), F.explode(spans).alias("__span"))
    again = F.when(
        F.col("__span.end") > F.col("__span.start"),
        F.transform(F.sequence(F.col("__span.start"), F.col("__span.end") - 1), lambda i: one(F.col("__constant"))),
    )
    return cut.select(
        "file_id", "track_index", "__span", F.posexplode(F.coalesce("__span.sizes", again)).alias("__i", "r")
    ).select("file_id", "track_index", (F.col("__span.start") + F.col("__i")).alias("idx"), "r.*")


def chunk_offsets() -> Column:
    """Chunk offsets as an array, from the wide table when there is one."""
    n, w = F.col("stco"), F.col("co64")
    narrow = _records(n, 8, 4, lambda at: F.struct(u32(n, at).alias("offset")))
    wide = _records(w, 8, 8, lambda at: F.struct(u64(w, at).cast("bigint").alias("offset")))
    return F.when(w.isNotNull(), wide).otherwise(narrow)


def stco(parts: DataFrame) -> DataFrame:
    """Chunk offsets; chunks count from one."""
    return _table(parts, chunk_offsets(), "chunk", 1)


def stss(parts: DataFrame) -> DataFrame:
    p = F.col("stss")
    return _table(parts, _records(p, 8, 4, lambda at: F.struct(u32(p, at).alias("sample_number"))), "position")


def ctts(parts: DataFrame) -> DataFrame:
    """Composition runs: unsigned in version 0, signed in version 1."""
    p, v = F.col("ctts"), u8(F.col("ctts"), 0)
    make = lambda at: F.struct(
        u32(p, at).alias("n"), F.when(v == 0, u32(p, at + 4)).otherwise(i32(p, at + 4)).alias("offset")
    )
    return _table(parts, _records(p, 8, 8, make), "run")


def run_tables(parts: DataFrame) -> tuple[DataFrame, ...]:
    """The six tables in the order the sample operators take them, of the tracks whose tables are sound."""
    parts = sound(parts)
    return stts(parts), stsc(parts), stsz(parts), stco(parts), stss(parts), ctts(parts)


def _problems() -> Column:
    """What is wrong with a track's run tables, as an array."""
    sizes, offsets = F.coalesce("stsz", "stz2"), F.coalesce("co64", "stco")
    present = {"sizes": sizes, "offsets": offsets}
    missing = [
        F.when(present.get(name, F.col(name)).isNull(), F.lit(f"{text} is missing")) for name, text in REQUIRED
    ]
    short = []
    for name, head, width in (("stts", 8, 8), ("stsc", 8, 12), ("stco", 8, 4), ("co64", 8, 8), ("stss", 8, 4), ("ctts", 8, 8)):
        p = F.col(name)
        declared = F.coalesce(u32(p, head - 4), F.lit(1))
        short.append(F.when(declared * width + head > F.length(p), F.lit(f"{name} is truncated")))
    plain = F.col("stsz")
    short.append(
        F.when((u32(plain, 4) == 0) & (u32(plain, 8) * 4 + 12 > F.length(plain)), F.lit("stsz is truncated"))
    )
    compact, bits = F.col("stz2"), u8(F.col("stz2"), 7)
    short.append(F.when(~bits.isin(4, 8, 16), F.concat(F.lit("stz2 has the unknown version "), bits.cast("string"))))
    short.append(F.when(u32(compact, 8) * bits > (F.length(compact) - 12) * 8, F.lit("stz2 is truncated")))
    return F.array_compact(F.array(*missing, *short))


def table_problems(parts: DataFrame) -> DataFrame:
    """Run tables shorter than they declare, and required parts a track lacks."""
    return parts.select("file_id", "track_index", F.explode(_problems()).alias("problem"))


def _total(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, v: a + v)


def contradiction() -> Column:
    """The first cross-check that a track's run tables break, decided on runs and counts alone, or NULL.

    The order is that of RULES, rules two to four run by run.
    """
    p = {name: F.col(name) for name in RUN_TABLES}
    sized = F.when(p["stsz"].isNotNull(), u32(p["stsz"], 8)).otherwise(u32(p["stz2"], 8)).cast("bigint")
    chunks = F.when(p["co64"].isNotNull(), u32(p["co64"], 4)).otherwise(u32(p["stco"], 4)).cast("bigint")
    timed = _total(_records(p["stts"], 8, 8, lambda at: u32(p["stts"], at)))
    composed = F.when(u32(p["ctts"], 4) > 0, _total(_records(p["ctts"], 8, 8, lambda at: u32(p["ctts"], at))))
    syncs = F.coalesce(_records(p["stss"], 8, 4, lambda at: u32(p["stss"], at)), F.array().cast("array<bigint>"))

    def checked(runs: Column, numbers: Column, known: Column) -> Column:
        first, sized, chunks = (lambda i: F.get(runs, i)["first_chunk"]), known["sized"], known["chunks"]
        # A run past the last chunk holds none; whatever else it says is told by the rules before the seventh.
        held = F.transform(
            runs,
            lambda r, i: F.greatest(F.least(F.coalesce(first(i + 1), chunks + 1), chunks + 1) - r["first_chunk"], F.lit(0))
            * r["per_chunk"],
        )
        broken = F.transform(
            runs,
            lambda r, i: F.when((r["first_chunk"] == 0) | ((i > 0) & (r["first_chunk"] <= first(i - 1))), 2)
            .when(r["first_chunk"] > chunks, 3)
            .when(r["per_chunk"] == 0, 4),
        )
        misplaced = F.exists(
            F.transform(
                numbers, lambda s, i: (s <= F.coalesce(F.get(numbers, i - 1), F.lit(0))) | (s > sized)
            ),
            lambda wrong: wrong,
        )
        return F.coalesce(
            F.when(known["timed"] != sized, 1),
            F.get(F.filter(broken, lambda rule: rule.isNotNull()), F.lit(0)),
            F.when((sized > 0) & ((F.size(runs) == 0) | (chunks == 0)), 5),
            F.when(first(F.lit(0)) != 1, 6),
            F.when(_total(held) != sized, 7),
            F.when(misplaced, 8),
            F.when(known["composed"] != sized, 9),
        )

    known = F.struct(
        sized.alias("sized"), chunks.alias("chunks"), timed.alias("timed"), composed.alias("composed")
    )
    rule = let(chunk_runs(), lambda r: let(syncs, lambda s: let(known, lambda k: checked(r, s, k))))
    texts = F.create_map(*[F.lit(part) for rule in RULES for part in rule])
    return texts[rule]


def refusal() -> Column:
    """Why a track may not be listed: a missing or short table, or the first contradiction; else NULL."""
    return F.coalesce(F.get(_problems(), F.lit(0)), contradiction())


def sound(parts: DataFrame) -> DataFrame:
    """The tracks that say nothing wrong: the only ones whose samples may be listed or totalled."""
    return parts.where(refusal().isNull())


def _totalled() -> tuple[Column, Column, Column]:
    """Count and bytes of a sound track's samples, how many sync samples it lists, and whether any is moved."""
    constant, given = size_lists()
    p, c, v = F.col("stsz"), F.col("ctts"), u8(F.col("ctts"), 0)
    declared = u32(p, 8).cast("bigint")
    repeated = p.isNotNull() & (constant != 0)
    listed = let(given, lambda sizes: F.struct(
        F.size(sizes).cast("bigint").alias("sample_count"), _total(F.transform(sizes, lambda s: s["size"].cast("bigint"))).alias("sample_bytes")
    ))
    summed = F.when(repeated, F.struct(declared.alias("sample_count"), (declared * constant).cast("bigint").alias("sample_bytes"))).otherwise(listed)
    moves = _records(c, 8, 8, lambda at: F.when(v == 0, u32(c, at + 4)).otherwise(i32(c, at + 4)))
    syncs = _counted(F.col("stss"), 8, 4).cast("bigint")
    return summed, F.when(syncs > 0, syncs), F.coalesce(F.exists(moves, lambda o: o != 0), F.lit(False))


def totals(parts: DataFrame) -> DataFrame:
    """What ``samples.totals`` says, of the tracks that say nothing wrong and list a sample, from their tables alone.

    Every table is in its track's row, so nothing is listed sample by sample or exchanged.
    """
    summed, listed, moved = _totalled()
    rows = sound(parts).select(
        "file_id", "track_index", listed.alias("listed"), moved.alias("composition_offsets"), F.inline_outer(F.array(summed))
    )
    return rows.where("sample_count > 0").select(
        "file_id", "track_index", "sample_count", "sample_bytes", F.coalesce("listed", "sample_count").alias("sync_sample_count"), "composition_offsets"
    )


def with_totals(placed: DataFrame) -> DataFrame:
    """Adds what ``totals`` says to rows of ``media.places``, NULL for a track with a reason or without a sample."""
    summed, listed, moved = _totalled()
    rows = placed.withColumn("__s", F.when(F.col("reason").isNull(), summed))
    some = F.col("__s.sample_count") > 0
    return rows.withColumns(
        {
            "sample_count": F.when(some, F.col("__s.sample_count")),
            "sample_bytes": F.when(some, F.col("__s.sample_bytes")),
            "sync_sample_count": F.when(some, F.coalesce(listed, F.col("__s.sample_count"))),
            "composition_offsets": F.when(some, moved),
        }
    ).drop("__s")


def duration_ms(duration: Column, timescale: Column) -> Column:
    """Whole milliseconds, NULL when the timescale is zero."""
    scaled = (duration.cast("decimal(20,0)") * 1000).cast("decimal(28,0)")
    return F.when(timescale != 0, F.floor(scaled / timescale.cast("decimal(20,0)"))).cast("bigint")


def typed(part: Callable[[str], Column]) -> dict[str, Column]:
    """The typed columns of a track; ``part`` gives a part by its name, of a row of parts or of one of a file's tracks."""
    t, p = part("tkhd"), part("mdhd")
    u, v = u8(t, 0), u8(p, 0)
    flags = unsigned(t, 1, 3)
    timescale = F.when(v == 0, u32(p, 12)).when(v == 1, u32(p, 20))
    ticks = versioned(p, v, 16, 24)
    handler = slice_(part("hdlr"), 8, 4)
    kind = F.when(handler == code("vide"), "video").when(handler == code("soun"), "audio").otherwise(
        F.concat(F.lit("other:"), shown(handler))
    )
    entry, at, entry_kind = part("entry"), part("entry_header"), part("entry_kind")
    visual, audio = one_of(entry_kind, VISUAL), one_of(entry_kind, AUDIO)
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    named = F.least(or_zero(u8(entry, at + 42)), F.lit(31))
    configuration = part("configuration")
    a = avc_fields(configuration["payload"])
    avc = (configuration["kind"] == code("avcC")) & a["valid"]
    return {
        "track_index": part("track_index"),
        "track_id": u32(t, F.when(u == 1, 20).otherwise(12)),
        "kind": kind,
        "coding": F.coalesce(shown(entry_kind), F.lit("none")),
        "codec_string": F.when(avc, F.format_string("%s.%02X%02X%02X", shown(entry_kind), a["profile"], a["compatibility"], a["level"])),
        "width": F.when(visual, or_zero(u16(entry, at + 24))),
        "height": F.when(visual, or_zero(u16(entry, at + 26))),
        "sample_rate": F.when(audio, F.shiftright(or_zero(u32(entry, at + 24)), 16)),
        "channels": F.when(audio, or_zero(u16(entry, at + 16))),
        "timescale": timescale,
        "duration_ticks": ticks,
        "duration_ms": duration_ms(ticks, timescale),
        "flags": flags,
        "enabled": flags.bitwiseAND(1) == 1,
        "handler_name": without_trailing_zeros(lossy_text(slice_(part("hdlr"), 24, F.length(part("hdlr")) - 24))),
        "compressor": F.when(visual, without_trailing_zeros(lossy_text(slice_(entry, at + 43, named)))),
        "configuration_kind": shown(configuration["kind"]),
        "configuration_payload": configuration["payload"],
        "nal_length_size": F.when(avc, a["length_size"]),
        **{name: part(name) for name in ("track_children", "table_children", "entry_children")},
    }


# The parts that the typed columns are made of.
TYPED = ("tkhd", "mdhd", "hdlr", "stsd", "entry_kind", "entry_header", "entry", "configuration", "track_children", "table_children", "entry_children")


def tracks(parts: DataFrame) -> DataFrame:
    """Typed tracks, all narrow projections of one row per track."""
    return parts.select("file_id", *[c.alias(name) for name, c in typed(F.col).items()])
