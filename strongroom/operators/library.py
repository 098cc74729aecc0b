"""Library detection: file names, probe summaries, recordings, siblings and signs of a rewrite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.functions.binding import let
from strongroom.functions.bytes import code, one_of, slice_, u8, versioned
from strongroom.operators.boxes import KNOWN_TOP_LEVEL, is_standard
from strongroom.operators.headers import movie_header_payload, typed
from strongroom.operators.manifest import civil_1904

# Extensions opened by a scan, and those a recording's name may carry.
SCANNED_EXTENSIONS = ("mp4", "mov", "m4v", "3gp", "3g2")
NAME_EXTENSIONS = ("mp4", "mov")
# Camera words, the letters of the two letter grammars, member order.
CAMERA_WORDS = (
    ("front", "front"),
    ("back", "rear"),
    ("rear", "rear"),
    ("interior", "interior"),
)
CAMERA_LETTERS = (("F", "front"), ("R", "rear"), ("I", "interior"))
EVENT_LETTERS = (("E", "event"), ("M", "manual"), ("N", "normal"))
CAMERA_RANK = (("front", 0), ("rear", 1), ("interior", 2), ("all", 3))
# The grammar measured on a recorder, whose files carry vendor boxes; tags of other muxers.
MEASURED_GRAMMAR = "timestamp_event_letter"
FOREIGN_TAGS = ("Lavf", "Lavc")
# Signs in the order they are reported.
SIGNS = (
    "moov_after_mdat",
    "foreign_muxer_tag",
    "single_video_track_where_sibling_has_two",
    "vendor_boxes_absent",
    "resolution_below_siblings",
)

# The bounds of a time in a name are part of its pattern: years 2000 to 2099, days to 31 in any month.
_YEAR, _MONTH, _DAY = r"20\d{2}", "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_HOUR, _SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
STAMP = (
    f"(?:{_YEAR}{_MONTH}{_DAY}_{_HOUR}{_SIXTY}{_SIXTY}"
    f"|{_YEAR}-{_MONTH}-{_DAY}_{_HOUR}-{_SIXTY}-{_SIXTY})"
)
_PARTS = r"^(\d{4})-?(\d{2})-?(\d{2})_(\d{2})-?(\d{2})-?(\d{2})$"


def lookup(column: Column, pairs: tuple) -> Column:
    """A small fixed mapping as a chain of cases."""
    found = F.when(column == pairs[0][0], F.lit(pairs[0][1]))
    for key, value in pairs[1:]:
        found = found.when(column == key, F.lit(value))
    return found


def extension(name: Column) -> Column:
    """What follows the last dot, lower case; NULL without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def split_extension(name: Column) -> Column:
    """The part before the last dot when the extension is one a recording carries."""
    pattern = rf"(?is)^(.*)\.({'|'.join(NAME_EXTENSIONS)})\z"
    return let(name, lambda n: F.when(n.rlike(pattern), F.regexp_extract(n, pattern, 1)))


def timestamp(text: Column) -> Column:
    """The time a text opens with, as ``YYYY-MM-DDTHH:MM:SS``; 31 February is accepted, so it stays text."""
    stamp = F.regexp_extract(text, f"^({STAMP})", 1)
    return F.nullif(F.regexp_replace(stamp, _PARTS, "$1-$2-$3T$4:$5:$6"), F.lit(""))


def parse_name(name: Column) -> Column:
    """The first of the three grammars that fits, as one struct, or NULL."""
    return let(split_extension(name), _parse_stem)


def _parse_stem(stem: Column) -> Column:
    def parsed(pattern: str, grammar: str, camera, event, timed: bool) -> Column:
        part = lambda group: F.regexp_extract(stem, pattern, group)
        return F.when(
            stem.rlike(pattern),
            F.struct(
                F.lit(grammar).alias("grammar"),
                part(1).alias("stem"),
                camera(part(2)).alias("camera"),
                event(part(2)).alias("event"),
                timestamp(part(1) if timed else stem).alias("time"),
            ),
        )

    none = lambda _: F.lit(None).cast("string")
    words = "|".join(word for word, _ in CAMERA_WORDS)
    return F.coalesce(
        parsed(
            rf"^({STAMP})([EMN])\z",
            "timestamp_event_letter",
            lambda _: F.lit("all"),
            lambda letter: lookup(letter, EVENT_LETTERS),
            False,
        ),
        parsed(
            rf"(?is)^(.+)[-_]({words})\z",
            "stem_camera_word",
            lambda word: lookup(F.lower(word), CAMERA_WORDS),
            none,
            True,
        ),
        parsed(
            rf"^({STAMP})_?([FRIfri])[HLhl]?\z",
            "stem_camera_letter",
            lambda letter: lookup(F.upper(letter), CAMERA_LETTERS),
            none,
            False,
        ),
    )


def worth_opening(name: Column) -> Column:
    """A recording's extension, or a name that fits a grammar."""
    return F.coalesce(extension(name).isin(*SCANNED_EXTENSIONS), F.lit(False)) | parse_name(name).isNotNull()


def probe_summary(walked: DataFrame) -> DataFrame:
    """Eleven facts per file from its tracks, its boxes and its movie header.

    ``walked`` is a walk with ``boxes``, ``tracks`` and ``movie``. All of a file is in its row and bounded by the caps of
    the walk, so each fact is worked out there: nothing is exchanged, joined or stored.
    """
    fine = F.filter("boxes", lambda b: b["error"].isNull() & b["offset"].isNotNull())
    rows = walked.select("file_id", "movie", movie_header_payload().alias("header"), fine.alias("boxes"), _facts().alias("tracks"))
    top = F.filter("boxes", lambda b: b["depth"] == 0)
    under = F.filter("boxes", lambda b: b["path"].startswith("moov/udta/"))
    unknown = lambda b: (b["depth"] == 0) & ~one_of(b["kind"], KNOWN_TOP_LEVEL) & ~b["clipped"]
    own = lambda b: b["path"].startswith("moov/udta/") & ~is_standard(b["kind"])
    at = lambda kind: F.array_min(F.transform(F.filter("top", lambda b: b["kind"] == code(kind)), lambda b: b["offset"]))
    content = lambda b: slice_(F.col("movie.bytes"), b["offset"] - F.col("movie.offset"), b["size"])
    foreign = F.transform(
        "under", lambda b: F.struct(b["offset"].alias("offset"), let(content(b), _foreign).alias("tags"))
    )
    version = u8(F.col("header"), 0)
    many = lambda found: F.size(found).cast("bigint")
    of = lambda kind: F.filter("tracks", lambda t: t["kind"] == kind)
    found = rows.select(
        "file_id",
        "movie",
        "tracks",
        top.alias("top"),
        under.alias("under"),
        many(F.filter("boxes", lambda b: F.coalesce(own(b) | unknown(b), F.lit(False)))).alias("vendor_boxes"),
        civil_1904(versioned(F.col("header"), version, 4, 4).cast("bigint")).alias("container_time"),
        F.get(of("video"), F.lit(0)).alias("first"),
    )
    facts = F.struct(
        many(of("video")).alias("video_tracks"),
        many(of("audio")).alias("audio_tracks"),
        many(F.filter("tracks", lambda t: (t["kind"] == "video") & t["enabled"])).alias("enabled_video_tracks"),
        (at("moov") < at("mdat")).alias("moov_before_mdat"),
        "vendor_boxes",
        F.array_distinct(F.flatten(F.transform("tracks", lambda t: F.filter(t["names"], lambda name: name != "")))).alias("encoder_tags"),
        F.col("first.width").alias("width"),
        F.col("first.height").alias("height"),
        F.array_max(F.transform("tracks", lambda t: t["duration_ms"])).alias("duration_ms"),
        "container_time",
        F.array_distinct(F.flatten(F.transform(F.array_sort(foreign), lambda b: b["tags"]))).alias("foreign_muxer_tags"),
    )
    # The outer form of the generator keeps the optimizer from copying the walk into a filter below it.
    some = F.when(F.size("top") + F.size("under") > 0, facts)
    return found.select("file_id", F.inline_outer(F.array(some))).where("vendor_boxes IS NOT NULL")


# The parts of tracks that a summary looks at.
SUMMED = ("tkhd", "mdhd", "hdlr", "entry_kind", "entry_header", "entry", "configuration")


def _facts() -> Column:
    """Of each track of a file what a summary shows; its names are the compressor and the handler's."""
    names = ("kind", "enabled", "width", "height", "duration_ms")

    def of(track: Column) -> Column:
        t = typed(lambda name: track[name])
        return F.struct(*[t[n].alias(n) for n in names], F.array(t["compressor"], t["handler_name"]).alias("names"))

    return F.transform("tracks", of)


def first_seen(df: DataFrame, keys: list[str], tag: str, order: list[str]) -> DataFrame:
    """Distinct tags of a key in the order they first appear. Repeats are folded before the shuffle."""
    seen = df.groupBy(*keys, tag).agg(F.min(F.struct(*order)).alias("at"))
    return seen.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", F.col(tag).alias("tag")))), lambda x: x["tag"]).alias("tags")
    )


def contains_bytes(content: Column, text: str) -> Column:
    """Whether the bytes of a text occur, in a one-byte-per-character view of the content."""
    return F.instr(F.decode(content, "ISO-8859-1"), text) > 0


def _foreign(content: Column) -> Column:
    """The tags of other muxers that occur in the bytes, as they are listed."""
    return F.array_compact(F.array(*[F.when(contains_bytes(content, t), F.lit(t)) for t in FOREIGN_TAGS]))


def foreign_tags(boxes: DataFrame) -> DataFrame:
    """Tags of other muxers in the user-data children, distinct, first seen first."""
    found = boxes.select("file_id", "offset", F.posexplode(_foreign(F.col("content"))).alias("place", "tag"))
    return first_seen(found, ["file_id"], "tag", ["offset", "place"]).withColumnRenamed("tags", "foreign_muxer_tags")


def recordings(probes: DataFrame) -> DataFrame:
    """Files in the recordings they belong to, one row per member.

    ``probes(path, parsed, unreadable)``. The stem alone decides which files belong together. Members
    stay rows, ranked front, rear, interior, all, so a stem of any size is never one value.
    """
    camera = F.col("parsed.camera")
    placed = probes.select(
        "path",
        F.col("parsed.stem").alias("stem"),
        camera.alias("camera"),
        F.when(F.col("unreadable").isNotNull(), "unreadable")
        .when(F.col("parsed").isNull(), "unrecognised")
        .when(camera == "all", "single_file")
        .alias("alone"),
    )
    stems = placed.where("alone IS NULL").groupBy("stem").agg(F.count(F.lit(1)).alias("members"))
    paired = placed.where("alone IS NULL").join(stems, "stem")
    grouped = paired.select(
        F.when(F.col("members") > 1, "paired").otherwise("unpaired").alias("kind"),
        "stem",
        "camera",
        lookup(F.col("camera"), CAMERA_RANK).alias("rank"),
        "path",
        "members",
    )
    single = placed.where("alone IS NOT NULL").select(
        F.col("alone").alias("kind"),
        F.when(F.col("alone") == "single_file", F.col("stem")).alias("stem"),
        F.when(F.col("alone") == "single_file", F.col("camera")).alias("camera"),
        F.lit(0).alias("rank"),
        "path",
        F.lit(1).cast("bigint").alias("members"),
    )
    return grouped.unionByName(single)


# Parts that a population's names are dealt in: there are few grammars, each with a good part of all names, and many
# times, each mostly with few.
GRAMMAR_PARTS, TIME_PARTS = 1024, 16


def attached(names: DataFrame, facts: DataFrame, key: list[str], parts: int) -> DataFrame:
    """Names with the one row of their population. The row is repeated for each part of the names, so that names are
    never shuffled by the population alone; where the rows are few, Spark broadcasts them."""
    repeated = facts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = names.withColumn("__part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    return dealt.join(repeated, [*key, "__part"]).drop("__part")


def sibling_facts(probes: DataFrame, key: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """What the other *names* of each population say, one row per population and name.

    ``probes(name, grammar, time, video_tracks, vendor_boxes, width, height, readable)``. A name is folded
    to one row first, a population to two, so nothing pairs files with files. The largest resolution
    without oneself is the largest of all, or the largest among the other names for the name holding it.
    """
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height"))
    readable = probes.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]) & F.col("readable"))
    names = readable.groupBy(*key, "name").agg(
        F.max((F.col("video_tracks") >= 2).cast("int")).alias("two"),
        F.max((F.col("vendor_boxes") > 0).cast("int")).alias("vendor"),
        F.max(size).alias("size"),
    )
    whole = names.groupBy(*key).agg(
        F.sum("two").alias("all_two"),
        F.sum("vendor").alias("all_vendor"),
        F.max(F.when(F.col("size").isNotNull(), F.struct("size", "name"))).alias("best"),
    )
    beside = attached(names, whole.where("best IS NOT NULL").select(*key, "best"), key, parts)
    second = (
        beside.where(F.col("name") != F.col("best.name"))
        .groupBy(*key)
        .agg(F.max("size").alias("second"))
    )
    return (
        whole.join(second, key, "left")
        .select(*key, "all_two", "all_vendor", "best", "second")
    ), names.select(*key, "name", "two", "vendor")


def _population(probes: DataFrame, key: list[str], label: str, parts: int) -> DataFrame:
    """Per file: does another name of its population have two tracks or vendor boxes, and the largest size."""
    whole, own = sibling_facts(probes, key, parts)
    mine = own.select(*key, "name", F.col("two").alias("own_two"), F.col("vendor").alias("own_vendor"))
    asked = probes.select("name", *key).distinct()
    joined = attached(asked, whole, key, parts).join(mine, [*key, "name"], "left")
    return joined.select(
        "name",
        *key,
        (F.col("all_two") - F.coalesce("own_two", F.lit(0)) > 0).alias(f"{label}_two"),
        (F.col("all_vendor") - F.coalesce("own_vendor", F.lit(0)) > 0).alias(f"{label}_vendor"),
        F.when(F.col("best.name") == F.col("name"), F.col("second")).otherwise(F.col("best.size")).alias(f"{label}_size"),
    )


def with_siblings(probes: DataFrame) -> DataFrame:
    """Each file with what its siblings show: same grammar, or the same time in the name."""
    by_grammar = _population(probes, ["grammar"], "g", GRAMMAR_PARTS)
    fitted = probes.where("grammar IS NOT NULL AND time IS NOT NULL")
    by_time = _population(fitted, ["time"], "t", TIME_PARTS)
    joined = probes.join(by_grammar, ["name", "grammar"], "left").join(by_time, ["name", "time"], "left")
    fits = F.col("grammar").isNotNull()
    either = lambda what: fits & (
        F.coalesce(F.col(f"g_{what}"), F.lit(False)) | F.coalesce(F.col(f"t_{what}"), F.lit(False))
    )
    return joined.select(
        *[F.col(name) for name in probes.columns],
        either("two").alias("sibling_has_two"),
        either("vendor").alias("sibling_has_vendor"),
        F.when(fits, F.greatest("g_size", "t_size")).alias("largest"),
    )


def signs(assessed: DataFrame) -> DataFrame:
    """One row per file and sign, in reporting order. Unreadable files show none."""
    readable = assessed.where("readable")
    width, height = F.col("width"), F.col("height")
    below = (width < F.col("largest.width")) | (height < F.col("largest.height"))
    expects = F.coalesce(F.col("grammar") == MEASURED_GRAMMAR, F.lit(False))

    def sign(rank: int, when: Column, detail: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(rank).alias("rank"), F.lit(SIGNS[rank]).alias("sign"), detail.cast("string").alias("detail"))
        )

    none = F.lit(None)
    always = F.array_compact(
        F.array(
            sign(0, F.col("moov_before_mdat") == F.lit(False), none),
            sign(2, (F.col("video_tracks") == 1) & F.col("sibling_has_two"), none),
            sign(3, (F.col("vendor_boxes") == 0) & (expects | F.col("sibling_has_vendor")), none),
            sign(
                4,
                below,
                F.concat_ws(" ", F.concat_ws("x", width, height), F.lit("below"), F.concat_ws("x", "largest.width", "largest.height")),
            ),
        )
    )
    tagged = F.transform(
        F.coalesce("foreign_muxer_tags", F.array().cast("array<string>")),
        lambda tag: F.struct(F.lit(1).alias("rank"), F.lit(SIGNS[1]).alias("sign"), tag.alias("detail")),
    )
    return readable.select("path", "name", F.inline(F.concat(always, tagged)))


def origins(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """Signs of each file in fixed order; no sign with an unknown layout is never called clean."""
    listed = found.groupBy("path").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "detail", "sign"))),
            lambda s: F.concat_ws(" ", s["sign"], s["detail"]),
        ).alias("signs")
    )
    known = F.coalesce(F.col("grammar") == MEASURED_GRAMMAR, F.lit(False))
    count = F.coalesce(F.size("signs"), F.lit(0))
    return assessed.join(listed, "path", "left").select(
        "path",
        known.alias("layout_known"),
        count.alias("sign_count"),
        F.coalesce("signs", F.array().cast("array<string>")).alias("signs"),
        F.when(~F.col("readable"), "unreadable")
        .when(count > 0, "signs_found")
        .when(known, "no_sign_found")
        .otherwise("layout_unknown")
        .alias("reading"),
    )


def scan_verdict(probes: DataFrame) -> DataFrame:
    """Negative when any file of the scan could not be read."""
    return probes.groupBy().agg(
        F.count(F.lit(1)).alias("files"),
        F.count(F.when(~F.col("readable"), 1)).alias("unreadable"),
        (F.count(F.when(~F.col("readable"), 1)) > 0).alias("negative"),
    )
