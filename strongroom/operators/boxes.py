"""Box inventory: the structure of every file as rows.

A file is one row whose ``segments(offset, bytes)`` hold the parts that were read: the whole file,
or only its headers and small boxes. The trees of many files are enumerated at once, level by level
over arrays of positions, so the walk is one narrow projection with no shuffle and no recursion in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from strongroom.functions.binding import let
from strongroom.functions.bytes import code, one_of, shown, slice_, u32
from strongroom.operators.running import running_maximum
from strongroom.operators.tree import RUN_TABLES, walker

# Bounds on what is read and enumerated.
MOVIE_BOX_CAP = 64 * 1024 * 1024
FILE_TYPE_BOX_CAP = 64 * 1024
UNKNOWN_BOX_HOLD_CAP = 1024 * 1024
MAX_DEPTH = 12
MAX_CHILDREN = 1 << 16
MAX_TOP_LEVEL = 1 << 12
# What may open a file, what is stepped over, what is descended into, what is known.
OPENING = ("ftyp", "moov", "mdat", "free", "skip", "wide", "uuid", "moof", "sidx", "styp", "pdin")
STEPPED_OVER = ("mdat", "free", "skip", "wide", "moof", "mfra", "sidx")
DESCENDED = ("moov", "trak", "edts", "mdia", "minf", "dinf", "stbl", "mvex", "tref")
KNOWN_TOP_LEVEL = ("ftyp", "moov", "mdat", "free", "skip", "wide", "moof", "mfra", "sidx")
# Sample entries and the bytes before their children, by version for audio.
VISUAL = ("avc1", "avc3", "hvc1", "hev1", "mp4v", "encv")
AUDIO = ("mp4a", "enca", "ac-3", "ec-3")
VISUAL_FIXED, AUDIO_FIXED = 86, (36, 52, 72)
SAMPLE_DESCRIPTION_FIELDS = 8
CONFIGURATIONS = ("avcC", "hvcC", "esds", "dac3", "dec3")
# Children of user data that a standard defines.
STANDARD_USER_DATA = (
    "cprt",
    "tsel",
    "strk",
    "kind",
    "meta",
    "hnti",
    "hinf",
    "titl",
    "dscp",
    "perf",
    "auth",
    "gnre",
    "rtng",
    "clsf",
    "kywd",
    "loci",
    "albm",
    "yrrc",
    "urat",
    "thmb",
    "name",
)

# A box in a file's row, and a track with the payloads of the boxes that describe it.
_BOX = (
    "struct<kind:binary,offset:bigint,size:bigint,header:int,fields:int,clipped:boolean,error:string,"
    "detail_kind:binary,detail_offset:bigint,parent:bigint,depth:int,ord:int,path:string>"
)
_TRACK = (
    "struct<track_index:int,trak_offset:bigint,tkhd:binary,mdhd:binary,hdlr:binary,elst:binary,stbl:bigint,stsd:binary,"
    "entry_kind:binary,entry_header:int,entry:binary,configuration:struct<kind:binary,payload:binary>,track_children:string,"
    f"table_children:string,entry_children:string,{','.join(f'{kind}:binary' for kind in RUN_TABLES)}>"
)
_TREE = f"boxes:array<{_BOX}>,movie_offset:bigint,movie_size:bigint"
_SEGMENTS = "segments:array<struct<offset:bigint,bytes:binary>>"
# Bytes of a file in which ranges and what is held of it meet.
BUCKET = 1 << 20


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def whole_files(files: DataFrame) -> DataFrame:
    """``files(file_id, length, content)`` as one segment each."""
    segment = F.struct(F.lit(0).cast("bigint").alias("offset"), F.col("content").alias("bytes"))
    return files.select("file_id", "length", F.array(segment).alias("segments"))


def read(segments: Column, at: Column, size: Column) -> Column:
    """Bytes of a range, when one segment contains it entirely."""
    held = F.filter(
        segments, lambda s: (s["offset"] <= at) & (at + size <= s["offset"] + F.length(s["bytes"]).cast("bigint"))
    )
    return let(F.get(held, F.lit(0)), lambda s: slice_(s["bytes"], at - s["offset"], size))


def opens_a_file(head: Column) -> Column:
    """Whether the first bytes could open a container: a listed code and a plausible size."""
    size = u32(head, 0)
    return one_of(slice_(head, 4, 4), OPENING) & ((size == 1) | (size >= 8) | (size == 0))


RULES = {
    "MOVIE_BOX_CAP": MOVIE_BOX_CAP,
    "FILE_TYPE_BOX_CAP": FILE_TYPE_BOX_CAP,
    "UNKNOWN_BOX_HOLD_CAP": UNKNOWN_BOX_HOLD_CAP,
    "MAX_DEPTH": MAX_DEPTH,
    "MAX_CHILDREN": MAX_CHILDREN,
    "MAX_TOP_LEVEL": MAX_TOP_LEVEL,
    "OPENING": OPENING,
    "STEPPED_OVER": STEPPED_OVER,
    "DESCENDED": DESCENDED,
    "VISUAL": VISUAL,
    "AUDIO": AUDIO,
    "VISUAL_FIXED": VISUAL_FIXED,
    "AUDIO_FIXED": AUDIO_FIXED,
    "SAMPLE_DESCRIPTION_FIELDS": SAMPLE_DESCRIPTION_FIELDS,
    "CONFIGURATIONS": CONFIGURATIONS,
}


def walk(files: DataFrame) -> DataFrame:
    """Adds ``boxes``, every box of each file breadth first, ``movie``, the bytes of its movie box, and ``tracks``, its
    tracks with the payloads that describe them.

    Files of an Arrow batch are walked together, see ``tree``; the other columns never leave the JVM.
    """
    made = f"struct<{_TREE},tracks:array<{_TRACK}>>"
    return _trees(files, F.arrow_udf(walker(RULES, to_arrow_type(T._parse_datatype_string(_TRACK))), made), "tracks")


def _trees(files: DataFrame, trees, *more: str) -> DataFrame:
    walked = files.withColumn("__w", trees("length", "segments"))
    at, size = F.col("__w.movie_offset"), F.col("__w.movie_size")
    return walked.select(
        *files.columns,
        F.col("__w.boxes").alias("boxes"),
        F.struct(at.alias("offset"), read(F.col("segments"), at, size).alias("bytes")).alias("movie"),
        *[F.col(f"__w.{name}").alias(name) for name in more],
    )


def walk_boxes(files: DataFrame) -> DataFrame:
    """The walk without ``tracks``, for what looks at boxes only: no payload is cut or sent."""
    return _trees(files, F.arrow_udf(walker(RULES, None), f"struct<{_TREE}>"))


def _walked(files: DataFrame, made, tracks=None, **asked) -> Column:
    """The walk over segments; or, of files that have none, over contents.

    Contents that a function makes in the same plan go to the walk where they are made: both run in one pass.
    """
    held = ("length", "segments") if "segments" in files.columns else ("content",)
    return F.arrow_udf(walker(RULES, tracks, whole=len(held) == 1, **asked), made)(*held)


def list_boxes(files: DataFrame, *names: str, path: str | None = None) -> DataFrame:
    """Adds only ``boxes``, for what needs no bytes, with the named columns of a box beside its offset and error.

    Without names a box has all its columns. Where a path is named, only the boxes that have it or lie above it are listed.
    ``files`` have segments, or ``content`` where they are held whole.
    """
    every = T._parse_datatype_string(_BOX)
    if unknown := set(names) - set(every.names):
        raise ValueError(f"unknown columns of a box: {sorted(unknown)}")
    asked = {"offset", "error", *names} if names else set(every.names)
    box = T.StructType([f for f in every.fields if f.name in asked])
    return files.withColumn("boxes", _walked(files, T.ArrayType(box), movie=False, path=path, names=tuple(box.names)))


def _track(*names: str) -> T.StructType:
    """The type of a track with its number and the named columns."""
    every = T._parse_datatype_string(_TRACK)
    if unknown := set(names) - set(every.names):
        raise ValueError(f"unknown columns of a track: {sorted(unknown)}")
    return T.StructType([f for f in every.fields if f.name == "track_index" or f.name in names])


def walk_held(files: DataFrame, *names: str, tracks: tuple[str, ...] = ()) -> DataFrame:
    """The walk of files with ``content`` for what looks at bytes of held boxes: ``segments`` are the held top-level boxes,
    ``boxes`` have the named columns beside what tells which are held, or all, ``movie`` is the movie box. No media leaves
    the walk. Where columns of a track are named, ``tracks`` are there too, each with its number and these.
    """
    every = T._parse_datatype_string(_BOX)
    if unknown := set(names) - set(every.names):
        raise ValueError(f"unknown columns of a box: {sorted(unknown)}")
    asked = {"kind", "offset", "size", "clipped", "error", "depth", *names} if names else set(every.names)
    box = T.StructType([f for f in every.fields if f.name in asked])
    track = _track(*tracks) if tracks else None
    described = f",tracks:array<{track.simpleString()}>" if tracks else ""
    made = T._parse_datatype_string(f"boxes:array<{box.simpleString()}>,movie_offset:bigint,movie_size:bigint,{_SEGMENTS}{described}")
    walked = files.withColumn("__w", _walked(files, made, track and to_arrow_type(track), names=tuple(box.names), holds=True))
    walked = walked.select(*[c for c in files.columns if c not in ("content", "segments")], "__w.*")
    movie = F.struct(F.col("movie_offset").alias("offset"), read(F.col("segments"), F.col("movie_offset"), F.col("movie_size")).alias("bytes"))
    return walked.withColumn("movie", movie).drop("movie_offset", "movie_size")


def walk_types(files: DataFrame) -> DataFrame:
    """The top level of files with ``content``, with the file type boxes as ``segments``: nothing else leaves the walk."""
    made = f"struct<boxes:array<{_BOX}>,{_SEGMENTS}>"
    walked = files.withColumn("__w", _walked(files, made, below=False, holds=("ftyp",)))
    return walked.select(*[c for c in files.columns if c not in ("content", "segments")], "__w.*")


def walk_tracks(files: DataFrame, *names: str) -> DataFrame:
    """Adds only ``tracks``, each with its number and the named columns: no box is listed, no other payload cut or sent,
    and no container entered that holds none of them.

    ``files`` have segments, or ``content`` where they are held whole.
    """
    track = _track(*names)
    return files.withColumn("tracks", _walked(files, T.ArrayType(track), to_arrow_type(track), boxes=False))


def walk_top(files: DataFrame) -> DataFrame:
    """Adds ``boxes``, the top-level boxes of each file, by their headers alone: no box is entered.

    What the top level shows needs no more, whatever the movie box holds.
    """
    return files.withColumn("boxes", _walked(files, f"array<{_BOX}>", below=False))


def boxes(walked: DataFrame, *keep: str) -> DataFrame:
    """One row per box. The offset identifies a box within its file.

    The outer form of the generator keeps the optimizer from copying the walk into a filter below it.
    """
    return (
        walked.select("file_id", *keep, F.inline_outer("boxes"))
        .where("error IS NULL AND offset IS NOT NULL")
        .drop("error", "detail_kind", "detail_offset")
    )


def held(kind: Column, size: Column) -> Column:
    """Whether a top-level box is one whose bytes are kept."""
    return one_of(kind, ("moov", "ftyp")) | (~one_of(kind, STEPPED_OVER) & (size <= UNKNOWN_BOX_HOLD_CAP))


def held_only(walked: DataFrame) -> DataFrame:
    """The walk without the media: only the bytes of held boxes stay, which is what is worth storing."""
    kept = F.filter(
        "boxes", lambda b: (b["depth"] == 0) & b["error"].isNull() & ~b["clipped"] & held(b["kind"], b["size"])
    )
    bytes_ = F.transform(
        kept, lambda b: F.struct(b["offset"].alias("offset"), read(F.col("segments"), b["offset"], b["size"]).alias("bytes"))
    )
    return walked.select("file_id", "length", bytes_.alias("segments"), "boxes", "movie", "tracks")


def held_bytes(walked: DataFrame) -> DataFrame:
    """Every box with its bytes, header included, when a held top-level box contains it; else NULL."""
    rows = walked.select("file_id", "segments", "movie", F.inline_outer("boxes")).where("error IS NULL AND offset IS NOT NULL")
    kept = F.when(
        F.col("depth") == 0,
        F.when(held(F.col("kind"), F.col("size")) & ~F.col("clipped"), read(F.col("segments"), F.col("offset"), F.col("size"))),
    ).otherwise(slice_(F.col("movie.bytes"), F.col("offset") - F.col("movie.offset"), F.col("size")))
    return rows.withColumn("bytes", kept).drop("segments", "movie", "error", "detail_kind", "detail_offset")


def bytes_of(ranges: DataFrame, held_ranges: DataFrame) -> DataFrame:
    """Bytes of ranges from the hold that contains each entirely, NULL where none does; the first hold of several.

    ``ranges(file_id, offset, size)``, ``held_ranges(file_id, hold_offset, bytes)``. Ranges meet the extents of the holds
    first, by the bucket of ``BUCKET`` bytes that a range begins in and each that a hold lies in, so no range looks at
    all the holds of its file. The bytes of a hold then meet the list of its own ranges once, and are never copied per
    range or bucket.
    """
    extents = held_ranges.select("file_id", "hold_offset", (F.col("hold_offset") + F.length("bytes")).alias("hold_end"))
    last = F.floor(F.greatest(F.col("hold_end") - 1, F.col("hold_offset")) / BUCKET)
    extents = extents.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("hold_offset") / BUCKET), last)))
    asked = ranges.distinct().withColumn("bucket", F.floor(F.col("offset") / BUCKET))
    met = asked.join(extents, ["file_id", "bucket"])
    inside = (F.col("hold_offset") <= F.col("offset")) & (F.col("offset") + F.col("size") <= F.col("hold_end"))
    one = met.where(inside).groupBy("file_id", "offset", "size").agg(F.min("hold_offset").alias("hold_offset"))
    lists = one.groupBy("file_id", "hold_offset").agg(F.collect_list(F.struct("offset", "size")).alias("ranges"))
    cut = F.transform(
        "ranges",
        lambda r: F.struct(
            r["offset"].alias("offset"),
            r["size"].alias("size"),
            slice_(F.col("bytes"), r["offset"] - F.col("hold_offset"), r["size"]).alias("bytes"),
        ),
    )
    found = held_ranges.join(lists, ["file_id", "hold_offset"]).select("file_id", F.inline(cut))
    return ranges.join(found, ["file_id", "offset", "size"], "left")


def errors(walked: DataFrame) -> DataFrame:
    """What makes each file unreadable as a container, first error first, one row per file."""
    failed = F.filter("boxes", lambda b: b["error"].isNotNull())
    first = F.array_min(
        F.transform(
            failed,
            lambda b: F.struct(
                b["offset"].alias("at"), b["error"].alias("code"), b["detail_kind"].alias("kind"), b["detail_offset"].alias("offset")
            ),
        )
    )
    movies = F.size(F.filter("boxes", lambda b: (b["depth"] == 0) & b["error"].isNull() & (b["kind"] == code("moov")) & ~b["clipped"]))
    none = F.when(
        movies == 0,
        F.struct(
            _null("bigint").alias("at"), F.lit("no_movie_box").alias("code"), _null("binary").alias("kind"), _null("bigint").alias("offset")
        ),
    )
    return (
        walked.select("file_id", F.inline_outer(F.array_compact(F.array(F.coalesce(first, none)))))
        .where("code IS NOT NULL")
        .select("file_id", "code", shown(F.col("kind")).alias("kind"), "offset")
    )


def readable(walked: DataFrame) -> DataFrame:
    """Files without an error: exactly one movie box and a consistent tree."""
    return walked.join(errors(walked).select("file_id"), "file_id", "left_anti")


def children_of(parents: DataFrame, rows: DataFrame, kind: str | None = None, first: bool = False) -> DataFrame:
    """Children of the given boxes, of one kind when named, only the first when asked."""
    asked = parents.select("file_id", F.col("offset").alias("parent")).distinct()
    found = rows.join(asked, ["file_id", "parent"], "left_semi")
    if kind is not None:
        found = found.where(F.col("kind") == code(kind))
    if not first:
        return found
    picked = found.groupBy("file_id", "parent").agg(F.min("offset").alias("offset"))
    return found.join(picked, ["file_id", "parent", "offset"], "left_semi")


def children_at(walked: DataFrame, path: str) -> DataFrame:
    """Children of the boxes of a path, looked up inside the file's row like ``descend``."""
    at = F.transform(F.filter("boxes", lambda b: (b["path"] == path) & b["error"].isNull()), lambda b: b["offset"])
    below = let(at, lambda parents: F.filter("boxes", lambda b: F.array_contains(parents, b["parent"]) & b["error"].isNull()))
    return boxes(walked.select("file_id", below.alias("boxes")))


def descend(walked: DataFrame, start: str, path: list[str]) -> DataFrame:
    """Follows a path of kinds from the first top-level box of a kind, the first match at each step.

    The boxes of a file are in one row, so each step is a filter inside it.
    """
    usable = F.filter("boxes", lambda b: b["error"].isNull())
    first = F.get(F.filter(usable, lambda b: (b["depth"] == 0) & (b["kind"] == code(start))), F.lit(0))

    def follow(parent: Column, kinds: list[str]) -> Column:
        if not kinds:
            return parent
        below = F.filter(
            "boxes", lambda b: (b["parent"] == parent["offset"]) & (b["kind"] == code(kinds[0])) & b["error"].isNull()
        )
        return let(F.get(below, F.lit(0)), lambda b: follow(b, kinds[1:]))

    found = let(first, lambda b: follow(b, path))
    return (
        walked.select("file_id", F.inline_outer(F.array(found)))
        .where("offset IS NOT NULL")
        .select("file_id", "kind", "offset", "size", "header", "path")
    )


def gaps(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents whose children do not tile them: a gap, an overlap, or an end short of the parent's.

    ``rows(file_id, parent, ord, offset, size)`` with dense ``ord``; ``parents(file_id, parent, start, end)``.
    Neighbours meet in a group of their place and parents in the group of their children, so a parent with most of the
    boxes is many tasks and no side is broadcast, however small it is taken to be.
    """
    keys = ["file_id", "parent"]
    end, none = F.col("offset") + F.col("size"), _null("bigint")
    here = rows.select(*keys, "ord", "offset", end.alias("end"), none.alias("before"))
    ahead = rows.select(*keys, F.col("ord") + 1, none, none, end)
    met = here.union(ahead).groupBy(*keys, "ord").agg(F.max("offset").alias("offset"), F.max("end").alias("end"), F.max("before").alias("before"))
    children = met.where("offset IS NOT NULL").select(
        *keys, "offset", "end", (F.col("before") != F.col("offset")).alias("broken"), none.alias("from"), none.alias("to")
    )
    given = parents.select(*keys, none, none, F.lit(None).cast("boolean"), "start", "end")
    facts = children.union(given).groupBy(*keys).agg(
        F.count_if("broken").alias("breaks"),
        F.min("offset").alias("first"),
        F.max("end").alias("last"),
        F.max("from").alias("start"),
        F.max("to").alias("end"),
    )
    tiles = (F.col("breaks") == 0) & (F.col("first") == F.col("start")) & (F.col("last") == F.col("end"))
    return facts.where("first IS NOT NULL AND start IS NOT NULL").select(*keys, "breaks", tiles.alias("tiles"))


def tilings(files: DataFrame) -> DataFrame:
    """``gaps`` of the boxes of files, with no exchange: the walk has the children of every box. The parent of the boxes
    of the top level is -1.

    ``files`` have segments, or ``content`` where they are held whole.
    """
    made = _walked(files, "array<struct<parent:bigint,breaks:bigint,tiles:boolean>>", tiles=True)
    return files.select("file_id", made.alias("tilings")).select("file_id", F.inline_outer("tilings")).where("parent IS NOT NULL")


def coverage(ranges: DataFrame, parents: DataFrame, block: Column) -> DataFrame:
    """Where the ranges of a parent leave it uncovered or lie on each other, and where they end short of it or past it.

    ``ranges(file_id, parent, offset, size)`` in any order and number, ``parents(file_id, parent, start, end)``; each
    finding is ``(file_id, parent, kind, offset, size)``. A sweep by offset knows how far earlier ranges reach, as a
    running maximum over blocks, so a parent with most of the ranges is many tasks. ``block`` must never decrease along
    the offset.
    """
    keys = ["file_id", "parent"]
    end = F.col("offset") + F.col("size")
    swept = running_maximum(ranges, keys, ["offset", "size"], block, "reach", end).join(parents, keys)
    reach = F.greatest(F.coalesce("reach", "start"), F.col("start"))
    found = swept.select(*keys, "offset", end.alias("until"), reach.alias("reach"))
    within = found.select(
        *keys,
        F.when(F.col("offset") > F.col("reach"), "gap").otherwise("overlap").alias("kind"),
        F.least("offset", "reach").alias("offset"),
        F.when(F.col("offset") > F.col("reach"), F.col("offset") - F.col("reach"))
        .otherwise(F.least("reach", "until") - F.col("offset"))
        .alias("size"),
    ).where("size > 0")
    last = ranges.groupBy(*keys).agg(F.max(end).alias("last"))
    ended = parents.join(last, keys, "left").withColumn("last", F.greatest(F.coalesce("last", "start"), F.col("start")))
    after = ended.select(
        *keys,
        F.when(F.col("last") < F.col("end"), "short").otherwise("past").alias("kind"),
        F.least("last", "end").alias("offset"),
        F.abs(F.col("end") - F.col("last")).alias("size"),
    ).where("size > 0")
    return within.unionByName(after)


def movie_before_media(top: DataFrame) -> DataFrame:
    """Whether the movie box precedes the first media box; NULL when either is absent."""
    at = lambda kind: F.min(F.when(F.col("kind") == code(kind), F.col("offset")))
    return top.groupBy("file_id").agg((at("moov") < at("mdat")).alias("moov_before_mdat"))


def unknown_top_level(top: DataFrame) -> DataFrame:
    """Top-level boxes of no known kind; a clipped tail is not a box."""
    return top.where(~one_of(F.col("kind"), KNOWN_TOP_LEVEL) & ~F.col("clipped"))


def is_standard(kind: Column) -> Column:
    """Whether a child of user data is one a standard defines."""
    return one_of(kind, STANDARD_USER_DATA)


def clipped_tail(top: DataFrame) -> DataFrame:
    """The last top-level range of each file, when it is clipped."""
    last = top.groupBy("file_id").agg(F.max_by(F.struct("kind", "offset", "size", "clipped"), "offset").alias("b"))
    return last.where("b.clipped").select("file_id", "b.kind", "b.offset", "b.size")


def boxes_in_file_order(files: DataFrame) -> DataFrame:
    """``in_file_order`` of files, with no exchange: the walk knows the place of each box."""
    made = f"struct<{_TREE}>".replace("path:string>", "path:string,place:bigint>")
    return boxes(_trees(files, F.arrow_udf(walker(RULES, None, places=True), made)))


def in_file_order(rows: DataFrame) -> DataFrame:
    """Depth-first place of every box: by offset, the container before what it holds."""
    by_file = Window.partitionBy("file_id").orderBy("offset", "depth")
    # The boxes of one file are bounded by the caps above.
    return rows.withColumn("place", F.row_number().over(by_file) - 1)
