"""Digests over files, tracks and ordered listings.

The digest of a track is one SHA-256 over its samples in decode order, so its last byte cannot
be hashed before its first: a track is bounded work for one hash state, whatever runs it. Tracks
that fit in a row are digested inside a Spark aggregate. Tracks above ``ROW_BYTES`` are range
sorted by Spark and streamed through a hash state that holds 32 bytes, never the track. The tree
digest beside it is a separate, versioned number whose work splits over any number of tasks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.functions.bytes import one_of, shown, u8, u32
from strongroom.operators.boxes import KNOWN_TOP_LEVEL
from strongroom.operators.headers import brands, file_type_payload, header_error, movie_header_payload
from strongroom.operators.headers import tracks as typed_tracks
from strongroom.operators.headers import typed
from strongroom.operators.running import by_rows, running_totals

# Functions that run in workers are shipped by value: a cluster needs no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The most bytes of one group that are concatenated into a row.
ROW_BYTES = 64 * 1024 * 1024
# Samples under one inner node of the tree digest.
TREE_FANOUT = 4096
TREE_VERSION = "tree/1"


def sha256(column: Column | str) -> Column:
    """SHA-256 as 64 lower-case hex digits."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def file_digests(files: DataFrame) -> DataFrame:
    """Whole-file digest and length, one row per file; narrow, no shuffle."""
    return files.select(
        "file_id", sha256("content").alias("sha256"), F.length("content").cast("bigint").alias("length")
    )


def checked_digest(text: Column) -> Column:
    """A digest text in its displayed form, or NULL when it is not 64 hex digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def _stream_digests(keys: list[str], value: str, schema: pa.Schema):
    """Hashes a partition sorted by key and order; only the hash state is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, count, size, whole = None, None, 0, 0, True

        def row():
            fields = [*current, state.hexdigest() if whole else None, count, size]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, fields))], schema=schema)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(key)).to_pylist() for key in keys]
            payloads = batch.column(batch.schema.get_field_index(value))
            for position, key in enumerate(zip(*columns)):
                if key != current:
                    if current is not None:
                        yield row()
                    current, state, count, size, whole = key, hashlib.sha256(), 0, 0, True
                payload = payloads[position].as_py()
                count += 1
                if payload is None:
                    whole = False
                else:
                    state.update(payload)
                    size += len(payload)
        if current is not None:
            yield row()

    return run


def ordered_digests(
    samples: DataFrame, keys: list[str], order: list[str], value: str, row_bytes: int = ROW_BYTES
) -> DataFrame:
    """SHA-256 of a group's binary values joined in order, with how many there were and their bytes.

    A group with a NULL value has no digest, however large it is: what was not read proves nothing. Its
    count holds every value, its bytes those that were read.
    """
    sizes = samples.groupBy(*keys).agg(F.sum(F.length(value)).cast("bigint").alias("__bytes"))
    large = sizes.where(F.col("__bytes") > row_bytes).select(*keys)

    listing = ", ".join(order)
    within_row = (
        samples.join(large, keys, "left_anti")
        .groupBy(*keys)
        .agg(
            F.expr(
                f"CASE WHEN NOT bool_or({value} IS NULL) THEN sha2(listagg({value}) WITHIN GROUP (ORDER BY {listing}), 256) END"
            ).alias("sha256"),
            F.count(F.lit(1)).alias("count"),
            F.coalesce(F.sum(F.length(value)), F.lit(0)).cast("bigint").alias("bytes"),
        )
    )
    fields = {field.name: field.dataType for field in samples.schema.fields}
    ddl = ", ".join(f"`{key}` {fields[key].simpleString()}" for key in keys)
    ddl += ", sha256 string, count bigint, bytes bigint"
    streamed_in = (
        samples.join(large, keys, "left_semi")
        .select(*keys, *[name for name in order if name not in keys], value)
        .repartition(*keys)
        .sortWithinPartitions(*keys, *order)
    )
    arrow = pa.schema(
        [pa.field(key, _arrow_type(fields[key].simpleString())) for key in keys]
        + [pa.field("sha256", pa.string()), pa.field("count", pa.int64()), pa.field("bytes", pa.int64())]
    )
    streamed = streamed_in.mapInArrow(_stream_digests(keys, value, arrow), ddl)
    return within_row.unionByName(streamed)


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def tree_digests(samples: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """The parallel companion of the ordered digest: a root over digests of blocks of samples.

    Every inner node covers ``TREE_FANOUT`` consecutive samples and holds their digests only, so
    a track of any length is hashed by as many tasks as it has blocks.
    """
    leaves = samples.select(*keys, index, sha256(value).alias("leaf"), by_rows(index, TREE_FANOUT).alias("node"))
    level, name = leaves, "leaf"
    nodes = level.groupBy(*keys, "node").agg(
        F.expr(f"sha2(listagg({name}) WITHIN GROUP (ORDER BY {index}), 256)").alias("leaf"),
    )
    upper = nodes.groupBy(*keys, F.floor(F.col("node") / TREE_FANOUT).alias("upper")).agg(
        F.expr("sha2(listagg(leaf) WITHIN GROUP (ORDER BY node), 256)").alias("leaf")
    )
    return upper.groupBy(*keys).agg(
        F.expr("sha2(listagg(leaf) WITHIN GROUP (ORDER BY upper), 256)").alias("tree_sha256"),
        F.lit(TREE_VERSION).alias("tree_version"),
    )


def listing_digests(lines: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """SHA-256 of a group's lines joined by newlines: the structural fingerprint of a listing.

    The newline belongs to every line but the first in order, so the group is hashed as an
    ordered run of byte values like any other.
    """
    first = lines.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    bytes_ = (
        lines.join(first, keys)
        .withColumn(
            "__line",
            F.when(F.struct(*order) == F.col("__first"), F.encode(F.col(line), "UTF-8")).otherwise(
                F.encode(F.concat(F.lit("\n"), F.col(line)), "UTF-8")
            ),
        )
        .select(*keys, *order, "__line")
    )
    return ordered_digests(bytes_, keys, order, "__line")


_UNITS = "array<struct<at:int,size:int>>"


def _places(data: pa.Array, width: pa.Array) -> pa.Array:
    """Units of the samples of a batch: every sample has a cursor, and one step reads a prefix at each."""
    known = data.is_valid().to_numpy(zero_copy_only=False) & width.is_valid().to_numpy(zero_copy_only=False)
    _, ends, held = data.buffers()
    ends = np.frombuffer(ends, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    held = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(1, np.uint8)
    width = width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, length = ends[:-1], ends[1:] - ends[:-1]
    at, broken = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
    rows, made = np.flatnonzero(known & (length > 0)), []
    while len(rows):
        here, wide = at[rows], width[rows]
        size = np.zeros(len(rows), np.int64)
        for k in range(int(wide.max())):
            byte = held[np.minimum(start[rows] + here + k, len(held) - 1)]
            size = np.where(k < wide, size << 8 | byte, size)
        fits = (wide > 0) & (here + wide + size <= length[rows])
        broken[rows[~fits]] = True
        rows, here, size = rows[fits], (here + wide)[fits], size[fits]
        made.append((rows, here, size))
        at[rows] = here + size
        rows = rows[at[rows] < length[rows]]
    row, here, size = (np.concatenate([np.zeros(0, np.int64), *(m[i] for m in made)]) for i in range(3))
    order = np.argsort(row, kind="stable")
    counts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(data)))))
    units = pa.StructArray.from_arrays([pa.array(v[order].astype(np.int32)) for v in (here, size)], ["at", "size"])
    listed = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), units)
    return pa.StructArray.from_arrays([listed, pa.array(broken)], ["units", "broken"], mask=pa.array(~known))


def unit_places(data: Column, width: Column) -> Column:
    """Places of the length-prefixed units of a sample, and whether a prefix ran past its end.

    The samples of an Arrow batch are split together; a sample is bounded by what is read at once.
    """
    return F.arrow_udf(_places, f"struct<units:{_UNITS},broken:boolean>")(data, width)


def units(samples: DataFrame) -> DataFrame:
    """Units of ``samples(file_id, track_index, sample_idx, bytes, nal_length_size)``, one row each.

    ``broken`` says of every unit whether its sample fails to split under its prefixes: the units before the break are
    there to be looked at, and prove nothing.
    """
    placed = samples.withColumn("places", unit_places(F.col("bytes"), F.col("nal_length_size").cast("int")))
    rows = placed.select(
        "file_id",
        "track_index",
        "sample_idx",
        F.col("bytes").alias("sample"),
        F.col("places.broken").alias("broken"),
        F.posexplode_outer("places.units").alias("unit", "u"),
    ).where("u IS NOT NULL")
    data = F.substring(F.col("sample"), F.col("u.at") + 1, F.col("u.size"))
    byte = lambda at: F.conv(F.hex(F.substring(F.col("bytes"), F.lit(at + 1), F.lit(1))), 16, 10).cast("int")
    return rows.select("file_id", "track_index", "sample_idx", "unit", "broken", data.alias("bytes")).withColumns(
        {
            "type": F.coalesce(byte(0).bitwiseAND(0x1F), F.lit(0)),
            "opens_picture": F.coalesce(byte(1).bitwiseAND(0x80) != 0, F.lit(False)),
        }
    )


def malformed_samples(samples: DataFrame) -> DataFrame:
    """Samples that do not split under their declared prefix."""
    broken = unit_places(F.col("bytes"), F.col("nal_length_size").cast("int"))["broken"]
    return samples.where(broken).select(
        "file_id", "track_index", "sample_idx", F.lit("a unit's length prefix runs past the sample").alias("reason")
    )


# The unit types that steer parameter-set insertion.
SEQUENCE_SET, PICTURE_SET, REFRESH_SLICE = 7, 8, 5


def parameter_set_insertions(units: DataFrame, block: Column, sample_block: Column) -> DataFrame:
    """Marks where parameter sets go in front of a unit: ``both``, ``pictures`` or NULL.

    ``units(file_id, track_index, sample_idx, unit, type, opens_picture)``. A segment starts at a
    parameter set and at a refresh slice that opens a picture; the first refresh slice of a segment
    with no set earlier in its sample takes both sets. One that has a sequence set but no picture
    set earlier in its sample takes the picture sets.
    """
    track, sample = ["file_id", "track_index"], ["file_id", "track_index", "sample_idx"]
    starts = (
        F.col("type").isin(SEQUENCE_SET, PICTURE_SET)
        | ((F.col("type") == REFRESH_SLICE) & F.col("opens_picture"))
    ).cast("bigint")
    segmented = running_totals(units, track, ["sample_idx", "unit"], block, {"before": starts}).withColumn(
        "segment", F.col("before") + starts
    )
    seen = running_totals(
        segmented,
        sample,
        ["unit"],
        sample_block,
        {
            "sequence_sets": (F.col("type") == SEQUENCE_SET).cast("bigint"),
            "picture_sets": (F.col("type") == PICTURE_SET).cast("bigint"),
        },
    )
    refresh = F.col("type") == REFRESH_SLICE
    eligible = refresh & (F.col("sequence_sets") == 0) & (F.col("picture_sets") == 0)
    place = F.struct("sample_idx", "unit")
    first = (
        seen.where(eligible)
        .groupBy(*track, "segment")
        .agg(F.min(place).alias("first"))
        .select(*track, F.col("first.sample_idx").alias("sample_idx"), F.col("first.unit").alias("unit"))
        .withColumn("takes_both", F.lit(True))
    )
    marked = seen.join(first, [*sample, "unit"], "left")
    return marked.withColumn(
        "inserted",
        F.when(F.col("takes_both"), "both").when(
            refresh & (F.col("sequence_sets") > 0) & (F.col("picture_sets") == 0), "pictures"
        ),
    ).drop("takes_both", "before", "sequence_sets", "picture_sets")


def _quoted(text: Column) -> Column:
    """A text in double quotes, quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _track_line(part: Callable[[str], Column]) -> Column:
    """What a track's shape shows; ``part`` gives a typed column by its name."""
    return F.concat_ws(
        " ",
        F.lit("track"),
        part("track_index"),
        part("kind"),
        part("coding"),
        F.concat(F.lit("["), part("entry_children"), F.lit("]")),
        F.lit("compressor"),
        _quoted(F.coalesce(part("compressor"), F.lit(""))),
        F.lit("handler"),
        _quoted(part("handler_name")),
        F.lit("flags"),
        F.concat(F.lit("0x"), F.lower(F.hex(part("flags")))),
        F.lit("timescale"),
        part("timescale"),
        F.concat(F.lit("trak ["), part("track_children"), F.lit("]")),
        F.concat(F.lit("stbl ["), part("table_children"), F.lit("]")),
    )


def structural_fingerprints(walked: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """What a container's shape shows, one observation per line, and the digest of the lines.

    A listing is bounded by the caps of the walk, so it is built in the file's own row, its brands, its scale and its
    tracks too. Only ``parts``, where tracks are given as rows of their own, join it.
    """
    top = F.filter("boxes", lambda b: (b["depth"] == 0) & b["error"].isNull())
    kinds = lambda boxes: F.array_join(F.transform(boxes, lambda b: shown(b["kind"])), " ")
    listed = lambda prefix, boxes: F.transform(
        boxes, lambda b: F.concat(F.lit(prefix), shown(b["kind"]), F.lit(" "), b["size"].cast("string"))
    )
    unknown = F.filter(top, lambda b: ~one_of(b["kind"], KNOWN_TOP_LEVEL) & ~b["clipped"])
    tail = F.filter(F.slice(top, -1, 1), lambda b: b["clipped"])
    # A code has four bytes, so a path that begins so is one below.
    under = lambda path: F.filter(
        "boxes", lambda b: (b["depth"] == path.count("/")) & b["path"].startswith(path) & b["error"].isNull()
    )
    tracks = F.transform("tracks", lambda t: _track_line(typed(lambda name: t[name]).__getitem__))
    shape = walked.select(
        "file_id",
        F.concat(F.lit("top-level "), kinds(top)).alias("order"),
        listed("top-level-unknown ", unknown).alias("unknown"),
        listed("top-level-clipped ", tail).alias("tail"),
        F.concat(F.lit("moov "), kinds(under("moov/"))).alias("movie_children"),
        listed("udta ", under("moov/udta/")).alias("user_data"),
        *([tracks.alias("tracks")] if parts is None else []),
        F.inline_outer(F.array(F.struct(file_type_payload().alias("type"), movie_header_payload().alias("header")))),
    )
    major, compatible = brands(F.col("type"))
    named = F.array(F.concat(F.lit("brand "), major), F.concat(F.lit("compatible "), F.array_join(compatible, " ")))
    header, version = F.col("header"), u8(F.col("header"), 0)
    scale = F.when(version == 0, u32(header, 12)).when(version == 1, u32(header, 20)).cast("string")
    read_well = header_error(header, version, "mvhd", 100, 112).isNull()
    shape = shape.withColumns(
        {
            "brands": F.when(F.length("type") >= 8, named),
            "scale": F.when(read_well, F.array(F.concat(F.lit("movie-timescale "), scale))),
        }
    ).drop("type", "header")
    if parts is not None:
        t = typed_tracks(parts).select("file_id", F.struct("track_index", _track_line(F.col).alias("line")).alias("t"))
        listing = t.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["line"]).alias("tracks"))
        shape = shape.join(listing, "file_id", "left")
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.coalesce("brands", F.array(F.lit("brand none"))),
        F.array("order"),
        "unknown",
        "tail",
        F.coalesce("scale", none),
        F.array("movie_children"),
        "user_data",
        F.coalesce("tracks", none),
    )
    return (
        shape.select("file_id", lines.alias("observations"))
        .withColumn("sha256", sha256(F.array_join("observations", "\n")))
    )
