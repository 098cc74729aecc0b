"""Media read once, where it lies: samples and digests of tracks without a shuffle of their bytes.

The run tables of a track are checked in its own row, before anything is listed: a track whose tables are missing, short
or contradict each other has a reason and nothing else. What a sound track's tables place, its chunks, is worked out in
the same row. One task then seeks along the chunks of a track, in decode order, with a hash state of the payload and one
of the elementary stream; it holds one sample at a time, or a piece of a chunk where single samples don't matter. So no
exchange and no stored table holds media, files of any size can be read, and audio tracks are tracks like others.

A digest is there only with its proof: a track with a range outside its file, with a sample larger than any that is held
or with a unit that runs past its sample has NULL and the reason.

Rows carry either the whole content of a file or the path of one; with a path only the ranges are read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.functions.binding import let
from strongroom.operators import headers
from strongroom.sources.archive import MAX_SAMPLE_SIZE, opened

# What the numbers are computed by; a changed rule gets a new version and never the same column value.
PAYLOAD_VERSION, STREAM_VERSION = "payload/1", "stream/1"
# Bytes read at once where single samples don't matter.
PIECE = 8 * 1024 * 1024
# The most samples that are handed on at once.
ROWS = 1 << 14
# Unit types that steer the insertion of parameter sets, and the start codes.
SEQUENCE_SET, PICTURE_SET, REFRESH_SLICE = 7, 8, 5
LONG_START, SHORT_START = bytes.fromhex("00000001"), bytes.fromhex("000001")
OUT_OF_BOUNDS, TOO_LARGE = "out of bounds", "larger than any sample held"
RUNS_PAST = "a unit's length prefix runs past the sample"

# Functions that run in workers are shipped by value: a cluster needs no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGESTS = (
    "samples bigint, bytes bigint, payload_sha256 string, payload_reason string, stream_sha256 string, "
    "stream_bytes bigint, access_units bigint, insertions bigint, stream_reason string"
)
SAMPLES = "sample_idx bigint, offset bigint, size bigint, width int, bytes binary, problem string"


def places(parts: DataFrame) -> DataFrame:
    """Adds ``reason``, ``chunks`` (offset and samples of each, in decode order), ``size`` or ``sizes``, and ``avc``.

    A track that can't be listed has the reason and none of the others. ``avc`` is there for tracks with an AVC
    configuration that names its parameter sets: the prefix width and the sets.
    """
    constant, listed = headers.size_lists()

    def chunks(offsets):
        def of_run(run, following):
            return F.transform(
                F.sequence(run["first_chunk"], following - 1),
                lambda c: F.struct(F.get(offsets, (c - 1).cast("int"))["offset"].alias("offset"), run["per_chunk"].alias("n")),
            )

        return let(
            headers.chunk_runs(),
            lambda runs: F.flatten(
                F.transform(
                    runs,
                    lambda run, i: of_run(run, F.coalesce(F.get(runs, i + 1)["first_chunk"], F.size(offsets).cast("bigint") + 1)),
                )
            ),
        )

    offsets = F.coalesce(headers.chunk_offsets(), F.array().cast("array<struct<offset:bigint>>"))
    sets = headers.avc_sets(F.col("configuration.payload"))
    known = headers.is_avc() & sets["complete"] & (headers.u8(F.col("configuration.payload"), 0) == 1)
    width = (headers.u8(F.col("configuration.payload"), 4).bitwiseAND(3) + 1).cast("int")
    sized = F.when(F.col("stsz").isNotNull() & (constant != 0), constant)
    refused = parts.withColumn("reason", headers.refusal())
    sound = F.col("reason").isNull()
    return refused.withColumns(
        {
            "chunks": F.when(sound, let(offsets, chunks)),
            "size": F.when(sound, sized),
            "sizes": F.when(sound & sized.isNull(), F.transform(listed, lambda s: s["size"])),
            "avc": F.when(sound & known, F.struct(width.alias("width"), sets["sps"].alias("sps"), sets["pps"].alias("pps"))),
        }
    )


def refusals(parts: DataFrame) -> DataFrame:
    """Tracks that have no samples, digests or totals, with the reason."""
    return parts.select("file_id", "track_index", headers.refusal().alias("reason")).where("reason IS NOT NULL")


class Stream:
    """The elementary stream of a track: start codes for length prefixes, parameter sets put in where decoding may begin.

    A segment begins at a parameter set and at a refresh slice that opens a picture. Its first refresh slice takes both
    sets if none came before in its sample; one with only a sequence set before it takes the picture sets.
    """

    def __init__(self, width: int, sequence_sets: list[bytes], picture_sets: list[bytes]):
        self.width = width
        self.pictures = b"".join(LONG_START + p for p in picture_sets)
        self.both = b"".join(LONG_START + s for s in sequence_sets) + self.pictures
        self.state = hashlib.sha256()
        self.size = self.access_units = self.insertions = 0
        self.fresh, self.reason = True, None

    def split(self, sample: bytes) -> list[bytes] | None:
        """The units of a sample, or None where a prefix runs past it."""
        units, at = [], 0
        while at < len(sample):
            start = at + self.width
            end = start + int.from_bytes(sample[at:start], "big")
            if start > len(sample) or end > len(sample):
                return None
            units.append(sample[start:end])
            at = end
        return units

    def add(self, sample: bytes) -> None:
        units = None if self.reason else self.split(sample)
        if units is None:
            self.reason = RUNS_PAST
            return
        self.access_units += bool(units)
        sequence = picture = False
        for number, unit in enumerate(units):
            kind = unit[0] & 0x1F if unit else 0
            sequence, picture = sequence or kind == SEQUENCE_SET, picture or kind == PICTURE_SET
            opens = len(unit) > 1 and unit[1] & 0x80
            self.fresh = self.fresh or kind in (SEQUENCE_SET, PICTURE_SET) or (kind == REFRESH_SLICE and bool(opens))
            inserted = b""
            if kind == REFRESH_SLICE and not picture:
                if not sequence and self.fresh:
                    inserted, self.fresh = self.both, False
                    self.insertions += 1
                elif sequence:
                    inserted = self.pictures
            coded = inserted + (SHORT_START if number or inserted else LONG_START) + unit
            self.state.update(coded)
            self.size += len(coded)


class Media:
    """The bytes of one file, from its content or from its path."""

    def __init__(self, content: pa.Scalar | None, path: str | None):
        self.stream = None
        if content is not None:
            self.view = memoryview(content.as_buffer())
            self.length = len(self.view)
        else:
            system, name = opened(path)
            self.stream = system.open_input_file(name)
            self.length = self.stream.size()

    def read(self, at: int, size: int) -> bytes:
        if self.stream is None:
            return self.view[at : at + size].tobytes()
        return self.stream.read_at(size, at)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


class Track:
    """What a row of ``places`` says: samples in decode order."""

    def __init__(self, offsets: np.ndarray, counts: np.ndarray, size: int | None, sizes: np.ndarray):
        self.offsets, self.counts, self.size = offsets, counts, size
        self.samples = int(counts.sum())
        if self.size is None and self.samples:
            self.sizes = sizes
            self.ends = np.concatenate(([0], np.cumsum(sizes)))

    def chunks(self) -> Iterator[tuple[int, int, int, int]]:
        """The first sample of each chunk, how many it holds, its offset and its bytes."""
        if not len(self.counts):
            return iter(())
        last = np.cumsum(self.counts)
        if self.size is not None:
            sizes = [n * self.size for n in self.counts.tolist()]
        else:
            sizes = (self.ends[last] - self.ends[last - self.counts]).tolist() if self.samples else [0] * len(last)
        return zip((last - self.counts).tolist(), self.counts.tolist(), self.offsets.tolist(), sizes, strict=True)

    def sizes_of(self, first: int, n: int) -> Iterable[int]:
        return (self.size for _ in range(n)) if self.size is not None else self.sizes[first : first + n].tolist()

    def problem(self, length: int) -> str | None:
        """Why the track can't be read whole from a file of so many bytes."""
        largest = self.size if self.size is not None else int(self.sizes.max()) if self.samples else 0
        if any(offset + size > length for _, _, offset, size in self.chunks()):
            return OUT_OF_BOUNDS
        return TOO_LARGE if self.samples and largest > MAX_SAMPLE_SIZE else None


def _digest(media: Media, track: Track, avc: dict | None, payload: bool, stream: bool) -> list:
    """The fields of DIGESTS; those of a digest that isn't asked for are NULL."""
    reason = track.problem(media.length)
    if reason:
        return [track.samples, None, None, reason, None, None, None, None, reason if avc else None]
    state, total = hashlib.sha256() if payload else None, 0
    stream = Stream(avc["width"], avc["sps"], avc["pps"]) if avc and stream else None
    for first, n, offset, size in track.chunks():
        at, total = offset, total + size
        if stream is None or stream.reason:
            while payload and at < offset + size:
                piece = media.read(at, min(PIECE, offset + size - at))
                state.update(piece)
                at += len(piece)
            continue
        for held in track.sizes_of(first, n):
            sample = media.read(at, held)
            if payload:
                state.update(sample)
            stream.add(sample)
            at += held
    row = [track.samples, total, state.hexdigest() if payload else None, None]
    if stream is None:
        return [*row, None, None, None, None, None]
    if stream.reason:
        return [*row, None, None, None, None, stream.reason]
    return [*row, stream.state.hexdigest(), stream.size, stream.access_units, stream.insertions, None]


class Batch:
    """The tracks of a batch of ``places`` rows, and the files they lie in; columns are looked at as arrays, once."""

    def __init__(self, batch: pa.RecordBatch):
        column = {name: batch.column(name) for name in batch.schema.names}
        self.rows = batch.num_rows
        self.keys = [column["file_id"].to_pylist(), column["track_index"].to_pylist()]
        self.reason, self.avc, self.size = (column[n].to_pylist() for n in ("reason", "avc", "size"))
        self.offsets, self.counts = (column["chunks"].flatten().field(n).to_numpy() for n in ("offset", "n"))
        self.sizes = column["sizes"].flatten().to_numpy().astype(np.int64)
        self.chunk_at, self.size_at = (
            np.concatenate(([0], np.cumsum(column[n].value_lengths().fill_null(0).to_numpy()))).tolist() for n in ("chunks", "sizes")
        )
        self.content, self.path = column.get("content"), column["path"].to_pylist() if "path" in column else None

    def track(self, k: int) -> Track:
        chunks, sizes = slice(*self.chunk_at[k : k + 2]), slice(*self.size_at[k : k + 2])
        return Track(self.offsets[chunks], self.counts[chunks], self.size[k], self.sizes[sizes])

    def open(self, k: int) -> Media:
        return Media(self.content[k], None) if self.content is not None else Media(None, self.path[k])


def _kept(placed: DataFrame, ddl: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, T.StructType, list[str]]:
    """The columns the readers need, and the schema of their rows: the track's keys, what is made and what is kept."""
    source = "content" if "content" in placed.columns else "path"
    needed = placed.select("file_id", "track_index", "reason", "chunks", "size", "sizes", "avc", source, *keep)
    made = T._parse_datatype_string(ddl)
    keys = [f for f in needed.schema.fields if f.name in ("file_id", "track_index")]
    return needed, T.StructType([*keys, *made.fields, *[needed.schema[name] for name in keep]]), [f.name for f in made.fields]


def _unreadable(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error)[:200]}"


def _columns(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def digests(placed: DataFrame, payload: bool = True, stream: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per track of ``places`` rows with ``content`` or ``path``: see DIGESTS, with the versions of the digests.

    A digest that isn't asked for isn't worked out: its columns are NULL, as is ``stream_reason`` of a broken unit.
    Columns named in ``keep`` go along, so what else is known of a track needs no join.
    """
    needed, schema, _ = _kept(placed, DIGESTS, keep)
    arrow = None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            batch, rows = Batch(given), []
            for k, (reason, *keys) in enumerate(zip(batch.reason, *batch.keys, strict=True)):
                if reason is None:
                    try:
                        media = batch.open(k)
                        try:
                            made = _digest(media, batch.track(k), batch.avc[k], payload, stream)
                        finally:
                            media.close()
                    except (OSError, ValueError) as error:
                        reason = _unreadable(error)
                if reason is not None:
                    made = [None, None, None, reason, None, None, None, None, reason]
                rows.append([*keys, *made])
            columns = [*_columns(rows, arrow).columns, *(given.column(name) for name in keep)]
            yield pa.RecordBatch.from_arrays(columns, [*arrow.names, *keep])

    arrow = _arrow(T.StructType(schema.fields[: len(schema) - len(keep)]))
    rows = needed.mapInArrow(run, schema)
    return rows.withColumns({"payload_version": F.lit(PAYLOAD_VERSION), "stream_version": F.lit(STREAM_VERSION)})


def samples(placed: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per sample of ``places`` rows: see SAMPLES; ``width`` is that of the unit prefixes of AVC tracks.

    Tracks with a reason have none; a sample that can't be read has the problem instead of its bytes. Without bytes
    nothing but the length of the file is looked at.
    """
    needed, schema, _ = _kept(placed.where("reason IS NULL"), SAMPLES)
    arrow = _arrow(schema)

    def of_track(media: Media, track: Track, width: int | None) -> Iterator[list]:
        for first, n, offset, _ in track.chunks():
            at = offset
            for number, size in enumerate(track.sizes_of(first, n), first):
                problem = OUT_OF_BOUNDS if at + size > media.length else TOO_LARGE if size > MAX_SAMPLE_SIZE else None
                yield [number, at, size, width, media.read(at, size) if with_bytes and problem is None else None, problem]
                at += size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(Batch, batches):
            held, size = [], 0
            for k, keys in enumerate(zip(*batch.keys, strict=True)):
                try:
                    media = batch.open(k)
                except (OSError, ValueError) as error:
                    held.append([*keys, None, None, None, None, None, _unreadable(error)])
                    continue
                avc = batch.avc[k]
                for made in of_track(media, batch.track(k), avc and avc["width"]):
                    held.append([*keys, *made])
                    size += len(made[4] or b"")
                    if size > PIECE or len(held) == ROWS:
                        yield _columns(held, arrow)
                        held, size = [], 0
                media.close()
            if held:
                yield _columns(held, arrow)

    return needed.mapInArrow(run, schema)


def file_digests(paths: DataFrame) -> DataFrame:
    """``file_id, sha256, length, reason`` of the files of ``path``, of any size, read in pieces."""
    schema = T._parse_datatype_string("file_id string, sha256 string, length bigint, reason string")
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = {"file_id": path, "sha256": None, "length": None, "reason": None}
                try:
                    media, state = Media(None, path), hashlib.sha256()
                    for at in range(0, media.length, PIECE):
                        state.update(media.read(at, min(PIECE, media.length - at)))
                    media.close()
                    row |= {"sha256": state.hexdigest(), "length": media.length}
                except (OSError, ValueError) as error:
                    row["reason"] = _unreadable(error)
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return paths.select("path").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([pa.field(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
