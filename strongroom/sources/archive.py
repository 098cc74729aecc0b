"""Files of an archive: discovery, content, and bounded range reads."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.operators.boxes import (
    FILE_TYPE_BOX_CAP,
    MAX_TOP_LEVEL,
    MOVIE_BOX_CAP,
    STEPPED_OVER,
    UNKNOWN_BOX_HOLD_CAP,
)

# Functions that run in workers are shipped by value: a cluster needs no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the largest sample held at once.
MAX_SAMPLE_SIZE = 64 * 1024 * 1024


def discover(spark: SparkSession, *roots: str) -> DataFrame:
    """Files under the roots, each once, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return found.select("path", "length", F.unix_micros("modificationTime").alias("modified"))


def contents(spark: SparkSession, *roots: str) -> DataFrame:
    """Whole files as ``files(file_id, length, content)``; for files under two gibibytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return found.select(F.col("path").alias("file_id"), "length", "content")


def range_problem(length: Column, offset: Column, size: Column) -> Column:
    """Why a range is refused before anything is read, or NULL."""
    return (
        F.when((offset < 0) | (size < 0) | (offset + size > length), F.lit("out of bounds"))
        .when(size > MAX_SAMPLE_SIZE, F.lit("larger than any sample held"))
    )


def cut_ranges(files: DataFrame, ranges: Column) -> DataFrame:
    """Bytes of ``ranges`` (array of range_id, offset, size) of each file's content, or the problem that refused each.

    Narrow: the ranges are worked out in the file's own row. They are bounded by the movie box that listed them.
    """
    problem = lambda r: range_problem(F.col("length"), r["offset"], r["size"])
    cut = F.transform(
        ranges,
        lambda r: F.struct(
            r["range_id"].alias("range_id"),
            r["offset"].alias("offset"),
            r["size"].alias("size"),
            F.when(
                problem(r).isNull(),
                F.substring(F.col("content"), (r["offset"] + 1).cast("int"), r["size"].cast("int")),
            ).alias("bytes"),
            problem(r).alias("problem"),
        ),
    )
    return files.select("file_id", F.inline_outer(cut))


def opened(path: str):
    """The store and the name in it. Names are taken as they are: spaces, signs and percent signs included."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, name = rest.removeprefix("//").partition("/")
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(), f"{host}/{name}"
    system, _ = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, f"/{name}"


def header_segments(paths: DataFrame) -> DataFrame:
    """``files(file_id, length, segments, reason)`` of paths, reading headers and small boxes only.

    The bytes read per file are its movie box and a few headers, whatever the media holds, and files
    past two gibibytes are fine. Paths are spread by Spark; each task seeks within its own files. A file
    that cannot be read is a row with the reason, without length and segments. The walk ends one past the
    most boxes a file may have, where the walker refuses it.
    """
    schema = "file_id string, length bigint, segments array<struct<offset:bigint,bytes:binary>>, reason string"
    arrow = pa.schema(
        [
            pa.field("file_id", pa.string()),
            pa.field("length", pa.int64()),
            pa.field("segments", pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.binary())]))),
            pa.field("reason", pa.string()),
        ]
    )
    stepped = {code.encode("latin-1") for code in STEPPED_OVER}
    caps, hold, most = {b"moov": MOVIE_BOX_CAP, b"ftyp": FILE_TYPE_BOX_CAP}, UNKNOWN_BOX_HOLD_CAP, MAX_TOP_LEVEL + 1

    def held(stream, length: int) -> list[dict]:
        """Headers of the top-level boxes, whole bytes of the ones worth holding; media is stepped over."""
        found, at, seen = [], 0, False
        while at < length and len(found) < most:
            stream.seek(at)
            head = stream.read(min(16, length - at))
            size = int.from_bytes(head[:4], "big") if len(head) >= 8 else 0
            kind = head[4:8]
            size = length - at if size == 0 else int.from_bytes(head[8:16], "big") if size == 1 else size
            whole = 8 <= size <= length - at
            if whole and kind not in stepped and len(head) < size <= caps.get(kind, hold):
                stream.seek(at)
                head = stream.read(size)
            found.append({"offset": at, "bytes": head})
            # A second movie box or a broken header ends the walk; the walker says why.
            if not whole or (seen and kind == b"moov"):
                break
            seen = seen or kind == b"moov"
            at += size
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = {"file_id": path, "length": None, "segments": None, "reason": None}
                try:
                    system, name = opened(path)
                    with system.open_input_file(name) as stream:
                        length = stream.size()
                        row |= {"segments": held(stream, length), "length": length}
                except (OSError, ValueError) as error:
                    row["reason"] = f"{type(error).__name__}: {str(error)[:200]}"
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return paths.select("path").mapInArrow(run, schema)
