"""Web archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a seek table in a skippable frame, as
the seekable format has it, so any reader of Zstandard can read a bundle through and one that knows the table can jump.
An index maps each record to its bundle, frame and offset within the frame.

Bundles go to a folder all executors reach, under a name that no other attempt of a task uses; the index holds the
bundles of the attempts that counted, so what a lost executor left behind is never read.
"""

from __future__ import annotations

import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm.common import shared_folder, stored, whole_text

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of records that a frame takes before it is closed, and of frames that a bundle takes.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
# Payloads from this size on are written once.
REVISIT_BYTES = 1000

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("bundle", T.StringType(), False),
        T.StructField("frame", T.IntegerType(), False),
        T.StructField("offset", T.IntegerType(), False),
        T.StructField("length", T.IntegerType(), False),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_digest", T.StringType(), False),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme, or with file:, is a mounted folder."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle, of (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, from the end of an open bundle."""
    file.seek(file.size() - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(file.size() - 9 - count * width)
    entries, frames, start = file.read(count * width), [], 0
    for i in range(count):
        compressed, plain = struct.unpack_from("<II", entries, i * width)
        frames.append((start, compressed, plain))
        start += compressed
    return frames


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC record. A revisit has the response's head, whose Content-Length is the payload's, and no payload."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, the fields of its HTTP head and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """A bundle being written: frames one after the other, the table at the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, place = opened(self.path)
        self.file = store.open_output_stream(place, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.written = 0

    def add(self, plain: bytes) -> int:
        """Writes a frame and gives its number."""
        # Frames are of a size, so a compressor that knows it makes them checkable and small.
        data = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)
        self.file.write(data)
        self.frames.append((len(data), len(plain)))
        self.written += len(data)
        return len(self.frames) - 1

    def close(self) -> None:
        self.file.write(seek_table(self.frames))
        self.file.close()


def with_origins(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes and refers_to, null for what is written in full.

    Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is written in full; rows
    that repeat that page_id are too. A null html is an empty payload. A null page_id is never the largest.
    """
    rows = pages.select("page_id", "url", F.encode(whole_text("html"), "UTF-8").alias("payload"))
    rows = rows.withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    # Only digests that repeat are kept, as a written table: its size is known, so the join is a broadcast only if small.
    repeated = stored(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select("payload_digest", "original"),
        "warc-originals",
    )
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        "payload_bytes",
        F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and gives the index, a table that is written too.

    ``folder`` must be reached by all executors; without one it is below the session's shared folder. A task holds one
    frame. An empty table gives an empty index.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, place = opened(folder)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, frame, places, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, frame, places, size
            bundle = bundle or Bundle(folder)
            number = bundle.add(b"".join(frame))
            done = pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in places], pa.int64()),
                    pa.array([bundle.path] * len(places), pa.string()),
                    pa.array([number] * len(places), pa.int32()),
                    pa.array([p[1] for p in places], pa.int32()),
                    pa.array([p[2] for p in places], pa.int32()),
                ],
                names=INDEX.names,
            )
            frame, places, size = [], [], 0
            if bundle.written >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            return done

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")]
            for at in range(batch.num_rows):
                row = [c[at].as_py() for c in columns]
                data = record(*row)
                frame.append(data)
                places.append((row[0], size, len(data)))
                size += len(data)
                if size >= FRAME_BYTES:
                    yield flush()
        if frame:
            yield flush()
        if bundle:
            bundle.close()

    return stored(with_origins(pages).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """The records of an index, read back from their bundles: RECORD, one row for each.

    The records of a frame are asked for together (a frame bounds their number), the table of a bundle is read once a
    task. Frames are dealt by bundle over as many partitions as there are bundles: the index is small, what it points to
    isn't. The digest of a payload that is there is computed anew; a difference is an error.
    """
    bundles = index.select("bundle").distinct().count()
    frames = (
        index.groupBy("bundle", "frame")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
        .repartition(max(1, bundles), "bundle")
        .sortWithinPartitions("bundle", "frame")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        path, file, table = None, None, []
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                bundle, frame, places = (batch.column(n)[at].as_py() for n in ("bundle", "frame", "places"))
                if bundle != path:
                    if file:
                        file.close()
                    store, place = opened(bundle)
                    path, file = bundle, store.open_input_file(place)
                    table = read_seek_table(file)
                start, compressed, plain = table[frame]
                file.seek(start)
                data = zstandard.ZstdDecompressor().decompress(file.read(compressed), max_output_size=plain)
                for p in places:
                    fields, http, payload = parse(data[p["offset"] : p["offset"] + p["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{bundle}, frame {frame}: a payload differs from its digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append(
                        (
                            number(fields["WARC-Record-ID"]),
                            int(http["Content-Length"]),
                            digest,
                            fields["WARC-Type"],
                            number(refers) if refers else None,
                            fields.get("WARC-Target-URI"),
                        )
                    )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=RECORD.names
            )
        if file:
            file.close()

    return frames.mapInArrow(run, RECORD)
