"""Manifests: track records, structure, vendor boxes and times of every file, and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.functions.json import canonical, unknown_keys
from strongroom.operators import headers, media
from strongroom.operators.boxes import STANDARD_USER_DATA
from strongroom.operators.running import by_rows, numbered

FORMAT = "strongroom-manifest/1"
# The seconds between the two epochs, the clocks, and how a sentence names them.
EPOCH_1904 = 2082844800
CLOCKS = (
    ("container_clock", "the container clock"),
    ("satellite_clock", "the satellite clock"),
    ("file_name", "the file name"),
    ("system_clock_at_manifest", "the system clock at the time of the manifest"),
)
# Track records that are put in order at once.
ASSEMBLED = 4096
# Boxes whose kinds are listed at once.
LISTED = 4096

SCHEMA = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField(
            "file",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("size", T.LongType()),
                    T.StructField("sha256", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "tracks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.LongType()),
                        T.StructField("coding", T.StringType()),
                        T.StructField("sample_count", T.LongType()),
                        T.StructField("payload_sha256", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "times",
            T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("source", T.StringType())])),
        ),
    ]
)


def bit_rate(size: Column, milliseconds: Column) -> Column:
    """Bits per second from bytes over a duration, NULL on a zero duration."""
    bits = (size.cast("decimal(20,0)") * 8000).cast("decimal(28,0)")
    return F.when(milliseconds != 0, F.floor(bits / milliseconds.cast("decimal(20,0)"))).cast("bigint")


# The facts of a track that its record holds beside its digests, and the parts they are made of.
RECORDED = ("track_id", "kind", "coding", "codec_string", "width", "height", "sample_rate", "channels", "timescale", "duration_ticks", "duration_ms")
RECORD_PARTS = ("entry_kind", "entry_header", "entry", "elst")


def track_records(placed: DataFrame) -> DataFrame:
    """One record per track of ``media.places`` rows that have ``RECORD_PARTS`` as well, with its payload digest.

    All that is known of a track is in its row and goes along with it to where its media is read: no record is joined. A
    track that has no totals, as its tables are refused, keeps its record.
    """
    known = headers.typed(F.col)
    listed, configuration = headers.edits(), known["configuration_payload"]
    facts = headers.with_totals(placed).withColumns(
        {
            **{name: known[name] for name in (*RECORDED, "flags", "enabled")},
            "edits": F.when(listed.isNotNull(), F.size(listed)).otherwise(0).cast("bigint"),
            "configuration_sha256": F.sha2(configuration, 256),
        }
    )
    facts = facts.withColumn("average_bit_rate", bit_rate(F.col("sample_bytes"), F.col("duration_ms")))
    counted = ("sample_count", "sync_sample_count", "composition_offsets")
    kept = (*RECORDED, *counted, "flags", "enabled", "average_bit_rate", "configuration_sha256", "edits")
    made = media.digests(facts, stream=False, keep=kept)
    return made.select(
        "file_id",
        "track_index",
        *RECORDED,
        "flags",
        "enabled",
        *counted,
        "average_bit_rate",
        "payload_sha256",
        "payload_version",
        "configuration_sha256",
        "edits",
    )


def vendor_records(user_data: DataFrame, unknown: DataFrame) -> DataFrame:
    """User-data children and unknown top-level boxes of each file, by offset.

    ``(file_id, kind string, offset, size, sha256)`` on both sides.
    """
    standard = F.col("kind").isin(*STANDARD_USER_DATA)
    both = user_data.withColumns({"location": F.lit("user_data"), "standard": standard}).unionByName(
        unknown.withColumns({"location": F.lit("top_level"), "standard": F.lit(False)})
    )
    return numbered(both, ["file_id"], ["offset"], by_rows("offset"), "position")


def structure_records(top: DataFrame) -> DataFrame:
    """Order of kinds, place of the movie box, and the tail, per file.

    ``top(file_id, ord, kind string, offset, size, clipped)``. The walk refuses files of too many boxes; here every group
    is whole. Kinds are listed per block of the order first, so no task sorts a large group's rows at once.
    """
    block = F.floor(F.col("ord") / LISTED).alias("block")
    pieces = top.groupBy("file_id", block).agg(
        F.min(F.when(F.col("kind") == "moov", F.struct("ord", "offset", "size"))).alias("moov"),
        F.min(F.when(F.col("kind") == "mdat", F.col("ord"))).alias("mdat"),
        F.max_by(F.struct("clipped", "size"), "ord").alias("last"),
        F.expr("listagg(kind, ' ') WITHIN GROUP (ORDER BY ord)").alias("piece"),
    )
    whole = pieces.groupBy("file_id").agg(
        F.min("moov").alias("moov"),
        F.min("mdat").alias("mdat"),
        F.max_by("last", "block").alias("last"),
        F.expr("listagg(piece, ' ') WITHIN GROUP (ORDER BY block)").alias("top_level"),
    )
    return whole.select(
        "file_id",
        "top_level",
        (F.col("moov.ord") < F.col("mdat")).alias("moov_before_mdat"),
        F.col("moov.offset").alias("moov_offset"),
        F.col("moov.size").alias("moov_size"),
        F.when(F.col("last.clipped"), F.col("last.size")).alias("clipped_tail_bytes"),
    )


def scoped(files: DataFrame, scope: str) -> DataFrame:
    """File records: a structure scope reads no content, a full scope digests it."""
    digest = F.sha2("content", 256) if scope == "full" else F.lit(None).cast("string")
    return files.select("file_id", F.lit(scope).alias("scope"), digest.alias("sha256"))


def civil(seconds: Column) -> Column:
    """Seconds since 1970 as civil time without a zone; a year past 9999 has more digits and no sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+"))


def civil_1904(seconds: Column) -> Column:
    """Seconds since 1904, the container's epoch, as civil time without a zone."""
    return civil(seconds - EPOCH_1904)


def utc(civil_time: Column) -> Column:
    return F.concat(civil_time, F.lit("Z"))


def times(clocks: DataFrame) -> DataFrame:
    """One row per file and clock that says something, in the order clocks are listed.

    ``clocks(file_id, container_clock, satellite_clock, file_name, system_clock_at_manifest)``.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("source"), F.col(n).alias("value")) for i, (n, _) in enumerate(CLOCKS)])
    return clocks.select("file_id", F.inline(rows)).where("value IS NOT NULL")


def clock_disagreement(said: DataFrame) -> DataFrame:
    """Files with more than one clock: what each says, and how far apart they are in seconds."""
    names = F.create_map(*[F.lit(part) for pair in CLOCKS for part in pair])
    sentence = F.concat(names[F.col("source")], F.lit(" says "), F.col("value"))
    moment = F.unix_seconds(F.to_timestamp("value", "yyyy-MM-dd'T'HH:mm:ss"))
    return (
        said.withColumns({"sentence": sentence, "moment": moment})
        .groupBy("file_id")
        .agg(
            F.count(F.lit(1)).alias("clocks"),
            F.expr("listagg(sentence, ', ') WITHIN GROUP (ORDER BY rank)").alias("list"),
            (F.max("moment") - F.min("moment")).alias("spread_seconds"),
        )
        .where("clocks > 1")
    )


def documents(files: DataFrame, tracks: DataFrame, said: DataFrame) -> DataFrame:
    """Nested documents, one of each file whatever it holds.

    ``files(file_id, name, size, sha256)``, ``tracks(file_id, index, coding, sample_count,
    payload_sha256)``. Track records are put in order per block of the index, then the blocks: no task sorts a large
    file's records at once.
    """
    record = F.struct("index", "coding", "sample_count", "payload_sha256")
    block = F.floor(F.col("index") / ASSEMBLED).alias("block")
    pieces = tracks.groupBy("file_id", block).agg(F.sort_array(F.collect_list(record)).alias("piece"))
    listed = pieces.groupBy("file_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"])).alias("tracks")
    )
    clocks = said.groupBy("file_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "source"))),
            lambda t: F.struct(t["value"].alias("value"), t["source"].alias("source")),
        ).alias("times")
    )
    none = F.array().cast(SCHEMA["times"].dataType)
    return (
        files.join(listed, "file_id", "left")
        .join(clocks, "file_id", "left")
        .select(
            "file_id",
            F.struct(
                F.lit(FORMAT).alias("format"),
                F.struct("name", "size", "sha256").alias("file"),
                F.coalesce("tracks", F.array().cast(SCHEMA["tracks"].dataType)).alias("tracks"),
                F.coalesce("times", none).alias("times"),
            ).alias("manifest"),
        )
    )


def to_canonical_json(manifests: DataFrame) -> DataFrame:
    """Documents as canonical text with a last line break."""
    kind = manifests.schema["manifest"].dataType
    return manifests.select(
        "file_id", F.concat(canonical(F.col("manifest"), kind), F.lit("\n")).alias("json")
    )


def from_json(texts: DataFrame, text: str = "json") -> DataFrame:
    """Documents read strictly: malformed text, another format or an unknown key is a reason, not a document."""
    corrupt = "_corrupt"
    schema = T.StructType([*SCHEMA.fields, T.StructField(corrupt, T.StringType())])
    read = texts.withColumn(
        "manifest", F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    ).withColumn("unknown", unknown_keys(F.col(text), SCHEMA))
    reason = (
        F.when(F.col("manifest").isNull() | F.col(f"manifest.{corrupt}").isNotNull(), "malformed")
        .when(F.size("unknown") > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_sort("unknown"), ", ")))
        .when(~F.col("manifest.format").eqNullSafe(FORMAT), "another format")
    )
    return read.withColumn("reason", reason).withColumn(
        "manifest", F.when(F.col("reason").isNull(), F.col("manifest").dropFields(corrupt))
    ).drop("unknown")
