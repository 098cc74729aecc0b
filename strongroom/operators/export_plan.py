"""Export planning as tables: what is kept, where it lands, and whether it still carries its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.operators.running import by_rows, neighbour, numbered, running_totals

# The end narrow offsets reach, the largest piece copied at once.
NARROW_LIMIT = 0xFFFFFFFF
COPY_BUFFER = 16 * 1024 * 1024
NO_VIDEO = "the recording has no video track"
NO_REAR = "the recording has one video track, so there is no rear camera to keep"
NO_SECOND_VIDEO = "the second recording has no video track"


def select_camera(tracks: DataFrame, selection: str, block: Column) -> DataFrame:
    """Tracks a camera selection keeps: ``front`` and ``rear`` take one video and every audio, ``both`` all.

    ``tracks(file_id, track_index, kind, …)``; ``block`` follows ``track_index``.
    """
    if selection == "both":
        return tracks
    wanted = {"front": 0, "rear": 1}[selection]
    kinds = tracks.where(F.col("kind").isin("video", "audio"))
    placed = numbered(kinds, ["file_id", "kind"], ["track_index"], block, "of_kind")
    kept = placed.where((F.col("kind") == "audio") | (F.col("of_kind") == wanted)).drop("of_kind")
    return kept.join(refused_camera(tracks, selection).select("file_id"), "file_id", "left_anti")


def refused_camera(tracks: DataFrame, selection: str) -> DataFrame:
    """Files a camera selection cannot be made from, each with its reason."""
    videos = tracks.groupBy("file_id").agg(F.count(F.when(F.col("kind") == "video", 1)).alias("videos"))
    if selection == "both":
        return videos.where(F.lit(False)).select("file_id", F.lit("").alias("reason"))
    needed, reason = {"front": (1, NO_VIDEO), "rear": (2, NO_REAR)}[selection]
    return videos.where(F.col("videos") < needed).select("file_id", F.lit(reason).alias("reason"))


def select_listed(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tracks a list of ``(file_id, track_index)`` names."""
    return tracks.join(wanted.select("file_id", "track_index").distinct(), ["file_id", "track_index"])


def missing_listed(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listed tracks the recording does not have."""
    return (
        wanted.select("file_id", "track_index")
        .distinct()
        .join(tracks, ["file_id", "track_index"], "left_anti")
        .withColumn("reason", F.concat(F.lit("the recording has no track "), F.col("track_index").cast("string")))
    )


def join_two(pairs: DataFrame, tracks: DataFrame, block: Column) -> DataFrame:
    """Front and audio of the first file, then the first video of the second.

    ``pairs(export_id, first_id, second_id)``.
    """
    front = select_camera(tracks, "front", block)
    video = numbered(
        tracks.where("kind = 'video'"), ["file_id"], ["track_index"], block, "of_kind"
    ).where("of_kind = 0")
    first = pairs.select("export_id", F.col("first_id").alias("file_id"), F.lit(0).alias("input")).join(front, "file_id")
    second = pairs.select("export_id", F.col("second_id").alias("file_id"), F.lit(1).alias("input")).join(
        video.drop("of_kind"), "file_id"
    )
    return first.unionByName(second.select(*first.columns))


def selection_problems(exports: DataFrame, tracks: DataFrame, selected: DataFrame) -> DataFrame:
    """Nothing selected, a track that does not exist, a track selected twice."""
    empty = exports.select("export_id").join(selected, "export_id", "left_anti").select(
        "export_id", F.lit("nothing_selected").alias("problem"), F.lit(None).cast("bigint").alias("track_index")
    )
    times = selected.groupBy("export_id", "track_index").agg(F.count(F.lit(1)).alias("times"))
    missing = times.join(tracks, ["export_id", "track_index"], "left_anti").select(
        "export_id", F.lit("no_such_track").alias("problem"), F.col("track_index").cast("bigint")
    )
    twice = times.where("times > 1").select(
        "export_id", F.lit("selected_twice").alias("problem"), F.col("track_index").cast("bigint")
    )
    return empty.unionByName(missing).unionByName(twice)


def renumber(selected: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Output position and identifier: kept for one input, one to n in output order for more."""
    inputs = selected.groupBy("export_id").agg((F.max("input") > F.min("input")).alias("renumbered"))
    placed = numbered(selected, ["export_id"], order, block, "output_index")
    return placed.join(inputs, "export_id").withColumn(
        "track_id", F.when(F.col("renumbered"), F.col("output_index") + 1).otherwise(F.col("source_track_id"))
    )


def chunk_runs(samples: DataFrame) -> DataFrame:
    """Consecutive samples of one chunk as one row: first index, count, bytes, first time.

    ``samples(export_id, slot, idx, chunk, size, decode_time, timescale)``. Index less rank within
    the chunk is constant along a run, so runs fall out of a pre-aggregated grouping.
    """
    ranked = numbered(samples, ["export_id", "slot", "chunk"], ["idx"], by_rows("idx"), "rank")
    return (
        ranked.groupBy("export_id", "slot", "chunk", (F.col("idx") - F.col("rank")).alias("run"))
        .agg(
            F.min("idx").alias("first"),
            F.count(F.lit(1)).alias("count"),
            F.sum("size").alias("bytes"),
            F.min("decode_time").alias("time"),
            F.min("timescale").alias("timescale"),
        )
        .drop("run")
    )


def with_exact_time(chunks: DataFrame) -> DataFrame:
    """Decode time as whole seconds and the fraction's first 64 binary digits, in two halves.

    Two different fractions with denominators under 2^32 differ by more than 2^-64, and equal ones have
    equal digits, so the order is exact whatever the timescales are, and no product can overflow.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    scale = F.greatest(F.col("timescale"), F.lit(1)).cast("bigint")
    half = F.lit(1 << 32)
    digits = chunks.withColumn("second", F.expr("time DIV greatest(timescale, 1)")).withColumn(
        "__left", wide(F.col("time") % scale) * half
    )
    return (
        digits.withColumn("part", F.floor(F.col("__left") / wide(scale)).cast("bigint"))
        .withColumn("__left", wide(F.col("__left") % wide(scale)) * half)
        .withColumn("part_low", F.floor(F.col("__left") / wide(scale)).cast("bigint"))
        .drop("__left")
    )


INTERLEAVED = ["second", "part", "part_low", "slot", "first"]


def interleave(chunks: DataFrame, seconds_per_block: int = 3600) -> DataFrame:
    """Chunks in the order the output stores them, with their place and the bytes before them."""
    timed = with_exact_time(chunks)
    block = F.floor(F.col("second") / seconds_per_block)
    return running_totals(
        timed,
        ["export_id"],
        INTERLEAVED,
        block,
        {"place": F.lit(1).cast("bigint"), "bytes_before": F.col("bytes")},
    )


def new_offsets(interleaved: DataFrame, base: Column) -> DataFrame:
    """The new offset of every chunk, numbered per track in the track's own order."""
    placed = interleaved.withColumn("offset", base + F.col("bytes_before"))
    return numbered(placed, ["export_id", "slot"], ["first"], by_rows("first"), "position").select(
        "export_id", "slot", "position", "first", "bytes", "offset"
    )


def layout(chunks: DataFrame, base: Column) -> DataFrame:
    """Media bytes per export, where they end, and the widths that follow from it."""
    return (
        chunks.groupBy("export_id")
        .agg(F.sum("bytes").alias("media_bytes"), F.count(F.lit(1)).alias("chunks"))
        .withColumn("wide_header", F.col("media_bytes") + 8 > NARROW_LIMIT)
        .withColumn("media_end", base + F.when(F.col("wide_header"), 16).otherwise(8) + F.col("media_bytes"))
        .withColumn("wide_offsets", F.col("media_end") > NARROW_LIMIT)
    )


def rewrite_references(references: DataFrame, ids: DataFrame) -> DataFrame:
    """References with their target's new identifier, NULL where the target is not kept.

    ``references(export_id, input, slot, type, ord, target)``; ``ids(export_id, input, source_track_id, track_id)``.
    """
    mapped = ids.select(
        "export_id", "input", F.col("source_track_id").alias("target"), F.col("track_id").alias("new_id")
    )
    return references.join(mapped, ["export_id", "input", "target"], "left")


def kept_references(rewritten: DataFrame) -> DataFrame:
    """References that remain; a type without any is gone with its rows."""
    return rewritten.where("new_id IS NOT NULL")


def dropped_references(rewritten: DataFrame) -> DataFrame:
    """How many references each type kept and dropped."""
    return rewritten.groupBy("export_id", "slot", "type").agg(
        F.count("new_id").alias("kept"), F.count_if(F.col("new_id").isNull()).alias("dropped")
    )


def preserved_boxes(
    user_data: DataFrame, unknown: DataFrame, keep_user_data: bool = True, keep_unknown: bool = True
) -> DataFrame:
    """Boxes copied as bytes, in output order: user data, then unknown top-level boxes."""
    places = (
        (user_data, keep_user_data, 0, "user_data"),
        (unknown, keep_unknown, 1, "top_level"),
    )
    tables = [
        df.where(F.lit(keep)).withColumn("rank", F.lit(rank)).withColumn("placement", F.lit(name))
        for df, keep, rank, name in places
    ]
    both = tables[0].unionByName(tables[1])
    block = F.col("rank") * F.lit(1 << 40) + by_rows("offset")
    return numbered(both, ["file_id"], ["rank", "offset"], block, "position").drop("rank")


def read_plan(samples: DataFrame, cap: int = COPY_BUFFER, whole: bool = False) -> DataFrame:
    """Reads that copy each chunk: one when its samples abut and fit the buffer, else one per sample.

    ``samples(file_id, track_index, idx, chunk, offset, size)``. ``whole`` says that no track is larger than a task takes
    (``small_keys``): the samples of a chunk then meet once and are neither joined with each other nor with their chunk.
    """
    keys = ["file_id", "track_index", "chunk"]
    if whole:
        by, every = Window.partitionBy(*keys).orderBy("idx"), Window.partitionBy(*keys)
        rows = samples.withColumn("next", F.lead(F.struct("idx", "offset")).over(by))
        follows = F.col("next").isNull() | (F.col("next.idx") != F.col("idx") + 1) | (F.col("offset") + F.col("size") == F.col("next.offset"))
        rows = rows.withColumns({"first": F.min("idx").over(every), "bytes": F.sum("size").over(every), "one": F.bool_and(follows).over(every)})
        rows = rows.withColumn("one", F.col("one") & (F.col("bytes") <= cap)).where(~F.col("one") | (F.col("idx") == F.col("first")))
        length = F.when(F.col("one"), F.col("bytes")).otherwise(F.col("size"))
        return rows.select(*keys, F.col("idx").alias("first"), "offset", length.alias("length"))
    ahead = neighbour(samples, keys, "idx", 1, {"offset": "next_offset"})
    abuts = F.col("next_offset").isNull() | (F.col("offset") + F.col("size") == F.col("next_offset"))
    chunks = ahead.groupBy(*keys).agg(
        F.bool_and(abuts).alias("contiguous"),
        F.sum("size").alias("bytes"),
        F.min_by("offset", "idx").alias("start"),
        F.min("idx").alias("first"),
    )
    whole = F.col("contiguous") & (F.col("bytes") <= cap)
    joined = chunks.where(whole).select(*keys, "first", F.col("start").alias("offset"), F.col("bytes").alias("length"))
    single = (
        samples.join(chunks.where(~whole).select(*keys), keys)
        .select(*keys, F.col("idx").alias("first"), "offset", F.col("size").alias("length"))
    )
    return joined.unionByName(single)


def track_report(kept: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples and bytes copied per output track."""
    counted = samples.groupBy("export_id", "slot").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("size").alias("bytes")
    )
    return kept.join(counted, ["export_id", "slot"], "left").withColumns(
        {"samples": F.coalesce("samples", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))}
    )


def export_class(kept: DataFrame) -> DataFrame:
    """An archive when more than one video track is written, an extraction otherwise."""
    videos = F.count_if(F.col("kind") == "video")
    return kept.groupBy("export_id").agg(
        videos.alias("videos"),
        F.when(videos > 1, "two_track_archive").otherwise("extraction").alias("class"),
    )


def source_records(kept: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Each source's tracks with where they landed and the fingerprint they had."""
    return kept.join(fingerprints, ["file_id", "track_index"], "left")


def lineage(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per export, the first output track whose payload and configuration are not its source's."""
    o = outputs.select("export_id", "output_index", F.struct("payload_sha256", "configuration_sha256").alias("written"))
    s = sources.select("export_id", "output_index", F.struct("payload_sha256", "configuration_sha256").alias("expected"))
    differs = ~F.col("written").eqNullSafe(F.col("expected"))
    return (
        o.join(s, ["export_id", "output_index"], "left")
        .groupBy("export_id")
        .agg(F.min(F.when(differs, F.col("output_index"))).alias("first_mismatch"), F.count_if(differs).alias("mismatches"))
    )


def canonical_path(path: Column, fold_case: bool = True) -> Column:
    """One spelling per path: empty and single-dot steps removed, double-dot steps taken, the last slash too.

    At the root a double-dot step stays there; a relative path keeps those it cannot take. Case is folded
    for stores that do not tell it apart.
    """
    rooted = path.startswith("/")
    none = F.array().cast("array<string>")
    steps = F.filter(F.split(F.lower(path) if fold_case else path, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        none,
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s)))
        .when((F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .when(rooted, acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(walked, "/"))


def output_is_input(outputs: DataFrame, inputs: DataFrame, fold_case: bool = True) -> DataFrame:
    """Exports that would write over one of their own inputs."""
    keyed = lambda df: df.withColumn("canonical", canonical_path(F.col("path"), fold_case))
    return keyed(outputs).join(keyed(inputs).select("export_id", "canonical"), ["export_id", "canonical"], "left_semi")
