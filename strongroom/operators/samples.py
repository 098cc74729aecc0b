"""Sample tables: run-length rows expanded to located samples, totals and cross-checks.

Times and chunk numbers are worked out on the runs, in closed form, before anything is expanded:
a run knows the index and the time it starts at, so its samples need no window of their own.
Long runs are first cut into spans and the spans are spread, so one long run is many tasks.

Tables, all keyed by ``file_id, track_index``: ``stts(run, n, delta)``, ``stsc(run, first_chunk,
per_chunk, description)``, ``stsz(idx, size)``, ``stco(chunk, offset)``,
``stss(position, sample_number)``,
``ctts(run, n, offset)``. ``run`` is zero-based and dense, ``chunk`` one-based and dense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strongroom.operators.running import by_rows, neighbour, running_totals

TRACK = ["file_id", "track_index"]
RUNS_PER_BLOCK = 4096
SPAN = 65536

# The cross-checks in the order they are made.
RULES = (
    (1, "the time-to-sample table covers a different number of samples than the size table"),
    (2, "the sample-to-chunk table is not ascending from chunk one"),
    (3, "the sample-to-chunk table names a chunk past the offset table"),
    (4, "the sample-to-chunk table declares an empty chunk"),
    (5, "samples are declared and no chunk locates them"),
    (6, "the sample-to-chunk table does not start at chunk one"),
    (7, "the chunks hold a different number of samples than the size table declares"),
    (8, "the sync sample table is not ascending within the sample count"),
    (9, "the composition offset table covers a different number of samples than the size table"),
)


def _runs_by(name: str) -> Column:
    return by_rows(name, RUNS_PER_BLOCK)


def spans(df: DataFrame, length: str, keys: list[str]) -> DataFrame:
    """Cuts rows of ``length`` members into spans of at most ``SPAN`` and spreads the spans."""
    last_span = F.floor((F.col(length) - 1) / SPAN).cast("bigint")
    cut = df.where(F.col(length) > 0).withColumn("__span", F.explode(F.sequence(F.lit(0).cast("bigint"), last_span)))
    return cut.repartition(*keys, "__span")


def members(df: DataFrame, length: str) -> Column:
    """The zero-based member numbers of a span, as a generator."""
    start = F.col("__span") * SPAN
    return F.explode(F.sequence(start, F.least(start + SPAN, F.col(length)) - 1))


def expand_durations(stts: DataFrame) -> DataFrame:
    """One row per sample with its duration and decode time."""
    based = running_totals(
        stts,
        TRACK,
        ["run"],
        _runs_by("run"),
        {"start": F.col("n"), "base_time": F.col("n") * F.col("delta")},
    )
    spread = spans(based, "n", [*TRACK, "run"])
    return spread.withColumn("i", members(spread, "n")).select(
        *TRACK,
        (F.col("start") + F.col("i")).alias("idx"),
        F.col("delta").alias("duration"),
        (F.col("base_time") + F.col("i") * F.col("delta")).alias("decode_time"),
    )


def expand_compositions(ctts: DataFrame) -> DataFrame:
    """One row per sample with its composition offset."""
    based = running_totals(ctts, TRACK, ["run"], _runs_by("run"), {"start": F.col("n")})
    spread = spans(based, "n", [*TRACK, "run"])
    return spread.withColumn("i", members(spread, "n")).select(
        *TRACK, (F.col("start") + F.col("i")).alias("idx"), F.col("offset").alias("composition_offset")
    )


def chunk_counts(stco: DataFrame) -> DataFrame:
    return stco.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("chunks"))


def run_extents(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """Every chunk run with the chunk the next run starts at: one past the last for the last run."""
    following = neighbour(stsc, TRACK, "run", 1, {"first_chunk": "following"})
    return (
        following.join(chunk_counts(stco), TRACK, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        .withColumn("next_first", F.coalesce("following", F.col("chunks") + 1))
        .withColumn("run_chunks", F.greatest(F.col("next_first") - F.col("first_chunk"), F.lit(0)))
        .drop("following")
    )


def placed_samples(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """How many samples the chunk runs place, from the runs alone."""
    return (
        run_extents(stsc, stco)
        .groupBy(*TRACK)
        .agg(F.sum(F.col("run_chunks") * F.col("per_chunk")).alias("placed"))
    )


def expand_chunks(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """One row per chunk with the index of its first sample and how many it holds."""
    based = running_totals(
        run_extents(stsc, stco),
        TRACK,
        ["run"],
        _runs_by("run"),
        {"start": F.col("run_chunks") * F.col("per_chunk")},
    )
    spread = spans(based, "run_chunks", [*TRACK, "run"])
    return spread.withColumn("i", members(spread, "run_chunks")).select(
        *TRACK,
        (F.col("first_chunk") + F.col("i")).alias("chunk"),
        (F.col("start") + F.col("i") * F.col("per_chunk")).alias("first_idx"),
        "per_chunk",
    )


def assign_chunks(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """One row per sample with the chunk it lies in, the chunk's offset and its place in it."""
    chunks = expand_chunks(stsc, stco).join(stco, [*TRACK, "chunk"])
    spread = spans(chunks, "per_chunk", [*TRACK, "chunk"])
    return spread.withColumn("i", members(spread, "per_chunk")).select(
        *TRACK,
        (F.col("first_idx") + F.col("i")).alias("idx"),
        "chunk",
        F.col("i").alias("in_chunk"),
        F.col("offset").alias("chunk_offset"),
    )


def locate(stsc: DataFrame, stco: DataFrame, stsz: DataFrame) -> DataFrame:
    """Absolute offset of every sample: its chunk's offset and the earlier sizes in that chunk."""
    sized = assign_chunks(stsc, stco).join(stsz, [*TRACK, "idx"])
    before = running_totals(
        sized, [*TRACK, "chunk"], ["idx"], by_rows("in_chunk", SPAN), {"before": F.col("size")}
    )
    return before.select(*TRACK, "idx", "chunk", "size", (F.col("chunk_offset") + F.col("before")).alias("offset"))


def sync_flags(stsz: DataFrame, stss: DataFrame) -> DataFrame:
    """Whether each sample is a sync sample; a track without the table is all sync samples."""
    having = stss.groupBy(*TRACK).agg(F.lit(True).alias("has_table"))
    numbers = stss.select(*TRACK, (F.col("sample_number") - 1).alias("idx"), F.lit(True).alias("listed"))
    return (
        stsz.select(*TRACK, "idx")
        .join(having, TRACK, "left")
        .join(numbers, [*TRACK, "idx"], "left")
        .select(*TRACK, "idx", (F.col("has_table").isNull() | F.col("listed").isNotNull()).alias("sync"))
    )


def samples(
    stts: DataFrame, stsc: DataFrame, stsz: DataFrame, stco: DataFrame, stss: DataFrame, ctts: DataFrame
) -> DataFrame:
    """The sample fact table: every sample in decode order, located."""
    return (
        locate(stsc, stco, stsz)
        .join(expand_durations(stts), [*TRACK, "idx"], "left")
        .join(expand_compositions(ctts), [*TRACK, "idx"], "left")
        .join(sync_flags(stsz, stss), [*TRACK, "idx"])
        .select(
            *TRACK,
            "idx",
            "offset",
            "size",
            F.coalesce("decode_time", F.lit(0)).alias("decode_time"),
            F.coalesce("duration", F.lit(0)).alias("duration"),
            F.coalesce("composition_offset", F.lit(0)).alias("composition_offset"),
            "sync",
            "chunk",
        )
    )


def _in_track(*order: Column | str):
    return Window.partitionBy(*TRACK).orderBy(*order)


def _filled(value: Column, by) -> Column:
    """The last value that is there, of the rows up to this one."""
    return F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))


def _before(value: Column, by) -> Column:
    """The sum over the earlier rows."""
    return F.coalesce(F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _marks(df: DataFrame, rank: int, at: Column | str, **mark: Column | str) -> DataFrame:
    """Rows of a table as marks along the samples: where they begin, and what they say."""
    fields = [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(n) for n, c in mark.items()]
    at = F.col(at) if isinstance(at, str) else at
    return df.select(*TRACK, at.cast("bigint").alias("pos"), F.lit(rank).alias("rank"), F.struct(*fields).alias(f"m{rank}"))


def _along(stsz: DataFrame, *marks: DataFrame) -> DataFrame:
    """The samples with, of each table of marks, the last that begins at them or before, and whether the track has any of
    the fourth."""
    sized = stsz.select(*TRACK, F.col("idx").alias("pos"), F.lit(9).alias("rank"), "size")
    rows = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), [sized, *marks])
    names = [c for c in rows.columns if c in ("m1", "m2", "m3", "m4")]
    by = _in_track("pos", "rank")
    # A chunk also knows the bytes of all samples before it.
    rows = rows.withColumn("sum", _before(F.coalesce("size", F.lit(0)), by))
    rows = rows.withColumn("m1", F.when(F.col("m1").isNotNull(), F.col("m1").withField("sum", F.col("sum"))))
    filled = {name: _filled(F.col(name), by) for name in names}
    if "m4" in names:
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        filled["has_table"] = F.coalesce(F.bool_or(F.col("m4").isNotNull()).over(whole), F.lit(False))
    return rows.withColumns(filled).where("rank = 9")


def _chunk_marks(stsc: DataFrame, stco: DataFrame) -> DataFrame:
    """Chunks that hold samples, at their first."""
    runs = stsc.select(*TRACK, F.col("first_chunk").cast("bigint").alias("chunk"), F.lit(0).alias("rank"), F.col("per_chunk").cast("bigint").alias("per"))
    rows = stco.select(*TRACK, F.col("chunk").cast("bigint").alias("chunk"), F.lit(1).alias("rank"), F.col("offset").cast("bigint").alias("offset"))
    by = _in_track("chunk", "rank")
    dealt = runs.unionByName(rows, allowMissingColumns=True).withColumn("n", _filled(F.col("per"), by))
    held = F.when(F.col("rank") == 1, F.col("n")).otherwise(0)
    first = dealt.withColumn("first", _before(held, by)).where("rank = 1 AND n > 0")
    return _marks(first, 1, "first", chunk="chunk", offset="offset", end=F.col("first") + F.col("n"), sum=F.lit(0))


def _run_marks(runs: DataFrame, rank: int, value: str) -> DataFrame:
    """Runs of samples at their first, with the sum of the value over all samples before."""
    by = _in_track("run")
    n, v = F.col("n").cast("bigint"), F.col(value).cast("bigint")
    begun = runs.withColumns({"__start": _before(n, by), "__base": _before(n * v, by)}).where("n > 0")
    return _marks(begun, rank, "__start", start="__start", n="n", value=value, base="__base")


def locate_whole(stsc: DataFrame, stco: DataFrame, stsz: DataFrame) -> DataFrame:
    """``locate`` of tables that agree with each other, where no track is larger than a task takes (``small_keys``).

    The rows of a track are brought together once and read along its samples: nothing is expanded or joined.
    """
    rows = _along(stsz, _chunk_marks(stsc, stco))
    return rows.where("pos < m1.end").select(
        *TRACK,
        F.col("pos").alias("idx"),
        F.col("m1.chunk").alias("chunk"),
        "size",
        (F.col("m1.offset") + F.col("sum") - F.col("m1.sum")).alias("offset"),
    )


def samples_whole(
    stts: DataFrame, stsc: DataFrame, stsz: DataFrame, stco: DataFrame, stss: DataFrame, ctts: DataFrame
) -> DataFrame:
    """``samples`` under the terms of ``locate_whole``."""
    listed = _marks(stss, 4, F.col("sample_number") - 1, idx=F.col("sample_number") - 1)
    rows = _along(stsz, _chunk_marks(stsc, stco), _run_marks(stts, 2, "delta"), _run_marks(ctts, 3, "offset"), listed)
    rows = rows.where("pos < m1.end")
    timed = F.col("pos") < F.col("m2.start") + F.col("m2.n")
    moved = F.col("pos") < F.col("m3.start") + F.col("m3.n")
    return rows.select(
        *TRACK,
        F.col("pos").alias("idx"),
        (F.col("m1.offset") + F.col("sum") - F.col("m1.sum")).alias("offset"),
        "size",
        F.coalesce(F.when(timed, F.col("m2.base") + (F.col("pos") - F.col("m2.start")) * F.col("m2.value")), F.lit(0)).alias("decode_time"),
        F.coalesce(F.when(timed, F.col("m2.value")), F.lit(0)).alias("duration"),
        F.coalesce(F.when(moved, F.col("m3.value")), F.lit(0)).alias("composition_offset"),
        (F.coalesce(F.col("m4.idx") == F.col("pos"), F.lit(False)) | ~F.col("has_table")).alias("sync"),
        F.col("m1.chunk").alias("chunk"),
    )


def totals(stsz: DataFrame, stss: DataFrame, ctts: DataFrame) -> DataFrame:
    """Count, bytes, sync count and whether any composition offset is not zero, per track."""
    sizes = stsz.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("size").alias("sample_bytes")
    )
    syncs = stss.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("listed"))
    moved = ctts.groupBy(*TRACK).agg(F.max((F.col("offset") != 0).cast("int")).alias("moved"))
    return (
        sizes.join(syncs, TRACK, "left")
        .join(moved, TRACK, "left")
        .select(
            *TRACK,
            "sample_count",
            "sample_bytes",
            F.coalesce("listed", "sample_count").alias("sync_sample_count"),
            (F.coalesce("moved", F.lit(0)) == 1).alias("composition_offsets"),
        )
    )


def violations(
    stts: DataFrame, stsc: DataFrame, stsz: DataFrame, stco: DataFrame, stss: DataFrame, ctts: DataFrame
) -> DataFrame:
    """Every cross-check a track breaks, with the rank the checks are made in."""
    facts = reduce(
        lambda left, right: left.join(right, TRACK, "full_outer"),
        [
            stsz.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("sized")),
            stts.groupBy(*TRACK).agg(F.sum("n").alias("timed")),
            chunk_counts(stco),
            placed_samples(stsc, stco),
            ctts.groupBy(*TRACK).agg(F.sum("n").alias("composed")),
        ],
    )
    sized = F.coalesce(F.col("sized"), F.lit(0))
    chunks = F.coalesce(F.col("chunks"), F.lit(0))
    runs = (
        neighbour(stsc, TRACK, "run", -1, {"first_chunk": "previous"})
        .join(chunk_counts(stco), TRACK, "left")
        .select(
            *TRACK,
            F.explode(
                F.array_compact(
                    F.array(
                        F.when((F.col("first_chunk") == 0) | (F.col("first_chunk") <= F.col("previous")), 2),
                        F.when(F.col("first_chunk") > chunks, 3),
                        F.when(F.col("per_chunk") == 0, 4),
                        F.when((F.col("run") == 0) & (F.col("first_chunk") != 1), 6),
                    )
                )
            ).alias("rule_rank"),
            "run",
        )
    )
    syncs = (
        neighbour(stss, TRACK, "position", -1, {"sample_number": "previous"})
        .join(stsz.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("sized")), TRACK, "left")
        .where(
            (F.col("sample_number") <= F.coalesce(F.col("previous"), F.lit(0))) | (F.col("sample_number") > sized)
        )
        .select(*TRACK, F.lit(8).alias("rule_rank"), F.col("position").alias("run"))
    )
    whole = facts.select(
        *TRACK,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(F.col("timed"), F.lit(0)) != sized, 1),
                    F.when((sized > 0) & (F.col("placed").isNull() | (chunks == 0)), 5),
                    F.when(F.coalesce(F.col("placed"), F.lit(0)) != sized, 7),
                    F.when(F.col("composed") != sized, 9),
                )
            )
        ).alias("rule_rank"),
        F.lit(0).cast("bigint").alias("run"),
    )
    return _told(runs.unionByName(syncs).unionByName(whole))


def violations_whole(
    stts: DataFrame, stsc: DataFrame, stsz: DataFrame, stco: DataFrame, stss: DataFrame, ctts: DataFrame
) -> DataFrame:
    """``violations`` where no track is larger than a task takes (``small_keys``).

    Counts and sums of a track's tables, its chunk runs and its sync numbers are brought together once: nothing is joined.
    """
    number = F.lit(1)
    facts = [
        stsz.groupBy(*TRACK).agg(F.count(number).alias("sized")),
        stts.groupBy(*TRACK).agg(F.sum("n").alias("timed")),
        chunk_counts(stco),
        ctts.groupBy(*TRACK).agg(F.sum("n").alias("composed")),
    ]
    runs = stsc.select(*TRACK, number.alias("table"), F.col("run").alias("at"), F.col("first_chunk").alias("value"), "per_chunk")
    syncs = stss.select(*TRACK, F.lit(2).alias("table"), F.col("position").alias("at"), F.col("sample_number").alias("value"))
    rows = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), [runs, syncs, *facts])
    every, by = Window.partitionBy(*TRACK), _in_track("table", "at")
    here, near = F.struct("table", "at", "value"), lambda n, step: F.when((n["table"] == F.col("table")) & (n["at"] == F.col("at") + step), n["value"])
    rows = rows.withColumns(
        {
            **{name: F.max(name).over(every) for name in ("sized", "timed", "chunks", "composed")},
            "earlier": F.lag(here).over(by),
            "later": F.lead(here).over(by),
            "__nth": F.row_number().over(by),
        }
    )
    sized, chunks, value = F.coalesce("sized", F.lit(0)), F.coalesce("chunks", F.lit(0)), F.col("value")
    previous = near(F.col("earlier"), -1)
    held = F.greatest(F.coalesce(near(F.col("later"), 1), chunks + 1) - value, F.lit(0)) * F.col("per_chunk")
    rows = rows.withColumn("placed", F.sum(F.when(F.col("table") == 1, held)).over(every))
    run, sync, once = F.col("table") == 1, F.col("table") == 2, F.col("__nth") == 1
    told = lambda rule, wrong, at: F.when(wrong, F.struct(F.lit(rule).alias("rule_rank"), at.cast("bigint").alias("run")))
    at, none = F.col("at"), F.lit(0)
    broken = F.array_compact(
        F.array(
            told(2, run & ((value == 0) | (value <= previous)), at),
            told(3, run & (value > chunks), at),
            told(4, run & (F.col("per_chunk") == 0), at),
            told(6, run & (at == 0) & (value != 1), at),
            told(8, sync & ((value <= F.coalesce(previous, none)) | (value > sized)), at),
            told(1, once & (F.coalesce("timed", none) != sized), none),
            told(5, once & (sized > 0) & (F.col("placed").isNull() | (chunks == 0)), none),
            told(7, once & (F.coalesce("placed", none) != sized), none),
            told(9, once & (F.col("composed") != sized), none),
        )
    )
    return _told(rows.select(*TRACK, F.inline(broken)))


def _told(broken: DataFrame) -> DataFrame:
    """The rules that are broken, with the first place of each and how often."""
    # Checks two to four are made run by run, so the earlier run wins between them.
    stage = F.when(F.col("rule_rank").isin(3, 4), 2).otherwise(F.col("rule_rank"))
    texts = F.create_map(*[F.lit(part) for rule in RULES for part in rule])
    return (
        broken.groupBy(*TRACK, "rule_rank")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(stage.alias("stage"), "run", "rule_rank")).alias("at"))
        .withColumn("what", texts[F.col("rule_rank")])
    )


def first_violation(broken: DataFrame) -> DataFrame:
    """The violation a reader that stops at the first one reports."""
    return broken.groupBy(*TRACK).agg(
        F.min("at").alias("at"), F.min_by("what", "at").alias("what"), F.count(F.lit(1)).alias("rules_broken")
    )
