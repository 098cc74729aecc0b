"""What a manifest recorded against what is observed now, as graded findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.operators.running import numbered

FINDING = ("file_id", "subject", "position", "location", "kind", "outcome", "recorded", "observed", "reason")

# The sentence of every subject and outcome, placeholders in braces.
SENTENCES = (
    ("whole_file", "identical", "The file is identical, byte for byte, to the one the manifest was made from."),
    (
        "whole_file",
        "differs",
        "The file differs from the one the manifest was made from: recorded {recorded}, observed {observed}.",
    ),
    (
        "whole_file",
        "not_recorded",
        "The manifest records no whole-file digest, so the file as a whole was not compared.",
    ),
    ("track", "identical", "Track {index}: the stored samples are identical to those the manifest records."),
    ("track", "differs", "Track {index}: the stored samples differ from those the manifest records."),
    (
        "track",
        "not_recorded",
        "Track {index}: the manifest records no fingerprint, so the samples were not compared.",
    ),
    ("track", "not_checkable", "Track {index}: the samples could not be compared: {reason}."),
    ("track", "missing", "Track {index}: the manifest records a track the file does not have."),
    (
        "vendor_box",
        "identical",
        "Vendor box {kind} at {location}: identical to the bytes the manifest records.",
    ),
    ("vendor_box", "differs", "Vendor box {kind} at {location}: differs from the bytes the manifest records."),
    ("vendor_box", "missing", "Vendor box {kind} at {location}: recorded in the manifest and absent from the file."),
    (
        "vendor_box",
        "not_recorded",
        "Vendor box {kind} at {location}: recorded in the manifest and absent from the file.",
    ),
    (
        "vendor_box",
        "not_checkable",
        "Vendor box {kind} at {location}: recorded in the manifest and absent from the file.",
    ),
    (
        "vendor_box",
        "unexpected",
        "Vendor box {kind} at {location}: present in the file and not recorded in the manifest.",
    ),
    ("structure", "identical", "The container structure matches the one the manifest records."),
    ("structure", "differs", "The container structure differs from the one the manifest records."),
)
# How a location is written in a sentence.
LOCATION_WORDS = (("user_data", "user data"), ("top_level", "the top level"))
NOT_HELD = "the box is larger than the reader holds"
NOT_THERE = "the recorded file was not found"


def digest_outcome(recorded: Column, observed: Column) -> Column:
    """Identical or differs, for two digests that both exist."""
    return F.when(recorded == observed, "identical").otherwise("differs")


def shown(outcome: Column, digest: Column) -> Column:
    """A digest is shown only where the two differ."""
    return F.when(outcome == "differs", digest)


def _finding(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {name: F.lit(None).cast("string") for name in FINDING}
    empty["position"] = F.lit(None).cast("bigint")
    columns = {**empty, "file_id": F.col("file_id"), **columns}
    return df.select(*[columns[name].alias(name) for name in FINDING])


def whole_file_findings(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """``recorded(file_id, sha256 NULL)`` against ``observed(file_id, sha256)``.

    A recorded file without an observed digest is not checkable, and says why.
    """
    joined = _both_digests(recorded, observed)
    outcome = F.when(F.col("r").isNull(), "not_recorded").otherwise(_outcome_if_seen())
    return _finding(
        joined,
        subject=F.lit("whole_file"),
        outcome=outcome,
        recorded=shown(outcome, F.col("r")),
        observed=shown(outcome, F.col("o")),
        reason=F.when(outcome == "not_checkable", F.lit(NOT_THERE)),
    )


def _both_digests(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Every recorded file with its digests r and o, NULL where it was not observed."""
    return recorded.select("file_id", F.col("sha256").alias("r")).join(
        observed.select("file_id", F.col("sha256").alias("o")), "file_id", "left"
    )


def _outcome_if_seen() -> Column:
    return F.when(F.col("o").isNull(), "not_checkable").otherwise(digest_outcome(F.col("r"), F.col("o")))


def track_findings(recorded: DataFrame, observed: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Tracks by position; the decoder configuration is compared before the payload.

    ``recorded(file_id, track_index, coding, configuration_sha256, payload_sha256)`` with NULL
    digests where none was recorded; ``observed`` the same plus ``error``;
    ``unreadable(file_id, reason)`` for files whose tables cannot be read.
    """
    names = ("coding", "configuration_sha256", "payload_sha256")
    r = recorded.select("file_id", "track_index", *[F.col(n).alias(f"r_{n}") for n in names])
    o = observed.select(
        "file_id", "track_index", *[F.col(n).alias(f"o_{n}") for n in names], "error", F.lit(True).alias("present")
    )
    u = unreadable.select("file_id", F.col("reason").alias("unreadable"))
    joined = r.join(o, ["file_id", "track_index"], "left").join(u, "file_id", "left")

    configured = F.col("r_configuration_sha256") == F.col("o_configuration_sha256")
    coded = F.coalesce(F.col("o_coding"), F.lit("none"))
    recoded = coded != F.col("r_coding")
    outcome = (
        F.when(F.col("r_payload_sha256").isNull(), "not_recorded")
        .when(F.col("unreadable").isNotNull(), "not_checkable")
        .when(F.col("present").isNull(), "missing")
        .when(recoded, "not_checkable")
        .when(F.col("error").isNotNull(), "not_checkable")
        .when(~configured, "differs")
        .otherwise(digest_outcome(F.col("r_payload_sha256"), F.col("o_payload_sha256")))
    )
    described = F.when(F.col("o_coding").isNull(), "without a sample entry").otherwise(F.col("o_coding"))
    reason = F.when(
        outcome == "not_checkable",
        F.coalesce(
            F.col("unreadable"),
            F.when(
                recoded,
                F.concat(
                    F.lit("the track at this position is "),
                    described,
                    F.lit("; the manifest records "),
                    F.col("r_coding"),
                ),
            ),
            F.col("error"),
        ),
    )
    pick = lambda side: F.when(configured, F.col(f"{side}_payload_sha256")).otherwise(
        F.col(f"{side}_configuration_sha256")
    )
    return _finding(
        joined,
        subject=F.lit("track"),
        position=F.col("track_index").cast("bigint"),
        outcome=outcome,
        recorded=shown(outcome, pick("r")),
        observed=shown(outcome, pick("o")),
        reason=reason,
    )


def kth_match(
    recorded: DataFrame, observed: DataFrame, keys: list[str], order: list[str], block: Column
) -> DataFrame:
    """Pairs the k-th recorded row of a key with the k-th observed one; leftovers stay on their side.

    ``block`` follows ``order``; see ``running``. Both sides end up hashed on key and k, so a key
    with a third of the rows spreads over all tasks of the join.
    """
    r = numbered(recorded, keys, order, block, "k").withColumn("in_recorded", F.lit(True))
    o = numbered(observed, keys, order, block, "k").withColumn("in_observed", F.lit(True))
    rest = [name for name in recorded.columns if name not in keys]
    r = r.select(*keys, "k", "in_recorded", *[F.col(n).alias(f"r_{n}") for n in rest])
    o = o.select(*keys, "k", "in_observed", *[F.col(n).alias(f"o_{n}") for n in observed.columns if n not in keys])
    return r.join(o, [*keys, "k"], "full_outer")


def vendor_findings(recorded: DataFrame, observed: DataFrame, block: Column) -> DataFrame:
    """Boxes of ``(file_id, location, kind, offset, sha256)`` matched by k-th occurrence."""
    matched = kth_match(recorded, observed, ["file_id", "location", "kind"], ["offset"], block)
    r, o = F.col("r_sha256"), F.col("o_sha256")
    outcome = (
        F.when(F.col("in_observed").isNull(), "missing")
        .when(F.col("in_recorded").isNull(), "unexpected")
        .when(r.isNull(), "not_recorded")
        .when(o.isNull(), "not_checkable")
        .otherwise(digest_outcome(r, o))
    )
    return _finding(
        matched,
        subject=F.lit("vendor_box"),
        position=F.col("k"),
        location=F.col("location"),
        kind=F.col("kind"),
        outcome=outcome,
        recorded=shown(outcome, r),
        observed=shown(outcome, o),
        reason=F.when(outcome == "not_checkable", F.lit(NOT_HELD)),
    )


def structure_findings(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """Structural digests, one per file on each side; a recorded file that is gone is not checkable."""
    joined = _both_digests(recorded, observed)
    outcome = _outcome_if_seen()
    return _finding(
        joined,
        subject=F.lit("structure"),
        outcome=outcome,
        recorded=shown(outcome, F.col("r")),
        observed=shown(outcome, F.col("o")),
        reason=F.when(outcome == "not_checkable", F.lit(NOT_THERE)),
    )


def all_findings(*parts: DataFrame) -> DataFrame:
    """The findings of several subjects in one table, with the rank that orders them."""
    rank = (
        F.when(F.col("subject") == "whole_file", 0)
        .when(F.col("subject") == "track", 1)
        .when(F.col("subject") == "vendor_box", 2)
        .otherwise(3)
    )
    return reduce(DataFrame.unionByName, parts).withColumn("subject_rank", rank)


def roll_up(findings: DataFrame) -> DataFrame:
    """True iff something was compared and everything compared is identical."""
    compared = F.col("outcome") != "not_recorded"
    return findings.groupBy("file_id").agg(
        F.count(F.when(compared, 1)).alias("compared"),
        (
            (F.count(F.when(compared, 1)) > 0)
            & (F.count(F.when(compared & (F.col("outcome") != "identical"), 1)) == 0)
        ).alias("every_compared_is_identical"),
    )


def sentences(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """One sentence per finding; a placeholder without a value stays visible."""
    catalogue = spark.createDataFrame(SENTENCES, "subject string, outcome string, template string")
    words = spark.createDataFrame(LOCATION_WORDS, "location string, words string")
    joined = findings.join(F.broadcast(catalogue), ["subject", "outcome"], "left").join(
        F.broadcast(words), "location", "left"
    )
    text = F.coalesce(F.col("template"), F.concat(F.lit("["), F.col("subject"), F.lit("]")))
    for name, value in (
        ("recorded", F.col("recorded")),
        ("observed", F.col("observed")),
        ("index", F.col("position").cast("string")),
        ("reason", F.col("reason")),
        ("kind", F.col("kind")),
        ("location", F.col("words")),
    ):
        text = F.when(value.isNull(), text).otherwise(F.replace(text, F.lit(f"{{{name}}}"), value))
    return joined.select("file_id", "subject", "position", "kind", "location", "outcome", text.alias("sentence"))
