"""Comparison queries over documents, conversations and events.

Documents are files, turns of a conversation are tracks, events of a user are vendor boxes. The
recorded and the observed side are two readings of the same rows, told apart by their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.operators import compare
from strongroom.operators.digests import listing_digests, sha256
from strongroom.plans.registry import by_moment, query, table


def text_id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Recorded for labelled documents, from the text on one line; observed from the text as it is."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    recorded = docs.join(labels, "doc_id", "left").select(
        text_id("doc", "doc_id").alias("file_id"),
        F.when(F.col("quality").isNotNull(), sha256(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("sha256"),
    )
    return recorded, docs.select(text_id("doc", "doc_id").alias("file_id"), sha256("text").alias("sha256"))


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "conversations").select(
        text_id("conv", "conv_id").alias("file_id"),
        F.col("turn").alias("track_index"),
        "role",
        "text",
        F.length("text").alias("n"),
    )
    known = F.col("role") != "system"
    recorded = c.select(
        "file_id",
        "track_index",
        F.col("role").alias("coding"),
        F.when(known, sha256("role")).alias("configuration_sha256"),
        F.when(known, sha256("text")).alias("payload_sha256"),
    )
    observed = c.where("n < 1500").select(
        "file_id",
        "track_index",
        F.when(F.col("n") >= 1000, "recoded").otherwise(F.col("role")).alias("coding"),
        sha256(F.concat("role", F.when(F.col("n") < 60, "+").otherwise(""))).alias("configuration_sha256"),
        sha256(F.replace("text", F.lit("\n"), F.lit(" "))).alias("payload_sha256"),
        F.when(F.col("n").between(800, 999), "no decoder configuration").alias("error"),
    )
    unreadable = (
        c.where("track_index = 0 AND n > 300")
        .select("file_id", F.lit("the sample tables contradict each other").alias("reason"))
        .distinct()
    )
    return recorded, observed, unreadable


def boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vendor boxes: signups are not recorded with a digest, purchases are too large to hold."""
    e = table(spark, d, "events").select(
        text_id("user", "user_id").alias("file_id"),
        F.when(F.col("event_type").isin("error", "click"), "top_level").otherwise("user_data").alias("location"),
        F.col("event_type").alias("kind"),
        F.struct("ts", "event_id").alias("offset"),
        "value",
        "props",
    )
    digest = sha256("props")
    recorded = e.where("value >= 2").select(
        "file_id",
        "location",
        "kind",
        "offset",
        F.when(~((F.col("kind") == "signup") & (F.col("value") > 20)), digest).alias("sha256"),
    )
    observed = e.where("value < 50").select(
        "file_id",
        "location",
        "kind",
        "offset",
        F.when(~((F.col("kind") == "purchase") & (F.col("value") > 20)), digest).alias("sha256"),
    )
    return recorded, observed


def shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations").select(
        text_id("conv", "conv_id").alias("file_id"), "turn", "role", F.length("text").alias("n")
    )
    recorded = c.withColumn("line", F.concat(F.lit("turn "), F.col("role")))
    observed = c.withColumn(
        "line", F.concat(F.lit("turn "), F.when(F.col("n") > 1600, "long").otherwise(F.col("role")))
    )
    digest = lambda df: listing_digests(df, ["file_id"], ["turn"], "line").select("file_id", "sha256")
    return digest(recorded), digest(observed)


def every_finding(spark: SparkSession, d: str) -> DataFrame:
    recorded, observed, unreadable = turns(spark, d)
    return compare.all_findings(
        compare.whole_file_findings(*documents(spark, d)),
        compare.track_findings(recorded, observed, unreadable),
        compare.vendor_findings(*boxes(spark, d), by_moment(spark, d, "offset.ts")),
        compare.structure_findings(*shapes(spark, d)),
    )


WHOLE = """
whole AS (
  SELECT 'doc' || d.doc_id AS file_id,
         CASE WHEN l.doc_id IS NOT NULL THEN sha256(replace(d.text, chr(10), ' ')) END AS r,
         sha256(d.text) AS o
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
whole_f AS (
  SELECT file_id, 'whole_file' AS subject, NULL::BIGINT AS position, NULL::VARCHAR AS location, NULL::VARCHAR AS kind,
         CASE WHEN r IS NULL THEN 'not_recorded' WHEN r = o THEN 'identical' ELSE 'differs' END AS outcome,
         CASE WHEN r <> o THEN r END AS recorded, CASE WHEN r <> o THEN o END AS observed, NULL::VARCHAR AS reason
  FROM whole)"""

TRACK = """
c AS (SELECT 'conv' || conv_id AS file_id, turn AS i, role, text, length(text) AS n FROM conversations),
bad AS (SELECT DISTINCT file_id FROM c WHERE i = 0 AND n > 300),
track AS (
  SELECT r.file_id, r.i, r.role, r.n, o.file_id IS NOT NULL AS present, bad.file_id IS NOT NULL AS unreadable,
         sha256(r.role) AS rc, sha256(r.text) AS rp,
         CASE WHEN o.n >= 1000 THEN 'recoded' ELSE o.role END AS oc_coding,
         sha256(o.role || CASE WHEN o.n < 60 THEN '+' ELSE '' END) AS oc,
         sha256(replace(o.text, chr(10), ' ')) AS op,
         o.n BETWEEN 800 AND 999 AS failed
  FROM c r LEFT JOIN (SELECT * FROM c WHERE n < 1500) o ON o.file_id = r.file_id AND o.i = r.i
  LEFT JOIN bad ON bad.file_id = r.file_id),
track_o AS (
  SELECT *, CASE WHEN role = 'system' THEN 'not_recorded' WHEN unreadable THEN 'not_checkable'
                 WHEN NOT present THEN 'missing' WHEN oc_coding <> role THEN 'not_checkable'
                 WHEN failed THEN 'not_checkable' WHEN rc <> oc THEN 'differs'
                 WHEN rp = op THEN 'identical' ELSE 'differs' END AS outcome FROM track),
track_f AS (
  SELECT file_id, 'track' AS subject, i::BIGINT AS position, NULL::VARCHAR AS location, NULL::VARCHAR AS kind, outcome,
         CASE WHEN outcome = 'differs' THEN CASE WHEN rc = oc THEN rp ELSE rc END END AS recorded,
         CASE WHEN outcome = 'differs' THEN CASE WHEN rc = oc THEN op ELSE oc END END AS observed,
         CASE WHEN outcome = 'not_checkable' THEN CASE WHEN unreadable THEN 'the sample tables contradict each other'
              WHEN oc_coding <> role THEN 'the track at this position is ' || oc_coding || '; the manifest records ' || role
              ELSE 'no decoder configuration' END END AS reason
  FROM track_o)"""

VENDOR = """
e AS (SELECT 'user' || user_id AS file_id, event_type AS kind, ts, event_id, value, sha256(props) AS h,
             CASE WHEN event_type IN ('error', 'click') THEN 'top_level' ELSE 'user_data' END AS location FROM events),
vr AS (SELECT *, row_number() OVER (PARTITION BY file_id, location, kind ORDER BY ts, event_id) - 1 AS k,
              CASE WHEN NOT (kind = 'signup' AND value > 20) THEN h END AS s FROM e WHERE value >= 2),
vo AS (SELECT *, row_number() OVER (PARTITION BY file_id, location, kind ORDER BY ts, event_id) - 1 AS k,
              CASE WHEN NOT (kind = 'purchase' AND value > 20) THEN h END AS s FROM e WHERE value < 50),
vendor AS (
  SELECT coalesce(r.file_id, o.file_id) AS file_id, coalesce(r.k, o.k)::BIGINT AS k,
         coalesce(r.location, o.location) AS location, coalesce(r.kind, o.kind) AS kind, r.s AS rs, o.s AS os,
         CASE WHEN o.k IS NULL THEN 'missing' WHEN r.k IS NULL THEN 'unexpected' WHEN r.s IS NULL THEN 'not_recorded'
              WHEN o.s IS NULL THEN 'not_checkable' WHEN r.s = o.s THEN 'identical' ELSE 'differs' END AS outcome
  FROM vr r FULL OUTER JOIN vo o ON r.file_id = o.file_id AND r.location = o.location AND r.kind = o.kind AND r.k = o.k),
vendor_f AS (
  SELECT file_id, 'vendor_box' AS subject, k AS position, location, kind, outcome,
         CASE WHEN outcome = 'differs' THEN rs END AS recorded, CASE WHEN outcome = 'differs' THEN os END AS observed,
         CASE WHEN outcome = 'not_checkable' THEN 'the box is larger than the reader holds' END AS reason
  FROM vendor)"""

SHAPE = """
sc AS (SELECT 'conv' || conv_id AS file_id, turn, role, length(text) AS n FROM conversations),
shape AS (
  SELECT file_id, sha256(string_agg('turn ' || role, chr(10) ORDER BY turn)) AS r,
         sha256(string_agg('turn ' || CASE WHEN n > 1600 THEN 'long' ELSE role END, chr(10) ORDER BY turn)) AS o
  FROM sc GROUP BY file_id),
shape_f AS (
  SELECT file_id, 'structure' AS subject, NULL::BIGINT AS position, NULL::VARCHAR AS location, NULL::VARCHAR AS kind,
         CASE WHEN r = o THEN 'identical' ELSE 'differs' END AS outcome,
         CASE WHEN r <> o THEN r END AS recorded, CASE WHEN r <> o THEN o END AS observed, NULL::VARCHAR AS reason
  FROM shape)"""

ALL = f"""WITH {WHOLE},{TRACK},{VENDOR},{SHAPE},
f AS (SELECT 0 AS subject_rank, * FROM whole_f UNION ALL SELECT 1, * FROM track_f
      UNION ALL SELECT 2, * FROM vendor_f UNION ALL SELECT 3, * FROM shape_f)"""


@query("g1_whole_file", f"WITH {WHOLE} SELECT file_id, outcome, recorded, observed FROM whole_f")
def whole_file(spark, d):
    return compare.whole_file_findings(*documents(spark, d)).select("file_id", "outcome", "recorded", "observed")


@query(
    "g2_track_by_position",
    f"WITH {TRACK} SELECT file_id, position, outcome, recorded, observed, reason FROM track_f",
)
def track_by_position(spark, d):
    return compare.track_findings(*turns(spark, d)).select(
        "file_id", "position", "outcome", "recorded", "observed", "reason"
    )


@query("g3_kth_occurrence", f"WITH {VENDOR} SELECT * EXCLUDE (subject) FROM vendor_f")
def kth_occurrence(spark, d):
    return compare.vendor_findings(*boxes(spark, d), by_moment(spark, d, "offset.ts")).drop("subject")


@query("g4_structure_digest", f"WITH {SHAPE} SELECT file_id, outcome, recorded, observed FROM shape_f")
def structure_digest(spark, d):
    return compare.structure_findings(*shapes(spark, d)).select("file_id", "outcome", "recorded", "observed")


@query(
    "g5_digest_comparison",
    """SELECT conv_id, turn,
              CASE WHEN text = upper(left(text, 1)) || lower(substr(text, 2)) THEN 'identical' ELSE 'differs' END AS outcome,
              CASE WHEN text <> upper(left(text, 1)) || lower(substr(text, 2)) THEN sha256(text) END AS recorded,
              CASE WHEN text <> upper(left(text, 1)) || lower(substr(text, 2))
                   THEN sha256(upper(left(text, 1)) || lower(substr(text, 2))) END AS observed
       FROM conversations""",
)
def digest_comparison(spark, d):
    cased = F.concat(F.upper(F.substring("text", 1, 1)), F.lower(F.expr("substring(text, 2)")))
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", sha256("text").alias("r"), sha256(cased).alias("o")
    )
    outcome = compare.digest_outcome(F.col("r"), F.col("o"))
    return c.select(
        "conv_id",
        "turn",
        outcome.alias("outcome"),
        compare.shown(outcome, F.col("r")).alias("recorded"),
        compare.shown(outcome, F.col("o")).alias("observed"),
    )


@query("g6_findings_in_order", f"{ALL} SELECT * FROM f")
def findings_in_order(spark, d):
    return every_finding(spark, d)


@query(
    "g7_roll_up",
    f"""{ALL} SELECT file_id, count(*) FILTER (outcome <> 'not_recorded') AS compared,
          count(*) FILTER (outcome <> 'not_recorded') > 0
          AND count(*) FILTER (outcome NOT IN ('not_recorded', 'identical')) = 0 AS every_compared_is_identical
        FROM f GROUP BY file_id""",
)
def roll_up(spark, d):
    return compare.roll_up(every_finding(spark, d))


def template_values() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quoted(cell) for cell in row) + ")" for row in compare.SENTENCES)


@query(
    "g8_sentences",
    f"""{ALL}, t(subject, outcome, template) AS (VALUES {template_values()}),
        w AS (SELECT f.*, t.template, CASE location WHEN 'user_data' THEN 'user data' WHEN 'top_level' THEN 'the top level' END AS words
              FROM f LEFT JOIN t ON t.subject = f.subject AND t.outcome = f.outcome)
        SELECT file_id, subject, position, kind, location, outcome,
          replace(replace(replace(replace(replace(replace(template,
            '{{recorded}}', coalesce(recorded, '{{recorded}}')), '{{observed}}', coalesce(observed, '{{observed}}')),
            '{{index}}', coalesce(position::VARCHAR, '{{index}}')), '{{reason}}', coalesce(reason, '{{reason}}')),
            '{{kind}}', coalesce(kind, '{{kind}}')), '{{location}}', coalesce(words, '{{location}}')) AS sentence
        FROM w""",
)
def sentences(spark, d):
    return compare.sentences(spark, every_finding(spark, d))
