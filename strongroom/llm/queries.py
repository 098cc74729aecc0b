"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

import sys
import zlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.llm import (
    decontaminate,
    exact_dedup,
    fingerprint,
    license_scan,
    ngram_join,
    periodic,
    pieces,
    ppm,
    ring,
    secret_scan,
    spelling,
    toxicity,
    warc,
)
from strongroom.llm.common import id_remainder
from strongroom.plans.registry import Query, table

TOKENIZERS = "/opt/tokenizers"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# Functions of this module that run in workers are shipped by value, as those of the operators are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def registered(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def vocabulary(path: str | None = None) -> pieces.Vocabulary:
    """Of the model file at a path; without one, the public model of this machine's tokenizer folder."""
    return pieces.read_vocabulary(path or f"{TOKENIZERS}/piece_bpe_32k.model")


@registered
def op1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    made = pieces.encode_and_decode(docs, vocabulary())
    same = F.sha2("decoded", 256) == F.col("sha")
    return made.select("doc_id", F.size("ids").alias("n_ids"), "piece_score", "ids", same.alias("round_trip"))


def toxicity_model(spark: SparkSession, directory: str) -> toxicity.Model:
    """Fitted on labelled rows that aren't held out."""
    labels = table(spark, directory, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    return toxicity.fit(toxicity.labelled_rows(table(spark, directory, "documents"), labels))


@registered
def op2_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, directory))
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        "predicted",
        "toxic_likelihood",
        "ordinary_likelihood",
    )


@registered
def op3_archives(spark: SparkSession, directory: str) -> DataFrame:
    index = warc.write(table(spark, directory, "pages").select("page_id", "url", "html"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registered
def op4_license_notices(spark: SparkSession, directory: str) -> DataFrame:
    found = license_scan.scan(table(spark, directory, "documents").select("doc_id", "text"))
    labels = F.transform("places", lambda p: p["label"])
    fuzzy = F.transform("matches", lambda m: m["notice"])
    lengths = F.create_map(*(F.lit(x) for n in license_scan.NOTICES for x in (n.label, float(len(n.text)))))
    likeness = F.transform("matches", lambda m: 1 - m["edits"] / lengths[m["notice"]])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, fuzzy))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(likeness), F.lit(0.0))).alias("score"),
        "matches",
    )


@registered
def op5_secret_parts(spark: SparkSession, directory: str) -> DataFrame:
    found = secret_scan.scan(table(spark, directory, "documents").select("doc_id", "text"))
    base = F.filter("parts", lambda p: p["kind"].isin("assign", "access", "hex"))
    joined = lambda parts: F.array_join(
        F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("parts")).alias("spans"),
    )


@registered
def op6_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.matches(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@registered
def op7_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.links(table(spark, directory, "documents"))


@registered
def op8_matching(spark: SparkSession, directory: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    scored = ppm.score(table(spark, directory, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@registered
def op9_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    made = fingerprint.fingerprints(table(spark, directory, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.spelled(F.col("sketch")).alias("fingerprint"),
        fingerprint.spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@registered
def op10_bounded_ring(spark: SparkSession, directory: str) -> DataFrame:
    placed = ring.assign(table(spark, directory, "documents").select("doc_id", "text"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@registered
def op11_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, directory, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT
    doc_id,
    min(doc_id) OVER same AS keep_id,
    count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept,
    sha256(text) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY text)
"""


# The checksum as SQL: a table of 256 remainders from the reversed polynomial, and a fold over the digits.
CRC_TABLE = """
    SELECT list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc
"""
CRC_OF_BYTES = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
CRC_OF_ID = CRC_OF_BYTES.format(
    bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
)


def less_a_letter(doc: str, word: str) -> str:
    """The word, or where its checksum with the document's identifier is divisible by 31 the word less one letter."""
    hashed = zlib.crc32(f"{doc}:{word}".encode())
    return word if hashed % 31 else word[: hashed % len(word)] + word[hashed % len(word) + 1 :]


@registered
def op12_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    words = spelling.count_words(table(spark, directory, "documents"), less_a_letter)
    return spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root")


# One edit apart: the same with one place left out of both, or the longer one with one place left out is the other.
ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE table_of AS MATERIALIZED ({CRC_TABLE}),
found AS (
    SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS word FROM documents)
),
runs AS (SELECT doc_id, word, count(*) AS n, hex(encode(doc_id || ':' || word)) AS spelled FROM found GROUP BY ALL),
hashed AS (
    SELECT word, n, {CRC_OF_BYTES.format(
        bytes="list_transform(range(len(spelled) // 2), lambda i: CAST('0x' || substr(spelled, 2 * i + 1, 2) AS BIGINT))"
    )} AS h
    FROM runs, table_of
),
altered AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(word, 1, h % len(word)) || substr(word, h % len(word) + 2) ELSE word END AS word, n
    FROM hashed
),
words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered GROUP BY word HAVING len(word) >= 7 AND sum(n) >= 2
),
less AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)
),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.rest = a.word
    UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON b.rest = a.word
),
ranked AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
),
forms AS MATERIALIZED (
    SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
           CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1
),
followed AS (
    SELECT word, word AS root, 0 AS step FROM forms
    UNION ALL SELECT f.word, g.form, step + 1 FROM followed f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL
)
SELECT f.word, n, n_near, form, form_n, max_by(root, step) AS root
FROM forms f JOIN followed r ON f.word = r.word GROUP BY ALL
"""


@registered
def op13_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    hashed = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    planted = periodic.with_repeats(F.col("text"), F.floor(hashed / 10))
    docs = table(spark, directory, "documents").select(
        "doc_id", F.when(hashed % 10 == 0, planted).otherwise(F.col("text")).alias("text")
    )
    found = periodic.find(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.col1")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.col1") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Equal stretches at each distance come from equal runs of five words, as no run has less in common with itself.
ORACLES["op13_periodic_runs"] = rf"""
WITH table_of AS MATERIALIZED ({CRC_TABLE}),
split AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS ws,
           {CRC_OF_ID} AS h
    FROM documents, table_of
),
counted AS (SELECT *, len(ws) AS n, h // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM counted),
edited AS MATERIALIZED (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
        list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1]
            ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
        ELSE ws END AS ws
    FROM placed
),
grams AS MATERIALIZED (
    SELECT doc_id, n, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] || ' ' || ws[i + 5] AS gram
    FROM (SELECT doc_id, n, ws, unnest(range(n - 4)) AS i FROM edited WHERE n >= 6)
),
apart AS (
    SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b
    ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM apart),
stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM islands
    GROUP BY doc_id, q, island HAVING count(*) + 4 >= 3 * q
),
runs AS MATERIALIZED (
    SELECT * FROM stretches r WHERE NOT EXISTS (
        SELECT 1 FROM stretches s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start
        AND s.start + s.length >= r.start + r.length)
),
listed AS (
    SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q))
        AS runs_sha256
    FROM runs GROUP BY doc_id
),
longest AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) AS place FROM runs
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
    FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM edited) w
    ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id
)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM edited e LEFT JOIN listed l ON e.doc_id = l.doc_id
LEFT JOIN longest m ON e.doc_id = m.doc_id AND place = 1 LEFT JOIN kept k ON e.doc_id = k.doc_id
"""
