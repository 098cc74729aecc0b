"""A corpus cleaned for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.llm import decontaminate, ngram_join, pieces, queries, secret_scan, toxicity
from strongroom.llm.common import shared_folder
from strongroom.plans.registry import table


def others(docs: DataFrame) -> Column:
    """All columns but the text as one, so that no name of theirs meets one that an operator makes."""
    return F.struct(F.lit(0).alias("nothing"), *(c for c in docs.columns if c != "text")).alias("row")


def held(name: str) -> Column:
    """A column of the documents, beside whom only the text stands by itself."""
    return F.col("text") if name == "text" else F.col("row")[name].alias(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents judged toxic go; the others stay with all their columns, null and empty texts among them.

    The model is fitted on the labelled rows of the documents table. Repeated rows are judged alike.
    """
    model = queries.toxicity_model(spark, sf_dir)
    scored = toxicity.score(docs.select(others(docs), "text"), model, keep_text=True)
    return scored.where("predicted = 0").select(*(held(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles join, the one with the least doc_id stays.

    Documents without words, null and empty texts among them, are no copies of each other and stay. Of repeated rows one
    stays. All columns stay as they are.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts hold none. All columns stay as they are."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and n_chars follows; every document stays, repeated rows and null texts too."""
    return secret_scan.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece identifiers, and whether they decode to its text, a null one as the empty one.

    Columns of the documents named ids, n_ids or round_trip give way to those of this stage.
    """
    made = pieces.encode_and_decode(docs.select(others(docs), "text"), queries.vocabulary(), keep_text=True)
    own = {
        "ids": F.col("ids"),
        "n_ids": F.size("ids"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")),
    }
    kept = [held(c) for c in docs.columns if c not in own]
    return made.select(*kept, *(value.alias(name) for name, value in own.items()))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece", to_pieces),
]

# A fitted model, near copies by sketches and piece segmentation are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
