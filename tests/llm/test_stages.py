"""Every stage of the pipeline over an awkward table and over an empty one."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SMALL, awkward, none

# Names that the operators below use for columns of their own.
OWN = ("predicted", "n_scored", "bands", "label", "hash", "begin", "distance", "_hit", "row", "new", "decoded", "piece_score", "_text")


def table(frame):
    """The awkward rows as documents, with clashing names beside their columns."""
    documents = frame.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("int").alias("n_chars"),
        "score", "key", "shard", "parts", "words", "n",
    )
    return documents.select("*", *(F.lit(f"mine {c}").alias(c) for c in OWN))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, name, stage):
    docs = table(awkward(spark))
    got = stage(spark, docs, SMALL)
    last = name == corpus_pipeline.STAGES[-1][0]
    if last:
        assert sorted(got.columns) == sorted([*docs.columns, "ids", "n_ids", "round_trip"])
    else:
        assert got.schema == docs.schema or sorted(got.columns) == sorted(docs.columns)
    rows = got.collect()
    given = Counter(r.doc_id for r in docs.collect())
    kept = Counter(r.doc_id for r in rows)
    if name == "n-gram Jaccard join":
        # Row 6 is row 1 with other signs, which is there twice.
        assert kept == given - Counter([1, 6])
    else:
        assert kept == given
    assert all(r[c] == f"mine {c}" for r in rows for c in OWN)
    assert {r.text for r in rows} <= {r.text for r in docs.collect()}
    empty = stage(spark, table(none(spark)), SMALL)
    assert sorted(empty.columns) == sorted(got.columns) and empty.count() == 0
