"""Exact duplicates: hashes that combine, colliding fingerprints, awkward tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strongroom.llm import exact_dedup, queries
from tests.llm.test_llm import SMALL, awkward, none
from tests.oracle import compare, connect


def brute(rows):
    """(doc_id, keep_id, group_size) of every row, and how many of a group are kept."""
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "", flags=re.A)) for i, t in rows]
    groups = defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, least[t], len(groups[t])) for i, t in normal), len(groups)


def check(got, rows):
    want, groups = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_hashes_combine_at_any_cuts(data, cuts):
    cuts = [c for c in cuts if c <= len(data)]
    want = [sum((b + 1) * pow(x, k, m) for k, b in enumerate(data)) % m for x, m in zip(exact_dedup.bases(0, exact_dedup.MODULI), exact_dedup.MODULI)]
    assert exact_dedup.whole_hash(data, cuts)[:2] == want == exact_dedup.whole_hash(data, [])[:2]


def test_chunks_of_huge_documents_combine(spark):
    """Keys of documents in many chunks are those of the whole bytes."""
    texts = [(i, "".join(random.Random(i).choices("abcdefé ", k=n))) for i, n in enumerate((17, 100, 257, 1000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chunks = exact_dedup.long_chunks(docs, 16)
    keys = {r.doc_id: r.key for r in exact_dedup.long_documents(chunks, 2, exact_dedup.MODULI, 16).collect()}
    for i, text in texts:
        data = re.sub(" +", " ", text).encode()
        pairs = [exact_dedup.whole_hash(data, [], seed) for seed in (0, 1)]
        assert keys[i] == [len(data), *((a << 31) | b for a, b, _, _ in pairs)]


def test_equals_sql(spark):
    ok, said = compare(spark, connect(SMALL), "op11", queries.op11_exact_dedup, queries.ORACLES["op11_exact_dedup"], SMALL)
    assert ok, said


def test_colliding_fingerprints_are_told_apart(spark):
    """With moduli of 5 and 7 nearly every fingerprint is shared by different texts, of one chunk and of several."""
    draw = random.Random(7)
    rows = [(i, "".join(draw.choices("ab \t", k=draw.choice((3, 4, 9, 20, 40))))) for i in range(300)]
    rows += [(1000 + i, "x" * 40 + "yz"[i % 2] + "x" * 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(exact_dedup.duplicates(docs, moduli=(5, 7), chunk=16).collect(), rows)


def test_chunk_size_changes_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    check(exact_dedup.duplicates(docs, chunk=300).collect(), rows)


def test_awkward(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    got = exact_dedup.duplicates(awkward(spark).withColumn("key", F.lit(1)).withColumn("kept", F.lit(2))).collect()
    check(got, rows)
    assert exact_dedup.duplicates(none(spark)).count() == 0
    ids = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    assert Counter((r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicates(ids).collect()) == Counter(
        [(None, 2, True), (None, 2, False), (None, 1, True)]
    )
