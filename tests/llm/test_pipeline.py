"""The pipeline's stages on the smallest tables, each held against a plain version over its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from strongroom.llm import queries, secret_scan
from tests.llm.test_llm import SMALL, brute_links, words


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
    return [*out, docs]


def test_columns_of_documents_stay(kept):
    for frame in kept[:-1]:
        assert sorted(frame.columns) == sorted(kept[0].columns)


def test_toxic_documents_go(spark, kept):
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, SMALL).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept[1].collect()} == {r.doc_id for r in kept[0].collect()} - toxic


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    firsts = {least for _, least, _ in brute_links(rows)}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(firsts)


def test_leaks_go(spark, kept):
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    spelled = [" ".join(["", *w, ""]) for w in items]
    leaked = {r.doc_id for r in kept[2].collect() if any(s in " ".join(["", *words(r.text), ""]) for s in spelled)}
    left = {r.doc_id for r in kept[3].collect()}
    assert left <= {r.doc_id for r in kept[2].collect()} - leaked
    assert len(left) >= kept[2].count() - len(leaked) - 2


def test_secrets_are_masked(kept):
    before = {r.doc_id: r for r in kept[3].collect()}
    after = {r.doc_id: r for r in kept[4].collect()}
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert row.text == secret_scan.redacted(before[i].text or "")
        assert row.n_chars == (len(row.text) if row.text != before[i].text else before[i].n_chars)


def test_pieces_keep_every_document(kept):
    last = kept[5].collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in kept[4].collect())
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in last)


def test_run_gives_the_last_stage(spark, kept):
    got = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in kept[5].collect())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    rows = queries.QUERIES[name](spark, SMALL)
    of = "pages" if name.startswith("op3") else "documents"
    whole = spark.read.parquet(f"{SMALL}/{of}.parquet").count()
    assert rows.count() == whole if not name.startswith("op6") else rows.count() > 0
    assert defaultdict(int, Counter(rows.columns)) == {c: 1 for c in rows.columns}
