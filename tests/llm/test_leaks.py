"""Benchmark passages against brute force over every window, passages in another order among them."""

import itertools
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from strongroom.llm import decontaminate
from tests.llm.test_llm import SMALL, shingles, words


def brute(docs, items, threshold=0.8):
    """(doc, item) where some window of the item's length reaches the threshold, plain or weighted."""
    holders = Counter(s for t in {t for _, t in items} for s in shingles(t))
    want = set()
    for (i, text), (item, target) in itertools.product(docs, items):
        w, own = words(text), shingles(target)
        n = len(words(target))
        if not own & shingles(text):
            continue
        for b in range(len(w)):
            window = shingles(" ".join(w[b : b + n]))
            shared, strange = window & own, len(window - own)
            weight = lambda of: sum(1 / holders[s] for s in of)
            plain = len(shared) / (len(own) + strange)
            if max(plain, weight(shared) / (weight(own) + strange)) >= threshold - 1e-12:
                want.add((i, item))
                break
    return want


def found(spark, docs, items, **options):
    got = decontaminate.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options
    )
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_swapped_halves_are_found(spark):
    item = [f"w{i}" for i in range(60)]
    text = [f"v{i}" for i in range(25)] + item[30:] + item[:30] + [f"u{i}" for i in range(25)]
    docs, items = [(1, " ".join(text))], [(1, " ".join(item))]
    assert found(spark, docs, items) == {(1, 1)} == brute(docs, items)


def test_parts_in_any_order_equal_every_window(spark):
    draw = random.Random(21)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice((24, 45, 60, 90))))) for i in range(14)]
    docs = []
    for i in range(170):
        item = items[i % 14][1].split()
        parts, at = [], 0
        for cut in sorted(draw.sample(range(1, len(item)), draw.choice((0, 1, 1, 2)))) + [len(item)]:
            parts.append(item[at:cut])
            at = cut
        draw.shuffle(parts)
        if draw.random() < 0.4:
            parts.insert(draw.randrange(len(parts) + 1), draw.choices(vocabulary, k=draw.randrange(1, 5)))
        if draw.random() < 0.3:
            parts[0] = parts[0][draw.randrange(4) :]
        passage = [w for p in parts for w in p]
        docs.append((i, " ".join(draw.choices(vocabulary, k=30) + passage + draw.choices(vocabulary, k=30))))
    want = brute(docs, items)
    assert found(spark, docs, items) == want and 40 <= len(want) < 170


def test_given_tables_equal_every_window(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    want = brute([d for d in docs if d[1]], items)
    assert found(spark, docs, items) == want and want


def test_a_passage_many_items_share_seeds_each_window_once(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    items = [(i, f"{shared} own{i}a own{i}b own{i}c") for i in range(50)]
    docs = spark.createDataFrame([(1, f"start {shared} end")], "doc_id long, text string")
    known = decontaminate.item_table(spark.createDataFrame(items, "item_id long, text string"))
    placed = decontaminate.windows(docs, known)
    assert placed.groupBy("key", "begin").count().where("count > 1").count() == 0
    assert placed.groupBy("key").count().agg(F.max("count")).first()[0] <= 3
