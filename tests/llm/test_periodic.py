"""Periodic runs against a plain search of every period, against SQL, and in awkward and very long texts."""

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strongroom.llm import periodic, queries
from tests.llm.test_llm import SMALL, awkward, none
from tests.oracle import compare, connect


def brute(words):
    """Every maximal stretch of each period that no smaller period covers."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                covered = any(s <= i and s + m >= i + length for s, m, p in found if p < q)
                if length >= max(6, 4 * q) and not covered:
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def analysed(texts):
    n, runs, kept = (c.to_pylist() for c in periodic.analyse(texts))
    return n, [[(r["start"], r["length"], r["period"]) for r in row] for row in runs], kept


def hold(texts):
    n, runs, kept = analysed(texts)
    for text, size, got, left in zip(texts, n, runs, kept, strict=True):
        words = text.encode().split()
        assert size == len(words)
        assert got == brute(words)
        assert left == collapsed([w.decode() for w in words], got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_small_alphabets_equal_brute_force(texts):
    hold([" ".join(t) for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_repeated_pieces_equal_brute_force(pieces):
    hold([" ".join(w for piece, times in pieces for w in piece * times)])


def test_runs_in_runs():
    draw = random.Random(3)
    texts = []
    for _ in range(60):
        words = ["a"]
        for _ in range(4):
            words = words * draw.choice((1, 4, 5)) + [draw.choice("abc")] * draw.choice((0, 1, 6))
        texts.append(" ".join(words[:700]))
    hold(texts)


def test_ordered_sets_equal_lists():
    draw = random.Random(1)
    numbers = draw.sample(range(10**6), 5 * periodic.PART)
    ordered, plain = periodic.Ordered([numbers[0]]), sorted(numbers)
    for x in numbers[1:]:
        ordered.add(x)
    assert list(ordered) == plain and len(ordered) == len(plain)
    for k in draw.sample(range(1, len(plain) - 1), 500):
        assert ordered.around(plain[k]) == (plain[k - 1], plain[k + 1])
    assert ordered.around(plain[0]) == (None, plain[1]) and ordered.around(plain[-1]) == (plain[-2], None)


def test_long_texts_take_near_linear_time():
    took = []
    for n in (30_000, 240_000):
        started = time.time()
        words = np.array(["x", "y", "z"])[np.arange(n) % 3]
        _, runs, kept = analysed([" ".join(words), "x " * n])
        assert runs == [[(0, n, 3)], [(0, n, 1)]] and kept == ["x y z", "x"]
        took.append(time.time() - started)
    assert took[1] < 30 * max(took[0], 0.1)


def test_equals_sql(spark):
    ok, said = compare(
        spark, connect(SMALL), "op13", queries.op13_periodic_runs, queries.ORACLES["op13_periodic_runs"], SMALL
    )
    assert ok, said


def test_planted_texts_equal_the_rule(spark):
    rows = [(k, n) for k in (0, 7, 1234567, 429496729) for n in (0, 1, 5, 80)]
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n))) for k, n in rows], "k long, text string")
    got = docs.select("k", periodic.with_repeats(F.col("text"), F.col("k")).alias("text"), F.col("text").alias("old"))
    for r in got.collect():
        words = r.old.split()
        n = len(words)
        if n:
            a = r.k % n
            p = 1 + (n - a) // (3 + r.k % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.text == " ".join(words)


def test_awkward(spark):
    df = awkward(spark).withColumn("runs", F.lit("mine")).withColumn("start", F.lit(1))
    rows = periodic.find(df).collect()
    assert len(rows) == 9 and len(rows[0].asDict()) == len(df.columns) - 1 + 2
    for r in rows:
        text = next(x.text or "" for x in awkward(spark).collect() if x.doc_id == r.doc_id)
        words = re.split(r"[\x20\x09-\x0D]+", text.strip("\x20\t\n\v\f\r")) if text.strip() else []
        if r.doc_id == 4:
            assert [tuple(x) for x in r.runs] == [(0, 60_000, 1)] and r.collapsed == "a"
        else:
            assert [tuple(x) for x in r.runs] == brute(words) and r.collapsed == " ".join(words)
    assert periodic.find(none(spark)).count() == 0
