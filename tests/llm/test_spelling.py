"""Spelling variants against all pairs, in boxes and blocks of any size, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strongroom.llm import queries, spelling
from tests.llm.test_llm import SMALL, awkward, none
from tests.oracle import compare, connect


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def invented(seed, n, letters="abcdé"):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.choice((7, 8, 9)))) for _ in range(n)}
    words |= {"".join(draw.sample("abcdefg", 7)) for _ in range(n // 4)}
    return sorted(words | {"x" * 200, "x" * 201, "x" * 199 + "y"})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abà", min_size=3, max_size=5), unique=True, max_size=40), st.sampled_from((1, 2)))
def test_near_words_equal_all_pairs(words, role):
    sizes = {len(w) for w in words}
    for size in sizes:
        held = [w for w in words if len(w) == size]
        asked = [w for w in words if len(w) == size - (role == spelling.INSERTED)]
        if asked:
            i, j = spelling.near_words(held, asked, role)
            got = Counter((held[a], asked[b]) for a, b in zip(i, j, strict=True))
            assert got == Counter((h, a) for h in held for a in asked if one_edit(h, a))


def test_boxes_reach_every_word_one_edit_away():
    words = [w for w in invented(5, 600) if len(w) == 8]
    at = spelling.points(words)
    tree, made = spelling.boxes(at, 20)
    home = np.full(len(words), -1)
    for box, rows in spelling.reached(tree, at, 0, 0):
        assert (home[rows] == -1).all()
        home[rows] = box
    assert made > 10 and (home >= 0).all()
    asked = {(box, r) for box, rows in spelling.reached(tree, at, 1, 1) for r in rows.tolist()}
    assert all((home[j], i) in asked for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))
    assert len(asked) < made * len(words)


@pytest.mark.parametrize("sizes", [{}, {"sample": 50, "block_words": 7, "block_letters": 300}])
def test_pairs_equal_all_pairs(spark, sizes):
    words = invented(9, 500)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.near, r.near_n) for r in spelling.near(df, **sizes).collect())
    number = {w: i + 1 for i, w in enumerate(words)}
    assert got == Counter((a, b, number[b]) for a in words for b in words if a != b and one_edit(a, b))


def test_forms_and_roots_follow_the_rule(spark):
    draw = random.Random(2)
    number = {w: 10 ** draw.randrange(6) * draw.choice((1, 2)) for w in invented(11, 400, "ab")}
    chain = ["q" * 7 + "z" * k for k in range(12)]
    number |= {w: 2 * 10**k for k, w in enumerate(chain)}
    df = spark.createDataFrame(list(number.items()), "word string, n long")
    forms = {}
    for word, n in number.items():
        close = sorted((-number[w], w) for w in number if w != word and one_edit(word, w))
        forms[word] = (len(close), close[0][1] if close and -close[0][0] >= 10 * n else None)
    for r in spelling.variants(df).collect():
        assert (r.n, r.n_near, r.form) == (number[r.word], *forms[r.word])
        assert r.form_n == (number[r.form] if r.form else None)
        last = r.word
        while forms[last][1]:
            last = forms[last][1]
        assert r.root == last
    assert forms[chain[0]][1] == chain[1]


def test_equals_sql(spark):
    ok, said = compare(
        spark, connect(SMALL), "op12", queries.op12_spelling_variants, queries.ORACLES["op12_spelling_variants"], SMALL
    )
    assert ok, said


def test_counts(spark):
    rows = [(1, "Kitchen kitchen KITCHENS ßtraßen ÀÉÎÕÜÝÞ x1kitchen_kitchen"), (1, "kitchens ÀÉÎÕÜÝÞ"), (None, "ßtraßen"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert got == {"kitchen": 4, "kitchens": 2, "ßtraßen": 2, "ÀÉÎÕÜÝÞ": 2}
    altered = {r.word: r.n for r in spelling.count_words(docs, queries.less_a_letter).collect()}
    want = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            lowered = "".join(c.lower() if c.isascii() else c for c in w)
            want[queries.less_a_letter("" if i is None else str(i), lowered)] += 1
    assert altered == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_awkward(spark):
    words = spelling.count_words(awkward(spark))
    rows = {r.word: (r.n, r.n_near, r.form, r.root) for r in spelling.variants(words).collect()}
    assert rows == {}
    assert spelling.variants(spelling.count_words(none(spark))).count() == 0
    long = spark.createDataFrame([(1, ("y" * 50_000 + " ") * 2 + ("y" * 50_001 + " ") * 20)], "doc_id long, text string")
    got = spelling.variants(spelling.count_words(long)).collect()
    assert sorted((len(r.word), r.n, r.n_near, len(r.form or "")) for r in got) == [(50_000, 2, 1, 50_001), (50_001, 20, 1, 0)]
