"""What all operators owe: clashing names, workers without the package, long texts in reasonable time."""

import os
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from strongroom.llm import license_scan, pieces, queries, secret_scan, toxicity
from tests.llm.test_llm import SMALL, awkward

MODEL = toxicity.Model({"fox": (5, 1), "dog": (1, 5)}, (10.0, 10.0), (3, 4), (0.5, 0.5), (2.0, 2.0), 1.5, 0.1)
REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: pieces.encode(d, queries.vocabulary()),
        lambda d: pieces.decode(d.withColumn("ids", F.array(F.lit(500))), queries.vocabulary()),
        license_scan.scan,
        secret_scan.scan,
        lambda d: toxicity.score(d, MODEL),
    ],
)
def test_own_columns_win(spark, apply):
    """A column named as an output gives way to it; every other column stays as it was."""
    plain = apply(awkward(spark).select("doc_id", "text"))
    own = [c for c in plain.columns if c != "doc_id"]
    clashing = awkward(spark).select("doc_id", "text", *(F.lit("mine").alias(c) for c in own if c not in ("text", "ids")))
    got = apply(clashing.withColumn("other", F.lit(7)))
    assert sorted(got.columns) == sorted([*plain.columns, "other"])
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert {r.other for r in got.collect()} == {7}


def test_workers_need_no_package(tmp_path):
    """A worker that can't import the package runs every operator that has Python in it."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.append({REPOSITORY!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config(
            "spark.ui.enabled", "false").getOrCreate()
        def there(batches):
            import importlib.util, pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("strongroom") is not None]}})
        assert not any(r.found for r in spark.range(4).mapInArrow(there, "found boolean").collect())
        from strongroom.llm import queries
        for name in ("op1_pieces", "op2_toxicity", "op4_license_notices", "op5_secret_parts", "op11_exact_dedup",
                     "op12_spelling_variants", "op13_periodic_runs"):
            assert queries.QUERIES[name](spark, {SMALL!r}).count() > 0, name
        print("all ran")
    """)
    path = tmp_path / "apart.py"
    path.write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]


@pytest.mark.parametrize("unit", ["a+", "a.", "://", "key:", "a@", "token=abcdef1 a+", "AKIA", "user " * 3, "x://a:"])
def test_secret_search_is_linear(unit):
    text = "token=abcdef1 " + unit * (1_000_000 // len(unit))
    started = time.time()
    secret_scan.find_parts(text)
    assert time.time() - started < 6


def test_schemes_belong_to_endpoints():
    weak = "Zx81kQpW02mNvB73tYhD"
    for before, scheme in (("at ", "https://"), ("at +", "x+y://"), ("at 9", ""), ("at ", "h2+c://"), ("at A", "")):
        host = "db.example.com:99"
        given = scheme or "http://"
        text = f"{weak} {before}{given}{host} end"
        (span,) = [p[1:3] for p in secret_scan.find_parts(text) if p[0] == "endpoint"]
        assert text[slice(*span)] == scheme + host


def test_ranks_are_read_as_frequencies():
    encoder = pieces.Encoder(queries.vocabulary())
    spelled = lambda text: [encoder.vocabulary.pieces[i][0] for i in encoder.encode(text)[0]]
    assert spelled("the house and the street") == ["▁the", "▁house", "▁and", "▁the", "▁street"]
    scores = [p[1] for p in encoder.vocabulary.pieces if p]
    assert max(scores) < 0


def test_remembered_stretches_are_bounded(monkeypatch):
    encoder = pieces.Encoder(queries.vocabulary())
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    texts = [f"word{i} and a thing{i * 7}" for i in range(200)]
    want = [pieces.Encoder(queries.vocabulary()).encode(t) for t in texts]
    for text, (ids, score) in zip(texts, want, strict=True):
        got = encoder.encode(text)
        assert got[0] == ids and got[1] == pytest.approx(score)
        assert encoder.characters < 200


def test_one_pass_equals_two(spark):
    docs = awkward(spark).select("doc_id", "text")
    known = queries.vocabulary()
    both = pieces.encode_and_decode(docs, known).select("doc_id", "ids", "piece_score", F.col("decoded").alias("text"))
    two = pieces.decode(pieces.encode(docs, known).withColumn("kept", F.col("ids")), known)
    two = two.select("doc_id", F.col("kept").alias("ids"), "piece_score", "text")
    assert sorted(map(str, both.collect())) == sorted(map(str, two.collect()))


def test_toxicity_equals_brute_force(spark):
    """Counts, discounts and likelihoods against a plain version over rows without near copies."""
    import math

    texts = [("idiot fox %d" % (i % 3), 1) for i in range(30)] + [("quiet fox %d dog" % (i % 5), 0) for i in range(60)]
    texts = [(f"{t} {' '.join(f'{t[0]}{i}x{k}' for k in range(6))}", y) for i, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs)
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(toxicity.FIT_SHARE)) == 0
    fitted = {r.doc_id for r in docs.where(share).collect()}
    counts: dict[str, list[int]] = {}
    for i, (text, y) in enumerate(texts):
        if i not in fitted:
            for word in set(text.lower().split()):
                counts.setdefault(word, [0, 0])[0 if y else 1] += 1
    totals = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    assert model.totals == tuple(map(float, totals))
    least = toxicity.class_discounts(min(toxicity.DISCOUNTS), model.totals)
    kept = {w: tuple(c) for w, c in counts.items() if any(n > d for n, d in zip(c, least, strict=True))}
    assert model.counts == kept and model.rest[0] == len(counts) - len(kept)
    half = 0.5 / sum(totals)
    weights = [sum(min(c[k], model.discounts[k]) for c in counts.values()) / totals[k] for k in (0, 1)]
    for word, c in kept.items():
        shared = min(c[k] / totals[k] for k in (0, 1)) + half
        want = [math.log(max(c[k] - model.discounts[k], 0) / totals[k] / weights[k] + shared) for k in (0, 1)]
        assert toxicity.likelihoods(model, word) == pytest.approx(want)
    scored = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    for i, (text, y) in enumerate(texts):
        words = set(text.lower().split())
        sums = [sum(toxicity.likelihoods(model, w)[k] for w in words) / math.sqrt(len(words)) for k in (0, 1)]
        r = scored[i]
        assert [r.toxic_likelihood, r.ordinary_likelihood] == pytest.approx(sums)
        assert r.score == pytest.approx(1 / (1 + math.exp(-model.slope * (sums[0] - sums[1] - model.middle))))
        assert r.predicted == y
