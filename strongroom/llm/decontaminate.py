"""Benchmark passages in documents, by item-sized windows that shingles seed.

A window has as many words as the item. Stretches of shingles that a document shares with an item, its runs, put
windows where the item would lie, where a run begins and where one ends; among all windows of a document one with most
of the item's shingles is among these, also where its parts stand in another order. Every such window is verified on its
shingles, both plain and weighted by how few items have them: the weights alone would let one edited word cost an item
that shares a template with others far more than the similarity says.

Windows and items have a fingerprint too, the SimHash of their words. Their distance is told but doesn't decide: a window
with a tenth of its words replaced, which is still similar enough, is often more bits away than any radius of use, and
the fingerprints of all windows of all item lengths, some 60 for each word of the corpus, are too dear for DataFrame
functions. Only where a radius is asked for are candidates those within it, by a multi-index: with radius r the 64 bits
are cut into r + 1 blocks, and two fingerprints within r bits agree on one block at least.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.llm.common import let, stored, with_shingles, words_of

# A radius to ask for, where missed passages are no harm; see above.
RADIUS = 12
SIMILARITY = 0.8
SIZE = 5
# Rows of item shingles up to which they are broadcast; beyond, the join is left to Spark.
BROADCAST_ROWS = 500_000


def with_simhash(df: DataFrame, words: str, name: str) -> DataFrame:
    """df with the 64-bit SimHash of an array of words: a bit is set where most of the words' hashes have it."""

    def print_of(hashes: Column) -> Column:
        def with_bit(bits: Column, k: Column) -> Column:
            votes = F.size(F.filter(hashes, lambda h: F.getbit(h, k) == 1))
            one = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
            return F.when(2 * votes > F.size(hashes), bits.bitwiseOR(one)).otherwise(bits)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), with_bit)

    return df.withColumn(name, let(F.transform(words, lambda w: F.xxhash64(w)), print_of))


def blocks(fingerprint: Column, radius: int) -> Column:
    """(block, value) of the radius + 1 blocks that a fingerprint is cut into."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *(
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        )
    )


def item_table(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, key, n_words, fingerprint, hashes, shingles: array of (hash, weight), of every item with a word.

    A shingle weighs one over the number of different item texts that have it. Items without words, null texts among
    them, can be nowhere and are left out; of equal item_id and text one is kept.
    """
    spelled = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    shingled = with_shingles(spelled, "words", "hashes", size)
    shingled = with_simhash(shingled, "words", "fingerprint").withColumn("key", F.xxhash64("words"))
    each = shingled.select("item_id", "key", F.explode(F.array_distinct("hashes")).alias("hash"))
    weights = each.groupBy("hash").agg((1 / F.count_distinct("key")).alias("weight"))
    weighed = each.join(weights, "hash").groupBy("item_id", "key").agg(
        F.collect_list(F.struct("hash", "weight")).alias("shingles")
    )
    return shingled.join(weighed, ["item_id", "key"]).select(
        "item_id", "key", F.size("words").alias("n_words"), "fingerprint", "hashes", "shingles"
    )


def windows(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, key, begin, words, aside: the item-sized windows of docs in which a run of shared shingles fixes the place.

    A run is a stretch of a document's shingles that follow each other in the item too. A run's first shingle gives the
    window that lies as the item does and the one that begins with the run, its last one the window that ends with the
    run. Of all windows one that holds most of the item's shingles, whatever their order, is among these: moved to either
    side, a window loses none before its edge comes to a run's end. ``aside`` are those that don't lie as the item does.
    """
    beside = lambda hashes: F.transform(
        hashes, lambda h, i: F.struct(h.alias("hash"), F.get(hashes, i - 1).alias("before"), F.get(hashes, i + 1).alias("after"))
    )
    seeds = items.select("key", "n_words", F.posexplode(beside(F.col("hashes"))).alias("offset", "seed"))
    seeds = seeds.select("key", "n_words", "offset", "seed.hash", *(F.col(f"seed.{c}").alias(f"own_{c}") for c in ("before", "after")))
    seeds = seeds.distinct()
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    spelled = with_shingles(docs.select("doc_id", words_of(F.col("text")).alias("words")), "words", "hashes", size)
    places = spelled.select("doc_id", "words", F.posexplode(beside(F.col("hashes"))).alias("at", "place"))
    places = places.select("doc_id", "words", "at", "place.hash", "place.before", "place.after")
    starts = ~F.coalesce(F.col("before") == F.col("own_before"), F.lit(False))
    ends = ~F.coalesce(F.col("after") == F.col("own_after"), F.lit(False))
    place = lambda at, aside: F.struct(F.greatest(at, F.lit(0)).alias("begin"), F.lit(aside).alias("aside"))
    nowhere = F.array().cast("array<struct<begin:int,aside:boolean>>")
    begins = F.concat(
        F.when(starts, F.array(place(F.col("at") - F.col("offset"), False), place(F.col("at"), True))).otherwise(nowhere),
        F.when(ends, F.array(place(F.col("at") + size - F.col("n_words"), True))).otherwise(nowhere),
    )
    placed = places.join(seeds, "hash").where(starts | ends)
    placed = placed.select("doc_id", "key", "words", "n_words", F.inline(begins))
    cut = F.slice("words", F.col("begin") + 1, F.col("n_words")).alias("words")
    return placed.select("doc_id", "key", "begin", "aside", cut).groupBy("doc_id", "key", "begin", "words").agg(
        F.min("aside").alias("aside")
    )


def near_fingerprints(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Windows with a column print and the items whose fingerprint is within the radius of it."""
    one = lambda df, of: df.select(of, F.inline(blocks(F.col(of), radius)))
    # Fingerprints meet first, each once: what has a fingerprint is joined after that.
    prints, index = (one(df.select(of).distinct(), of) for df, of in ((windows, "print"), (items, "fingerprint")))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))
    near = prints.join(index, ["block", "value"]).where(distance <= radius).select("print", "fingerprint").distinct()
    return windows.join(near, "print").join(items, "fingerprint")


def matches(
    docs: DataFrame, items: DataFrame, radius: int | None = None, similarity: float = SIMILARITY, size: int = SIZE
) -> DataFrame:
    """doc_id, item_id, similarity, distance and begin (in words) of the best window of each document and item that
    match.

    The similarity of a window and an item is the weight of the shingles they share over that of the shingles either
    has; shingles that the item hasn't weigh 1. It is the plain Jaccard similarity, every weight 1, where that is more.
    Of equally similar windows one that lies as the item does is the best, then the first. With a radius, only windows
    that lie so are looked at, and those farther from the item in bits are left out, similar or not. Null and empty texts match nothing. Rows that repeat a doc_id count as one document. An item of fewer
    than ``size`` words matches only documents of just these words. Empty tables give an empty result.
    """
    known = stored(item_table(items, size), "leak-items")
    found = windows(docs, known, size)
    if radius is not None:
        found = found.where("NOT aside")
    if radius is None:
        pairs = with_shingles(found, "words", "hashes", size).join(known.drop("hashes"), "key")
    else:
        marked = with_simhash(with_shingles(found.drop("key").distinct(), "words", "hashes", size), "words", "print")
        pairs = near_fingerprints(stored(marked, "leak-windows"), known.drop("hashes", "key"), radius).drop("print")
    shared = F.filter("shingles", lambda s: F.array_contains("hashes", s["hash"]))
    weight = lambda of: F.aggregate(of, F.lit(0.0), lambda total, s: total + s["weight"])

    def alike(both: Column) -> Column:
        strange = F.size(F.array_distinct("hashes")) - F.size(both)
        plain = F.size(both) / (F.size("shingles") + strange)
        return F.greatest(plain, weight(both) / (weight(F.col("shingles")) + strange))

    likeness = let(shared, alike)
    in_place = (~F.col("aside")).alias("in_place")
    near = pairs.select("doc_id", "item_id", "begin", "words", "fingerprint", in_place, likeness.alias("similarity")).where(
        F.col("similarity") >= similarity
    )
    return (
        with_simhash(near, "words", "print")
        .withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", "in_place", (-F.col("begin")).alias("early"), "distance")).alias("_best"))
        .select(
            "doc_id",
            "item_id",
            F.col("_best.similarity").alias("similarity"),
            F.col("_best.distance").alias("distance"),
            (-F.col("_best.early")).alias("begin"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id matches no item; null identifiers are kept only if no null one matches."""
    hit = stored(matches(docs, items, **options).select("doc_id").distinct(), "leak-hits")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]), "left_anti")
