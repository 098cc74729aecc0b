"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so a document's sketch grows with it, the
sketch of a union is the union of the sketches, and containment of a small document in a large one can be told from
sketches alone. The least hash is kept too, so that no text with words has an empty sketch.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongroom.llm.common import longs, whole_text, with_shingles, words_of

# One in so many shingle hashes is kept.
SCALE = 8
# Rows that a range of identifiers should hold, and the most ranges there are (their borders are a literal of the plan).
RANGE_ROWS = 4_000
MOST_RANGES = 1 << 16


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column: the sorted different shingle hashes below the threshold, and the least."""
    most = F.lit(-(1 << 63) + (1 << 64) // scale - 1)
    shingled = with_shingles(df.withColumn("_w", words_of(F.col(text))), "_w", "_s").drop("_w")
    kept = F.filter("_s", lambda h: h <= most)
    least = F.when(F.size("_s") > 0, F.array(F.array_min("_s"))).otherwise(F.array().cast("array<bigint>"))
    return shingled.withColumn(name, F.array_sort(F.array_union(kept, least))).drop("_s")


def jaccard(a: Column, b: Column) -> Column:
    """The estimate of the likeness of two sketches' documents; two without words are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """The estimate of the share of a's document that is in b's; a document without words is in every other."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def spelled(sketch: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), " ")


def with_next(docs: DataFrame, columns: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """docs with next_X for each of the columns: those of the next row by descending doc_id, after the last the first.

    Equal doc_ids follow each other by text, null ones come last. The identifiers' quantiles cut the table into ranges,
    each a window partition; the first row of a range is put into the one before it as well, where it is only looked at.
    Rows are shuffled once. What the driver sees are the borders, at most MOST_RANGES numbers.
    """
    count = docs.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(count / rows)))
    borders = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        found = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges))).first()[0] or []
        borders = sorted(set(found))
    # Binary search: the number of borders below the identifier. Null identifiers are in the lowest range.
    of = F.lit(0)
    if borders:
        held, step = longs(borders), 1 << (len(borders).bit_length() - 1)
        steps = []
        while step:
            steps.append(step)
            step //= 2
        of = F.coalesce(
            F.aggregate(
                F.lit(steps),
                F.lit(0),
                lambda at, step: F.when(
                    (at + step <= len(borders)) & (F.get(held, at + step - 1) < F.col("doc_id")), at + step
                ).otherwise(at),
            ),
            F.lit(0),
        )
    ranged = docs.withColumn("_range", of)
    firsts = {r: first for r, first in ranged.groupBy("_range").agg(F.max("doc_id")).collect()}
    if not firsts:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    order = sorted(firsts)
    # The range that comes before each in descending order; the topmost comes after the lowest.
    before = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    first_of = longs([firsts.get(r) for r in range(order[-1] + 1)])
    before_of = longs([before.get(r, 0) for r in range(order[-1] + 1)])
    is_first = F.col("doc_id").eqNullSafe(F.get(first_of, F.col("_range")))
    place = lambda r, shown: F.struct(r.alias("range"), F.lit(shown).alias("shown"))
    own, shown = place(F.col("_range").cast("bigint"), True), place(F.get(before_of, F.col("_range")), False)
    placed = ranged.withColumn("_place", F.explode(F.when(is_first, F.array(own, shown)).otherwise(F.array(own))))
    along = Window.partitionBy("_place.range").orderBy(
        F.desc("_place.shown"), F.desc_nulls_last("doc_id"), *([F.asc("text")] if "text" in docs.columns else [])
    )
    return (
        placed.select("*", *(F.lead(c).over(along).alias(f"next_{c}") for c in columns))
        .where("_place.shown")
        .drop("_place", "_range")
    )


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited, sketch, edited_sketch and next_sketch of every row of docs.

    The edited text has its last third replaced by the beginning of the next document, as long, or all of it. A null
    text is the empty text. A single document is next to itself.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    both = with_next(with_sketch(texts, "text", "sketch", scale), ["text", "sketch"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)).alias(
            "edited"
        ),
        "sketch",
        "next_sketch",
    )
    return with_sketch(edited, "edited", "edited_sketch", scale)
