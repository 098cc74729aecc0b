"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, by MinHash banding.

A document's set is reduced to a signature of bands; documents that agree on a band meet. Bands and rows are chosen for a
target recall at the threshold. Every pair that meets is verified on the full sets, within groups that hold all meetings
of their members: the components of the graph of meetings. In large groups nobody lists pairs: members are cut into
blocks, each pair of blocks is a task, and a task gives counts of links and a spanning set of edges, as many rows as
members.

Documents with equal sets (exact copies, and texts that differ in case or signs only) are one member, with a weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm.common import BETWEEN_WORDS, map_texts, stored, whole_text

SIZE, SIMILARITY, RECALL = 5, 0.8, 0.999
# Hash functions at most; members of a block.
MOST_HASHES, BLOCK = 180, 512
# Identifiers that are broadcast at most.
BROADCAST_ROWS = 500_000
_BETWEEN = re.compile(BETWEEN_WORDS)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Hashes of words that a task remembers.
REMEMBERED = 500_000


def banding(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with the target recall: as many rows as the number of hash
    functions allows, so that unlike documents meet as little as possible."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sorted different hashes of runs of word hashes; of fewer words the one of them all; of none none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(min(size, len(words))):
        out = _mixed(out + words[k : k + count] + _MIX[0])
    return np.unique(out)


def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band, of the least values of its hash functions over the set. The empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX[0])
        least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
        for first in range(0, len(shingles), 2048):
            # One multiplication and shift are enough over hashes that are mixed already.
            x = (shingles[first : first + 2048, None] ^ seeds) * _MIX[1]
            x ^= x >> np.uint64(32)
            np.minimum(least, x.min(axis=0), out=least)
        out = np.arange(bands, dtype=np.uint64)
        for of_row in least.reshape(bands, rows).T:
            out = _mixed(out + of_row + _MIX[0])
    return out.view(np.int64)


def _set_maker(size: int):
    """A function that gives the shingle set of a text, remembering hashes of words."""
    known: dict[str, int] = {}

    def make(text: str) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        words = [w for w in _BETWEEN.split(text.lower()) if w]
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        with np.errstate(over="ignore"):
            return shingle_set(np.fromiter((known[w] for w in words), np.uint64, len(words)), size)

    return make


def set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


def keyed(docs: DataFrame, bands: int, rows: int, size: int = SIZE) -> DataFrame:
    """The columns of docs but the text, with key (of the set, null if it is empty) and bands (its signature)."""

    def make():
        set_of = _set_maker(size)

        def work(texts: list[str]) -> list[pa.Array]:
            sets = [set_of(text) for text in texts]
            marks = [signature(s, bands, rows) for s in sets]
            offsets = np.cumsum([0, *(len(m) for m in marks)]).astype(np.int32)
            flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            return [
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ]

        return work

    fields = [T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    return map_texts(docs, make, fields)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): the least node that each node of edges (a, b) is joined with, over any number of steps.

    Alternates the two star operations: every node's greater neighbours, then its lesser ones, are tied to the least
    node it knows. Edges halve their distance to it each time. Each round is a written table.
    """
    turned = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).otherwise(
        F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    current = stored(edges.where("a != b").select(turned.alias("e")).select("e.u", "e.v").distinct(), "edges")

    def settled(df: DataFrame) -> bool:
        """Whether every node is tied to one other at most, and none that is tied has others tied to it."""
        ends = df.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            df.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        sums = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return not sums.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0]

    for _ in range(most_rounds):
        if settled(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Greater neighbours go to the least.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        current = stored(tied.where("u != v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def linked_pairs(
    left: list[np.ndarray], right: list[np.ndarray], met: np.ndarray, similarity: float, columns: int = 4096
) -> np.ndarray:
    """Of the pairs that met (a matrix of truths), those whose sets have the similarity. Exact: counts of shared shingles
    by products of 0-1 matrices, over shingles that both sides have, some columns at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    at = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes)]
    both = np.intersect1d(flat[0], flat[1])
    shared = np.zeros(met.shape, np.float32)
    columns_of = []
    for values, rows in zip(flat, at):
        place = np.searchsorted(both, values)
        there = place < len(both)
        there[there] = both[place[there]] == values[there]
        order = np.argsort(place[there], kind="stable")
        columns_of.append((place[there][order], rows[there][order]))
    for first in range(0, len(both), columns):
        part = []
        for (place, rows), side in zip(columns_of, (left, right)):
            lo, hi = np.searchsorted(place, [first, first + columns])
            matrix = np.zeros((len(side), min(columns, len(both) - first)), np.float32)
            matrix[rows[lo:hi], place[lo:hi] - first] = 1
            part.append(matrix)
        shared += part[0] @ part[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return met & (shared >= similarity * union - 1e-9) & (union > 0)


def _verify(similarity: float):
    """(key, other, n) of a task's members: of each member the rows it is linked with here, and edges that span them."""

    def forest(a: np.ndarray, b: np.ndarray, count: int) -> list[tuple[int, int]]:
        root = list(range(count))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                kept.append((x, y))
        return kept

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        group = table.column("group").to_pylist()
        side = table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        alone = table.column("within").to_pylist()
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(keys), -1)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        places: dict[bytes, list[int]] = {}
        for i, g in enumerate(group):
            places.setdefault(g, []).append(i)
        out_key, out_other, out_n = [], [], []
        for own in places.values():
            own = np.array(own)
            left, right = own[side[own] == 0], own[side[own] == 1]
            within = alone[own[0]]
            if within:
                right = left
            if not len(left) or not len(right):
                continue
            met = np.zeros((len(left), len(right)), bool)
            for band in range(bands.shape[1]):
                met |= bands[left, band][:, None] == bands[right, band][None, :]
            if within:
                np.fill_diagonal(met, False)
            good = linked_pairs([sets[i] for i in left], [sets[i] for i in right], met, similarity)
            degrees = [(left, good @ copies[right])]
            if not within:
                degrees.append((right, copies[left] @ good))
            for members, n in degrees:
                for i in np.flatnonzero(n):
                    out_key.append(keys[members[i]])
                    out_other.append(None)
                    out_n.append(int(n[i]))
            a, b = np.nonzero(np.triu(good) if within else good)
            for x, y in forest(left[a], right[b], len(keys)):
                out_key.append(keys[x])
                out_other.append(keys[y])
                out_n.append(0)
        return pa.table(
            {"key": pa.array(out_key, pa.binary()), "other": pa.array(out_other, pa.binary()), "n": pa.array(out_n, pa.int64())}
        )

    return run


def links(
    docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, size: int = SIZE, block: int = BLOCK
) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs.

    class_id is the least doc_id of the documents that links join, over any number of steps; n_links is the number of
    other rows that a row is linked with: whose set has the similarity with its own, copies included. Documents without
    words are alone (null and empty texts, signs only), with their own doc_id and 0. A null doc_id is never the least,
    unless there is no other; rows that repeat a doc_id are linked as copies are. One row for each row of docs.
    """
    bands, rows = banding(similarity, recall)
    texts = docs.select("doc_id", whole_text().alias("text"))
    every = stored(keyed(texts, bands, rows, size), "join-keys")
    sets = stored(
        every.where("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")),
        "join-sets",
    )
    # Documents that agree on a band are tied to the least of them: as many rows as documents and bands.
    placed = sets.select("key", F.posexplode("bands").alias("band", "value"))
    least = placed.groupBy("band", "value").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    meetings = placed.join(least, ["band", "value"]).select(F.col("key").alias("a"), F.col("first").alias("b"))
    groups = components(meetings).select(F.col("node").alias("key"), F.col("label").alias("group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    asked = stored(sets.join(groups, "key").join(sizes, "group"), "join-asked")

    # The sets of documents that met others, made again from their texts: of each key one row.
    wanted = asked.select(F.col("least").alias("doc_id")).distinct()
    n_asked = asked.count()
    again = texts.join(bounded(wanted, n_asked), "doc_id", "left_semi")
    if n_asked and asked.where("least is null").limit(1).count():
        again = again.unionByName(texts.where("doc_id is null"))

    def make_sets():
        set_of = _set_maker(size)

        def work(batch: list[str]) -> list[pa.Array]:
            made = [set_of(text) for text in batch]
            return [pa.array([set_key(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())]

        return work

    full = map_texts(
        again.select("text"), make_sets, [T.StructField("key", T.BinaryType()), T.StructField("set", T.BinaryType())]
    )
    full = full.where("key is not null").join(asked, "key")
    # Small groups share tasks of about ``block`` members; a large one is cut into blocks, and each pair of them is one.
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    tasks = max(1, math.ceil(n_asked / block))
    pair = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(
            F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).cast("int").alias("side")
        ),
    )
    dealt = full.withColumn("_pair", F.explode(pair)).select(
        "key",
        "group",
        "copies",
        "bands",
        "set",
        F.col("_pair.side").alias("side"),
        (F.col("_pair.i") == F.col("_pair.j")).alias("within"),
        F.when(F.col("members") <= block, F.pmod(F.xxhash64("group"), F.lit(tasks)))
        .otherwise(F.xxhash64("group", "_pair.i", "_pair.j"))
        .alias("task"),
        F.when(F.col("members") <= block, F.lit(-1)).otherwise(F.col("_pair.i") * 65536 + F.col("_pair.j")).alias("part"),
    )
    dealt = dealt.dropDuplicates(["key", "task", "part"])
    found = stored(
        dealt.groupBy("task", "part").applyInArrow(_verify(similarity), "key binary, other binary, n long"), "join-found"
    )
    degrees = found.where("other is null").groupBy("key").agg(F.sum("n").alias("links"))
    classes = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    classes = classes.select(F.col("node").alias("key"), "label")
    leasts = sets.join(classes, "key").groupBy("label").agg(F.min("least").alias("class_least"))
    known = (
        sets.select("key", "copies", "least")
        .join(degrees, "key", "left")
        .join(classes.join(leasts, "label").select("key", "class_least"), "key", "left")
        .select(
            "key",
            F.coalesce("class_least", "least").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return every.select("doc_id", "key").join(stored(known, "join-known"), "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def bounded(ids: DataFrame, rows: int) -> DataFrame:
    """Identifiers to be broadcast if they are few; beyond that the join is left to Spark."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose class has a document with a lesser doc_id.

    Rows that repeat both doc_id and text are one; rows that repeat a doc_id with another text are not told apart, and
    stay or go together. Rows without a doc_id, or without words, stay.
    """
    dropped = stored(links(docs, **options).where("class_id != doc_id").select("doc_id").distinct(), "join-dropped")
    kept = docs.join(bounded(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(
        docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"),
        "join-repeated",
    )
    n = repeated.count()
    if not n:
        return kept
    again = kept.join(bounded(repeated, n), "doc_id", "left_semi").select(*docs.columns)
    return (
        kept.join(bounded(repeated, n), "doc_id", "left_anti")
        .select(*docs.columns)
        .unionByName(again.dropDuplicates(["doc_id", "text"]))
    )
