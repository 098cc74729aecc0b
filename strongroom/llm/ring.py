"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 64-bit hashes; the arc before a point is that point's. A row starts on
the arc its hash falls on. Shards have capacities; what overflows a full shard goes on clockwise to the next arc whose
shard has room. Only counts an arc go to the driver (their number is shards times vnodes, whatever the input), where the
overflow is settled as intervals of ranks within each arc; rows then find their shard by rank.

Ranks inside an arc are spread over ``blocks`` sub-blocks (by a hash of identifier and text), each ranked in a task of
its own with the totals of the blocks before it added, so an arc that holds a third of all rows is not one task.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongroom.llm.common import longs, stored, whole_text

@dataclass(frozen=True)
class Ring:
    """points: sorted (hash, shard); an arc reaches from the point before it, exclusive, to its own, inclusive."""

    points: tuple[tuple[int, int], ...]
    shards: int


def build(shards: int, vnodes: int = 64) -> Ring:
    """The same points for a shard whatever the number of shards, so that a further shard only takes arcs over."""
    points = []
    for shard in range(shards):
        for node in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big", signed=True), shard))
    return Ring(tuple(sorted(points)), shards)


def arc_of(ring: Ring, key: Column) -> Column:
    """The index of the arc that a 64-bit key falls on; past the last point it is the first arc's."""
    ends = [p for p, _ in ring.points]
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    held = longs(ends)
    # Binary search for the number of ends below the key.
    below = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(ends)) & (F.get(held, at + step - 1) < key), at + step).otherwise(at),
    )
    return (below % len(ends)).cast("int")


def settle(ring: Ring, loads: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, first rank, rank after the last, shard, first slot) that place every row of every arc.

    Walks the ring clockwise from its first arc, carrying what overflows as a queue of intervals, the longest carried
    first, and goes round until nothing is left. The capacities must hold all rows.
    """
    if sum(loads) > sum(capacity):
        raise ValueError("the shards can't hold all rows")
    room, used = list(capacity), [0] * ring.shards
    placed, carried = [], []
    for turn in range(2):
        for arc, (_, shard) in enumerate(ring.points):
            if turn == 0 and loads[arc]:
                carried.append([arc, 0, loads[arc]])
            while carried and room[shard]:
                origin, first, end = carried[0]
                take = min(room[shard], end - first)
                placed.append((origin, first, first + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                carried[0][1] += take
                if carried[0][1] == end:
                    carried.pop(0)
    return placed


def exact_capacity(rows: int, shards: int) -> list[int]:
    """Capacities that add up to the rows and are at most one apart."""
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def headroom_capacity(rows: int, shards: int, headroom: float) -> list[int]:
    """Equal capacities with a share to spare: less balance, and fewer rows that move when the shards change."""
    return [math.ceil(rows * (1 + headroom) / shards)] * shards


def assign(
    docs: DataFrame, shards: int, vnodes: int = 64, blocks: int = 32, headroom: float = 0.0, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the columns in keep: a row for each row of docs.

    The key is a hash of the text, so equal texts start on one arc and stay together where the loads allow. With
    ``headroom`` 0 the counts of the shards are at most one apart.

    A null text has 0 bytes and the key of the empty text; a null identifier is ranked as the empty text. Repeated
    rows are separate rows: each has a slot of its own. An empty table gives an empty table.
    """
    ring = build(shards, vnodes)
    text = whole_text()
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), F.lit(blocks))
        .cast("int")
        .alias("_block"),
        F.xxhash64(text).alias("_key"),
        *keep,
    ).withColumn("_arc", arc_of(ring, F.col("_key")))
    narrow = stored(narrow, "ring-rows")
    counts = narrow.groupBy("_arc", "_block").agg(F.count("*").alias("n"))
    loads, before = [0] * len(ring.points), {}
    # At most shards * vnodes * blocks small rows, whatever the input.
    for arc, block, n in sorted(counts.collect()):
        before[(arc, block)] = loads[arc]
        loads[arc] += n
    rows = sum(loads)
    capacity = headroom_capacity(rows, shards, headroom) if headroom else exact_capacity(rows, shards)
    by_arc: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, first, end, shard, slot in settle(ring, loads, capacity):
        by_arc.setdefault(arc, []).append((first, end, shard, slot))
    plan = docs.sparkSession.createDataFrame(
        [(arc, block, base, by_arc[arc]) for (arc, block), base in before.items()],
        "_arc int, _block int, _base long, _spans array<struct<first:long,end:long,shard:int,slot:long>>",
    )
    within = Window.partitionBy("_arc", "_block").orderBy("_key", "doc_id", "size")
    # The plan is broadcast: its rows are bounded by the ring as said above.
    ranked = narrow.withColumn("_rank", F.row_number().over(within).cast("long")).join(
        F.broadcast(plan), ["_arc", "_block"]
    )
    span = F.filter("_spans", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["end"]))[0]
    return ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).withColumn("_span", span).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("_span.shard").alias("shard"),
        (F.col("_span.slot") + F.col("_rank") - F.col("_span.first")).alias("slot"),
        *keep,
    )
