"""Running totals over a key that may hold most of the table.

A window partitioned by the key alone sorts a whole key in one task. Here a key is cut into
blocks that follow the order: totals per block are pre-aggregated on the map side, prefixed
over the (few) blocks of a key, and added to a window that never crosses a block. The result
is the same number a single window gives. Blocks of equal rows come from the quantiles of what
leads the order (``borders``), so a day that holds most of the rows is many blocks as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "__block"
# Rows of a whole table that a block of equal rows should hold, and the most blocks there are.
BLOCK_ROWS, MOST_BLOCKS = 1 << 20, 1 << 14


def by_rows(index: str, rows: int = 65536) -> Column:
    """A block of consecutive index values."""
    return F.floor(F.col(index) / F.lit(rows)).cast("bigint")


def small_keys(df: DataFrame, keys: list[str], rows: int = BLOCK_ROWS, buckets: int = 1 << 16) -> bool:
    """Whether no key holds more rows than that, so that a window may hold a whole key.

    Every row is counted, by a hash of its key, so few counts are exchanged; only hashes with more rows are counted key by
    key. The driver gets those hashes, at most ``buckets``.
    """
    hashed = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    many = [r[0] for r in df.groupBy(hashed.alias("h")).count().where(F.col("count") > rows).select("h").collect()]
    return not many or df.where(hashed.isin(many)).groupBy(*keys).count().where(F.col("count") > rows).isEmpty()


def borders(df: DataFrame, value: Column, rows: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> list[int]:
    """Values that cut a table into blocks of about so many rows; none where it is one block anyway.

    What the driver gets is bounded by ``most``; a table with more rows has larger blocks. A value that many rows share
    is in one block, so take one that tells rows apart, such as a moment and not its day.
    """
    blocks = min(most, math.ceil(df.count() / rows))
    if blocks <= 1:
        return []
    shares = [k / blocks for k in range(1, blocks)]
    found = df.select(F.percentile_approx(value.cast("bigint"), shares, max(10_000, 4 * blocks))).first()[0]
    return sorted(set(found or []))


def block_of(cuts: list[int], value: Column) -> Column:
    """The block of a value: the number of borders below it, by binary search. It never decreases along the value."""
    if not cuts:
        return F.lit(0).cast("bigint")
    held = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) < value), at + step).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), further).cast("bigint")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    totals: dict[str, Column],
) -> DataFrame:
    """Adds, per entry of ``totals``, the sum over the earlier rows of the same key.

    ``block`` must never decrease along ``order`` within a key. A constant ``F.lit(1)`` total
    gives the zero-based row number.
    """
    blocked = df.withColumn(BLOCK, block)
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    sums = [F.sum(value).alias(f"__t_{name}") for name, value in totals.items()]
    bases = (
        blocked.groupBy(*keys, BLOCK)
        .agg(*sums)
        .select(
            *[F.col(key).alias(f"__k_{key}") for key in keys],
            F.col(BLOCK).alias("__k_block"),
            *[
                F.coalesce(F.sum(f"__t_{name}").over(across), F.lit(0)).alias(f"__b_{name}")
                for name in totals
            ],
        )
    )
    local = blocked.select(
        "*",
        *[F.coalesce(F.sum(value).over(within), F.lit(0)).alias(f"__l_{name}") for name, value in totals.items()],
    )
    same = F.col(BLOCK) == F.col("__k_block")
    for key in keys:
        same = same & (F.col(key) == F.col(f"__k_{key}"))
    joined = local.join(bases, same)
    return joined.select(
        *[F.col(name) for name in df.columns if name not in totals],
        *[(F.col(f"__b_{name}") + F.col(f"__l_{name}")).alias(name) for name in totals],
    )


def running_maximum(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str, value: Column) -> DataFrame:
    """Adds the greatest value over the earlier rows of the same key, NULL for the first; blocks as in running_totals."""
    blocked = df.withColumns({BLOCK: block, "__v": value})
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    bases = blocked.groupBy(*keys, BLOCK).agg(F.max("__v").alias("__m"))
    bases = bases.withColumn("__b", F.max("__m").over(across)).drop("__m")
    local = blocked.withColumn("__l", F.max("__v").over(within)).drop("__v")
    joined = local.join(bases, [*keys, BLOCK])
    return joined.select(*[F.col(c) for c in df.columns if c != name], F.greatest("__b", "__l").alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """The zero-based position of every row within its key."""
    return running_totals(df, keys, order, block, {name: F.lit(1).cast("bigint")})


def neighbour(df: DataFrame, keys: list[str], index: str, step: int, columns: dict[str, str]) -> DataFrame:
    """Brings columns of the row ``step`` places away, for tables whose index is dense.

    An equi-join on key and index, so no task ever holds a whole key.
    """
    other = df.select(
        *[F.col(key).alias(f"__n_{key}") for key in keys],
        (F.col(index) - F.lit(step)).alias("__n_index"),
        *[F.col(source).alias(target) for source, target in columns.items()],
    )
    same = F.col(index) == F.col("__n_index")
    for key in keys:
        same = same & (F.col(key) == F.col(f"__n_{key}"))
    return df.join(other, same, "left").drop("__n_index", *[f"__n_{key}" for key in keys])
