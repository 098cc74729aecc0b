"""Exact duplicates: composable polynomial fingerprints, and equal ones compared chunk by chunk.

Texts are equal when they are identical after each run of ASCII white space became one space. A text is cut into chunks
of CHUNK bytes. Every chunk is hashed for itself, as a polynomial in its bytes modulo two primes, and chunk hashes
combine in any grouping, as the right one is shifted by the length of the left one:

    (h, s) + (h', s') = (h + s * h', s * s')    where s is the base to the power of the length

So the chunks of a huge document are dealt over the cluster and hashed side by side. Documents of one chunk, nearly all,
are hashed where they are read.

Equal fingerprints are not taken for equal texts. The chunks of documents whose fingerprints agree are compared: a chunk
number of a fingerprint has one content where its least and its greatest chunk are the same. That is a sorted pass in
each task with one chunk held, and only different contents are shuffled, however many copies there are. Which
fingerprints are repeated is told by a bitmap of fixed size; whatever else the bitmap lets through is compared in vain.
Where texts differ under one fingerprint, all documents get a further fingerprint of fresh bases, until none do.

Nulls: a null text is the empty text. A null doc_id stays; it is kept for a group only where the group has no other.
Repeated rows: of rows that share text and least doc_id one is kept. An empty table gives an empty one. Other columns,
of whatever name, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strongroom.llm.common import stored

CHUNK = 1 << 16
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
# Slots of the bitmap of repeated fingerprints: 2^20 words of 64 bits, whatever the input.
SLOTS = 1 << 26
HASH = "struct<a: bigint, b: bigint, shift_a: bigint, shift_b: bigint>"


def normal(text: Column) -> Column:
    """The text with one space for each run of white space; null as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(whole, r"[\x20\x09-\x0D]+", " ")).otherwise(whole)


def bases(seed: int, moduli: tuple[int, int]) -> list[int]:
    """A base for each modulus, another for each seed."""
    drawn = hashlib.sha256(str(seed).encode()).digest()
    return [2 + int.from_bytes(drawn[8 * k : 8 * k + 8]) % (m - 2) for k, m in enumerate(moduli)]


def chunk_hasher(seed: int, moduli: tuple[int, int], chunk: int) -> Callable[[bytes], list[int]]:
    """A function from at most ``chunk`` bytes to their two hashes and two shifts."""
    powers = []
    for base, modulus in zip(bases(seed, moduli), moduli, strict=True):
        power = [1]
        for _ in range(chunk):
            power.append(power[-1] * base % modulus)
        powers.append((np.array(power, dtype=np.int64), modulus))

    def hashed(data: bytes) -> list[int]:
        values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
        # Bytes below 2^9, powers below 2^31 and at most 2^16 of them stay below 2^63.
        sums = [int(values @ power[: len(values)]) % modulus for power, modulus in powers]
        return [*sums, *(int(power[len(values)]) for power, _ in powers)]

    return hashed


def combine(left: Column, right: Column, moduli: tuple[int, int] = MODULI) -> Column:
    """The hash of two adjoining stretches, of theirs."""
    parts = []
    for name, modulus in zip("ab", moduli, strict=True):
        parts.append(((left[name] + left[f"shift_{name}"] * right[name]) % modulus).alias(name))
    for name, modulus in zip("ab", moduli, strict=True):
        parts.append(((left[f"shift_{name}"] * right[f"shift_{name}"]) % modulus).alias(f"shift_{name}"))
    return F.struct(*parts)


def hash_chunks(chunks: Column, seed: int, moduli: tuple[int, int], chunk: int) -> Column:
    """The hash of each chunk, in Arrow batches."""

    @F.arrow_udf(HASH)
    def of_batch(column: pa.Array) -> pa.Array:
        hashed = chunk_hasher(seed, moduli, chunk)
        made = [hashed(value.as_buffer()) for value in column]
        columns = np.array(made, dtype=np.int64).reshape(-1, 4).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["a", "b", "shift_a", "shift_b"])

    # Said to vary, so that a filter on what follows from it does not hash every chunk once more.
    return of_batch.asNondeterministic()(chunks)


def spelled(hashes: list[Column], size: Column) -> Column:
    """A fingerprint: the length, then both residues of each seed in one number."""
    return F.array(size.cast("long"), *(F.shiftleft(h["a"], 31).bitwiseOR(h["b"]) for h in hashes))


def short_documents(df: DataFrame, seeds: int, moduli: tuple[int, int], chunk: int) -> DataFrame:
    """doc_id, data and key of documents of one chunk."""
    data = df.where(F.octet_length("text") <= chunk).select("doc_id", normal(F.col("text")).cast("binary").alias("data"))
    hashes = data.withColumns({f"h{s}": hash_chunks(F.col("data"), s, moduli, chunk) for s in range(seeds)})
    return hashes.select(
        "doc_id", "data", spelled([F.col(f"h{s}") for s in range(seeds)], F.octet_length("data")).alias("key")
    )


def long_chunks(df: DataFrame, chunk: int) -> DataFrame:
    """The chunks of longer documents: document (a number of its own), doc_id, no, data, digest; written once."""
    data = normal(F.col("text")).cast("binary")
    long = df.where(F.octet_length("text") > chunk).select("doc_id", data.alias("all"))
    long = long.withColumns({"document": F.monotonically_increasing_id(), "digest": F.sha2("all", 256)})
    last = F.floor((F.greatest(F.octet_length("all"), F.lit(1)) - 1) / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("all", i * chunk + 1, F.lit(chunk)))
    return stored(long.select("document", "doc_id", "digest", F.posexplode(cut).alias("no", "data")), "chunks")


def long_documents(chunks: DataFrame, seeds: int, moduli: tuple[int, int], chunk: int) -> DataFrame:
    """document, doc_id, digest and key of documents in chunks: hashed side by side, combined in order."""
    hashes = chunks.select(
        "document",
        "doc_id",
        "digest",
        "no",
        F.octet_length("data").alias("size"),
        *(hash_chunks(F.col("data"), s, moduli, chunk).alias(f"h{s}") for s in range(seeds)),
    )
    ordered = hashes.groupBy("document").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("digest").alias("digest"),
        F.sum("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("no", *(f"h{s}" for s in range(seeds))))).alias("parts"),
    )
    nothing = F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("a", 0), ("b", 0), ("shift_a", 1), ("shift_b", 1))))

    def whole(seed: int) -> Column:
        return F.aggregate("parts", nothing, lambda left, part: combine(left, part[f"h{seed}"], moduli))

    return ordered.select("document", "doc_id", "digest", spelled([whole(s) for s in range(seeds)], F.col("size")).alias("key"))


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def contested(short: DataFrame, chunks: DataFrame, long: DataFrame, groups: DataFrame) -> DataFrame:
    """The repeated fingerprints under which contents differ: every chunk number's least and greatest content."""
    bits = groups.select(slot(F.col("key")).alias("slot"))
    bitmap = bits.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    )
    keyed = short.select("key", F.lit(0).alias("no"), "data").unionByName(
        chunks.join(long.select("document", "key"), "document").select("key", "no", "data")
    )
    told = keyed.withColumn("slot", slot(F.col("key"))).withColumn("word", F.shiftright("slot", 6))
    hit = F.expr("(shiftright(bits, CAST(slot & 63 AS INT)) & 1L) = 1L")
    repeated = told.join(F.broadcast(bitmap), "word").where(hit)
    ends = repeated.groupBy("key", "no").agg(F.min("data").alias("least"), F.max("data").alias("greatest"))
    return ends.where(F.col("least") != F.col("greatest")).select("key")


def duplicates(
    df: DataFrame, text: str = "text", moduli: tuple[int, int] = MODULI, chunk: int = CHUNK
) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256. See the module on what is equal."""
    docs = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = long_chunks(docs, chunk)
    seeds = 0
    while True:
        seeds += 1
        short = short_documents(docs, seeds, moduli, chunk)
        long = stored(long_documents(chunks, seeds, moduli, chunk), "long")
        narrow = short.select("doc_id", "key", F.sha2("data", 256).alias("digest")).unionByName(
            long.select("doc_id", "key", "digest")
        )
        rows = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
        groups = rows.groupBy("key").agg(F.count("*").alias("group_size"), first)
        groups = stored(groups.where("group_size > 1"), "groups")
        if contested(short, chunks, long, groups).isEmpty():
            break
    joined = rows.join(groups, "key", "left")
    alone = F.col("first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def whole_hash(data: bytes, cuts: list[int], seed: int = 0, moduli: tuple[int, int] = MODULI) -> list[int]:
    """The hash of bytes cut at the given places: the same for all cuts. For readers and tests."""
    ends = sorted({0, len(data), *cuts})
    hashed = chunk_hasher(seed, moduli, max(1, len(data)))

    def both(left: list[int], right: list[int]) -> list[int]:
        sums = [(left[k] + left[2 + k] * right[k]) % moduli[k] for k in (0, 1)]
        return [*sums, *(left[2 + k] * right[2 + k] % moduli[k] for k in (0, 1))]

    return reduce(both, (hashed(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)), [0, 0, 1, 1])
