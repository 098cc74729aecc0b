"""Prediction by partial matching over bytes, trained on a corpus and scored against it, without a broadcast model.

A symbol is predicted from the last ``ORDER`` bytes. Where the context has seen the symbol, its share is its count over
the context's counts and kinds (each kind of symbol adds one to the escape); else the model escapes to the context one
byte shorter, in which what the longer one has seen is excluded, and so on down to every symbol alike. A text begins
after, and ends with, a border symbol.

The trie is a table of counted grams (context and symbol), as large as the corpus makes it. The probability of a gram
needs its contexts of all lengths; those of two bytes and more share its last two bytes, so they are worked out group by
group of such bytes, while the contexts below are a table of at most 257 by 257 counts. The texts are cut into chunks
of bounded bytes; a chunk asks only for the grams and words it holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strongroom.llm.common import stored, whole_text

ORDER = 4
# Bits of a symbol in a gram's key; 256 is the border.
BITS, BORDER, SYMBOLS = 9, 256, 257
MASK = (1 << BITS) - 1
# Compressed bytes of input that make a chunk, and symbols that a worker takes at once.
CHUNK_BYTES = 8 * 1024 * 1024
AT_ONCE = 500_000
# Keys: a word, the end of a text, a gram.
WORD, END, GRAM = b"w", b"e", b"g"


def chunked(docs: DataFrame, columns: list[str], trained: Column) -> DataFrame:
    """The columns with _chunk and _train. A chunk is a part of a file as Spark reads it, of at most CHUNK_BYTES, so a
    row's chunk is the same whenever it is read. Rows that are in no files are written to some first."""
    where = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")]
    rows = docs.select(*columns)
    try:
        rows = docs.select(*columns, *(w.alias(n) for w, n in zip(where, ("_path", "_start", "_length"))))
    except AnalysisException:
        rows = stored(rows, "ppm-docs").select(*columns, *(w.alias(n) for w, n in zip(where, ("_path", "_start", "_length"))))
    parts = F.ceil(F.col("_length") / F.lit(CHUNK_BYTES))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(parts, F.lit(1)))
    return rows.select(*columns, F.xxhash64("_path", "_start", part).alias("_chunk"), trained.alias("_train"))


def symbols_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each after ``order`` borders and with one at its end; and where each ends (exclusive)."""
    sizes = np.array([len(t) + order + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(texts) else 0, BORDER, np.int64)
    at = 0
    for text, size in zip(texts, sizes):
        out[at + order : at + order + len(text)] = np.frombuffer(text, np.uint8)
        at += int(size)
    return out, ends


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of the gram at each predicted symbol of the texts, in order; and how many each text has."""
    symbols, _ = symbols_of(texts, order)
    keys = np.zeros(max(len(symbols) - order, 0), np.int64)
    for i in range(order + 1):
        keys |= symbols[i : len(symbols) - order + i] << (BITS * (order - i))
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    # A text's windows that reach into the next text's borders predict nothing.
    starts = np.concatenate(([0], np.cumsum(counts + order)[:-1])) if len(texts) else counts
    kept = np.ones(len(keys), bool)
    for i in range(order):
        inner = starts[1:] - order + i
        kept[inner] = False
    return keys[kept], counts


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, in lower case already."""
    return text.split()


def packed(keys: np.ndarray) -> list[bytes]:
    data = keys.astype(">i8").tobytes()
    return [GRAM + data[i : i + 8] for i in range(0, len(data), 8)]


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE bytes."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def chunk_keys(rows: DataFrame, order: int) -> DataFrame:
    """(_chunk, key, n): the words and grams of each chunk, and their counts in its training texts, summed in the task
    that reads the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, Counter] = {}
        ends: Counter = Counter()
        grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def out(chunk, keys, counts):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), chunk, np.int64)),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                ],
                names=["_chunk", "key", "n"],
            )

        for batch in batches:
            texts = _lowered(batch.column("text"))
            chunks = batch.column("_chunk").to_numpy()
            train = batch.column("_train").to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks):
                own_words = words.setdefault(int(chunk), Counter())
                own_grams = grams.setdefault(int(chunk), [])
                for counted in (True, False):
                    of = [texts[i] for i in np.flatnonzero((chunks == chunk) & (train == counted))]
                    for first, end in _parts(of):
                        part = of[first:end]
                        keys, n = np.unique(gram_keys(part, order)[0], return_counts=True)
                        own_grams.append((keys, n if counted else np.zeros(len(n), np.int64)))
                        if counted:
                            for text in part:
                                own_words.update(tokens_of(text))
                            ends[int(chunk)] += len(part)
                        else:
                            for text in part:
                                for word in tokens_of(text):
                                    own_words[word] += 0
                        if len(own_grams) > 8:
                            grams[int(chunk)] = own_grams = [merged(own_grams)]
        for chunk, own in words.items():
            listed = list(own.items())
            yield out(chunk, [END], [ends[chunk]])
            for first in range(0, len(listed), 100_000):
                part = listed[first : first + 100_000]
                yield out(chunk, [WORD + w for w, _ in part], [n for _, n in part])
        for chunk, parts in grams.items():
            if parts:
                keys, n = merged(parts)
                for first in range(0, len(keys), 100_000):
                    yield out(chunk, packed(keys[first : first + 100_000]), n[first : first + 100_000])

    return rows.select("_chunk", "text", "_train").mapInArrow(run, "_chunk long, key binary, n long")


def _suffix(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & ((1 << (BITS * symbols)) - 1)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of the last symbol of each gram, given its context.

    keys are unique, and hold all grams of every context of two bytes and more that occurs in them; counts are 0 for
    grams of other texts only. low[c, s] are the counts of symbols after single bytes.
    """
    found = np.zeros(len(keys), bool)
    logs = np.zeros(len(keys))
    seen = counts > 0

    def step(count, total, kinds):
        """Settles the grams whose symbol is seen here and escapes from here for the others. No kind left: no escape."""
        nonlocal logs, found
        with np.errstate(divide="ignore", invalid="ignore"):
            here = ~found & (count > 0)
            logs = np.where(here, logs + np.log10(count / (total + kinds)), logs)
            found |= here
            away = ~found & (kinds > 0)
            logs = np.where(away, logs + np.log10(kinds / (total + kinds)), logs)

    # The next longer context of each gram, and the gram's count there.
    previous = None
    for k in range(order, -1, -1):
        if k >= 2:
            grams, at = np.unique(_suffix(keys, k + 1), return_inverse=True)
            n = np.bincount(at, np.where(seen, counts, 0), len(grams))
            contexts, of = np.unique(grams >> BITS, return_inverse=True)
            total = np.bincount(of, n, len(contexts))
            kinds = np.bincount(of, n > 0, len(contexts))
            count, total, kinds = n[at], total[of][at], kinds[of][at]
        else:
            context, symbol = (keys >> BITS) & MASK, keys & MASK
            table = low if k == 1 else np.broadcast_to(low.sum(0), low.shape)
            count = table[context, symbol].astype(float)
            total, kinds = table.sum(1)[context].astype(float), (table > 0).sum(1)[context].astype(float)
        if previous is not None:
            # Counts, in this context, of the symbols that the longer one has seen.
            if k == 0:
                gone_total = ((low > 0) * low.sum(0)).sum(1)[context].astype(float)
                gone_kinds = (low > 0).sum(1)[context].astype(float)
            else:
                longer, longer_count = previous
                first, member = np.unique(longer, return_inverse=True)
                _, one = np.unique(_suffix(keys, k + 2), return_index=True)
                there = longer_count[one] > 0
                gone_total = np.bincount(member[one], np.where(there, count[one], 0), len(first))[member]
                gone_kinds = np.bincount(member[one], there, len(first))[member]
            step(count, total - gone_total, kinds - gone_kinds)
        else:
            step(count, total, kinds)
        previous = (_suffix(keys >> BITS, k), count)
    left = SYMBOLS - (low.sum(0) > 0).sum()
    return np.where(found, logs, logs - math.log10(left) if left else logs)


def gram_values(totals: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 of the probability of every gram of (key, n)."""
    gram = F.conv(F.hex(F.substring("key", 2, 8)), 16, 10).cast("long")
    grams = totals.where(F.substring("key", 1, 1) == GRAM).select(gram.alias("gram"), "n")
    context, symbol = F.shiftright("gram", BITS).bitwiseAND(MASK), F.col("gram").bitwiseAND(MASK)
    low = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    # At most 257 by 257 rows.
    for c, s, n in grams.where("n > 0").groupBy(context, symbol).agg(F.sum("n")).collect():
        low[c, s] = n
    sent = totals.sparkSession.sparkContext.broadcast(low)

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("gram").to_numpy()
        logs = log_probabilities(keys, table.column("n").to_numpy(), sent.value, order)
        return pa.table({"key": pa.array(packed(keys), pa.binary()), "value": pa.array(logs)})

    last_two = F.shiftright("gram", BITS).bitwiseAND((1 << (2 * BITS)) - 1)
    return grams.withColumn("_last", last_two).groupBy("_last").applyInArrow(run, "key binary, value double")


def score(docs: DataFrame, trained: Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text of docs.

    ``trained`` says which rows of docs the model learns from. score is log10 of the model's probability of the
    lower-cased text; base_score that of its words and end under add-one smoothing. A null text is the empty text, which
    has its end alone. Without training texts every symbol is alike. One row for each row of docs; repeated rows count
    as often as they are there.
    """
    rows = chunked(docs, ["doc_id", "text"], trained)
    keys = stored(chunk_keys(rows, order), "ppm-keys")
    totals = stored(keys.groupBy("key").agg(F.sum("n").alias("n")), "ppm-totals")
    is_gram = F.substring("key", 1, 1) == GRAM
    words = totals.where(~is_gram & (F.col("n") > 0)).agg(F.sum("n"), F.count("*")).first()
    n_train, kinds = words[0] or 0, words[1]
    values = totals.where(~is_gram).select("key", F.col("n").cast("double").alias("value")).unionByName(
        gram_values(totals, order)
    )
    answers = keys.select("_chunk", "key").join(values, "key")
    spread = math.log10(n_train + kinds + 1)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        count: dict[bytes, int] = {}
        ends = 0.0
        gram_parts, log_parts = [], []
        for batch in answers.to_batches(max_chunksize=100_000):
            listed, value = batch.column("key").to_pylist(), batch.column("value").to_numpy()
            is_gram = np.fromiter((k[:1] == GRAM for k in listed), bool, len(listed))
            data = b"".join([k[1:] for k in listed if k[:1] == GRAM])
            gram_parts.append(np.frombuffer(data, ">i8").astype(np.int64))
            log_parts.append(value[is_gram])
            count.update((k[1:], int(v)) for k, v in zip(listed, value.tolist()) if v > 0 and k[:1] == WORD)
            ends += sum(v for k, v in zip(listed, value.tolist()) if k == END)
        grams = np.concatenate(gram_parts) if gram_parts else np.zeros(0, np.int64)
        ranked = np.argsort(grams)
        grams, logs = grams[ranked], (np.concatenate(log_parts) if log_parts else np.zeros(0))[ranked]
        done = []
        for batch in texts.select(["doc_id", "text"]).to_batches(max_chunksize=500):
            lowered = _lowered(batch.column("text"))
            n_tokens, n_known, base, model = [], [], [], []
            for first, end in _parts(lowered):
                part = lowered[first:end]
                own, at = np.unique(gram_keys(part, order)[0], return_inverse=True)
                sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(grams, own)][at])))
                bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
                model += (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
                for text in part:
                    tokens = tokens_of(text)
                    known = np.array([count.get(t, 0) for t in tokens] + [ends], float)
                    n_tokens.append(len(known))
                    n_known.append(int((known > 0).sum()))
                    base.append(float(np.log10(known + 1).sum() - len(known) * spread))
            done.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array([n_train] * len(base), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(model, pa.float64()),
                    ],
                    names=shape.names,
                )
            )
        return pa.Table.from_batches(done, to_arrow_schema(shape))

    shape = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return (
        rows.select("doc_id", "text", "_chunk")
        .groupBy("_chunk")
        .cogroup(answers.groupBy("_chunk"))
        .applyInArrow(run, shape)
    )
