"""Spelling variants: words one edit apart, searched in k-d trees over letter counts.

A word is a point: how often it has each letter, letters folded into DIMENSIONS by their code. A replaced letter takes
one count down and another up, an inserted one takes one up, so one edit is an L1 distance of two at most. For each pair
of lengths (the same, and one more) the points near a word are searched by boxes: a box is passed by where its nearest
point would need more counts up or down than an edit has. What is left is verified by the order of the letters.

Spark deals the work by the same trees. The words of each length are divided into boxes, fitted on a sample of SAMPLE
words at most; every word of the table lies in one box and asks the few boxes that one edit can reach. Boxes and their
questions are cut into blocks of bounded words and letters, and blocks of one box meet in a join, one row for two
blocks, so that a box full of anagrams is spread over tasks too. Within two blocks a tree is built and searched in
numpy. Only verified pairs come out. How good the sample is changes the balance and nothing else.

A word's form is its near word of most occurrences, where it occurs at least RATIO times as often; roots follow forms to
the last. Occurrences grow tenfold a step, so 18 steps are the most, which doubling takes in five joins.

Nulls: a null text has no words; a null doc_id counts as the empty text. Repeated rows count each time. An empty table
gives an empty one. Ties go to the first word in code point order. Other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongroom.llm.common import slices, stored

DIMENSIONS = 32
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_OCCURRENCES, RATIO = 7, 2, 10
# Of words that fit the boxes; on the driver.
SAMPLE = 1 << 16
# Of a block: what a row of two blocks holds twice.
BLOCK_WORDS, BLOCK_LETTERS = 2048, 1 << 18
# Points that are compared one by one.
LEAF = 64
# Different words a task counts before it hands them on.
HELD = 1 << 17
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Counts up and down of one edit, by the role of the word that asks.
POINT, REPLACED, INSERTED = 0, 1, 2
ALLOWED = {POINT: (0, 0), REPLACED: (1, 1), INSERTED: (1, 0)}
# A box is a number, or (letter, count, below, from it on).
Box = int | tuple


def count_words(
    df: DataFrame, alter: Callable[[str, str], str] | None = None, least: int = LEAST_LETTERS, text: str = "text"
) -> DataFrame:
    """word and n: the runs of at least so many letters, A to Z lower-cased; alter(doc_id, word) may change each."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")
    docs = df.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))

    def given(held: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, whole in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for word, n in Counter(pattern.findall(whole or "")).items():
                        lowered = word.lower() if word.isascii() else word.translate(LOWER)
                        held[alter(doc, lowered) if alter else lowered] += n
                if len(held) > HELD:
                    yield given(held)
                    held = Counter()
        if held:
            yield given(held)

    counted = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.length("word") >= least) & (F.col("n") >= LEAST_OCCURRENCES))


def points(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word. Counts stop at 100, which brings points no farther apart."""
    sizes = [len(w) for w in words]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    cells = np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + codes % DIMENSIONS
    counts = np.bincount(cells, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return np.minimum(counts, 100).astype(np.int8)


def parted(at: np.ndarray) -> tuple[int, int] | None:
    """The letter that spreads most and the count that halves these points by it; none where all are the same."""
    low, high = at.min(axis=0), at.max(axis=0)
    if (low == high).all():
        return None
    letter = int(np.where(low == high, -1.0, at.var(axis=0)).argmax())
    count = int(np.partition(at[:, letter], len(at) // 2)[len(at) // 2])
    return letter, max(count, int(low[letter]) + 1)


def boxes(at: np.ndarray, most: int) -> tuple[Box, int]:
    """The space divided until a box has ``most`` of the points, and how many boxes that makes."""
    made = 0

    def divide(inside: np.ndarray) -> Box:
        nonlocal made
        split = parted(inside) if len(inside) > most else None
        if split is None:
            made += 1
            return made - 1
        letter, count = split
        below = inside[:, letter] < count
        return letter, count, divide(inside[below]), divide(inside[~below])

    return divide(at), made


def reached(box: Box, at: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each box and the rows of the points that reach into it with so many counts up and down."""

    def visit(box: Box, rows: np.ndarray, ups: np.ndarray, downs: np.ndarray, low: dict, high: dict) -> Iterator:
        keep = (ups <= up) & (downs <= down)
        rows, ups, downs = rows[keep], ups[keep], downs[keep]
        if not len(rows):
            return
        if isinstance(box, int):
            yield box, rows
            return
        letter, count, below, above = box
        own = at[rows, letter].astype(np.int64)
        before = np.maximum(own - high[letter], 0) if letter in high else 0
        yield from visit(below, rows, ups, downs - before + np.maximum(own - count + 1, 0), low, high | {letter: count - 1})
        before = np.maximum(low[letter] - own, 0) if letter in low else 0
        yield from visit(above, rows, ups - before + np.maximum(count - own, 0), downs, low | {letter: count}, high)

    none = np.zeros(len(at), dtype=np.int64)
    yield from visit(box, np.arange(len(at)), none, none, {}, {})


def near_points(held: np.ndarray, asked: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of held and asked that lie within so many counts up and down, by a k-d tree over the held ones.

    Letters stand first, as letter after letter is summed over all rows at once. Sums of far points may wrap round in
    eight bits, which can only let them through; those within the bounds are small.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    told = np.flatnonzero((held != held[:1]).any(axis=0) | (asked != held[:1]).any(axis=0)) if len(held) else []
    letters, questions = np.ascontiguousarray(held[:, told].T), np.ascontiguousarray(asked[:, told].T)

    def over(differences: np.ndarray) -> np.ndarray:
        return np.add.reduce(np.maximum(differences, 0), axis=0, dtype=np.int8)

    def visit(inside: np.ndarray, rows: np.ndarray) -> None:
        at, own = letters[:, inside], questions[:, rows]
        low, high = at.min(axis=1, keepdims=True), at.max(axis=1, keepdims=True)
        rows = rows[(over(low - own) <= up) & (over(own - high) <= down)]
        if not len(rows):
            return
        one_place = (low == high).all()
        if len(inside) > LEAF and not one_place:
            split = parted(at.T)
            below = at[split[0]] < split[1]
            visit(inside[below], rows)
            visit(inside[~below], rows)
            return
        step = max(1, (1 << 20) // len(inside))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            if one_place:
                # All points are as near as their box.
                i, j = np.indices((len(some), len(inside))).reshape(2, -1)
            else:
                # Lengths fix the difference of counts up and down, so the counts up decide.
                ups = np.zeros((len(some), len(inside)), dtype=np.int8)
                for letter in range(len(told)):
                    ups += np.maximum(at[letter][None, :] - questions[letter, some][:, None], 0)
                i, j = np.nonzero((ups >= 0) & (ups <= up))
            found.append((inside[j], some[i]))

    if len(held) and len(asked):
        visit(np.arange(len(held)), np.arange(len(asked)))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def spelled(words: list[str]) -> np.ndarray:
    """The letters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def near_words(held: list[str], asked: list[str], role: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of held and asked words one edit apart: replaced, or the held one has a letter more."""
    i, j = near_points(points(held), points(asked), *ALLOWED[role])
    of_held, of_asked = spelled(held), spelled(asked)
    good = np.zeros(len(i), dtype=bool)
    step = max(1, (1 << 20) // of_held.shape[1])
    for k in range(0, len(i), step):
        left, right = of_held[i[k : k + step]], of_asked[j[k : k + step]]
        if role == REPLACED:
            good[k : k + step] = (left != right).sum(axis=1) == 1
        else:
            # Letters agree up to the place of the insertion, and shifted by one from there on.
            before = np.cumprod(left[:, :-1] == right, axis=1).sum(axis=1)
            after = np.cumprod((left[:, 1:] == right)[:, ::-1], axis=1).sum(axis=1)
            good[k : k + step] = before + after >= right.shape[1]
    return i[good], j[good]


def dealt(words: DataFrame, trees: dict[int, Box]) -> DataFrame:
    """length, box, role, word, n: every word in its own box, and once more in each other box that it asks.

    Of two boxes of one length the words in the one with the lower number ask the other.
    """
    names = ["length", "box", "role", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                words, n = part.column("word"), part.column("n")
                sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
                for length in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == length)
                    at = points(words.take(pa.array(own)).to_pylist())
                    home = np.zeros(len(own), dtype=np.int64)
                    for role, size in ((POINT, length), (REPLACED, length), (INSERTED, length + 1)):
                        for box, rows in reached(trees.get(size, 0), at, *ALLOWED[role]):
                            if role == POINT:
                                home[rows] = box
                            elif role == REPLACED:
                                rows = rows[home[rows] < box]
                            some = pa.array(own[rows])
                            place = (pa.array(np.full(len(some), x, dtype=np.int32)) for x in (size, box, role))
                            columns = [*place, words.take(some), n.take(some)]
                            yield pa.RecordBatch.from_arrays(columns, names=names)

    return words.mapInArrow(run, "length int, box int, role int, word string, n long")


def fitted(words: DataFrame, sample: int, block_words: int) -> dict[int, Box]:
    """Boxes for each length, of about ``block_words`` words each, from at most about ``sample`` words."""
    one_in = words.count() // sample + 1
    by_length = defaultdict(list)
    for row in words.where(F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0).select("word").collect():
        by_length[len(row.word)].append(row.word)
    return {k: boxes(points(v), max(1, block_words // one_in))[0] for k, v in by_length.items()}


def near(
    words: DataFrame, sample: int = SAMPLE, block_words: int = BLOCK_WORDS, block_letters: int = BLOCK_LETTERS
) -> DataFrame:
    """word, near, near_n: every word with each that is one edit apart. words: word and n, no word twice."""
    asked = stored(dealt(words, fitted(words, sample, block_words)), "letters")
    place = ["length", "box", "role"]
    # A row for each box and role: at most three times SAMPLE and the number of different lengths.
    sizes = asked.groupBy(*place).agg(F.count("*").alias("words"))
    needed = F.greatest(F.col("words") / block_words, F.col("words") * F.col("length") / block_letters)
    spread = asked.join(F.broadcast(sizes.select(*place, F.ceil(needed).alias("blocks"))), place)
    blocks = spread.groupBy(*place, F.pmod(F.xxhash64("word"), "blocks").alias("block")).agg(
        F.collect_list("word").alias("words"), F.collect_list("n").alias("counts")
    )
    held = blocks.where(F.col("role") == POINT).select(
        "length", "box", F.col("block").alias("held_block"), F.col("words").alias("held"), F.col("counts").alias("held_n")
    )
    # The words of a box ask it too: its blocks meet each other and themselves.
    once = (F.col("role") != POINT) | (F.col("block") >= F.col("held_block"))
    alone = (F.col("role") == POINT) & (F.col("block") == F.col("held_block"))
    met = blocks.join(held, ["length", "box"]).where(once)
    met = met.select((F.col("role") == INSERTED).alias("longer"), alone.alias("alone"), "held", "held_n", "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                longer, alone, held, held_n, words, counts = (column[k].as_py() for column in batch.columns)
                i, j = near_words(held, words, INSERTED if longer else REPLACED)
                left, right = pa.array(held, pa.string()).take(pa.array(i)), pa.array(words, pa.string()).take(pa.array(j))
                of_left, of_right = pa.array(np.array(held_n)[i], pa.int64()), pa.array(np.array(counts)[j], pa.int64())
                yield pa.RecordBatch.from_arrays([right, left, of_left], names=["word", "near", "near_n"])
                # A block that meets itself finds every pair from both sides.
                if not alone:
                    yield pa.RecordBatch.from_arrays([left, right, of_right], names=["word", "near", "near_n"])

    return met.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of word and form: forms followed to the last, in doubling steps until none changes."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(reached.join(onward, "root", "left").select("word", "root", "next"), "roots")
        reached = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next IS NOT NULL").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = RATIO, **sizes: int) -> DataFrame:
    """word, n, n_near, form, form_n, root of words with their numbers. ``sizes`` goes to ``near``."""
    words = stored(words, "words")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("first")
    grouped = near(words, **sizes).groupBy("word").agg(F.count("*").alias("n_near"), first)
    frequent = -F.col("first.less") >= ratio * F.col("n")
    known = stored(
        words.join(grouped, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("first.form")).alias("form"),
            F.when(frequent, -F.col("first.less")).alias("form_n"),
        ),
        "forms",
    )
    followed = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(followed, "word", "left").withColumn("root", F.coalesce("root", "word"))
