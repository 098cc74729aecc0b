"""Periodic runs of words: suffix classes united by descending common prefix, seeds where positions become adjacent.

A run is a stretch of consecutive words with least period q (words q apart are the same), of at least LEAST words and
POWER periods, that no neighbouring word extends. Two suffixes of a text that begin q apart and share l words span a
stretch of l + q words with period q, so every run stands between two suffixes: those at its start and q behind it.

The suffixes of a text are sorted, and neighbours in that order are edges that weigh what they share. Kruskal's
algorithm takes the edges by descending weight and unites classes of suffixes in a union-find structure, each with its
positions in order, the smaller class into the larger. What two suffixes from different classes share is the weight of
the edge that unites them, so positions that become neighbours at distance d within a third of it (POWER 4) seed a run
of period d. No smaller period is possible, since its suffix would stand between them, and the run begins where the word
before breaks the period.

Such a run has weight 5 at least, so only suffixes whose next five words stand elsewhere in the text take part; they are
sorted by doubling, many texts at once, in numpy. A text is a row: no shuffle, and a task holds a slice of texts.
Memory is some 100 bytes a word; time grows as n log^2 n, also in a text that is one run.

Nulls: a null text has no words; doc_id is only passed on. Repeated rows are each answered. An empty table gives an empty
one. Columns of df named as an output (n_words, runs, collapsed) are replaced, all others are passed on.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm.common import let, map_texts, whole_text

LEAST, POWER = 6, 4
# Words that two suffixes share at least where a run begins: of one repeated word, LEAST - 1; of longer periods, more.
SHARED = LEAST - 1
# Positions in one list of an ordered set.
PART = 1024
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN, False)),
    T.StructField("collapsed", T.StringType()),
]


class Ordered:
    """A set of positions in order, in lists of bounded length, so that a set of any size takes an insertion."""

    __slots__ = ("lists", "lasts", "size")

    def __init__(self, positions: list[int]):
        self.lists = [positions]
        self.lasts = [positions[-1]]
        self.size = len(positions)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for part in self.lists:
            yield from part

    def add(self, position: int) -> None:
        k = min(bisect_left(self.lasts, position), len(self.lists) - 1)
        part = self.lists[k]
        insort(part, position)
        self.lasts[k] = part[-1]
        self.size += 1
        if len(part) > PART:
            half = len(part) // 2
            self.lists[k : k + 1] = [part[:half], part[half:]]
            self.lasts[k : k + 1] = [part[half - 1], part[-1]]

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The neighbours of a position of the set."""
        k = bisect_left(self.lasts, position)
        part = self.lists[k]
        at = bisect_left(part, position)
        before = part[at - 1] if at else self.lists[k - 1][-1] if k else None
        after = part[at + 1] if at + 1 < len(part) else self.lists[k + 1][0] if k + 1 < len(self.lists) else None
        return before, after


def repeated(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions whose next SHARED words stand again in the same text, and some others where hashes agree."""
    at = np.flatnonzero(np.arange(len(ids)) + SHARED <= end)
    key = doc[at].astype(np.uint64)
    for k in range(SHARED):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return at[hit]


def group_starts(changes: np.ndarray) -> np.ndarray:
    """For a sorted list, where each row's group begins; changes: whether a row differs from the one before."""
    starts = np.where(changes, np.arange(len(changes)), 0)
    return np.maximum.accumulate(starts)


def edges(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of suffixes that share SHARED words at least, and how many they share."""
    nothing = np.zeros(0, dtype=np.int64)
    active = repeated(ids, doc, end)
    if not len(active):
        return nothing, nothing, nothing
    # A comparison of active suffixes goes on SHARED words further, at positions that need a rank too.
    at = np.union1d(active, active[active + SHARED < end[active]] + SHARED)
    stops = end[at]
    words = [np.where(at + k < stops, ids[np.minimum(at + k, len(ids) - 1)], -1) for k in range(SHARED)]
    columns = [doc[at], *words]
    order = np.lexsort(columns[::-1])
    changes = np.ones(len(at), dtype=bool)
    changes[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    rank = np.empty(len(at), dtype=np.int64)
    rank[order] = group_starts(changes)
    levels, shared = [], SHARED
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=len(at))[rank] > 1)
        if not len(tied):
            break
        levels.append((shared, rank.astype(np.int32)))
        following = at[tied] + shared
        ended = following >= stops[tied]
        behind = rank[np.where(ended, 0, np.searchsorted(at, np.where(ended, at[0], following)))]
        behind = np.where(ended, -1, behind)
        order = np.lexsort((behind, rank[tied]))
        old, new = rank[tied][order], behind[order]
        first = np.ones(len(tied), dtype=bool)
        first[1:] = old[1:] != old[:-1]
        split = first.copy()
        split[1:] |= new[1:] != new[:-1]
        rank[tied[order]] = old + group_starts(split) - group_starts(first)
        shared *= 2
    order = np.argsort(rank)
    left, right = at[order][:-1], at[order][1:]
    together = doc[left] == doc[right]
    left, right = left[together], right[together]
    length = np.zeros(len(left), dtype=np.int64)
    for shared, level in reversed(levels):
        a, b = left + length, right + length
        inside = (a < end[left]) & (b < end[right])
        i, j = (np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (a, b))
        length += np.where(inside & (at[i] == a) & (at[j] == b) & (level[i] == level[j]), shared, 0)
    more = np.ones(len(left), dtype=bool)
    for _ in range(SHARED - 1):
        a, b = left + length, right + length
        more &= (a < end[left]) & (b < end[right])
        more &= ids[np.minimum(a, len(ids) - 1)] == ids[np.minimum(b, len(ids) - 1)]
        length += more
    enough = length >= SHARED
    return left[enough], right[enough], length[enough]


def seeds(left: list[int], right: list[int], shared: list[int]) -> list[tuple[int, int, int]]:
    """(position, distance, shared words) of positions that become adjacent within reach; edges by descending weight."""
    parent: dict[int, int] = {}
    members: dict[int, list[int] | Ordered] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for a, b, weight in zip(left, right, shared, strict=True):
        reach = weight // (POWER - 1)
        a, b = root(a), root(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        if isinstance(large, Ordered):
            for x in small:
                large.add(x)
        else:
            for x in small:
                insort(large, x)
            if len(large) > PART:
                large = Ordered(large)
        members[a] = large
        own = set(small) if len(small) > 1 else None
        for x in small:
            if isinstance(large, Ordered):
                before, after = large.around(x)
            else:
                at = bisect_left(large, x)
                before = large[at - 1] if at else None
                after = large[at + 1] if at + 1 < len(large) else None
            if before is not None and x - before <= reach and not (own and before in own):
                found.append((before, x - before, weight))
            if after is not None and after - x <= reach and not (own and after in own):
                found.append((x, after - x, weight))
    return found


def runs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of text, start, length and period, of texts whose word numbers stand one behind the other."""
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
    left, right, shared = edges(ids, doc, end)
    order = np.argsort(-shared, kind="stable")
    made = np.array(seeds(*(x[order].tolist() for x in (left, right, shared))), dtype=np.int64).reshape(-1, 3)
    at, period, weight = made.T
    maximal = (at == begin[at]) | (ids[at - 1] != ids[at + period - 1])
    at, period, weight = at[maximal], period[maximal], weight[maximal]
    rows = np.stack([doc[at], at - begin[at], weight + period, period], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def analyse(texts: list[str]) -> list[pa.Array]:
    """The columns of FIELDS for texts."""
    words = [t.encode().split() for t in texts]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for t in words for w in t], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in words])]).astype(np.int64)
    rows = runs(ids, starts)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    first = starts[rows[:, 0]] + rows[:, 1]
    np.add.at(change, first + rows[:, 3], 1)
    np.add.at(change, first + rows[:, 2], -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = []
    for k, text in enumerate(words):
        mask = kept[starts[k] : starts[k + 1]]
        collapsed.append(b" ".join(text if mask.all() else [w for w, m in zip(text, mask.tolist(), strict=True) if m]))
    offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    columns = [pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)]
    structs = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
    kind = pa.list_(pa.field("element", structs.type, False))
    return [
        pa.array([len(t) for t in words], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets), structs, type=kind),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of df but the text, with n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed is the text with single spaces where of each run the first period stays.
    """
    return map_texts(df, lambda: analyse, FIELDS, text)


def words_of_text(text: Column) -> Column:
    return F.filter(F.split(whole_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repeats(text: Column, number: Column) -> Column:
    """A text whose words from ``number % n`` on repeat, 3 to 10 times; what tests of runs plant."""

    def repeating(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = number % n
        period = F.lit(1) + F.floor((n - start) / (F.lit(3) + number % 8))
        again = F.transform(
            words,
            lambda w, i: F.when(i < start, w).otherwise(F.get(words, (start + (i - start) % period).cast("int"))),
        )
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    return let(words_of_text(text), repeating)
