"""The trees of a batch of files at once: where boxes lie, decided on arrays of positions.

Every list of siblings has a cursor, and all the cursors of a level move together: one step reads a header at each, says
what stands there and moves on. So the steps are as many as the longest list of siblings, not as the boxes, and no step
looks at what came before. Rules and fixed values are those of ``boxes``; Spark deals the files and keeps their columns.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Functions that run in workers are shipped by value: a cluster needs no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The tables of a track's samples, and the columns of a box.
RUN_TABLES = ("stts", "stsc", "stsz", "stz2", "stco", "co64", "stss", "ctts")
MOST = (1 << 63) - 1
PLAIN = re.compile(r"[\x20-\x7e]*\Z")
ENTRY = (
    ("kind", pa.binary()),
    ("offset", pa.int64()),
    ("size", pa.int64()),
    ("header", pa.int32()),
    ("fields", pa.int32()),
    ("clipped", pa.bool_()),
    ("error", pa.string()),
    ("detail_kind", pa.binary()),
    ("detail_offset", pa.int64()),
    ("parent", pa.int64()),
    ("depth", pa.int32()),
    ("ord", pa.int32()),
    ("path", pa.string()),
)
# Mean bytes up to which payloads are gathered by position.
SHORT = 256
# Bytes looked at where a box may begin.
HEAD = 20
# The last container on the way to each column of a track; those not named lie in the track itself.
STBL = "moov/trak/mdia/minf/stbl"
WAYS = {
    **dict.fromkeys(("mdhd", "hdlr"), "moov/trak/mdia"),
    "elst": "moov/trak/edts",
    "stbl": "moov/trak/mdia/minf",
    **dict.fromkeys(("stsd", "table_children", *RUN_TABLES), STBL),
    **dict.fromkeys(("entry_kind", "entry_header", "entry"), f"{STBL}/stsd"),
    **dict.fromkeys(("configuration", "entry_children"), f"{STBL}/stsd/*"),
}
FOUND, CUT, TAIL = 0, 1, 2
ERRORS = ("truncated", "undersized", "overrun", "too_many", "too_deep", "not_a_container", "two_movie_boxes", "oversized")
TRUNCATED, UNDERSIZED, OVERRUN, TOO_MANY, TOO_DEEP, NOT_A_CONTAINER, TWO_MOVIES, OVERSIZED = range(3, 11)
NO_KIND = -1


def number(kind: str) -> int:
    return int.from_bytes(kind.encode("latin-1"), "big")


def among(kinds: np.ndarray, widths: np.ndarray, codes) -> np.ndarray:
    return (widths == 4) & np.isin(kinds, np.array([number(c) for c in codes], np.int64))


def shown(kind: bytes) -> str:
    """A code as text, bytes that are not printable ASCII as ``\\xNN``."""
    text = kind.decode("latin-1")
    return text if PLAIN.match(text) else "".join(c if " " <= c <= "~" else f"\\x{ord(c):02x}" for c in text)


class Held:
    """The bytes that are held of the files of a batch, found by file and position."""

    def __init__(self, files: int, segments: pa.ListArray):
        flat = segments.flatten()
        counts = segments.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = flat.field("bytes")
        _, ends, data = held.buffers()
        wide = np.int64 if pa.types.is_large_binary(held.type) else np.int32
        at = np.frombuffer(ends, wide)[held.offset : held.offset + len(held) + 1].astype(np.int64) if len(held) else np.zeros(1, np.int64)
        self.buffer = data
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if len(self.data) < HEAD:
            self.data = np.concatenate((self.data, np.zeros(HEAD, np.uint8)))
        # Every run of bytes that a header may take, none copied.
        self.windows = np.ndarray(len(self.data) - HEAD + 1, f"V{HEAD}", self.data, strides=(1,))
        offset = flat.field("offset").fill_null(MOST).to_numpy(zero_copy_only=False)
        file = np.repeat(np.arange(files), counts)
        order = np.lexsort((offset, file))
        self.offset, self.start, self.size = offset[order], at[:-1][order], (at[1:] - at[:-1])[order]
        self.next = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.last = self.next + counts

    def rewind(self) -> None:
        """Ranges begin again with the first segment of each file."""
        self.next = self.last - np.diff(np.concatenate(([0], self.last)))

    def find(self, file: np.ndarray, at: np.ndarray, size: np.ndarray, keep: bool = True) -> np.ndarray:
        """Where ranges lie in the buffer, -1 where no segment contains one whole; a file's ranges never end earlier."""
        place, last = self.next[file].copy(), self.last[file]
        behind = np.flatnonzero(place < last)
        while len(behind):
            here = place[behind]
            behind = behind[self.offset[here] + self.size[here] < at[behind] + size[behind]]
            place[behind] += 1
            behind = behind[place[behind] < last[behind]]
        if keep:
            self.next[file] = place
        found = np.full(len(file), -1, np.int64)
        there = np.flatnonzero(place < last)
        there = there[self.offset[place[there]] <= at[there]]
        found[there] = self.start[place[there]] + at[there] - self.offset[place[there]]
        return found


    def heads(self, place: np.ndarray, have: np.ndarray, reach: int) -> np.ndarray:
        """The bytes from places on, a row each, zero behind those that are there; only the first ``reach`` are meant."""
        last = len(self.data) - HEAD
        head = self.windows[np.clip(place, 0, last)].view(np.uint8).reshape(-1, HEAD)
        span = np.arange(HEAD)
        late = np.flatnonzero(place > last)
        if len(late):
            head[late] = self.data[np.minimum(place[late, None] + span, len(self.data) - 1)]
        less = np.flatnonzero(have < reach)
        if len(less):
            head[less] = np.where(span < have[less, None], head[less], 0)
        return head


class Entries:
    """Columns of what was found, level by level, each in the order of its parents."""

    NAMES = ("file", "kind", "width", "offset", "size", "header", "fields", "said", "detail", "detail_width", "detail_offset")
    NAMES += ("parent", "depth", "ord", "child", "strict", "path")

    def __init__(self):
        self.parts, self.count, self.paths, self.path_of = [], 0, [], {}

    def add(self, level: dict[str, np.ndarray]) -> None:
        self.parts.append(level)
        self.count += len(level["file"])

    def named(self, over: np.ndarray, kind: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The paths of kinds below those paths, as numbers; each text is made once."""
        key = ((over + 1) * 8 + width + 1) << 32 | kind
        different, inverse = np.unique(key, return_inverse=True)
        numbers = np.empty(len(different), np.int64)
        for i, k in enumerate(different.tolist()):
            if k not in self.path_of:
                above, wide = divmod(k >> 32, 8)
                last = (k & 0xFFFFFFFF).to_bytes(4, "big")[: max(wide - 1, 0)]
                self.path_of[k] = len(self.paths)
                before = self.paths[above - 1] + "/" if above else ""
                self.paths.append(None if wide == 0 else before + shown(last))
            numbers[i] = self.path_of[k]
        return numbers[inverse]

    def whole(self) -> dict[str, np.ndarray]:
        return {n: np.concatenate([p[n] for p in self.parts]) for n in self.NAMES if n in self.parts[0]}


def siblings(rules: dict, held: Held, fetch, file, start, end, parent: dict | None, told: bool = True) -> dict[str, np.ndarray]:
    """The boxes between positions, for many parents at once; ``parent`` is None at the top level.

    ``fetch(rows, at, size)`` tells where bytes lie in the buffer. An error or a clipped box ends its list. ``told`` tells
    whether the columns are made that only a list of boxes shows.
    """
    top = parent is None
    most, reach = (rules["MAX_TOP_LEVEL"], 16) if top else (rules["MAX_CHILDREN"], 20)
    rows, at, made = np.flatnonzero(start < end), start.copy(), []
    movie, step = np.zeros(len(file), bool), 0
    while len(rows):
        here, left = at[rows], end[rows] - at[rows]
        have = np.minimum(left, reach)
        place = fetch(rows, here, have)
        none = place < 0
        have = np.where(none, 0, have)
        head = held.heads(place, have, reach)
        words = head.view(">u4")
        size32, kind = words[:, 0].astype(np.int64), words[:, 1].astype(np.int64)
        width = np.where(none, NO_KIND, np.clip(have - 4, 0, 4))
        size, header = np.where(size32 == 0, left, size32), np.full(len(rows), 8)
        long = np.flatnonzero((size32 == 1) & (have >= 4))
        if len(long):
            high, low = words[long, 2].astype(np.int64), words[long, 3].astype(np.int64)
            size[long] = np.where(high >= 1 << 31, MOST, (high & 0x7FFFFFFF) << 32 | low)
            header[long] = 16
        unread = have < 4
        unread[long] = have[long] < 16
        problem = np.where(unread, TRUNCATED, np.where(size < header, UNDERSIZED, FOUND))
        tolerant = movie[rows] if top else ~parent["strict"][rows]
        cut = size > left
        if top:
            opens = among(kind, width, rules["OPENING"]) & ((size32 == 1) | (size32 >= 8) | (size32 == 0))
            zeros = (width == 4) & (head[:, 4:8] == 0).any(axis=1)
            moov = among(kind, width, ("moov",))
            over = (moov & (size > rules["MOVIE_BOX_CAP"])) | (among(kind, width, ("ftyp",)) & (size > rules["FILE_TYPE_BOX_CAP"]))
            said = np.select(
                [
                    left < 8,
                    (here == 0) & ~opens & ~none,
                    tolerant & (zeros | (problem > 0)),
                    problem > 0,
                    cut,
                    tolerant & moov,
                    over,
                ],
                [TAIL, NOT_A_CONTAINER, TAIL, problem, np.where(tolerant, CUT, OVERRUN), TWO_MOVIES, OVERSIZED],
                FOUND,
            )
        else:
            bad = np.where(left < 8, TRUNCATED, problem)
            said = np.where(bad > 0, np.where(tolerant, TAIL, bad), np.where(cut, np.where(tolerant, CUT, OVERRUN), FOUND))
        if step >= most:
            said = np.full(len(rows), TOO_MANY)
        failed, found = said > TAIL, said == FOUND
        above = np.zeros(len(rows), np.int64) if top else parent["kind"][rows]
        # A tail shows the four bytes it begins with.
        tail = said == TAIL
        kind = np.where(tail, size32, np.where(width > 0, kind, 0))
        width = np.where(tail & ~none, 4, width)
        if top:
            descends, fields = found & moov, np.zeros(len(rows), np.int64)
            child, strict = np.where(descends, here + header, -1), descends
            movie[rows] |= ~failed & among(kind, width, ("moov",))
        else:
            listed, described = among(kind, width, rules["DESCENDED"]), among(kind, width, ("stsd",))
            own = np.minimum(rules["SAMPLE_DESCRIPTION_FIELDS"], size - header)
            child = np.where(listed | among(kind, width, ("udta",)), here + header, np.where(described, here + header + own, -1))
            fields = np.where(described, own, 0)
            # Sample entries, with the fields before their children.
            entry = np.flatnonzero(above == number("stsd"))
            if len(entry):
                code, wide, version = kind[entry], width[entry], words[entry, 4].astype(np.int64) >> 16
                sound = among(code, wide, rules["AUDIO"]) & (have[entry] >= 18) & (version < 3)
                fixed = np.where(sound, np.array((*rules["AUDIO_FIXED"], 0))[np.minimum(version, 3)], 0)
                fixed = np.where(among(code, wide, rules["VISUAL"]), rules["VISUAL_FIXED"], fixed)
                fits = entry[(fixed > 0) & (fixed <= size[entry]) & (child[entry] < 0)]
                fixed = fixed[np.searchsorted(entry, fits)]
                child[fits], fields[fits] = here[fits] + fixed, fixed - header[fits]
            child, strict, fields = np.where(found, child, -1), listed, np.where(found, fields, 0)
        made.append(
            {
                "row": rows,
                "file": file[rows],
                "kind": kind,
                "width": width,
                "offset": here,
                "size": np.where(found, size, np.where(failed, -1, left)),
                "header": np.where(failed | tail, 0, header),
                "said": said,
                "child": child,
                "strict": strict,
            }
        )
        if told:
            # Too many children and a child with no room for a header are told of the parent.
            of_parent = (said == TOO_MANY) | ((left < 8) & failed)
            no_detail = of_parent & top | (said == NOT_A_CONTAINER)
            made[-1] |= {
                "fields": fields,
                "detail": np.where(of_parent, above, kind),
                "detail_width": np.where(no_detail, NO_KIND, np.where(of_parent, 4, width)),
                "detail_offset": np.where(of_parent, -1 if top else parent["offset"][rows], here),
                "ord": np.full(len(rows), step),
            }
        going = rows[found]
        at[going] += size[found]
        rows, step = going[at[going] < end[going]], step + 1
    if not made:
        return {}
    level = {n: np.concatenate([m[n] for m in made]) for n in made[0]}
    order = np.argsort(level["row"], kind="stable")
    return {n: v[order] for n, v in level.items()}


def prefixes(paths) -> set[str]:
    """Paths with those of all containers above them."""
    return {path[:i] for path in paths for i in range(len(path) + 1) if path[i : i + 1] in ("/", "")}


def ways(columns) -> set[str]:
    """The paths of the containers that must be entered for columns of a track."""
    return prefixes({"moov/trak"} | {WAYS[n] for n in columns if n in WAYS})


def on_way(paths: list, entered: set[str]) -> np.ndarray:
    """The numbers of those paths that are entered, by their text or as any child of one."""
    return np.array([i for i, p in enumerate(paths) if p is not None and (p in entered or p.rpartition("/")[0] + "/*" in entered)], np.int64)


def enumerate_trees(
    rules: dict, length: np.ndarray, held: Held, below: bool, entered: set[str] | None = None, told: bool = True
) -> tuple[Entries, np.ndarray]:
    """Every box of each file level by level, and where each file's movie box lies in the buffer (-1: it isn't held).

    ``entered`` names the paths of the only containers that are entered.
    """
    entries, every = Entries(), np.arange(len(length))
    zero = np.zeros(len(length), np.int64)
    level = siblings(rules, held, lambda rows, at, size: held.find(rows, at, size), every, zero, length, None, told)
    base = np.full(len(length), -1, np.int64)
    if not level:
        return entries, base
    count = len(level["file"])
    over = np.full(count, -1, np.int64)
    level |= {"parent": over, "depth": np.zeros(count, np.int64), "path": entries.named(over, level["kind"], level["width"])}
    entries.add(level)
    movies = np.flatnonzero(level["child"] >= 0)
    file, at = level["file"][movies], level["offset"][movies]
    # The place of the movie box from the first of its file's segments on; a buffer position less the position in the file.
    held.rewind()
    base[file] = held.find(file, at, level["size"][movies], keep=False)
    shift = base.copy()
    shift[file] -= at
    depth = 1
    while below:
        rows = np.flatnonzero(level["child"] >= 0)
        if entered is not None:
            rows = rows[np.isin(level["path"][rows], on_way(entries.paths, entered))]
        if not len(rows):
            break
        parent = {n: level[n][rows] for n in ("file", "kind", "width", "offset", "size", "child", "strict", "path")}
        number_ = entries.count - len(level["file"]) + rows
        if depth > rules["MAX_DEPTH"]:
            blank = np.full(len(rows), -1)
            entries.add(
                {
                    **parent,
                    "size": blank,
                    "header": blank * 0,
                    "fields": blank * 0,
                    "said": np.full(len(rows), TOO_DEEP),
                    "detail": parent["kind"],
                    "detail_width": blank * 0 + NO_KIND,
                    "detail_offset": parent["child"],
                    "parent": number_,
                    "depth": np.full(len(rows), depth),
                    "ord": blank * 0,
                    "child": blank,
                }
            )
            break
        file = parent["file"]

        def fetch(rows, at, size, file=file):
            return np.where(base[file[rows]] < 0, -1, shift[file[rows]] + at)

        level = siblings(rules, held, fetch, file, parent["child"], parent["offset"] + parent["size"], parent, told)
        if not level:
            break
        of = level["row"]
        level |= {"parent": number_[of], "depth": np.full(len(of), depth), "path": entries.named(parent["path"][of], level["kind"], level["width"])}
        entries.add(level)
        depth += 1
    return entries, base


def _codes(kind: np.ndarray, width: np.ndarray) -> pa.Array:
    """Codes of up to four bytes; absent ones are NULL."""
    kept = np.maximum(width, 0)
    data = np.ascontiguousarray(kind.astype(">u4")).view(np.uint8)
    if (kept != 4).any():
        data = data.reshape(-1, 4)[np.arange(4) < kept[:, None]]
    ends = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
    valid = width >= 0
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(kind), [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _texts(texts: list, which: np.ndarray) -> pa.Array:
    return pa.array(texts, pa.string()).take(pa.array(which))


def _whole(values: np.ndarray, kind: pa.DataType, absent: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, mask=absent).cast(kind)


def in_order(e: dict[str, np.ndarray]) -> np.ndarray:
    """The depth-first place of every box in its file, -1 for errors: by offset, the container before what it holds."""
    fine = np.flatnonzero(e["said"] <= TAIL)
    fine = fine[np.lexsort((e["depth"][fine], e["offset"][fine], e["file"][fine]))]
    file = e["file"][fine]
    place = np.full(len(e["file"]), -1, np.int64)
    place[fine] = np.arange(len(fine)) - np.searchsorted(file, file)
    return place


def box_rows(
    e: dict[str, np.ndarray], paths: list, files: int, places: bool = False, only: set[str] | None = None, names: tuple[str, ...] | None = None
) -> pa.Array:
    """The boxes of each file as an array, breadth first.

    ``only`` names the paths of the boxes that are listed, ``names`` the only columns that are made of them.
    """
    order = np.argsort(e["file"], kind="stable")
    if only is not None:
        order = order[np.isin(e["path"][order], on_way(paths, only))]
    ends = np.concatenate(([0], np.cumsum(np.bincount(e["file"][order], minlength=files))))

    def of(name: str) -> np.ndarray:
        return e[name][order]

    def signed(values: np.ndarray) -> pa.Array:
        return _whole(values, pa.int64(), values < 0)

    def above() -> pa.Array:
        parent = of("parent")
        return _whole(np.where(parent < 0, 0, e["offset"][np.maximum(parent, 0)]), pa.int64(), parent < 0)

    columns = {
        "kind": lambda: _codes(of("kind"), of("width")),
        "offset": lambda: _whole(of("offset"), pa.int64()),
        "size": lambda: signed(of("size")),
        "header": lambda: _whole(of("header"), pa.int32()),
        "fields": lambda: _whole(of("fields"), pa.int32()),
        "clipped": lambda: pa.array((of("said") == CUT) | (of("said") == TAIL)),
        "error": lambda: _texts([None] * 3 + list(ERRORS), of("said")),
        "detail_kind": lambda: _codes(of("detail"), of("detail_width")),
        "detail_offset": lambda: signed(of("detail_offset")),
        "parent": above,
        "depth": lambda: _whole(of("depth"), pa.int32()),
        "ord": lambda: _whole(of("ord"), pa.int32()),
        "path": lambda: _texts(paths, of("path")),
        "place": lambda: signed(in_order(e)[order]),
    }
    fields = [pa.field(n, t) for n, t in (*ENTRY, *[("place", pa.int64())] * places) if names is None or n in names]
    rows = pa.StructArray.from_arrays([columns[f.name]() for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


def held_rows(rules: dict, e: dict[str, np.ndarray], held: Held, files: int, codes: tuple[str, ...] | None) -> pa.Array:
    """The top-level boxes of each file that are kept, or those of some kinds, as its segments."""
    kept = (e["parent"] < 0) & (e["said"] == FOUND)
    if codes is None:
        small = ~among(e["kind"], e["width"], rules["STEPPED_OVER"]) & (e["size"] <= rules["UNKNOWN_BOX_HOLD_CAP"])
        kept &= among(e["kind"], e["width"], ("moov", "ftyp")) | small
    else:
        kept &= among(e["kind"], e["width"], codes)
    top = np.flatnonzero(kept)
    top = top[np.lexsort((e["offset"][top], e["file"][top]))]
    file, at, size = (e[n][top] for n in ("file", "offset", "size"))
    place = held.find(file, at, size, keep=False)
    top, file, at, size, place = (v[place >= 0] for v in (top, file, at, size, place))
    data = memoryview(held.buffer) if held.buffer is not None else memoryview(b"")
    # As bytes: Arrow never lets go of a view it is given, and so of the batch.
    bytes_ = pa.array([bytes(data[p : p + n]) for p, n in zip(place.tolist(), size.tolist(), strict=True)], pa.binary())
    ends = np.concatenate(([0], np.cumsum(np.bincount(file, minlength=files))))
    segments = pa.StructArray.from_arrays([_whole(at, pa.int64()), bytes_], ["offset", "bytes"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), segments)


def track_rows(rules: dict, e: dict[str, np.ndarray], paths: list, held: Held, base: np.ndarray, files: int, schema: pa.StructType) -> pa.Array:
    """The tracks of each file as an array, each with the payloads of the boxes that describe it."""
    fine, count = e["said"] <= TAIL, len(e["file"])

    def first(parents: np.ndarray, kinds, mask: np.ndarray | None = None) -> np.ndarray:
        """The first child of some kinds of each parent, -1 where there is none."""
        among_ = fine & (e["parent"] >= 0) if mask is None else mask
        hits = np.flatnonzero(among_ if kinds is None else among_ & among(e["kind"], e["width"], kinds))[::-1]
        table = np.full(count + 1, -1, np.int64)
        table[e["parent"][hits]] = hits
        table[count] = -1
        return table[np.where(parents < 0, count, parents)]

    wanted = np.array([i for i, p in enumerate(paths) if p == "moov/trak"], np.int64)
    traks = np.flatnonzero(fine & np.isin(e["path"], wanted))
    traks = traks[np.argsort(e["file"][traks], kind="stable")]
    per_file = np.bincount(e["file"][traks], minlength=files)
    ends = np.concatenate(([0], np.cumsum(per_file)))
    index = np.arange(len(traks)) - ends[:-1][e["file"][traks]]
    mdia = first(traks, ("mdia",))
    stbl = first(first(mdia, ("minf",)), ("stbl",))
    stsd = first(stbl, ("stsd",))
    entry = first(stsd, None, fine & (e["parent"] >= 0) & (e["said"] == FOUND))
    configuration = first(entry, rules["CONFIGURATIONS"])
    movie_at = np.full(files, 0, np.int64)
    top = np.flatnonzero((e["child"] >= 0) & (e["parent"] < 0))
    movie_at[e["file"][top]] = e["offset"][top]
    data = memoryview(held.buffer) if held.buffer is not None else memoryview(b"")

    def cut(box: np.ndarray, skip: bool = True) -> pa.Array:
        at = np.maximum(box, 0)
        ahead = e["header"][at] if skip else 0
        start = base[e["file"][at]] + e["offset"][at] - movie_at[e["file"][at]] + ahead
        stop = start + e["size"][at] - ahead
        size = np.where(box < 0, 0, stop - start)
        ends = np.concatenate(([0], np.cumsum(size)))
        if ends[-1] > SHORT * len(box):
            made = [bytes(data[s:t]) if b >= 0 else None for b, s, t in zip(box.tolist(), start.tolist(), stop.tolist(), strict=True)]
            return pa.array(made, pa.binary())
        # Many short payloads are gathered at once.
        taken = held.data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        bits = pa.py_buffer(np.packbits(box >= 0, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(box), [bits, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)])

    # Children follow each other, in the order of their parents.
    known: dict[bytes, str] = {}
    listing = []

    def children() -> tuple[memoryview, np.ndarray, np.ndarray]:
        """Kind and width of the children of all boxes as one run of bytes, and where those of each box begin and end."""
        if not listing:
            inner = np.flatnonzero(fine & (e["parent"] >= 0))
            starts, stops = (np.searchsorted(e["parent"][inner], np.arange(count), side=side) for side in ("left", "right"))
            both = (e["kind"][inner] << 8 | e["width"][inner] & 0xFF).astype(np.int64)
            listing.append((memoryview(both.tobytes()), starts * 8, stops * 8))
        return listing[0]

    def listed(box: np.ndarray) -> pa.Array:
        """Kinds of the children of a box that are no errors, in order, separated by spaces."""
        both, starts, stops = children()
        here = np.maximum(box, 0)
        made = []
        for b, start, stop in zip(box.tolist(), starts[here].tolist(), stops[here].tolist(), strict=True):
            key = bytes(both[start:stop]) if b >= 0 else b""
            if key not in known:
                pairs = (divmod(k, 256) for k in np.frombuffer(key, np.int64).tolist())
                # The width of an absent code, -1, is held as 255.
                known[key] = " ".join(shown(k.to_bytes(4, "big")[: w if w <= 4 else NO_KIND]) for k, w in pairs)
            made.append(known[key])
        return pa.array(made, pa.string())

    def of(box: np.ndarray, name: str, kind: pa.DataType) -> pa.Array:
        return _whole(e[name][np.maximum(box, 0)], kind, box < 0)

    def kinds(box: np.ndarray) -> pa.Array:
        return _codes(e["kind"][np.maximum(box, 0)], np.where(box < 0, NO_KIND, e["width"][np.maximum(box, 0)]))

    # Made only where the schema has them.
    columns = {
        "track_index": lambda: _whole(index, pa.int32()),
        "trak_offset": lambda: of(traks, "offset", pa.int64()),
        "tkhd": lambda: cut(first(traks, ("tkhd",))),
        "mdhd": lambda: cut(first(mdia, ("mdhd",))),
        "hdlr": lambda: cut(first(mdia, ("hdlr",))),
        "elst": lambda: cut(first(first(traks, ("edts",)), ("elst",))),
        "stbl": lambda: of(stbl, "offset", pa.int64()),
        "stsd": lambda: cut(stsd),
        "entry_kind": lambda: kinds(entry),
        "entry_header": lambda: of(entry, "header", pa.int32()),
        "entry": lambda: cut(entry, False),
        "configuration": lambda: pa.StructArray.from_arrays([kinds(configuration), cut(configuration)], ["kind", "payload"]),
        "track_children": lambda: listed(traks),
        "table_children": lambda: listed(stbl),
        "entry_children": lambda: listed(entry),
        **{kind: lambda kind=kind: cut(first(stbl, (kind,))) for kind in RUN_TABLES},
    }
    rows = pa.StructArray.from_arrays([columns[f.name]() for f in schema], fields=list(schema))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


def tiling_rows(e: dict[str, np.ndarray], length: np.ndarray) -> pa.Array:
    """Of each file the boxes with children, and -1 for the file itself: how often a child does not begin where the one
    before ends, and whether the children cover what they are in from its start to its end."""
    fine = np.flatnonzero(e["said"] <= TAIL)
    file, above, at, end = e["file"][fine], e["parent"][fine], e["offset"][fine], e["offset"][fine] + e["size"][fine]
    # Children of one parent follow each other, in their order.
    group = np.where(above < 0, -1 - file, above)
    new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if not len(first):
        made = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    else:
        broken = ~new & (np.concatenate((end[:1], end[:-1])) != at)
        breaks = np.add.reduceat(broken.astype(np.int64), first)
        last, top, over = np.maximum.reduceat(end, first), above[first] < 0, np.maximum(above[first], 0)
        start = np.where(top, 0, e["offset"][over] + e["header"][over] + e["fields"][over])
        stop = np.where(top, length[file[first]], e["offset"][over] + e["size"][over])
        whole = (breaks == 0) & (np.minimum.reduceat(at, first) == start) & (last == stop)
        made = [np.where(top, -1, e["offset"][over]), breaks, whole]
    order = np.argsort(file[first], kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(file[first], minlength=len(length)))))
    rows = pa.StructArray.from_arrays([pa.array(v[order]) for v in made], ["parent", "breaks", "tiles"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


def one_segment(content: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lengths and segments of files that are held whole."""
    count = len(content)
    segment = pa.StructArray.from_arrays([pa.array(np.zeros(count, np.int64)), content], ["offset", "bytes"])
    ends = pa.array(np.arange(count + 1, dtype=np.int32))
    return pc.binary_length(content).cast(pa.int64()), pa.ListArray.from_arrays(ends, segment)


def walker(
    rules: dict,
    tracks: pa.DataType | None,
    boxes: bool = True,
    below: bool = True,
    places: bool = False,
    movie: bool = True,
    path: str | None = None,
    names: tuple[str, ...] | None = None,
    holds: bool | tuple[str, ...] = False,
    whole: bool = False,
    tiles: bool = False,
):
    """The walk of a batch as a function of lengths and segments: boxes, with where the movie box lies, tracks, or both.

    ``tracks`` is the Arrow type of a track, which says what columns it has and in what order. ``below`` tells whether
    boxes are entered; without it the top level is all there is. ``places`` adds their place in file order to boxes.
    ``movie`` tells whether boxes come with where the movie box lies. ``path`` names the only boxes that are listed, with
    the containers above them, and ``names`` the only columns of boxes. ``holds`` adds the bytes of the
    top-level boxes that are kept, or of some kinds. ``whole`` makes it a function of contents alone. ``tiles`` makes it
    tell how children cover their boxes, and nothing else.
    """
    only = None if path is None else prefixes({path})
    # Tracks alone, and boxes of a path, show nothing of what lies off their way.
    entered = ways(tracks.names) if tracks is not None and not boxes else only

    def run(length: pa.Array, segments: pa.Array) -> pa.Array:
        files = len(length)
        # A file that could not be read has neither length nor segments: its first header is missing.
        ends = length.fill_null(8).to_numpy(zero_copy_only=False)
        held = Held(files, segments)
        entries, base = enumerate_trees(rules, ends, held, below, entered, boxes)
        nothing = {n: np.zeros(0, np.int64) for n in Entries.NAMES}
        e = entries.whole() if entries.parts else nothing
        if tiles:
            return tiling_rows(e, ends)
        described = [track_rows(rules, e, entries.paths, held, base, files, tracks)] if tracks is not None else []
        if not boxes:
            return described[0]
        rows = box_rows(e, entries.paths, files, places, only, names)
        columns = {"boxes": rows}
        if below and movie:
            movies = np.flatnonzero((e["child"] >= 0) & (e["parent"] < 0))
            at, size = np.full(files, -1, np.int64), np.full(files, -1, np.int64)
            at[e["file"][movies]], size[e["file"][movies]] = e["offset"][movies], e["size"][movies]
            columns |= {"movie_offset": pa.array(at, mask=at < 0), "movie_size": pa.array(size, mask=at < 0)}
        if holds:
            held.rewind()
            columns["segments"] = held_rows(rules, e, held, files, None if holds is True else holds)
        if described:
            columns["tracks"] = described[0]
        return rows if len(columns) == 1 else pa.StructArray.from_arrays(list(columns.values()), list(columns))

    def run_whole(content: pa.Array) -> pa.Array:
        return run(*one_segment(content))

    return run_whole if whole else run
