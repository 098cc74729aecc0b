"""Secrets in texts: strong patterns on their own, weak parts only when complementary parts co-occur.

A credential is often written in parts: an identifier, a secret and an endpoint. Each part alone looks like ordinary
text, so weak candidates count only when linked. Every part reaches ``reach`` code points to both sides within its scope
(a block of lines between empty lines); a secret is linked when an identifier's or an endpoint's reach overlaps its own.
The value of a key=value pair can be a secret to one part and an identifier to another, but never vouches for itself.
The parts of a text are sorted, so the interval join is a binary search and no pair is ever listed.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm.common import map_texts

# The strong patterns, their least lengths (of the value for assign), and the order of kinds at one start.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

# Weak parts. A mixed token has a digit and a letter, and is no run of hexadecimal digits alone.
IDENTIFIER = re.compile(
    r"(?:client|account|user|key|tenant|project)[_ -]?(?:id|name)?[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})",
    re.ASCII | re.IGNORECASE,
)
# It may follow a key's '=' and end before a sentence's '.'.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIXED = re.compile(r"(?<![A-Za-z0-9+/_.@-])" + TOKEN + r"(?!\.?[A-Za-z0-9+/_=@-])")
NAMED_HOST = r"(?:[A-Za-z0-9-]+\.)+(?:com|net|org|io|dev|internal|local)(?::[0-9]+)?(?![A-Za-z0-9-])"
ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.])"
ENDPOINT = re.compile(rf"(?<![A-Za-z0-9.@-])(?P<named>{NAMED_HOST})|(?<![0-9.]){ADDRESS}")
# What comes before a host's "://", read backwards from there, so that a long run of such signs is read once.
SCHEME_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")
# A secret and a named host in an address such as db://user:secret@host; numbered ones are endpoints anyway.
LOGIN = re.compile(rf"://[^\s/:@]*:({TOKEN})@({NAMED_HOST})?")
SCOPE_END = re.compile(r"\n[\x20\t]*\n")

PART = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("linked_start", T.IntegerType(), True),
    ]
)


def strong_parts(text: str) -> list[tuple[str, int, int]]:
    """The spans of the strong patterns, leftmost and not overlapping within a kind.

    HEX asks for the least length in the pattern: runs are maximal either way.
    """
    found = [
        ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _is_mixed(token: str) -> bool:
    return (
        any(c.isdigit() for c in token)
        and any(c.isalpha() for c in token)
        and not all(c in "0123456789abcdef" for c in token)
    )


def _nearest(span: tuple[int, int], others: list[tuple[int, int]], reach: int) -> int | None:
    """The start of the closest interval beside the span whose reach overlaps the span's.

    Others are sorted and don't overlap one another. Those that overlap the span are the same text, so no other part.
    """
    at = bisect.bisect_left(others, span)
    best = None
    for side in (range(at - 1, -1, -1), range(at, len(others))):
        for other in (others[i] for i in side):
            if other[0] < span[1] and span[0] < other[1]:
                continue
            gap = max(other[0] - span[1], span[0] - other[1])
            if gap <= 2 * reach and (best is None or gap < best[0]):
                best = (gap, other[0])
            break
    return None if best is None else best[1]


def _with_scheme(text: str, start: int) -> int:
    """Where the address of a host begins: at its scheme, which begins with a letter and after none, or at the host."""
    if not text.startswith("://", start - 3) or start < 4:
        return start
    at, first = start - 3, start
    while at and text[at - 1] in SCHEME_SIGNS:
        at -= 1
        if text[at].isalpha() and not (at and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in ".@-")):
            first = at
    return first


def find_parts(text: str, reach: int = 100) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, start of the part it is linked with) by start, then kind as KINDS lists them.

    Strong parts are always there, and link too: assign and hex as secrets, access as an identifier. Weak parts are
    there only when linked. Offsets are code points. The empty text has none.
    """
    strong = strong_parts(text)
    taken = sorted((start, end) for _, start, end in strong)

    def free(start: int, end: int) -> bool:
        at = bisect.bisect_left(taken, (end, end))
        return not any(s < end and e > start for s, e in taken[max(0, at - 3) : at])

    logins = [m for m in LOGIN.finditer(text) if _is_mixed(m[1])] if "://" in text else []
    mixed = [m.span() for m in MIXED.finditer(text) if _is_mixed(m[0])] + [m.span(1) for m in logins]
    mixed = [span for span in mixed if free(*span)]
    held_secrets = [(s, e) for kind, s, e in strong if kind != "access"]
    if not mixed and not held_secrets:
        return [(kind, s, e, None) for kind, s, e in sorted(strong, key=lambda p: (p[1], KINDS.index(p[0])))]
    named = [m.span() for m in IDENTIFIER.finditer(text) if free(*m.span())]
    hosts = [(_with_scheme(text, m.start()) if m["named"] else m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    hosts += [m.span(2) for m in logins if m[2]]
    hosts = [span for span in hosts if free(*span)]
    secrets = sorted([*mixed, *held_secrets])
    identifiers = sorted([*named, *((s, e) for kind, s, e in strong if kind == "access")])
    hosts.sort()
    borders = [m.end() for m in SCOPE_END.finditer(text)]
    scope = lambda start: bisect.bisect_right(borders, start)

    def by_scope(spans: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
        grouped: dict[int, list[tuple[int, int]]] = {}
        for span in spans:
            grouped.setdefault(scope(span[0]), []).append(span)
        return grouped

    in_scope = {"identifier": by_scope(identifiers), "secret": by_scope(secrets), "endpoint": by_scope(hosts)}

    def link(span: tuple[int, int], roles: tuple[str, ...]) -> int | None:
        for role in roles:
            mate = _nearest(span, in_scope[role].get(scope(span[0]), []), reach)
            if mate is not None:
                return mate
        return None

    secret_mates, other_mates = ("identifier", "endpoint"), ("secret",)
    found = [(kind, s, e, link((s, e), other_mates if kind == "access" else secret_mates)) for kind, s, e in strong]
    for kind, spans, mates in (
        ("identifier", named, other_mates),
        ("secret", mixed, secret_mates),
        ("endpoint", hosts, other_mates),
    ):
        found += [(kind, s, e, mate) for s, e in spans if (mate := link((s, e), mates)) is not None]
    return sorted(found, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))


def scan(docs: DataFrame, reach: int = 100) -> DataFrame:
    """The columns of docs but the text, and parts: array of (kind, start, end, linked_start).

    One row for each row of docs; a null or empty text has no parts; the whole of a long text is searched.
    """

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            rows = [
                [{"kind": k, "start": s, "end": e, "linked_start": m} for k, s, e, m in find_parts(text, reach)]
                for text in texts
            ]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("linked_start", pa.int32())])
            return [pa.array(rows, pa.list_(kind))]

        return work

    return map_texts(docs, make, [T.StructField("parts", T.ArrayType(PART, False), False)])


def redacted(text: str, mark: str = "[secret]", reach: int = 100) -> str:
    """The text with the spans of all parts but endpoints replaced by a mark; overlapping spans are one."""
    out, at = [], 0
    for kind, start, end, _ in find_parts(text, reach):
        if kind == "endpoint" or end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = 100) -> DataFrame:
    """docs with secrets masked in text and n_chars to match; rows without secrets are unchanged, nulls included.

    All columns stay, whatever their names: the others are carried as one column beside the text.
    """
    others = F.struct(F.lit(0).alias("nothing"), *(c for c in docs.columns if c != "text")).alias("row")
    changed = map_texts(
        docs.select(others, "text"),
        lambda: lambda texts: [pa.array([redacted(t, mark, reach) for t in texts], pa.string())],
        [T.StructField("new", T.StringType())],
        keep_text=True,
    )
    touched = F.coalesce("text", F.lit("")) != F.col("new")
    masked = {"text": F.when(touched, F.col("new")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        size = F.length("new").cast(docs.schema["n_chars"].dataType)
        masked["n_chars"] = F.when(touched, size).otherwise(F.col("row")["n_chars"])
    return changed.select(*((masked[c] if c in masked else F.col("row")[c]).alias(c) for c in docs.columns))
