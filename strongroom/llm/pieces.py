"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces reads a stretch of text once. At each position its output links
give every piece that ends there, and each relaxes the best score of that position from the best score where the piece
begins: a single-pass Viterbi for the segmentation with the highest sum of scores. A character that no piece covers
costs the unknown penalty and becomes bytes.

Where no piece of the vocabulary crosses a border, the best segmentation of the whole is that of the parts, so each
different stretch between such borders is segmented once a slice.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strongroom.llm.common import map_texts

SPACE = "▁"
# Fixed values of the model format: kinds of pieces, and by how much an unknown character is worse than the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
# Characters of the stretches that a task remembers, which bounds their identifiers too. A slice's own come on top.
REMEMBERED = 1_000_000
# Scores of a merge model are ranks. They are read as the frequencies of a Zipf-Mandelbrot law, 1 / (rank + this), so
# that a sum of scores is a logarithm of a probability; as they stand, two short pieces would beat any long one.
RANK_OFFSET = 100
MERGES = 2
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Spaces and then letters, signs or one digit; a superscript numeral goes with the signs. See Encoder.splits.
_STRETCH = re.compile(rf"{SPACE}*[^\W\d_²]+|{SPACE}*(?:[^\w{SPACE}]|[_²])+|{SPACE}*\d|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (piece, score) by identifier, None for identifiers that text can't give; byte_ids: by byte, if the model
    has them; dummy_prefix: whether a space is put before the text."""

    pieces: tuple[tuple[str, float] | None, ...]
    byte_ids: tuple[int, ...] | None
    unknown: int
    dummy_prefix: bool = True


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, and bytes for strings, messages and fixed numbers."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read once on the driver.

    Scores are those of the file, but for a merge model, whose ranks become logarithms of frequencies. Of the normaliser only the identity with white space kept is supported; any other is an error.
    """
    with open(path, "rb") as file:
        data = file.read()
    pieces, bytes_of, unknown, prefix, merges = [], {}, 0, True, False
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for field, inner in _fields(value):
                if field == 1:
                    piece = inner.decode()
                elif field == 2:
                    score = float(np.frombuffer(inner, "<f4")[0])
                elif field == 3:
                    kind = inner
            if kind == BYTE:
                bytes_of[int(_BYTE_PIECE.fullmatch(piece)[1], 16)] = len(pieces)
            elif kind == UNKNOWN:
                unknown = len(pieces)
            pieces.append((piece, score) if kind in (NORMAL, USER) else None)
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == MERGES
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(1, b"identity") != b"identity" or spec.get(4, 1):
                raise ValueError("only the identity normaliser that keeps white space is supported")
            prefix = bool(spec.get(3, 1))
    if merges:
        total = sum(1 / (rank + RANK_OFFSET) for rank in range(len(pieces)))
        pieces = [p and (p[0], -math.log((RANK_OFFSET - p[1]) * total)) for p in pieces]
    return Vocabulary(tuple(pieces), tuple(bytes_of[b] for b in range(256)) if len(bytes_of) == 256 else None, unknown, prefix)


class Encoder:
    """Text to identifiers and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for identifier, piece in enumerate(vocabulary.pieces):
            if piece is not None:
                self.automaton.add_word(piece[0], (len(piece[0]), piece[1], identifier))
                if len(piece[0]) == 1:
                    self.single.add(piece[0])
        self.automaton.make_automaton()
        scores = [p[1] for p in vocabulary.pieces if p is not None]
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        # Borders may be cut at only if no piece holds two stretches, but for runs of spaces, which a cut ends anyway.
        self.splits = all(len(_STRETCH.findall(p[0])) == 1 for p in vocabulary.pieces if p is not None)
        self.forget()

    def segment(self, text: str) -> tuple[list[int], float]:
        """Identifiers and score of the best segmentation; of equal scores the one whose last piece begins first."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        single = self.single
        # Characters that are no piece, in order; they are crossed as unknown before anything further on is relaxed.
        strange = [] if single.issuperset(text) else [i for i, c in enumerate(text) if c not in single]
        strange.append(n)
        crossed = 0
        for last, (length, score, identifier) in self.automaton.iter(text):
            while strange[crossed] < last:
                self._cross(strange[crossed], best, back)
                crossed += 1
            start = last + 1 - length
            total = best[start] + score
            end = last + 1
            if total > best[end] or (total == best[end] and start < back[end][0]):
                best[end] = total
                back[end] = (start, identifier)
        for at in strange[crossed:-1]:
            self._cross(at, best, back)
        found, at = [], n
        while at:
            start, identifier = back[at]
            if identifier >= 0:
                found.append(identifier)
            elif self.vocabulary.byte_ids:
                found += [self.vocabulary.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            else:
                found.append(self.vocabulary.unknown)
            at = start
        return found[::-1], best[n]

    def _cross(self, at: int, best: list[float], back: list[tuple[int, int]]) -> None:
        score = best[at] + self.unknown_score
        if score > best[at + 1]:
            best[at + 1], back[at + 1] = score, (at, -1)

    def encode(self, text: str) -> tuple[list[int], float]:
        """Identifiers and score of a text; the empty text has none and 0."""
        ids, _, scores = self.encode_all([text])
        return ids.tolist(), float(scores[0])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The identifiers of all texts one after the other, where each text's begin and end, and the scores."""
        if self.characters > REMEMBERED:
            self.forget()
        known, codes, bounds = self.known, [], [0]
        for text in texts:
            if text:
                text = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
                stretches = _STRETCH.findall(text) if self.splits else [text]
                for new in set(stretches).difference(known):
                    ids, score = self.segment(new)
                    known[new] = len(self.scores)
                    self.characters += len(new)
                    self.flat.extend(ids)
                    self.ends.append(len(self.flat))
                    self.scores.append(score)
                codes += [known[stretch] for stretch in stretches]
            bounds.append(len(codes))
        codes = np.array(codes, np.int64)
        ends = np.array(self.ends)
        first, size = ends[codes], ends[codes + 1] - ends[codes]
        upto = np.concatenate(([0], np.cumsum(size)))
        # Of each stretch its identifiers from where they are kept to where they go.
        at = np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)
        bounds = np.array(bounds)
        each = np.array(self.scores)[codes]
        scores = np.array([each[i:j].sum() for i, j in zip(bounds, bounds[1:])])
        return np.array(self.flat)[at], upto[bounds], scores

    def forget(self) -> None:
        """Empties what is remembered of stretches: their number, identifiers one after the other, ends and scores."""
        self.known: dict[str, int] = {}
        self.characters = 0
        self.flat, self.ends, self.scores = array("i"), array("q", [0]), array("d")


class Decoder:
    """Identifiers to text. Unknown identifiers give nothing."""

    def __init__(self, vocabulary: Vocabulary):
        # Pieces as bytes by identifier; the last stands for identifiers that there are not.
        spell = [p[0].replace(SPACE, " ").encode() if p else b"" for p in vocabulary.pieces] + [b""]
        for byte, identifier in enumerate(vocabulary.byte_ids or ()):
            spell[identifier] = bytes([byte])
        self.table = pa.array(spell, pa.binary())
        self.dummy_prefix = vocabulary.dummy_prefix

    def decode_all(self, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of lists of identifiers that stand one behind the other."""
        strange = len(self.table) - 1
        ids = np.where((flat >= 0) & (flat < strange), flat, strange)
        # Taken in order, the pieces lie one after the other in one buffer.
        taken = self.table.take(pa.array(ids))
        ends = np.concatenate(([0], np.cumsum(pa.compute.binary_length(taken).to_numpy(zero_copy_only=False))))
        data = b"".join(memoryview(b)[: ends[-1]] for b in taken.buffers()[2:] if b) if len(ids) else b""
        texts = []
        for a, b in zip(ends[bounds], ends[bounds][1:], strict=False):
            own = data[a:b]
            if self.dummy_prefix and own.startswith(b" "):
                own = own[1:]
            texts.append(own.decode("utf-8", "replace"))
        return texts


IDS = [
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("piece_score", T.DoubleType(), False),
]


def _sent(docs: DataFrame, vocabulary: Vocabulary):
    """The vocabulary's values as a broadcast of plain tuples, which workers read without this package."""
    plain = (vocabulary.pieces, vocabulary.byte_ids, vocabulary.unknown, vocabulary.dummy_prefix)
    return docs.sparkSession.sparkContext.broadcast(plain)


def _encoded(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    ids, bounds, scores = encoder.encode_all(texts)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return ids, bounds, [lists, pa.array(scores)]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of docs but the text, with ids (array of int) and piece_score (the sum of the pieces' scores).

    A null or empty text has no identifiers and 0. One row for each row of docs; whole texts. Columns of docs named ids
    or piece_score are replaced. The vocabulary is broadcast: its size is the model file's.
    """
    sent = _sent(docs, vocabulary)

    def make():
        encoder = Encoder(Vocabulary(*sent.value))
        return lambda texts: _encoded(encoder, texts)[2]

    return map_texts(docs, make, IDS)


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, keep_text: bool = False) -> DataFrame:
    """As encode, and decoded: what the identifiers decode to. One pass, with one copy of the vocabulary a task.

    With ``keep_text`` the text stays as a column.
    """
    sent = _sent(docs, vocabulary)

    def make():
        known = Vocabulary(*sent.value)
        encoder, decoder = Encoder(known), Decoder(known)

        def work(texts: list[str]) -> list[pa.Array]:
            ids, bounds, columns = _encoded(encoder, texts)
            return [*columns, pa.array(decoder.decode_all(ids, bounds), pa.string())]

        return work

    return map_texts(docs, make, [*IDS, T.StructField("decoded", T.StringType(), False)], keep_text=keep_text)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns of encoded but ids, with text. Null ids give the empty text; unknown identifiers give nothing.

    A column of encoded named text is replaced.
    """
    sent = _sent(encoded, vocabulary)
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False)])

    def run(batches):
        decoder = Decoder(Vocabulary(*sent.value))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column("ids")
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = decoder.decode_all(flat, np.concatenate(([0], np.cumsum(sizes))))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[f.name for f in schema.fields]
                )

    return encoded.mapInArrow(run, schema)
