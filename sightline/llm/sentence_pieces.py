"""SentencePiece (merge type) encoding and decoding by a table over prefixes.

For every prefix of a chunk there is at most one token that can end its encoding: the longest vocabulary match ending
there whose predecessor (the unique last token of the remaining prefix) is compatible with it, that is, the two
strings side by side encode to exactly these two tokens. One automaton pass lists the matches, the table keeps the last
token of each prefix, and the ids are recovered backwards from the end.

Defined results: a null or empty text has no ids and decodes to ""; characters outside the vocabulary become byte
pieces; chunks and texts are of any length; repeated rows and rows without an id give their own results; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import pairwise

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_rows, remembered

SPACE = "▁"
#: Pairs, and chunks with their ids, that a worker remembers in two halves: a full half takes the place of the older one, from which what is met again returns. Neither changes a result.
REMEMBERED, CHUNKS = 1 << 18, 1 << 19
#: Marks before which a chunk is cut, after letters and digits that no piece joins with a mark.
MARKS = ".,;:!?"


class PieceCodec:
    """Encoder and decoder for a merge-type model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str, remember: int = CHUNKS):
        self.half = remember // 2
        model = sentencepiece.SentencePieceProcessor(model_file=path)  # only its vocabulary is read
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space inside: chunks can't be cut at spaces")
        self.pair: dict[tuple[str, str], bool] = {}
        self.older_pair: dict[tuple[str, str], bool] = {}
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self._merge(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        joined = {a for p in self.pieces for a, b in pairwise(p) if b in MARKS}  # never letters or digits here, but for a superscript
        last = "".join(sorted(c for c in self.chars if c.isalnum() and c not in joined))
        core = f" *(?>[^ \n{MARKS}]+)(?<=[{re.escape(last)}])(?=[{MARKS}])|" if last else ""
        self.chunks = re.compile(f"{core} *[^ \n]+| +|\n").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.raw: list[bytes] = [p.replace(SPACE, " ").encode() for p in self.pieces]
        self.bytes_of = {i: b for b, i in self.byte_id.items()}
        for i in range(n):
            if i in self.bytes_of:
                self.raw[i] = bytes([self.bytes_of[i]])
            elif model.is_control(i):
                self.raw[i] = b""
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()

    def _merge(self, text: str) -> list[str]:
        """Merge a short string pair by pair: best score first, then leftmost. Used for the compatibility tests."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: str, b: str) -> bool:
        ok = self.older_pair.get((a, b))
        if ok is None:
            ok = self._merge(a + b) == [a, b]
        if len(self.pair) >= REMEMBERED // 2:
            self.older_pair = self.pair
            self.pair = {}
        self.pair[a, b] = ok
        return ok

    def _chunk(self, text: str) -> list[int]:
        """The ids of a chunk whose characters all are pieces."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                if not start:
                    last[end] = piece
                elif (before := last[start]) is not None:
                    ok = self.pair.get((before, piece))
                    if ok or ok is None and self._fits(before, piece):
                        last[end] = piece
        out, at = [], n
        while at:
            piece = last[at]
            out.append(self.id[piece])
            at -= len(piece)
        return out[::-1]

    def _any(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk):
            return self._chunk(chunk)
        out, held = [], []
        for c in chunk:
            if c in self.chars:
                held.append(c)
                continue
            if held:
                out += self._chunk("".join(held))
                held = []
            out += [self.byte_id[b] for b in c.encode("utf-8")]
        return out + (self._chunk("".join(held)) if held else [])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        chunks = self.chunks(" " + text.replace(SPACE, " "))  # spaces take less memory than what they stand for
        found = list(map(self.known.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._learned(chunks[i])
        return np.frombuffer(b"".join(found), "<i4").tolist()

    def _learned(self, chunk: str) -> bytes:
        """The ids of a chunk as little-endian int32, which take less memory than a list."""
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.older.get(chunk)
            if ids is None:
                ids = np.array(self._any(chunk.replace(" ", SPACE)), "<i4").tobytes()
            if len(chunk) <= 32:
                if len(self.known) >= self.half:
                    self.older, self.known = self.known, {}
                self.known[chunk] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the dummy space; each undecodable byte gives U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.raw[i]), 0)  # control ids are silent
        if raw[:1] == b" " and self.pieces[first][0] == SPACE:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + width].decode("utf-8"))
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


def codec(path: str, remember: int = CHUNKS) -> PieceCodec:
    """One codec per process and model, kept while its tasks follow each other."""
    return remembered(PieceCodec, path, remember)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(source):
        to_ids = codec(model).encode
        for key, text in source:
            yield key, to_ids(text or "")

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>", rows, flush=200, keeps=True)


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", remember: int = CHUNKS) -> DataFrame:
    """id_col, ids and the text decoded from the ids, in one pass. remember: chunks that a worker remembers, which changes no result."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(source):
        c = codec(model, remember)
        for key, text in source:
            ids = c.encode(text or "")
            yield key, ids, c.decode(ids)

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, ids array<int>, decoded string", rows, flush=200, keeps=True)
