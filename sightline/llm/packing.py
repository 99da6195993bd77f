"""Packing of documents into sequences of fixed room by dynamic programming that keeps their order.

A task strings together the tokens of the documents it reads, in their order, and cuts that string into windows of at
most `room` tokens. Cuts may lie at the end of a document (free), at the end of a sentence (`SENTENCE` tokens of
penalty) and, in stretches without a sentence's end and near the end of a string, within a sentence (`TORN`). The least
sum of padding and penalties up to a cut i is

    f(i) = penalty(i) + min( min over i - room <= j < i of f(j) + j, kept in a monotone queue, + room - i ;
                             f(i - 2^k): a window of a power of two is not padded )

A string ends with the document that takes it to `STRING` tokens, so a task holds one string whatever its share of the
input; nothing is shuffled, broadcast or collected. The default keeps the order in which the table is stored, and each
file split is packed on its own; order_by gives the documents an order of their own at the cost of one shuffle.

Defined results: a null text counts as empty; a document always ends with its closing id, so an empty one has one
token; repeated rows and rows without an id are documents of their own; texts of any length are encoded whole and lie in
as many pieces as they need; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_rows, remembered

#: Tokens after which a string ends with its document; bounds memory and the work of a retry, not the result's size.
STRING = 1 << 19
#: What a cut costs, in tokens of padding: at the end of a sentence, and elsewhere in a document.
SENTENCE, TORN = 4, 48
#: In stretches without a sentence's end, one place to cut in so many tokens.
STEP = 64
#: Words that a worker remembers with their ids; the memory is emptied when full, which changes no result.
REMEMBERED, LONGEST = 1 << 20, 48
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20

#: The bit of an id that marks a sentence's end; above any id.
STOP = 1 << 31
_MARKS = b".,;:!?"
_SPACE = frozenset(b" \t\n\v\f\r")
_STOPS = tuple(s.encode() for s in (".", "!", "?", "。", "！", "？", '."', '!"', '?"', ".)", "!)", "?)", ".”", "!”", "?”"))


_PACK = [struct.Struct(f"<{n}I").pack for n in range(LONGEST + 1)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) <= LONGEST else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Token ids of whole texts as little-endian uint32, word by word.

    Words are runs without ASCII white space. The vocabularies this serves drop white space and never join across it (see
    `separable`), so the ids of a text are those of its words side by side, and each distinct word is encoded once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}
        if not self.separable():
            raise ValueError("this tokenizer's ids depend on white space: its words can't be encoded one by one")

    def separable(self) -> bool:
        """Whether white space neither has tokens nor changes those of the words around it, case is dropped, and marks after a letter or digit stand alone; on probes of each kind of word."""
        words = ["Ab", "cd", "'s", "12", "x.", "É", "日本", "<|endoftext|>", "!!", "ﬁ", "é"]
        alone = [self._ids(w) for w in words]
        marked = all(self._ids(w + m) == self._ids(w.lower()) + self._ids(m) for w in ("Ab", "X1", "don't", "éA") for m in (".", "?!", ",", ".;:"))
        return marked and all(self._ids(gap.join(words)) == [i for w in alone for i in w] for gap in (" ", "\n", " \t\r\n"))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words, from those of their cores; the last id of a word that ends a sentence carries STOP."""
        split = {w: self._core(w) for w in words}
        new = {part for pair in split.values() for part in pair if part not in self.cores}
        if new:
            if len(self.cores) + len(new) > REMEMBERED:
                self.cores.clear()
                new = {b"", *(part for pair in split.values() for part in pair)}
            order = list(new)
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in order], add_special_tokens=False)
            self.cores.update((w, _packed(e.ids)) for w, e in zip(order, found, strict=True))
        cores, fresh = self.cores, {}
        for w, (core, tail) in split.items():
            ids = cores[core] + cores[tail] if tail else cores[core]
            fresh[w] = ids[:-1] + bytes([ids[-1] | 0x80]) if ids and w.endswith(_STOPS) else ids
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        for part in {p for w in fresh if len(w) > LONGEST for p in split[w] if len(p) > LONGEST}:
            del cores[part]
        self.known.update(fresh if max(map(len, fresh)) <= LONGEST else {w: ids for w, ids in fresh.items() if len(w) <= LONGEST})
        return fresh

    def _core(self, word: bytes) -> tuple[bytes, bytes]:
        """A word in lower case without the marks at its end, and those: its ids are theirs side by side (see separable)."""
        if b"<|" in word:  # may be a special token, which only stands in one case
            return word, b""
        low = word.lower()
        core = low.rstrip(_MARKS)
        return (core, low[len(core) :]) if core[-1:].isalnum() else (low, b"")

    def encode(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The ids of a UTF-8 text, and after how many of them sentences end."""
        parts: list[bytes] = []
        for part in _slices(raw):
            words = part.split()
            got = list(map(self.known.get, words))
            if None in got:
                new = [i for i, ids in enumerate(got) if ids is None]
                fresh = self._learn({words[i] for i in new})
                for i in new:
                    got[i] = fresh[words[i]]
            parts.append(b"".join(got))
        ids = np.frombuffer(b"".join(parts), "<u4")
        return (ids & np.uint32(STOP - 1)).tobytes(), np.flatnonzero(ids & np.uint32(STOP)) + 1


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes that end at white space."""
    at = 0
    while len(raw) - at > SLICE:
        end = at + SLICE
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def encoder(path: str) -> WordEncoder:
    """One encoder per process and vocabulary, kept while its tasks follow each other."""
    return remembered(WordEncoder, path)


def places(lengths: list[int], ends: list[np.ndarray], room: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a string of documents may be cut, ascending and at most room apart, and the penalty of each cut."""
    total = sum(lengths)
    first = np.cumsum([0, *lengths])
    marks = [(first[:-1].repeat([len(e) for e in ends]) + np.concatenate(ends), SENTENCE), (first, 0)]
    soft = np.unique(np.concatenate([m for m, _ in marks]))
    gaps = np.diff(soft)
    step = min(STEP, room)
    wide = np.flatnonzero(gaps > 2 * step)
    torn = [np.arange(soft[i] + step, soft[i + 1], step) for i in wide] + [np.arange(max(0, total - room), total, step), np.arange(max(0, total - room // 8), total)]
    at = np.unique(np.concatenate([soft, *torn]))
    penalty = np.full(len(at), TORN, np.int64)
    for where, cost in marks:
        penalty[np.searchsorted(at, where)] = cost
    return at, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, room: int) -> list[int]:
    """The cuts of least padding plus penalties, both ends of the string among them. at: ascending from 0, at most room apart."""
    n, where, cost = len(at), at.tolist(), penalty.tolist()
    exact: dict[int, list[int]] = {}
    for k in range(room.bit_length()):
        j = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero(at[j] == at - (1 << k))
        for i, e in zip(hit.tolist(), j[hit].tolist(), strict=True):
            exact.setdefault(i, []).append(e)
    best, back, lift = [0] * n, [0] * n, [0] * n  # lift: best + where
    queue: deque[int] = deque()  # its lifts ascend
    for i in range(1, n):
        here, value = where[i], lift[i - 1]
        while queue and lift[queue[-1]] >= value:
            queue.pop()
        queue.append(i - 1)
        while here - where[queue[0]] > room:
            queue.popleft()
        j = queue[0]
        least = lift[j] + room - here
        if i in exact:
            for e in exact[i]:
                if best[e] < least:
                    least, j = best[e], e
        best[i], back[i], lift[i] = least + cost[i], j, least + cost[i] + here
    out, i = [where[-1]], n - 1
    while i:
        i = back[i]
        out.append(where[i])
    return out[::-1]


class _String:
    """Documents that are packed together."""

    def __init__(self, room: int):
        self.room, self.keys, self.ids, self.ends, self.tokens = room, [], [], [], 0

    def add(self, key, ids: bytes, ends: np.ndarray) -> None:
        self.keys.append(key)
        self.ids.append(ids)
        self.ends.append(ends)
        self.tokens += len(ids) // 4

    def pieces(self, sequence: int) -> Iterator[tuple]:
        """(key, start, length, crc, tokens of the document, sequence, offset) of every piece; sequences count up from the given one."""
        lengths = [len(i) // 4 for i in self.ids]
        if not lengths:
            return
        edges = cuts(*places(lengths, self.ends, self.room), self.room)
        window, base = 0, 0
        for key, ids, n in zip(self.keys, self.ids, lengths, strict=True):
            start = 0
            while start < n:
                if base + start == edges[window + 1]:
                    window += 1
                stop = min(n, edges[window + 1] - base)
                yield key, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n, sequence + window, base + start - edges[window]
                start = stop
            base += n


def pack(df: DataFrame, vocabulary: str, room: int = 4096, closing: int = 2, id_col: str = "doc_id", text_col: str = "text", order_by: list[str] | None = None) -> DataFrame:
    """Every piece: id_col, start and length in its document's ids, their crc32, the document's tokens, and the sequence and offset where it lies. A sequence's id is its task's number and its number there."""
    kind = df.schema[id_col].dataType.simpleString()
    mark = np.asarray([closing], "<u4").tobytes()
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)

    def rows(source):
        encode = encoder(vocabulary).encode
        sequence = TaskContext.get().partitionId() << 32
        string = _String(room)
        for key, text in source:
            ids, ends = encode((text or "").encode("utf-8"))
            string.add(key, ids + mark, ends)
            if string.tokens >= STRING:
                for piece in string.pieces(sequence):
                    yield piece
                sequence, string = piece[5] + 1, _String(room)
        yield from string.pieces(sequence)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return map_rows(df, [id_col, text_col], schema, rows, keeps=True)
