"""Token counts for a byte-level BPE vocabulary by the whole-token shortcut.

Offline, once per process, every vocabulary string that the pre-tokeniser can yield is merged on its own; those that
come out as one token are *proven*. While counting, a pre-token that is a proven string counts one without any merge;
only the rest is merged, and short results are remembered.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results, rows without an id
their own; texts are never cut; an empty table gives no rows; count_tokens() returns its four columns alone, whatever others
the table has and whatever they are called.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The pre-tokenising pattern of this vocabulary family, with \s spelled as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Remembered merges per Python worker; the memory is emptied when full, which changes no result.
REMEMBERED = 1 << 18


def printable_bytes() -> dict[int, str]:
    """The byte alphabet of the vocabulary file: printable bytes stand for themselves, the rest take code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class ByteBpeCounter:
    """Counts the tokens of a text for a vocabulary file (JSON: vocab, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        back = {c: b for b, c in printable_bytes().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[as_bytes(a), as_bytes(b)] = i
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = frozenset(special)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.find = regex.compile(PATTERN).findall
        self.proven = self._prove(as_bytes(s) for s in model["vocab"] if s not in self.special)
        self.known: dict[str, int] = {}

    def _prove(self, vocabulary: Iterator[bytes]) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and merge into one token."""
        out = {}
        for raw in vocabulary:
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text] and self.merged(raw) == 1:
                out[text] = 1
        return out

    def merged(self, raw: bytes) -> int:
        """How many tokens the merges leave of one pre-token."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        if len(parts) > 40:
            return self._merged_long(parts)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return len(parts)

    def _merged_long(self, parts: list[bytes]) -> int:
        """The same with a heap and links, for pre-tokens of any length in n log n."""
        n, rank = len(parts), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        left, live = n, [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], left = a + b, False, left - 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if 0 <= x and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def count(self, text: str) -> int:
        if self.split is None:
            return self._count(text)
        pieces = self.split(text) if any(s in text for s in self.special) else (text,)
        return sum(1 if p in self.special else self._count(p) for p in pieces if p)

    def _count(self, text: str) -> int:
        total, proven, known = 0, self.proven, self.known
        found = self.find(text)
        rest = [p for p in found if p not in proven]
        total = len(found) - len(rest)
        for p in rest:
            n = known.get(p)
            if n is None:
                n = self.merged(p.encode("utf-8"))
                if len(p) <= 32:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> ByteBpeCounter:
    """One counter per process and vocabulary."""
    return ByteBpeCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; text null: as if empty."""

    def rows(source):
        count = counter(vocabulary).count
        for key, text in source:
            text = text or ""
            yield key, len(text.encode("utf-8")), count(text)

    kind = df.schema[id_col].dataType.simpleString()
    out = map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint", rows)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
