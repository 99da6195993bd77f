"""Language-model scores by online logistic context mixing.

Symbols. A text is its lower-cased words, then one end mark. A word that occurs twice or more in the training texts and is
among the LEAVES most frequent ones is a leaf of a Huffman tree over their counts; so is the end mark. Every other word
is the leaf of an escape, whose count is theirs, and then its UTF-8 bytes and a closing mark in a second tree. A text is
thus a sequence of bits, and the product of their probabilities is a proper probability of any text.

Predictors of a bit (INPUTS): the share of ones at its node; three tables of hashed contexts with the node; and two
guesses of the word. The contexts of a word's own bits are the last of the FUNCTION most frequent words before it, the
last TAIL bytes of the word before, and the word before (words without a leaf are alike there); those of spelled bits are the two symbols before with that
frequent word, the three symbols before, and all before in the word. The guesses are the words that followed the same
two words, and the same one word, the last time in this text; they count for a bit as long as their paths agree.

Mixing. The predictions are stretched and mixed by weights that a gate selects: how deep the bit lies, how sure the guesses
are, how often the word before was met. Training texts are dealt into shards by a hash, each of about SHARD tokens and in the
order of that hash, so neither cores nor files change the model. A shard is learned from online: each step is predicted
from what came before, then the weights are moved, then the bits are counted. Counts of the shards are summed, weights
averaged by their bits. In a text that is scored the weights are refined further, block by block, each block
scored before it is learned from. Counts of words, N and V are exact over the whole corpus, in shuffles. The hashed tables
grow with the training tokens up to 2^max_bits slots; beyond, contexts share slots, and every token still counts.

Defined results: a null or empty text is the end mark alone; repeated rows get equal scores; null ids are kept; an empty
training set gives even predictions and N = V = 0; texts and words are of any length, words of more than LONGEST bytes
are always spelled; extra columns are ignored, and none of their names clashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, groupby, repeat
from os.path import commonprefix

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, lower_words, map_rows, written

#: Words with a leaf of their own, at most, and their bytes at most: so many are collected and sent to tasks (16 MB at most).
LEAVES, LONGEST = 1 << 18, 64
FUNCTION, TAIL = 256, 3
TABLES, GUESSES, LEVELS, STAGES = 3, 2, 3, 8
INPUTS = 1 + TABLES + GUESSES
#: Weight sets: depth of the bit x levels of the two guesses x level of the word before.
SETS = 4 * LEVELS**3
#: Slots of a table: 2 to the power of MIN_BITS to MAX_BITS, by the training tokens. Counts are sent in STRIP each.
MIN_BITS, MAX_BITS, STRIP = 16, 22, 1 << 16
#: Counts in tasks are 16-bit logarithms, STEPS to a doubling: exact where small, else within 0.02 %.
STEPS = 2048
#: Tokens of the texts that are laid out together and of a step of learning; texts that advance together.
BATCH_TOKENS, STEP_TOKENS, LANES = 1 << 16, 2048, 64
#: Tokens of a shard, which is learned from in one go.
SHARD = 1 << 22
#: A text is scored in blocks: the first of so many tokens, each next one twice as long, up to the second.
BLOCKS = 64, 1024
#: Distinct words that a task counts before it hands them over.
COUNTED = 1 << 18
#: Bits after which a task hands its counts over, so that no 32-bit count can overflow.
FLUSH_BITS = 1 << 31
RATE, FIRST_RATE = 0.02, 0.05
#: Nodes of GROUP levels of a tree lie side by side in a table, so a word's bits mostly meet in one cache line.
GROUP = 3
END, CLOSE = b"\n", b" "
_MIX, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_SALTS = [np.uint64((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1) for k in range(TABLES)]
_COUNTS = 2.0 ** (np.arange(1 << 16) / STEPS) - 1
_LOGS = np.log(_COUNTS + 0.4).astype(np.float32)


def coded(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(n + 1.0) * STEPS), (1 << 16) - 1).astype(np.uint16)


@dataclass
class Tree:
    """A Huffman tree over counts. By node, leaves first: its parent (the root's is -1) and the bit that leads to it; by inner node the log odds of a one."""

    up: np.ndarray
    one: np.ndarray
    odds: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        n = len(counts)
        weight = counts.tolist() + [0] * (n - 1)
        up, one = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, np.int8)
        leaves, odds = np.argsort(counts, kind="stable").tolist(), np.zeros(n - 1, np.float32)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if leaf < n and (inner >= new or weight[leaves[leaf]] <= weight[inner]):
                    pair.append(leaves[leaf])
                    leaf += 1
                else:
                    pair.append(inner)
                    inner += 1
            a, b = pair
            up[a] = up[b] = new
            one[b] = 1
            weight[new] = weight[a] + weight[b]
            odds[new - n] = np.log((weight[b] + 0.4) / (weight[a] + 0.4))
        return Tree(up, one, odds)

    def paths(self) -> tuple[np.ndarray, ...]:
        """Of each leaf where its path starts and its length; of all paths the inner nodes, from 0, the bits, the first node of each node's group and its place there."""
        n = len(self.odds) + 1
        at, length = np.arange(n), np.zeros(n, np.int64)
        while (inner := self.up[at] >= 0).any():
            length += inner
            at = np.where(inner, self.up[at], at)
        start = np.cumsum(length) - length
        nodes, bits = np.empty(int(length.sum()), np.int32), np.empty(int(length.sum()), np.int8)
        at, left = np.arange(n), length.copy()
        while len(live := np.flatnonzero(left)):
            left[live] -= 1
            place = start[live] + left[live]
            bits[place] = self.one[at[live]]
            at[live] = self.up[at[live]]
            nodes[place] = at[live] - n
        depth = np.arange(len(nodes)) - np.repeat(start, length)
        back = depth % GROUP
        place = np.ones(len(nodes), np.int8)
        for up in range(GROUP - 1, 0, -1):
            inside = np.flatnonzero(back >= up)
            place[inside] = 2 * place[inside] + bits[inside - up]
        return start, length, nodes, bits, nodes[np.arange(len(nodes)) - back], place


@dataclass
class Laid:
    """The distinct words of a batch as symbols: per word its leaf (or -1), its bits, where its symbols start and how many, and two hashes; per symbol its number, its contexts by table, and whether it is a word's own."""

    words: list[bytes]
    leaf: np.ndarray
    size: np.ndarray
    first: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    tails: np.ndarray
    symbols: np.ndarray
    inside: list[np.ndarray]
    own: np.ndarray


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its count, which is 1 or more, one after the other."""
    ends = np.cumsum(counts)
    steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    steps[:1] = starts[:1]
    steps[ends[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(steps, out=steps)


class Coder:
    """Words to bits. leaves: the words with a leaf of their own, most frequent first, with counts; other: the count of the rest."""

    def __init__(self, leaves: list[bytes], counts: list[int], other: int):
        self.leaves, self.counts = leaves, np.array(counts, np.int64)
        letters = np.ones(256, np.int64)
        for at in range(0, len(leaves), 4096):
            letters += np.bincount(np.frombuffer(CLOSE.join(leaves[at : at + 4096]), np.uint8), minlength=256)
        self.trees = Tree.of(np.append(self.counts, other + 1)), Tree.of(letters)
        self._lay_trees()

    def _paths(self) -> tuple[np.ndarray, ...]:
        """Tree.paths() of both trees, the second's behind the first's."""
        one, two = (t.paths() for t in self.trees)
        inner = len(self.trees[0].odds)
        add = len(one[2]), 0, inner, 0, inner, 0
        return tuple(np.concatenate([a, b + n if n else b]) for a, b, n in zip(one, two, add, strict=True))

    def _lay_trees(self):
        self.number = {w: i for i, w in enumerate(self.leaves)}
        self.escape = len(self.leaves)
        self.start, self.length, nodes, bits, group, place = self._paths()
        self.odds = np.concatenate([t.odds for t in self.trees])
        # by bit of the paths: its node's log odds; and its value, its place in its group and its part of the gate in one byte
        self.bit_odds = self.odds[nodes]
        depth = np.arange(len(bits)) - np.repeat(self.start, self.length)
        gate = np.where(np.arange(len(bits)) < self.start[self.escape + 1], (depth > 2).astype(np.int8) + (depth > 7), 3)
        self.told = (bits | place << 1 | gate << GROUP + 1).astype(np.uint8)
        # by group of slots on the paths: what tells it in hashes
        self.groups = -(-self.length // GROUP)
        self.group_start = np.cumsum(self.groups) - self.groups
        self.group_hash = (group[place == 1].astype(np.uint64) + np.uint64(1)) * _MIX2
        # by symbol: the first 64 bits of its path; a longer one takes more than 10^13 tokens
        self.code = np.zeros(len(self.length), np.uint64)
        near = depth < 64
        np.bitwise_or.at(self.code, np.repeat(np.arange(len(self.length)), self.length)[near], bits[near].astype(np.uint64) << (63 - depth[near]).astype(np.uint64))
        self.hashes, self.tails = (np.fromiter(map(h, self.leaves), np.uint64, len(self.leaves)) for h in (word_hash, tail_hash))

    # by bit of the paths, each when first asked for
    nodes, bits, group, place = (cached_property(lambda self, i=i: self._paths()[i]) for i in (2, 3, 4, 5))

    def __getstate__(self):
        return self.leaves, self.counts, self.trees

    def __setstate__(self, state):
        self.leaves, self.counts, self.trees = state
        self._lay_trees()

    def lay(self, words: list[bytes]) -> Laid:
        leaf = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        raw = [words[i] + CLOSE for i in np.flatnonzero(leaf < 0).tolist()]
        count = np.ones(len(words), np.int64)
        count[leaf < 0] += np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(count) - count
        symbols = np.zeros(int(count.sum()), np.int64)
        spelled = np.ones(len(symbols), bool)
        spelled[first] = False
        symbols[first] = np.where(leaf >= 0, leaf, self.escape)
        symbols[spelled] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + self.escape + 1
        place = np.arange(len(symbols)) - np.repeat(first, count)
        value = np.where(spelled, symbols - self.escape, 0).astype(np.uint64) * _MIX
        power = np.cumprod(np.full(int(count.max(initial=1)), _MIX2))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[place])])
        before = [np.where(place > back, np.concatenate([np.zeros(min(back, len(value)), np.uint64), value[:-back]]), np.uint64(0)) for back in (1, 2, 3)]
        near = before[0] * _MIX2 + before[1] * _MIX3
        contexts = near, near + before[2] * _SALTS[0], run[:-1] - run[np.repeat(first, count)] + place.astype(np.uint64) * _MIX3
        inside = [np.where(spelled, h, np.uint64(0)) + salt for h, salt in zip(contexts, _SALTS, strict=True)]
        size = np.add.reduceat(self.length[symbols], first) if len(first) else count
        hashes, tails = self.hashes.take(leaf, mode="clip"), self.tails.take(leaf, mode="clip")
        hashes[leaf < 0], tails[leaf < 0] = 1, np.fromiter((tail_hash(w[:-1]) for w in raw), np.uint64, len(raw))  # rare words before a word are alike
        return Laid(words, leaf, size, first, count, hashes, tails, symbols, inside, ~spelled)

    def agreed(self, laid: Laid, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits two different words, given by number, have in common before they part."""
        one, two = laid.leaf.take(a), laid.leaf.take(b)
        differ = self.code.take(np.where(one < 0, self.escape, one)) ^ self.code.take(np.where(two < 0, self.escape, two))
        differ &= ~(differ >> np.uint64(1))  # keeps the highest bit, and none that rounding could carry
        out = 64 - np.frexp(differ.astype(np.float64))[1].astype(np.int64)
        for i in np.flatnonzero((one < 0) & (two < 0)).tolist():
            x, y = laid.words[a[i]] + CLOSE, laid.words[b[i]] + CLOSE
            same = len(commonprefix([x, y]))
            letters = np.frombuffer(x[: same + 1], np.uint8).astype(np.int64) + self.escape + 1
            differ = int(self.code[letters[-1]]) ^ int(self.code[y[same] + self.escape + 1])
            out[i] = self.length[self.escape] + self.length[letters[:-1]].sum() + 64 - differ.bit_length()
        return out


def word_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 42)


def tail_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw[-TAIL:], 7)


@dataclass
class Tokens:
    """The tokens of a batch of texts: word numbers; contexts by table; by guess whether it is right, its level, and for how many bits it counts."""

    ids: np.ndarray
    before: np.ndarray
    right: np.ndarray
    level: np.ndarray
    told: np.ndarray

    @staticmethod
    def of(coder: Coder, laid: Laid, texts: list[np.ndarray]) -> Tokens:
        ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
        n, first = len(ids), np.repeat(np.cumsum(lengths) - lengths, lengths)
        at, none = np.arange(n), len(laid.size)
        starts = at == first
        before = np.zeros((TABLES, n), np.uint64)
        leaf = laid.leaf[ids]
        last = np.maximum.accumulate(np.where((leaf >= 0) & (leaf < FUNCTION), at, -1))
        last = np.concatenate([[-1], last[:-1]])
        before[0] = np.where(last >= first, leaf[last] + 1, 0).astype(np.uint64) * _MIX
        one = np.where(starts, none, np.concatenate([[none], ids[:-1]]))
        two = np.where(at - first < 2, none, np.concatenate([[none, none], ids[:-2]])[:n])
        before[1], before[2] = (np.append(x, np.uint64(0))[one] for x in (laid.tails, laid.hashes))
        text = np.repeat(np.arange(len(texts)), lengths)
        key = text * (none + 1) + one
        right, level, told = np.empty((GUESSES, n), bool), np.empty((GUESSES, n), np.int64), np.zeros((GUESSES, n), np.int64)
        for q, k in enumerate((key * (none + 1) + two, key)):
            order = np.argsort(k, kind="stable")
            same = k[order[1:]] == k[order[:-1]]
            past = np.full(n, -1)
            past[order[1:]] = np.where(same, order[:-1], -1)
            guess = np.where(past >= 0, ids[past], -1)
            right[q] = guess == ids
            level[q] = (past >= 0).astype(np.int64) + ((past >= 0) & right[q][past])
            told[q][right[q]] = laid.size.take(ids[right[q]])
            wrong = np.flatnonzero((past >= 0) & ~right[q])
            told[q][wrong] = coder.agreed(laid, ids[wrong], guess[wrong]) + 1
        return Tokens(ids, before, right, level, told)


@dataclass
class Inputs:
    """Of the bits of some tokens: how many each token has; the inputs of the mixer, those of guesses with the places of the bits they count for; weight sets, bits, slots by table, and the guesses' cells with whether they are right."""

    size: np.ndarray
    dense: list[np.ndarray]
    sparse: list[tuple[np.ndarray, np.ndarray]]
    cell: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    record: list[tuple[np.ndarray, np.ndarray]]


class Predictor:
    """The inputs of the mixer and its weight sets, from the guesses' record and read(table, slots), which gives log odds and, of the last table, levels (else None)."""

    def __init__(self, coder: Coder, bits: int, read, agree: np.ndarray):
        self.coder, self.read = coder, read
        self.shift = np.uint64(64 - bits + GROUP)
        self.agree = agree  # right and wrong by guess, level and stage
        self.sure = self._sure()

    def _sure(self) -> np.ndarray:
        return np.log((self.agree[..., 0] + 0.5) / (self.agree[..., 1] + 0.5)).astype(np.float32)

    def inputs(self, laid: Laid, tokens: Tokens, which: np.ndarray) -> Inputs:
        coder, ids = self.coder, tokens.ids.take(which)
        count, size = laid.count.take(ids), laid.size.take(ids)
        at = spans(laid.first.take(ids), count)
        token, symbol, own = np.repeat(np.arange(len(ids)), count), laid.symbols.take(at), laid.own.take(at)
        groups = coder.groups.take(symbol)
        there, hashes = np.repeat(np.arange(len(symbol)), groups), coder.group_hash.take(spans(coder.group_start.take(symbol), groups), mode="clip")
        path = spans(coder.start.take(symbol), coder.length.take(symbol))
        told = coder.told.take(path, mode="clip")
        bit, cell, side = told & 1, (told >> (GROUP + 1)) * np.uint8(LEVELS**3), told >> 1 & (1 << GROUP) - 1
        group = np.cumsum((side == 1).astype(np.int64))
        group -= 1
        dense, slots = [coder.bit_odds.take(path, mode="clip")], []
        for k in range(TABLES):
            met = tokens.before[k].take(which).take(token)
            if k:
                met *= own
            met += laid.inside[k].take(at)
            x = met.take(there, mode="clip")
            x += hashes
            x *= _MIX
            x ^= x >> np.uint64(29)
            x *= _MIX3
            x >>= self.shift
            x <<= np.uint64(GROUP)
            slot = x.view(np.int64).take(group, mode="clip")
            slot += side
            odds, level = self.read(k, slot)
            dense.append(odds)
            slots.append(slot)
        cell += level
        sparse, record, first = [], [], np.cumsum(size) - size
        for q in range(GUESSES):
            told = tokens.told[q].take(which)
            some = np.flatnonzero(told)
            told, mine = told.take(some), which.take(some)
            bits, place = spans(first.take(some), told), spans(np.zeros(len(some), np.int64), told)
            level = np.repeat(tokens.level[q].take(mine), told)
            right = np.ones(len(bits), bool)
            right[(np.cumsum(told) - 1)[~tokens.right[q].take(mine)]] = False
            known = level * STAGES + np.minimum(place, STAGES - 1)
            sure = self.sure[q].ravel().take(known)
            sure *= (bit.take(bits, mode="clip") == right) * np.float32(2) - np.float32(1)
            sparse.append((bits, sure))
            cell[bits] += (level * LEVELS ** (GUESSES - q)).astype(np.uint8)
            record.append((known, right))
        return Inputs(size, dense, sparse, cell.astype(np.int64), bit, slots, record)

    def learn(self, record) -> None:
        """Counts where the guesses were right."""
        for q, (cell, right) in enumerate(record):
            both = np.bincount(cell * 2 + ~right, minlength=LEVELS * STAGES * 2)
            self.agree[q] += both.reshape(LEVELS, STAGES, 2)
        self.sure = self._sure()


def _mixed(x: Inputs, w: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 / P of each bit as it is, and bit - P(one)."""
    z = x.dense[0] * w[0].take(cell, mode="clip")
    for k in range(1, 1 + TABLES):
        part = w[k].take(cell, mode="clip")
        part *= x.dense[k]
        z += part
    for (bits, odds), own in zip(x.sparse, w[1 + TABLES :], strict=True):
        z[bits] += odds * own.take(cell.take(bits, mode="clip"), mode="clip")
    sign = x.bit * np.float32(2) - np.float32(1)
    z *= sign
    np.clip(z, -30, 30, out=z)
    np.negative(z, out=z)
    e = np.exp(z, out=z)
    inverse = e + np.float32(1)
    e /= inverse
    e *= sign
    return inverse, e


def _slopes(x: Inputs, cell: np.ndarray, err: np.ndarray, n: int):
    """By input the sums of its products with err over the bits of each of n weight sets."""
    for s in x.dense:
        yield np.bincount(cell, err * s, n)
    for bits, s in x.sparse:
        yield np.bincount(cell.take(bits, mode="clip"), err.take(bits, mode="clip") * s, n)


def start_weights() -> np.ndarray:
    return np.repeat(np.array([[0.3]] + [[0.3]] * TABLES + [[0.2]] * GUESSES, np.float32), SETS, axis=1)


class Packed:
    """The coded count tables as compressed strips, unpacked in the tasks: the driver never holds them whole."""

    def __init__(self, bits: int, strips: dict[int, bytes]):
        self.bits, self.strips = bits, strips

    def __getstate__(self):
        return self.bits, self.strips

    def __setstate__(self, state):
        self.bits, strips = state
        flat = np.zeros((TABLES * (2 << self.bits) // STRIP, STRIP), np.uint16)
        for i in list(strips):
            flat[i] = np.frombuffer(zlib.decompress(strips.pop(i)), np.uint16)
        self.counts = flat.reshape(TABLES, 1 << self.bits, 2)

    def odds(self) -> np.ndarray:
        """table_odds() of the counts, in their place: a worker holds no second table."""
        if self.counts.dtype == np.uint16:
            self.counts = table_odds(self.counts, self.counts.view(np.float32)[..., 0])
        return self.counts


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and c of every token of the texts; the end mark is "\\n". Tasks count up to COUNTED words at a time, a shuffle adds them up."""

    def counted(rows):
        c = Counter()
        for (text,) in rows:
            c.update(lower_words(text.encode("utf-8", "surrogatepass")))
            c[END] += 1
            if len(c) > COUNTED:
                yield from c.items()
                c.clear()
        yield from c.items()

    words = map_rows(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), ["text"], "word binary, c bigint", counted, flush=1 << 14)
    return words.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def _batches(source):
    """The rows of some texts, each with its size in bytes and its words as numbers, BATCH_TOKENS or more at a time; and the distinct words."""
    held, texts, tokens = [], [], 0

    def numbered():
        number = dict.fromkeys(chain.from_iterable(texts))
        words = list(number)
        number = dict(zip(words, range(len(words)), strict=True))
        return [(*row, np.fromiter(map(number.__getitem__, text), np.int64, len(text))) for row, text in zip(held, texts, strict=True)], words

    for *row, text in source:
        raw = text.encode("utf-8", "surrogatepass")
        words = lower_words(raw)
        words.append(END)
        held.append((row, len(raw)))
        texts.append(words)
        tokens += len(words)
        if tokens >= BATCH_TOKENS:
            yield numbered()
            held, texts, tokens = [], [], 0
    if held:
        yield numbered()


def table_bits(tokens: int, max_bits: int = MAX_BITS) -> int:
    return min(max(MIN_BITS, int(tokens * 4).bit_length()), max_bits)


def _strips(counts: np.ndarray):
    flat = counts.reshape(-1, STRIP)
    for i in np.flatnonzero(flat.any(axis=1)).tolist():
        yield i, zlib.compress(flat[i].data, 1), 0.0, None, None


def table_odds(counts: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The log odds of slots of coded counts; in the last table the two lowest bits of each tell whether a count is above 0.5 and above 3.5. Both arrays can share memory."""
    few, some = coded(np.array([0.5, 3.5]))
    for k in range(TABLES):
        for low in range(0, counts.shape[1], STRIP):
            zeros, ones = counts[k, low : low + STRIP, 0], counts[k, low : low + STRIP, 1]
            odds = _LOGS.take(ones) - _LOGS.take(zeros)
            if k == TABLES - 1:
                most = np.maximum(zeros, ones)
                odds[(odds == 0) & (most > 0)] = 1e-9  # no denormal number
                raw = odds.view(np.uint32)
                raw &= np.uint32(0xFFFFFFFC)
                raw |= (most > few).astype(np.uint32) + (most > some)
            out[k, low : low + STRIP] = odds
    return out


def learn_online(coder: Coder, bits: int, source):
    """Rows part, v (counts of a strip), seen, w, agree; the last one, of part -1, holds the bits seen, the weights and the guesses' record."""
    counts = np.zeros((TABLES, 1 << bits, 2), np.uint32)
    pairs, single = counts.view(np.uint64)[..., 0], counts.reshape(TABLES, -1)

    def read(k, slot):
        pair = pairs[k].take(slot, mode="clip").view(np.int32).astype(np.float32)
        level = None
        if k == TABLES - 1:
            most = np.maximum(pair[::2], pair[1::2])
            level = (most > 0).astype(np.uint8) + (most > 3)
        pair += np.float32(0.4)
        odds = pair[1::2] / pair[::2]
        return np.log(odds, out=odds), level

    model = Predictor(coder, bits, read, np.zeros((GUESSES, LEVELS, STAGES, 2), np.int64))
    w, moved, seen, held = start_weights(), np.full((INPUTS, SETS), 1e-3), 0, 0
    for texts, words in _batches(source):
        laid = coder.lay(words)
        tokens = Tokens.of(coder, laid, [ids for *_, ids in texts])
        for low in range(0, len(tokens.ids), STEP_TOKENS):
            x = model.inputs(laid, tokens, np.arange(low, min(low + STEP_TOKENS, len(tokens.ids))))
            _, err = _mixed(x, w, x.cell)
            for k, g in enumerate(_slopes(x, x.cell, err, SETS)):
                moved[k] += g * g
                w[k] += FIRST_RATE * g / np.sqrt(moved[k])
            for flat, slot in zip(single, x.slots, strict=True):
                slot <<= 1
                slot += x.bit
                np.add.at(flat, slot, np.uint32(1))
            model.learn(x.record)
            held += len(x.bit)
        if held >= FLUSH_BITS:
            yield from _strips(counts)
            counts[:] = 0
            seen, held = seen + held, 0
    yield from _strips(counts)
    yield -1, None, float(seen + held), w.ravel().astype(float).tolist(), model.agree.ravel().tolist()


def shards(texts: DataFrame, n: int) -> DataFrame:
    """shard and text: texts(text) of n tokens dealt by a hash into shards of about SHARD tokens, in the order of that hash: the same shards however the table is stored, whatever the cluster and its number of partitions. Each has a task of its own, if Spark makes as many as asked for."""
    number = max(1, -(-n // SHARD))
    numbers = texts.sparkSession.range(1000 + 50 * number).groupBy(F.pmod(F.hash("id"), F.lit(number)).alias("task")).agg(F.min("id").alias("id"))
    key = {r["task"]: r["id"] for r in numbers.collect()}  # a number that goes to each task
    keys = F.array(*(F.lit(key.get(i, i)).cast("long") for i in range(number)))
    dealt = texts.select("text", F.xxhash64("text").alias("h")).withColumn("shard", F.pmod(F.hash("h"), F.lit(number)))
    return dealt.withColumn("key", F.element_at(keys, F.col("shard") + 1)).repartition(number, "key").sortWithinPartitions("shard", "h", "text").select("shard", "text")


def _learn(texts: DataFrame, n: int, coder, bits: int) -> tuple[Packed, np.ndarray, np.ndarray]:
    """The count tables, the weights and the guesses' record of texts(text) of n tokens. Each shard is learned from on its own."""

    def add(pdf):
        import pandas as pd

        total = np.zeros(STRIP, np.int64)
        for v in pdf["v"]:
            total += np.frombuffer(zlib.decompress(v), np.uint32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "v": [zlib.compress(coded(total).data, 1)]})

    def learned(rows):
        for _, shard in groupby(rows, lambda r: r[0]):
            yield from learn_online(coder.value, bits, ((text,) for _, text in shard))

    parts = map_rows(shards(texts, n), ["shard", "text"], "part int, v binary, seen double, w array<double>, agree array<bigint>", learned, flush=16)
    parts = written(parts)
    summed = parts.where("part >= 0").select("part", "v").groupBy("part").applyInPandas(add, "part int, v binary")
    packed = Packed(bits, {r["part"]: bytes(r["v"]) for r in summed.toLocalIterator()})
    ends = parts.where("part < 0 AND seen > 0")
    w, agree = start_weights().ravel(), np.zeros(GUESSES * LEVELS * STAGES * 2, np.int64)
    for r in ends.select(F.posexplode("w").alias("i", "x"), "seen").groupBy("i").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x")).collect():
        w[r["i"]] = r["x"]
    for r in ends.select(F.posexplode("agree").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        agree[r["i"]] = r["x"]
    return packed, w.reshape(INPUTS, SETS), agree.reshape(GUESSES, LEVELS, STAGES, 2)


class Scorer:
    """Scores batches of texts; the texts of a batch advance together, each with its own weights."""

    def __init__(self, coder: Coder, counts: np.ndarray, weights: np.ndarray, agree: np.ndarray):
        """counts: coded counts by table and slot, or Packed.odds()."""
        self.coder, self.weights = coder, weights
        odds = counts if counts.dtype == np.float32 else table_odds(counts, np.empty(counts.shape[:2], np.float32))

        def read(k, slot):
            found = odds[k].take(slot, mode="clip")
            return found, (found.view(np.uint32) & np.uint32(3)).astype(np.uint8) if k == TABLES - 1 else None

        self.model = Predictor(coder, odds.shape[1].bit_length() - 1, read, agree)

    def scores(self, texts: list[np.ndarray], words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Per text the log probabilities of its words, given as word numbers; and of each word its leaf, or -1."""
        laid = self.coder.lay(words)
        tokens = Tokens.of(self.coder, laid, texts)
        lengths = np.array([len(t) for t in texts])
        offset = np.cumsum(lengths) - lengths
        out = np.zeros(len(tokens.ids))
        order = np.argsort(-lengths, kind="stable")
        for top in range(0, len(order), LANES):
            lanes = order[top : top + LANES]
            w = np.repeat(self.weights.astype(np.float32)[:, None, :], len(lanes), axis=1)
            low, block = 0, BLOCKS[0]
            while low < lengths[lanes[0]]:
                live = int((lengths[lanes] > low).sum())  # the longer ones come first
                size = np.minimum(lengths[lanes[:live]] - low, block)
                lane = np.repeat(np.arange(live), size)
                which = np.repeat(offset[lanes[:live]] + low - (np.cumsum(size) - size), size) + np.arange(len(lane))
                own, sets = w[:, :live].reshape(INPUTS, -1), live * SETS
                last = low + block >= lengths[lanes[0]]
                slopes, met = np.zeros((INPUTS, sets)), np.zeros(sets, np.int64)
                for some in range(0, len(which), STEP_TOKENS):
                    part = which[some : some + STEP_TOKENS]
                    x = self.model.inputs(laid, tokens, part)
                    cell = x.cell + np.repeat(lane[some : some + STEP_TOKENS] * SETS, x.size)
                    inverse, err = _mixed(x, own, cell)
                    out[part] = -np.add.reduceat(np.log(inverse, dtype=np.float64), np.cumsum(x.size) - x.size)
                    if not last:
                        met += np.bincount(cell, minlength=sets)
                        for k, g in enumerate(_slopes(x, cell, err, sets)):
                            slopes[k] += g
                low, block = low + block, min(2 * block, BLOCKS[1])
                if not last:
                    w[:, :live] += (RATE / np.sqrt(np.maximum(met, 1)) * slopes).reshape(INPUTS, live, SETS)
        return np.split(out, offset[1:]), laid.leaf


def leaves_of(vocab: DataFrame, limit: int = LEAVES) -> tuple[list[bytes], list[int]]:
    """The words that get a leaf, with counts, most frequent first: of at least two occurrences and so many that no more than limit words reach it; the end mark always."""
    usable = vocab.where((F.col("c") >= 2) & (F.octet_length("word") <= LONGEST))
    least, total = 2, 0
    for r in usable.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(limit + 1).toLocalIterator():
        total += r["n"]
        if total > limit:
            least = r["c"] + 1
            break
    found = usable.where((F.col("c") >= least) & (F.col("word") != "\n")).orderBy(F.desc("c"), "word").toPandas()  # at most limit words of LONGEST bytes
    ends = vocab.where(F.col("word") == "\n").agg(F.sum("c")).first()[0] or 0
    return [END, *(w.encode("utf-8") for w in found["word"])], [ends, *found["c"].tolist()]


def fit(vocab: DataFrame, texts: DataFrame, n: int, max_bits: int = MAX_BITS):
    """The model of texts(text) with n tokens and their vocabulary (word, c): broadcasts of the coder and of the count tables, the weights, the guesses' record."""
    context = texts.sparkSession.sparkContext
    leaves, counts = leaves_of(vocab)
    coder = context.broadcast(Coder(leaves, counts, n - sum(counts)))
    packed, weights, agree = _learn(texts, n, coder, table_bits(n, max_bits))
    return coder, context.broadcast(packed), weights, agree


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~F.coalesce(is_training, F.lit(False))).alias("held_out"))
    vocab = written(vocabulary(rows.where("NOT held_out")))
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    coder, tables, weights, agree = fit(vocab, rows.where("NOT held_out").select("text"), n, max_bits)

    def run(source):
        scorer = Scorer(coder.value, tables.value.odds(), weights, agree)
        known = np.append(coder.value.counts, 0)
        for held, words in _batches(source):
            scores, leaf = scorer.scores([ids for *_, ids in held], words)
            c = known[leaf]
            logs = np.log10(c + 1.0)
            hashes = np.fromiter((0 if i >= 0 else word_hash(w) for w, i in zip(words, leaf.tolist(), strict=True)), np.uint64, len(words)).view(np.int64)
            for ((row, key, out), n_bytes, ids), p in zip(held, scores, strict=True):
                rare, times = np.unique(ids[leaf[ids] < 0], return_counts=True)
                yield row, key, out, len(ids), int((c[ids] > 0).sum()), float(logs[ids].sum()), float(p.sum() / np.log(10)), n_bytes, hashes[rare].tolist(), times.tolist()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, `{id_col}` {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, n_bytes bigint, rare array<bigint>, times array<bigint>"
    each = written(map_rows(rows, ["row", id_col, "held_out", "text"], schema, run, flush=200))
    rare = each.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    leaf_counts = coder.value.counts
    least = int(leaf_counts[-1]) if len(leaf_counts) > 1 else 1 << 62  # a word below it, or too long, has no leaf
    counts = vocab.where((F.col("c") <= least) | (F.octet_length("word") > LONGEST)).select(F.xxhash64("word").alias("h"), "c")
    found = rare.join(counts, "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("more_logs"))
    out = each.drop("rare", "times").join(found, "row", "left")
    none = float(np.log10(n + v + 1))
    return out.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        "score",
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") / np.log10(2.0) / F.col("n_bytes")).alias("bits_per_byte"),
    )
