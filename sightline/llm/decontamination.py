"""Benchmark decontamination by template windows.

Texts become template tokens: numbers, capitalised names and units after a number turn into typed placeholders, other
words are lower-cased. Windows of WINDOW tokens with at least LITERALS words are hashed; document windows are
hash-joined with those of the benchmark. Joined windows on one diagonal (document position minus item position) form
runs; a run leaks an item if it spans RUN tokens or the whole item, and if its slots are consistent: each benchmark value
always meets the same document value and the other way round, type by type. Verbatim copies are the identity case;
re-parameterised questions have other values. In an inconsistent run a stretch of that length with equal slots leaks too,
so a copy with one altered value is found.

Beside its template every window is also hashed as its lower-cased tokens. Such windows fill the runs where a template
can't: where numbers and names leave fewer than LITERALS words, and where a copy has other capitals.

Before the join, a bit map of fixed size (BITS) of the benchmark's window hashes, sent with the tasks, drops document
windows that can't join. Its size doesn't grow with the benchmark; where it fills up it only drops less.

Defined results: null and empty texts and items have no windows; items of fewer than WINDOW tokens can't be found;
rows of one id with different texts are matched apart and reported once per id; rows without an id are reported under a
null one; an empty benchmark or table gives no rows; texts are of any length; extra columns are ignored. clean() drops
exactly the rows whose text leaks, whatever their id, and keeps all others with all columns, whatever they are called.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbers, free_name, map_rows, sized, written

WINDOW, LITERALS, RUN, BITS = 8, 3, 13, 1 << 22
#: Units that count as such directly after a number.
UNITS = frozenset("% € $ £ ° km m cm mm mi kg g mg lb lbs oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks year years mile miles meter meters metre metres gram grams liter liters litre litres dollar dollars euro euros cent cents percent degrees".split())
_tokens = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%€$£°]").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = {j: np.uint64(pow(int(_BASE), j, 1 << 64)) for j in range(1, WINDOW + 1)}
LITERAL, NUMBER, NAME, UNIT = range(4)
_REMEMBERED = 1 << 18


def token_kind(token: str) -> int:
    if token[0].isdecimal():
        return NUMBER
    if token.lower() in UNITS:
        return UNIT
    return NAME if len(token) > 1 and token[0].isupper() and token[1:].islower() else LITERAL


class Templates:
    """Template tokens of texts, with a memory of tokens seen."""

    def __init__(self):
        self.known = Numbers()
        self.hashes, self.kinds = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int8)
        self.slot = np.array([xxhash.xxh64_intdigest(f"\0{k}") for k in range(4)], np.uint64)

    def _learn(self, tokens: list[str]) -> None:
        """Hashes and kinds of the tokens that were numbered last."""
        low, lower = len(self.known) - len(tokens), [t.lower() for t in tokens]
        if len(self.known) > len(self.hashes):
            size = max(len(self.known), 2 * len(self.hashes))
            self.hashes, self.kinds = (np.concatenate([x, np.zeros(size - len(x), x.dtype)]) for x in (self.hashes, self.kinds))
        self.hashes[low : len(self.known)] = list(map(xxhash.xxh64_intdigest, lower))
        # most are plain words: ASCII, no capital, no digit, no unit
        self.kinds[low : len(self.known)] = [LITERAL if t == s and t[0] > "9" and t not in UNITS and t.isascii() else token_kind(t) for t, s in zip(tokens, lower, strict=True)]

    def windows(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens and kinds; by first token the hashes of the windows' templates and of their lower-cased tokens, and which windows have enough words."""
        tokens = _tokens(text)
        if len(tokens) < WINDOW:
            return tokens, np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh.clear()
        values, kinds = self.hashes[at], self.kinds[at]
        kinds[(kinds == UNIT) & ~np.concatenate([[False], kinds[:-1] == NUMBER])] = LITERAL
        slots = np.where(kinds == LITERAL, values, self.slot[kinds])
        n = len(tokens) - WINDOW + 1
        words = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        return tokens, kinds, _rolled(slots, n, 0), _rolled(values, n, 1), words[WINDOW:] - words[:-WINDOW] >= LITERALS


def _rolled(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Polynomial hashes of n windows of WINDOW (a power of two) values, from those of half the width."""
    h, width = values, 1
    while width < WINDOW:
        h = h[:-width] * _POWER[width] + h[width:]
        width *= 2
    h = h[:n] + _POWER[WINDOW] * np.uint64(seed)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _let_through(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = (h >> np.uint64(40)) & np.uint64(BITS - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _rows_of(texts, bitmap: np.ndarray | None):
    """(key, version, position, hash, slots, tokens) of each window that the bit map lets through; windows of plain tokens have null slots."""
    t = Templates()
    for key, text in texts:
        if not text:
            continue
        tokens, kinds, h, plain, ok = t.windows(text)
        same = np.ones(len(plain), bool)
        if bitmap is not None:
            ok, same = ok & _let_through(h, bitmap), _let_through(plain, bitmap)
        if not (ok.any() or same.any()):
            continue
        version = xxhash.xxh64_intdigest(text, 42)
        version -= version >> 63 << 64
        for at in np.flatnonzero(ok).tolist():
            slots = [f"{kinds[i]}:{tokens[i].lower()}" for i in range(at, at + WINDOW) if kinds[i] != LITERAL]
            yield key, version, at, int(h[at].view(np.int64)), slots, len(tokens)
        for at in np.flatnonzero(same).tolist():
            yield key, version, at, int(plain[at].view(np.int64)), None, len(tokens)


_SCHEMA = "id bigint, version bigint, at int, hash bigint, slots array<string>, tokens int"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, item_col, n_tokens of the longest consistent run, and exact (its slots all equal) of each leaked item."""
    best = _runs(docs, benchmark, id_col, text_col, item_col, item_text).groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max(F.struct("n_tokens", "exact")).alias("best"))
    return best.select(id_col, item_col, "best.n_tokens", "best.exact")


def _runs(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """id, version (XXH64 of the text), item, n_tokens and exact of each run that leaks an item."""
    items = map_rows(benchmark, [item_col, item_text], _SCHEMA, lambda rows: _rows_of(rows, None))
    bits = items.select((F.shiftrightunsigned("hash", 40) % BITS).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()  # at most BITS rows
    bitmap = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    found = map_rows(docs.where(F.col(text_col).isNotNull()), [id_col, text_col], _SCHEMA, lambda rows: _rows_of(rows, shared.value))
    item = items.select("hash", F.col("id").alias("item"), F.col("version").alias("item_version"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("tokens").alias("item_tokens"))
    joined = found.select("hash", "id", "version", "at", "slots").join(item, "hash").where(F.col("slots").isNull() == F.col("item_slots").isNull())
    names = ["id", "version", "item", "item_version", "diagonal"]
    pairs = F.coalesce(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.array().cast("array<struct<a:string,b:string>>"))
    placed = joined.withColumn("diagonal", F.col("at") - F.col("item_at")).groupBy(*names, "item_at").agg(F.first("item_tokens").alias("item_tokens"), F.max(pairs).alias("pairs"))
    island = F.col("item_at") - F.row_number().over(Window.partitionBy(*names).orderBy("item_at"))
    ordered = F.array_sort(F.collect_list(F.struct("item_at", "pairs")))
    runs = placed.withColumn("island", island).groupBy(*names, "island").agg(F.count("*").alias("n"), F.first("item_tokens").alias("item_tokens"), ordered.alias("windows"))
    least = F.least(F.lit(RUN), "item_tokens") - (WINDOW - 1)
    runs = runs.where(F.col("n") >= least).withColumn("slots", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["pairs"]))))
    side = lambda f: F.size(F.array_distinct(F.transform("slots", lambda p: p[f])))
    consistent = (side("a") == F.size("slots")) & (side("b") == F.size("slots"))
    equal = lambda pairs: F.forall(pairs, lambda p: p["a"] == p["b"])
    longest = F.when(consistent, F.col("n")).otherwise(_longest(F.transform("windows", lambda w: equal(w["pairs"]))))
    kept = runs.select("id", "version", "item", longest.alias("n"), (~consistent | equal(F.col("slots"))).alias("exact"), least.alias("least"))
    return kept.where("n >= least").select("id", "version", "item", (F.col("n") + WINDOW - 1).cast("long").alias("n_tokens"), "exact")


def _longest(flags: Column) -> Column:
    """The most successive true ones of an array."""
    step = lambda acc, flag: F.struct(F.when(flag, acc["now"] + 1).otherwise(F.lit(0).cast("long")).alias("now"), F.greatest(acc["best"], F.when(flag, acc["now"] + 1).otherwise(F.lit(0).cast("long"))).alias("best"))
    none = F.lit(0).cast("long")
    return F.aggregate(flags, F.struct(none.alias("now"), none.alias("best")), step, lambda acc: acc["best"])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text leaks an item."""
    version = free_name("version", docs)
    gone = sized(written(_runs(docs, benchmark, id_col, text_col, item_col, item_text).select("version").distinct())).toDF(version)
    return docs.join(gone, F.xxhash64(docs[text_col]) == gone[version], "left_anti")
