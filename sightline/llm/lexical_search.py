"""Ranked lexical search as a blocked sparse matrix product: item x term weights times term x document impacts.

One pass counts, for every document, its terms and how often it holds each term of the items; this term-document table is
written once. Document frequencies and totals are sums over it. Then each task takes its documents in blocks: a block's
impacts (int64) are laid out by term, each item merges the rows of its terms into one dense row of scores (Gustavson's
row-wise product), a partition selects the block's k best, and the task keeps k of each item. Spark merges the tasks'
winners, first within salts and then over all.

Items are dealt into blocks of about ITEM_TERMS terms by a hash; what a task holds of them is bounded whatever the number
of items, and each block of items is one such pair of passes. Every document takes part for every item.

Defined results: a text without terms, null or empty, is no document and matches nothing; an item without terms has no
rows; equal scores go to the smaller doc_id, a null one first; repeated documents each take a rank; repeated items are
answered one by one; texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_rows, written

#: Documents of a block, and about how many terms the items of one pass have together.
BLOCK, ITEM_TERMS = 8192, 1 << 18
#: Tasks that share an item's merge.
SALTS = 32
#: Fixed values of the score: free and length share of the damping in hundredths; factors of the damping and of the occurrences; scale of a weight and of an impact.
FREE, SHARE, DAMPED, COUNTED, WEIGHT, IMPACT = 10, 90, 8, 1000, 1000, 1_000_000_000

#: ASCII letters and digits stay, A-Z as a-z; other ASCII bytes become spaces; bytes of other characters stay.
_FOLD = bytes(ord(chr(b).translate(ASCII_LOWER)) if b > 127 or chr(b).isalnum() else 32 for b in range(256))

Item = tuple[int, int | None, list[str], list[int]]


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in their order."""
    return (text or "").encode("utf-8").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms and their multiplicities of every item that has a term."""

    def rows(source):
        for key, text in source:
            if held := Counter(terms(text)):
                yield key, [t.decode("utf-8") for t in held], list(held.values())

    return map_rows(items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), ["id", "t"], "id bigint, terms array<string>, times array<int>", rows)


def counted(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms), and term numbers with their occurrences, of every document that has a term."""

    def rows(source):
        get = number.get
        for key, text in source:
            found = terms(text)
            if found:
                held = Counter(map(get, found))
                held.pop(None, None)
                yield key, len(found), list(held), list(held.values())

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), ["id", "t"], "id bigint, n bigint, terms array<int>, times array<int>", rows)


def by_term(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's matrix in rows of terms: where each row begins, and its documents and impacts."""
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(n_terms + 1)), doc[order], impact[order]


def merged(row: np.ndarray, factors: np.ndarray, begins: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
    """One row of the product: the rows of the item's terms, times their factors, added up over n documents."""
    out = np.zeros(n, np.int64)
    for term, factor in zip(row.tolist(), factors.tolist(), strict=True):
        part = slice(begins[term], begins[term + 1])
        out[docs[part]] += factor * impacts[part]  # a document occurs once in a row
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above zero; equal ones from the left."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    s = scores[some]
    edge = np.partition(s, len(s) - k)[len(s) - k]
    above = some[s > edge]
    return np.concatenate([above, some[s == edge][: k - len(above)]])


class _Best:
    """The k best of every item over a task's blocks."""

    def __init__(self, items: list[Item], factors: list[np.ndarray], k: int, n_docs: int, n_terms_all: int, n_terms: int):
        self.items, self.factors, self.k, self.n_docs, self.length, self.n_terms = items, factors, k, n_docs, n_terms_all, n_terms
        self.rows = [np.asarray(i[2], np.int64) for i in items]
        empty = np.zeros(0, np.int64)
        self.held = [(empty, empty, empty) for _ in items]  # present (0: null id), id, score

    def add(self, batch: pa.RecordBatch) -> None:
        ids, n, found, times = batch.columns
        present = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, present))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        present, ids = present[order], ids[order]
        damping = FREE + (SHARE * n.to_numpy() * self.n_docs) // self.length
        doc = np.repeat(np.arange(len(order)), np.diff(found.offsets.to_numpy()))
        tf = times.values.slice(times.offsets[0].as_py(), len(doc)).to_numpy().astype(np.int64)
        term = found.values.slice(found.offsets[0].as_py(), len(doc)).to_numpy().astype(np.int64)
        impact = (IMPACT * tf) // (COUNTED * tf + DAMPED * damping[doc])
        begins, docs, impacts = by_term(term, place[doc], impact, self.n_terms)
        for i, row in enumerate(self.rows):
            scores = merged(row, self.factors[i], begins, docs, impacts, len(ids))
            at = best(scores, self.k)
            if len(at):
                p, d, s = (np.concatenate(x) for x in zip(self.held[i], (present[at], ids[at], scores[at]), strict=True))
                top = np.lexsort((d, p, -s))[: self.k]
                self.held[i] = p[top], d[top], s[top]

    def out(self) -> pa.RecordBatch:
        sizes = [len(s) for _, _, s in self.held]
        p, d, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        number = np.repeat(np.asarray([i[0] for i in self.items], np.int64), sizes)
        names = [i[1] for i, size in zip(self.items, sizes, strict=True) for _ in range(size)]
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(names, pa.int64()), pa.array(d, mask=p == 0), pa.array(s)], ["number", "item_id", "doc_id", "score"])


def _block(docs: DataFrame, items: list[tuple], first: int, k: int, once: bool, id_col: str, text_col: str) -> DataFrame:
    """number, item_id, doc_id, score: the tasks' winners for one block of items."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t.encode("utf-8") for row in items for t in row[1]))}
    table = written(counted(docs, number, id_col, text_col))
    n_docs, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most as many as the block's terms
    weights = np.asarray([weight(n_docs, df.get(i, 0)) for i in range(len(number))], np.int64)
    rows = [(first + i, key, [number[t.encode("utf-8")] for t in words], times) for i, (key, words, times) in enumerate(items)]
    factors = [weights[row[2]] * (1 if once else np.asarray(row[3], np.int64)) for row in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, held, size = _Best(rows, factors, k, n_docs, length, len(number)), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    top.add(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if held:
            top.add(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        if rows:
            yield top.out()

    return table.mapInArrow(run, "number bigint, item_id bigint, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k highest-scoring documents. once: a term counts once however often its item holds it; else with its multiplicity."""
    asked = written(item_terms(items, item_col, item_text))
    n_blocks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS))
    out, first = None, 0
    for b in range(n_blocks):
        block = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("id", "terms"), F.lit(n_blocks)) == b).collect()]
        part = _block(docs, block, first, k, once, id_col, text_col)
        first += len(block)
        out = part if out is None else out.union(part)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    salted = Window.partitionBy("number", "salt").orderBy(*order)
    near = out.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
