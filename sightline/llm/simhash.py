"""SimHash fingerprints and exact near pairs among them through vantage-point trees.

Equal fingerprints are collapsed first. The upper levels of one vantage-point tree, fitted on a bounded sample of
fingerprints (SAMPLE), deal all distinct fingerprints into shards by Hamming distance: d(x, vantage) <= mu goes left,
else right. A fingerprint within the radius of a boundary also goes as a guest to the other side's shards, so that by
the triangle inequality every close pair meets in some shard. Each shard continues the tree over its own rows, prunes
by the same bounds, and compares what is left. A shard reports links as stars (each row to the smallest id of its
local group), never as all pairs of a group; components() joins the stars across shards.

Defined results: text null or without words: fingerprint zero, linked like any other; fewer words than a shingle: the
whole sequence is the one shingle; repeated rows share a component; rows without an id have a fingerprint, are linked to
nothing by themselves and show the component of their fingerprint (null, if only such rows have it); similar_documents()
leaves them out; an empty table gives no rows; texts are of any length; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words, map_rows, sized, written
from .components import components

#: Fingerprints sampled (smallest hashes first) to place the vantage points of the upper levels: at most 64 KB collected.
SAMPLE = 8192
#: Rows a shard is planned for; a leaf is compared exhaustively.
SHARD_ROWS, LEAF = 8192, 96
#: For similar_documents: bands of least shingle values, and of how many bands together groups are formed at most.
BANDS, BAND_ROWS, DEPTH = 12, 3, 3
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words than a shingle make one."""
    words = lower_words((text or "").encode("utf-8", "surrogatepass"))
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]  # noqa: B905
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, max(1, len(words) - width + 1))


def majority(h: np.ndarray) -> int:
    """64 bits; a bit is set if over half of the hashes have it set."""
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.bincount(raw[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(sum(1 << i for i, v in enumerate(ones.ravel().tolist()) if 2 * v > len(h)))


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (the fingerprint as a signed long) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(source):
        for key, text in source:
            fp = fingerprint(text, width)
            yield key, fp - (fp >> 63 << 64)

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, fp bigint", rows)


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(fps: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the median distance, of a few candidates the one that leaves the fewest rows near its boundary."""
    best = None
    for at in np.linspace(0, len(fps) - 1, 5).astype(int):
        d = _far(fps, fps[at])
        mu = int(np.sort(d)[(len(d) - 1) // 2])
        left = int((d <= mu).sum())
        if left == len(d):
            mu -= 1
            left = int((d <= mu).sum())
        if 0 < left < len(d):
            cost = int((np.abs(d - mu) <= 3).sum()) + abs(2 * left - len(d))
            if best is None or cost < best[0]:
                best = (cost, fps[at], mu)
    return best and best[1:]


def upper_tree(sample: np.ndarray, levels: int):
    """Nested (vantage, mu, left, right), or None for a shard."""
    if levels == 0 or len(sample) < 8 or (cut := _split(sample)) is None:
        return None
    d = _far(sample, cut[0])
    return (*cut, upper_tree(sample[d <= cut[1]], levels - 1), upper_tree(sample[d > cut[1]], levels - 1))


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, row numbers, home?) of all rows. Guests only go from left to right at the node where they leave home, which meets each pair once; from there to every side the bounds allow."""
    todo, name = [(tree, 1, np.arange(len(fps)), True)], 0
    while todo:
        node, name, rows, home = todo.pop()
        if not len(rows):
            continue
        if node is None:
            yield name, rows, home
            continue
        vantage, mu, left, right = node
        d = _far(fps[rows], vantage)
        if home:
            todo += [(left, 2 * name, rows[d <= mu], True), (right, 2 * name + 1, rows[d > mu], True)]
            todo.append((right, 2 * name + 1, rows[(d <= mu) & (d > mu - radius)], False))
        else:
            todo += [(left, 2 * name, rows[d <= mu + radius], False), (right, 2 * name + 1, rows[d > mu - radius], False)]


class Groups:
    """Disjoint sets over row numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, one: int, others: np.ndarray) -> None:
        roots = self.up[others]
        while (higher := self.up[roots]).tobytes() != roots.tobytes():
            roots = higher
        for j in np.unique(roots).tolist():
            i, j = self.find(one), self.find(j)
            self.up[max(i, j)] = min(i, j)


def near_groups(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its local group: rows linked by pairs (home with any) at most radius apart."""
    groups = Groups(len(fps))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        cut = _split(fps[own]) if len(own) > LEAF else None
        if cut is None:
            both = np.concatenate([own, guests])
            for low in range(0, len(own), 256):
                some = own[low : low + 256]
                for at in range(0, len(both), 8192):
                    others = both[at : at + 8192]
                    i, j = np.nonzero(_far(fps[some][:, None], fps[others][None, :]) <= radius)
                    apart = some[i] != others[j]
                    i, j = i[apart], j[apart]
                    for one in np.unique(i):
                        groups.link(int(some[one]), others[j[np.searchsorted(i, one) : np.searchsorted(i, one, "right")]])
            continue
        vantage, mu = cut
        d, g = _far(fps[own], vantage), _far(fps[guests], vantage)
        inside, outside = d <= mu, d > mu
        todo.append((own[inside], guests[g <= mu + radius]))
        todo.append((own[outside], np.concatenate([guests[g > mu - radius], own[inside & (d > mu - radius)]])))
    return np.array([groups.find(i) for i in range(len(fps))], np.int64)


def near_components(prints: DataFrame, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """id_col, fp and component_id (smallest id reachable over links of at most radius bits) of every row of prints(id_col, fp)."""
    prints = written(prints)
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    levels = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_ROWS))))
    tree = upper_tree(sample, min(levels, int(np.log2(SAMPLE // 16))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column("fp").to_numpy(), b.column("rep").to_numpy()
            for shard, rows, home in route(tree, fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(fp[rows]), pa.array(rep[rows]), pa.array(np.full(len(rows), home))], names=["shard", "fp", "rep", "home"])

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep"], kind="stable")
        rep = pdf["rep"].to_numpy()
        first = near_groups(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(bool), radius)
        linked = first != np.arange(len(first))
        return pd.DataFrame({"a": rep[linked], "b": rep[first[linked]]})

    dealt = distinct.where(F.col("rep").isNotNull()).mapInArrow(deal, "shard int, fp long, rep long, home boolean")
    edges = dealt.groupBy("shard").applyInPandas(stars, "a long, b long")
    found = components(edges)
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def _prints_and_bands(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id_col, fp and bands: hashes of BAND_ROWS least values each of the shingles."""
    kind = df.schema[id_col].dataType.simpleString()
    factor = np.random.default_rng(5).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)

    def rows(source):
        for key, text in source:
            h = shingle_hashes(text, width)
            fp = majority(h)
            bands = []
            if len(h):
                least = np.full(len(factor), ~np.uint64(0))
                for low in range(0, len(h), 4096):
                    x = (h[low : low + 4096, None] ^ (h[low : low + 4096, None] >> np.uint64(31))) * factor
                    least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
                bands = [xxhash.xxh64_intdigest(least[i : i + BAND_ROWS].tobytes(), i) for i in range(0, len(factor), BAND_ROWS)]
            yield key, fp - (fp >> 63 << 64), [b - (b >> 63 << 64) for b in bands]

    return map_rows(df, [id_col, text_col], f"`{id_col}` {kind}, fp bigint, bands array<bigint>", rows)


def _similar(df: DataFrame, pairs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of documents whose shingle sets overlap by the similarity or more; the texts are read for these documents only."""
    wanted = written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct())
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(sized(wanted), "doc")

    def sets(source):
        for doc, text in source:
            yield doc, np.unique(shingle_hashes(text, width)).view(np.int64)

    def compared(source):
        for a, b, x, y in source:
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both):
                yield a, b

    hashed = written(map_rows(texts, ["doc", "text"], "doc bigint, h array<bigint>", sets, flush=100).dropDuplicates(["doc"]))
    both = pairs.join(hashed.select(F.col("doc").alias("a"), F.col("h").alias("x")), "a").join(hashed.select(F.col("doc").alias("b"), F.col("h").alias("y")), "b")
    return map_rows(both, ["a", "b", "x", "y"], "a bigint, b bigint", compared)


def similar_documents(df: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and component_id of every row: linked within radius bits, or by a shingle similarity of at least that much.

    Copies of that similarity often differ in ten bits or so, a radius at which no tree over random fingerprints prunes.
    So documents that share a band of least shingle values form a group, and each is compared with the group's smallest
    document on the whole shingle sets. Those that fail form smaller groups with the same and one more band in common,
    together with two of those that didn't, and so on up to DEPTH bands: a true pair shares half of its bands.
    """
    prints = written(_prints_and_bands(df.where(F.col(id_col).isNotNull()), width, id_col, text_col))
    close = written(near_components(prints.select(id_col, "fp"), radius, id_col))
    one = prints.groupBy("fp", "bands").agg(F.min(F.col(id_col).cast("long")).alias("doc")).join(close.groupBy("fp").agg(F.min(F.col("component_id").cast("long")).alias("part")), "fp")
    edges = close.select(F.col(id_col).cast("long").alias("a"), F.col("component_id").cast("long").alias("b")).where("a <> b")
    rows = one.select("doc", "part", "bands", F.posexplode("bands").alias("last", "key"))
    for depth in range(DEPTH):
        groups = rows.groupBy("key").agg(F.min(F.struct("doc", "part")).alias("hub"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key", "hub")
        met = written(rows.join(groups, "key").where("doc <> hub.doc").withColumn("a", F.greatest("doc", "hub.doc")).withColumn("b", F.least("doc", "hub.doc")))
        alike = written(_similar(df, written(met.where("part <> hub.part").select("a", "b").distinct()), width, similarity, id_col, text_col))
        edges = edges.union(alike)
        told = met.join(alike.withColumn("alike", F.lit(True)), ["a", "b"], "left").withColumn("linked", F.coalesce("alike", F.col("part") == F.col("hub.part")))
        alone = told.where("NOT linked").select("key", "doc", "part", "bands", "last")
        if depth + 1 == DEPTH or alone.isEmpty():
            break
        member = F.struct("doc", F.col("hub.part").alias("part"), "bands", "last")
        settled = told.where("linked").groupBy("key").agg(F.array_distinct(F.array(F.min(member), F.max(member))).alias("m")).select("key", F.explode("m").alias("m")).select("key", "m.*")
        again = written(alone.union(settled.join(alone.select("key").distinct(), "key", "left_semi").select(*alone.columns)))
        more = again.select("key", "doc", "part", "bands", "last", F.posexplode("bands").alias("j", "band")).where("j > last")
        rows = more.select("doc", "part", "bands", F.col("j").alias("last"), F.xxhash64("key", "j", "band").alias("key"))
    found = components(edges)
    return close.join(found, close[id_col] == found["node"], "left").select(id_col, F.coalesce("component", id_col).alias("component_id"))


def near_duplicates(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component_id of every row of df."""
    return near_components(fingerprints(df, width, id_col, text_col), radius, id_col)
