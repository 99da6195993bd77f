"""Line dedup within one edit by a deletion-neighbourhood join.

A line is its lower-cased words; lines without words are never compared and stay. A line goes if an earlier line (by
doc_id, then a hash of the text, then line number) is equal, or, from NEAR_WORDS words on, at most one edit away: one word
replaced, inserted or deleted.

1. Equal lines are collapsed to their earliest occurrence by a hash of 128 bits; later occurrences go.
2. Two lines one edit apart agree on their first or second half. Hashed halves show which lines have a possible
   partner, on which side the edit would lie and whether it is a replacement or an insertion. This loses no pair.
3. Only these lines emit their deletion variants on that side, as hashed keys: with the position (two lines that share
   such a key differ in that word only, so a key's lines are near each other and its earliest one decides), and
   without it, to meet the whole shorter line. Keys are joined by minimum, never as pairs of a group.
4. Each link found is verified on the words of both lines.

Defined results: null and empty texts have no lines that go; identical rows (same id and text) count as one document
and get the same result; rows of one id with different texts are ordered by a hash of the text; an empty table gives
no rows; lines and texts are of any length. apply() keeps every row and column that it doesn't cut, whatever the columns
are called; rows without an id keep their texts, and so do null texts; a document that keeps no line goes with all rows
that repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, free_name, map_rows, released, sized, skew_join, written

#: From so many words on a line also goes if it is one edit away; of fewer words one is too large a part.
NEAR_WORDS = 8
EQUAL_LEFT, EQUAL_RIGHT, LONG_LEFT, LONG_RIGHT, SHORT = 1, 2, 4, 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_signed = lambda x: x - (x >> 63 << 64)
_hash = xxhash.xxh3_64_intdigest


def line_words(line: str) -> list[str]:
    return line.lower().split()


def line_id(words: list[str]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(" ".join(words))
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def half_keys(words: list[str]) -> list[int]:
    """Hashed halves: left and right in the class of the line's own length, then in that of one word less."""
    n, out = len(words), []
    for m in (n, n - 1):
        h = m // 2
        out += [_signed(_hash(f"{m} l " + " ".join(words[:h]))), _signed(_hash(f"{m} r " + " ".join(words[n - (m - h) :])))]
    return out


def variants(words: list[str], flags: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and kinds (0: position and rest, 1: the whole line, 2: rest) of the deletions that the flags ask for."""
    n = len(words)
    w = np.fromiter((_hash(x) for x in words), np.uint64, n)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power)])
    rest = total[:-1] + (total[-1] - total[1:]) * _INVERSE
    half, less = n // 2, (n - 1) // 2
    at = np.arange(n)
    pick = lambda left, right, h: at[((at >= h) & bool(flags & left)) | ((at < h + (left == LONG_LEFT)) & bool(flags & right))]
    same, longer = pick(EQUAL_LEFT, EQUAL_RIGHT, half), pick(LONG_LEFT, LONG_RIGHT, less)
    keys = [_mixed(rest[same], same + 1, n), _mixed(total[-1:], np.zeros(1, np.int64), n) if flags & SHORT else rest[:0], _mixed(rest[longer], np.zeros(len(longer), np.int64), n - 1)]
    return np.concatenate(keys).view(np.int64), np.repeat(np.arange(3), [len(k) for k in keys])


def _mixed(h: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    h = h ^ (position.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(length * 0xA5A5A5A5F1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word replaced, inserted or deleted makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i + (len(a) == len(b)) :] == long[i + 1 :]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per comparable line: h1, h2, its place (doc, version, line) and, of long lines, the half keys."""

    def rows(source):
        for doc, text in source:
            if not text:
                continue
            version = _signed(xxhash.xxh64_intdigest(text, 42))
            for i, line in enumerate(text.split("\n")):
                words = line_words(line)
                if words:
                    yield (*line_id(words), doc, version, i, half_keys(words) if len(words) >= NEAR_WORDS else None)

    return map_rows(docs, [id_col, text_col], "h1 bigint, h2 bigint, doc bigint, version bigint, line int, halves array<bigint>", rows, flush=4000)


def _flags(firsts: DataFrame) -> DataFrame:
    """h1 and the flags of the lines that share a half with a possible partner."""
    keys = firsts.where("halves IS NOT NULL").select("h1", F.posexplode("halves").alias("i", "key"))
    groups = keys.groupBy("key").agg(F.count_if(F.col("i") < 2).alias("own"), F.count_if(F.col("i") >= 2).alias("longer"))
    groups = written(groups.where("own > 1 OR (own > 0 AND longer > 0)").withColumn("n", F.col("own") + F.col("longer")))
    bit = (
        F.when(F.col("i") >= 2, F.when(F.col("own") > 0, F.when(F.col("i") == 2, LONG_LEFT).otherwise(LONG_RIGHT)).otherwise(0))
        .otherwise(F.when(F.col("own") > 1, F.when(F.col("i") == 0, EQUAL_LEFT).otherwise(EQUAL_RIGHT)).otherwise(0).bitwiseOR(F.when(F.col("longer") > 0, SHORT).otherwise(0)))
    )
    return skew_join(keys, groups.drop("n"), ["key"], groups.select("key", "n")).select("h1", bit.alias("flag")).groupBy("h1").agg(F.bit_or("flag").alias("flags"))


def _near(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The places (doc, version, line) of first occurrences that have an earlier line one edit away."""
    wanted = written(firsts.join(_flags(firsts), "h1").where("flags > 0").groupBy("doc", "version").agg(F.collect_list(F.struct("line", "flags")).alias("want")))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    fetched = source.join(sized(wanted), ["doc", "version"])

    def emit(rows):
        for doc, version, text, want in rows:
            lines = text.split("\n")
            for w in want:
                keys, kinds = variants(line_words(lines[w["line"]]), w["flags"])
                for key, kind in zip(keys.tolist(), kinds.tolist(), strict=True):
                    yield key, kind, doc, version, w["line"]

    place = F.struct("doc", "version", "line")
    rows = written(map_rows(fetched, ["doc", "version", "text", "want"], "key bigint, kind int, doc bigint, version bigint, line int", emit, flush=8000))
    first = lambda k: F.min(F.when(F.col("kind") == k, place))
    earliest = written(rows.groupBy("key").agg(F.count("*").alias("n"), first(0).alias("same"), first(1).alias("short"), first(2).alias("long")).where("n > 1"))
    other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("long")).otherwise(F.col("short"))
    links = skew_join(rows, earliest.drop("n"), ["key"], earliest.select("key", "n")).where(other < place).select("doc", "version", "line", other.alias("other")).distinct()
    return _verified(docs, written(links), id_col, text_col)


def _verified(docs: DataFrame, links: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The links whose lines are within one edit, by the words of both."""
    ends = links.select(F.col("other.doc").alias("doc"), F.col("other.version").alias("version"), F.col("other.line").alias("line")).union(links.select("doc", "version", "line")).distinct()
    wanted = written(ends.groupBy("doc", "version").agg(F.collect_list("line").alias("want")))
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    texts = source.join(sized(wanted), ["doc", "version"])
    at = texts.select("doc", "version", F.explode("want").alias("line"), F.split("text", "\n").alias("all")).select("doc", "version", "line", F.col("all")[F.col("line")].alias("words")).dropDuplicates(["doc", "version", "line"])
    at = written(at)
    mine = links.join(at, ["doc", "version", "line"])
    theirs = at.select(F.struct("doc", "version", "line").alias("other"), F.col("words").alias("other_words"))
    both = mine.join(theirs, "other")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(line_words(x), line_words(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return both.where(near("words", "other_words")).select("doc", "version", "line").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, version (hash of the text) and dropped (sorted line numbers from 0) of every document that loses lines."""
    lines = written(_lines(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    place = F.struct("doc", "version", "line")
    firsts = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("halves").alias("halves"))
    firsts = written(firsts.select("h1", "h2", "first.*", "halves", (F.col("first") < F.col("last")).alias("again")))
    again = firsts.where("again").select("h1", "h2", place.alias("first"))
    exact = lines.select("h1", "h2", "doc", "version", "line").join(again, ["h1", "h2"]).where(place > F.col("first")).select("doc", "version", "line")
    gone = exact.union(_near(docs, firsts, id_col, text_col))
    return gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines and dropped of every row of docs."""
    gone = dropped_lines(docs, id_col, text_col)
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("version"), F.when(F.length(text_col) > 0, F.size(F.split(text_col, "\n"))).otherwise(0).cast("long").alias("n_lines"))
    return rows.join(gone, (rows[id_col] == gone["doc"]) & (rows["version"] == gone["version"]), "left").select(id_col, "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines cut from the text; documents that keep no line go, those without lines stay."""
    doc, version, dropped = (free_name(n, docs) for n in ("doc", "version", "dropped"))
    gone = sized(written(dropped_lines(docs, id_col, text_col))).toDF(doc, version, dropped)

    def cut(text: str | None, lines: list[int] | None) -> str | None:
        if text is None or lines is None:
            return text
        gone = set(lines)
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone]
        return "\n".join(kept) if any(map(line_words, kept)) else None

    both = docs.join(gone, (docs[id_col] == gone[doc]) & (F.xxhash64(docs[text_col]) == gone[version]), "left").drop(doc, version)
    at = docs.columns.index(text_col)
    plain = both.toDF(*(f"c{i}" for i in range(len(both.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # few texts at a time are Python strings
                part = batch.slice(low, 256)
                lost = part.column(part.num_columns - 1)
                if lost.null_count < part.num_rows:
                    lists = lost.to_pylist()
                    texts = pa.array([cut(t, x) for t, x in zip(part.column(at).to_pylist(), lists, strict=True)], part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), texts).filter(pa.array([x is None or t for x, t in zip(lists, texts.is_valid().to_pylist(), strict=True)]))
                yield part.select(range(part.num_columns - 1))
        released()

    return plain.mapInArrow(run, plain.drop(plain.columns[-1]).schema).toDF(*docs.columns)
