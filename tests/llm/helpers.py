"""Small fixtures: documents with nulls, empty, long, repeated and hot texts, and extra columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("row", T.LongType()), ("h", T.DoubleType()), ("version", T.StringType()))])


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def lines(seed: int, n: int) -> str:
    return "\n".join(words(seed * 100 + i, 12) for i in range(n))


def frame(spark, texts: dict | list):
    pairs = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "k", 7, 0.5, "v") for i, t in pairs], SCHEMA)


def odd_texts() -> dict:
    hot = lines(1, 4)
    out = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "é ß 日本 𠮷 ▁ <|endoftext|>", 6: words(2, 6000), 7: "a" * 5000, 8: "x " * 3000, 9: lines(3, 30)}
    return out | {100 + i: hot for i in range(20)} | {200 + i: lines(50 + i, 3) for i in range(20)}


def write(folder, **tables) -> str:
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
