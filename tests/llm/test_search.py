import math

import pytest
from pyspark.sql import functions as F

from sightline.llm import topk_search as s

from .helpers import words  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, query_id string, score double"


def brute(rows, k=5):
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in ok if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q))[:k]  # noqa: B905
        out |= {(q, n + 1, i, -m) for n, (m, i) in enumerate(best)}
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.randrange(-64, 64) / 128 for _ in range(6)]) for i in range(230)]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]  # a hot vector: ties go to smaller ids
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (550, [0.0] * 6), (600, [0.25])]
    df = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], SCHEMA)
    got = s.top_k(df, F.col("vec_id") % 50 == 0)
    assert {tuple(x) for x in got.collect()} == brute(rows)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(1, [1.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], SCHEMA)
    assert s.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_query_ids(spark):
    df = spark.createDataFrame([(0, [1.0], "", 0.0), (0, [0.5], "", 0.0), (1, [1.0], "", 0.0)], SCHEMA)
    assert [tuple(x) for x in s.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 128 * 256)]


def test_null_ids_and_long_vectors(spark):
    df = spark.createDataFrame([(None, [9.0], "x", 0.0), (0, [0.5] * 5000, "x", 0.0), (1, [1.0] * 3, "x", 0.0), (2, [1.0] * 5000, "x", 0.0)], SCHEMA)
    assert [(x["vec_id"], x["score"]) for x in s.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(2, 5000 * 128 * 256), (1, 3 * 128 * 256)]
    assert s.top_k(df.withColumn("id", F.lit(1)).withColumn("terms", F.lit("t")), F.col("vec_id") == 1).count() == 2
