import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import scans, windows

SCHEMA = "t long, n long, v double, w string"


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(seed, n):
    r = random.Random(seed)
    return [(r.randrange(n * 3), i, r.choice([None, None, None, float(i)]), r.choice("ab")) for i in range(n)]


def global_windows(df) -> int:
    """Windows of the physical plan that have no keys, so that one task has all rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange SinglePartition")


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_scans_equal_plain_loops(spark, many_ranges, n):
    plain = rows(n, n)
    df = spark.createDataFrame(plain, SCHEMA).repartition(3)
    order = ["t", "n"]
    numbered, before, total, filled = (
        scans.numbered(df, order, "x"), scans.with_previous(df, order, "v", "x"), scans.running_total(df, order, F.col("t") % 7, "x"), scans.forward_filled(df, order, "v", "x"),
    )
    want = {k: [] for k in "nbtf"}
    previous, running, last = None, 0, None
    for i, r in enumerate(sorted(plain, key=lambda r: r[:2]), 1):
        running += r[0] % 7
        last = last if r[2] is None else r[2]
        for k, x in zip("nbtf", (i, previous, running, last), strict=True):
            want[k].append((r[1], x))
        previous = r[2]
    for df, k in ((numbered, "n"), (before, "b"), (total, "t"), (filled, "f")):
        assert sorted((r["n"], r["x"]) for r in df.collect()) == sorted(want[k])
        assert global_windows(df) == 0


def test_null_order_and_repeated_rows(spark, many_ranges):
    df = spark.createDataFrame([(None, 1, 1.0, "a"), (None, 1, 1.0, "a"), (3, 1, None, "b")], SCHEMA)
    assert sorted(r["x"] for r in scans.numbered(df, ["t", "n"], "x").collect()) == [1, 2, 3]
    assert [r["x"] for r in scans.forward_filled(df, ["t", "n"], "v", "x").where("w = 'b'").collect()] == [1.0]


@pytest.mark.parametrize("tick", [1, 10, 1000])
def test_ticks_equal_plain_search(spark, many_ranges, tick):
    plain = rows(8, 300)
    got = windows.first_at_or_after(spark.createDataFrame(plain, SCHEMA), "t", ["n", "v"], tick)
    assert global_windows(got) == 0
    order = sorted(plain, key=lambda r: r[:2])
    want, at = [], 0
    for tick_at in range(order[0][0] // tick * tick, order[-1][0] + 1, tick):
        while order[at][0] < tick_at:
            at += 1
        want.append((tick_at, order[at][1]))
    assert sorted((r["tick"], r["n"]) for r in got.collect()) == want
    assert windows.first_at_or_after(spark.createDataFrame([], SCHEMA), "t", ["n"], tick).count() == 0
