import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import chains, state


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("keys", "span", "least"), [(1, 4000, 50), (5, 300, 7), (3, 20, 5), (2, 50, 1000)])
def test_accepted_equals_the_walk(spark, keys, span, least):
    r = random.Random(span)
    plain = [(r.randrange(keys), r.randrange(span), i) for i in range(400)] + [(None, t, 1000 + t) for t in range(0, 60, 3)] + [(0, None, 2000)]
    df = spark.createDataFrame(plain, "k long, t long, i long").repartition(3)
    want = set()
    for k in {p[0] for p in plain}:
        own = sorted((t, i) for key, t, i in plain if key == k and t is not None)
        want |= {(k, i) for _, i in state.throttled(own, least)}
    got = chains.accepted(df, "k", "t", ["i"], least)
    assert {(x["k"], x["i"]) for x in got.collect()} == want and got.columns == ["k", "t", "i"]


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 1999).alias("t"), "id")
    got = chains.accepted(df, "k", "t", ["id"], 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 667 and "MapInArrow" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_greedy_choice(spark, seed):
    r = random.Random(seed)
    scored = [(g, r.choice([0.5, 0.5, r.random()]), a, b) for g in range(3 if seed else 1) for a in range(12) for b in range(12) if r.random() < 0.6]
    want = {(g, a, b) for g in {s[0] for s in scored} for a, b in state.greedy_match([s[1:] for s in scored if s[0] == g])}
    df = spark.createDataFrame([*scored, *scored[:5], (0, None, 1, 1)], "g long, s double, a long, b long")
    got = chains.greedy_pairs(df, ["g"], "s", "a", "b")
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert chains.greedy_pairs(df.limit(0), ["g"], "s", "a", "b").count() == 0


def plain_roots(links):
    up, out = dict(links), {}
    for node in up:
        path, at = [], node
        while at not in path:
            path.append(at)
            if up.get(at, at) == at:
                break
            at = up[at]
        out[node] = at if up.get(at, at) == at else min(path[path.index(at) :])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_led_to_ends_loops_and_larger_parents(spark, seed):
    r = random.Random(seed)
    links = [(n, r.choice([None, n, r.randrange(90), r.randrange(90), r.randrange(90)])) for n in range(80)]
    links += [(200, 201), (201, 200), (300 + 3, 300), (300, 301), (301, 302), (302, 300)] + [(400 + i, 400 + i + 1) for i in range(70)] + [(500, 500)]
    got = {x["node"]: x["root"] for x in chains.led_to(spark.createDataFrame(links, "node long, parent long")).collect()}
    assert got == plain_roots([(n, n if p is None else p) for n, p in links])
    assert got[400] == 470 and got[200] == got[201] == 200 and got[303] == 300
