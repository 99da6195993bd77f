import os
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import joins
from sightline.plans import join_queries, station_queries
from sightline.sources.tables import events
from sightline.streaming import hosts, links

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events over triggers of ten days, each up to two days out of place, and a row far behind them."""
    at = tmp_path_factory.mktemp("links")
    e = events(spark, DATA).withColumn("clock", F.timestamp_micros("t")).drop("ts")
    day = 86_400_000_000
    moved = F.floor((F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(2)) * day - F.lit(1)) / (10 * day))
    numbers = sorted(r[0] for r in e.select(moved).distinct().collect())
    assert len(numbers) >= 3
    ends = [(600_000_000, -1, "click"), (600_000_020, -2, "view")]  # in their zones, of users of their own
    last = reduce(DataFrame.union, (e.limit(1).withColumns({"clock": F.lit("2100-01-01").cast("timestamp"), "event_id": F.lit(n).cast(e.schema["event_id"].dataType), "user_id": F.lit(u).cast(e.schema["user_id"].dataType), "event_type": F.lit(k), "value": F.lit(30.0)}) for n, u, k in ends))
    for k, df in enumerate([*(e.where(moved == n) for n in numbers), last]):
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
        for f in Path(f"{at}/in").glob("*.parquet"):
            if f.stat().st_mtime > 1_600_000_000 + 1000:
                os.utime(f, (1_600_000_000 + k * 10,) * 2)
    return at, e.schema.simpleString()[7:-1].replace(":", " ")


def drained(q):
    q.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"] if "join" in s["operatorName"].lower()) for p in q.recentProgress]


def test_stream_of_zone_links_equals_the_query(spark, folder, tmp_path):
    at, schema = folder
    click, view = (station_queries.in_zone(hosts.event_stream(spark, f"{at}/in", schema), k).select("user_id", "event_id", "clock") for k in station_queries.SIDES)
    out = links.linked_first(click, view, ["user_id"], "clock", "event_id", "6 hours", "2 days").select("event_id", "other_event_id")
    held = drained(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    want = sorted(map(tuple, station_queries.zone_link_join(spark, DATA).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want and want
    assert max(held) > 10 and held[-1] <= 2  # what the watermark has passed is dropped


def test_stream_of_similar_twins_equals_the_query(spark, folder, tmp_path):
    at, schema = folder
    one, two = (hosts.event_stream(spark, f"{at}/in", schema).select("user_id", "event_id", "event_type", "clock", F.round("value", 1).cast("string").alias("reading")) for _ in range(2))
    other = (F.col("event_type") != F.col("other_event_type")) & (F.col("event_id") != F.col("other_event_id"))
    out = links.linked_first(one, two, ["user_id"], "clock", "event_id", "24 hours", "2 days", other & joins.alike("reading", "other_reading", 0.8)).select("event_id", "other_event_id")
    drained(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    want = sorted(map(tuple, join_queries.similarity_twin_join(spark, DATA).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want and want


def test_few_pairs_reach_the_exact_ratio(spark):
    pairs = join_queries.twin_pairs(spark, DATA)
    bound = joins.ratio_bound("reading", "other_reading")
    exact = pairs.withColumn("bound", bound).withColumn("ratio", joins.sequence_ratio("reading", "other_reading")).cache()
    assert exact.where("ratio > bound + 1e-12").count() == 0
    assert exact.where("bound >= 0.8").count() < 0.1 * exact.count()
    plan = pairs.where(joins.alike("reading", "other_reading", 0.8))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")  # the bound filters below it


def test_copies_do_not_multiply_the_pairs_of_similar_twins(spark, monkeypatch):
    rows = join_queries.readings(spark, DATA).where("user_id < 40")
    one = rows.where("event_id % 7 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("event_id", F.col("event_id") + F.col("k") * 1_000_000).drop("k")
    odd = rows.where("event_id % 7 = 0").limit(60).withColumn("event_type", F.lit("odd"))  # ids that are there with another type, without an id, without digits
    many = one.union(odd).union(odd.withColumn("event_type", F.lit("even"))).union(odd.withColumn("event_id", F.lit(None).cast("long"))).union(odd.withColumn("reading", F.lit("-"))).union(odd.withColumn("reading", F.lit("7" * 70))).cache()
    pairs = joins.within(many, many, ["user_id"], "t", 24 * join_queries.H, "other_").where("event_type <> other_event_type AND event_id <> other_event_id")
    want = joins.first_in(pairs.where(joins.alike("reading", "other_reading", 0.8)), ["event_id"], ["other_t", "other_event_id"]).select("event_id", "other_event_id")
    seen, within = [], joins.within
    monkeypatch.setattr(joins, "within", lambda *a: seen.append(within(*a)) or seen[0])
    got = sorted(map(tuple, joins.first_alike(many, many, ["user_id"], "t", "event_id", "reading", "event_type", 24 * join_queries.H, 0.8).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    assert seen[0].where("event_type <> other_event_type").count() < 0.4 * pairs.count()
