from pyspark.sql import functions as F

from sightline.operators import state
from sightline.streaming import hosts, upserts

SCHEMA = "user_id long, event_id long, t long, value double"


def rows(n=60):
    return [(i % 4, i, i * 7 + i % 3, float(i % 11)) for i in range(n)]


def files(spark, folder):
    for k in range(3):
        spark.createDataFrame(rows()[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_throttled_stream_equals_batch(spark, tmp_path):
    files(spark, tmp_path / "in")
    s = hosts.throttled(hosts.event_stream(spark, str(tmp_path / "in"), SCHEMA, 9), "user_id", "t", "event_id", 100)
    q = s.writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = set()
    for u in range(4):
        own = sorted((r[2], r[1]) for r in rows() if r[0] == u)
        ok, _ = state.throttle([t for t, _ in own], 100)
        want |= {e for (_, e), keep in zip(own, ok, strict=True) if keep}
    assert {r["event_id"] for r in spark.table("throttled").collect()} == want


def test_upsert_and_log(spark, tmp_path):
    files(spark, tmp_path / "in")
    stream = hosts.event_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    write = upserts.upsert_into(str(tmp_path / "out"), ["user_id"], ["t", "event_id"], buckets=8)
    for _ in range(2):  # a restart finds nothing new
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    table = upserts.KeyedTable(spark, str(tmp_path / "out"), ["user_id"], ["t", "event_id"])
    assert table.versions() == [1, 2]
    got = {r["user_id"]: r["event_id"] for r in table.read().collect()}
    assert got == {u: max(r[1] for r in rows() if r[0] == u) for u in range(4)}
    hosts.append_log(stream.select("event_id", F.lit("é").alias("event")), str(tmp_path / "log"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).where("event = 'é'").count() == 60


def test_windowed_rates(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("t") * 600))
    df.write.parquet(str(tmp_path / "w"))
    s = hosts.windowed_rates(hosts.event_stream(spark, str(tmp_path / "w"), f"{SCHEMA}, ts timestamp", 50), "ts", "user_id")
    q = s.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c3")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").count() > 20


def test_upsert_costs_its_batch(spark, tmp_path):
    """A batch of few keys writes few buckets, a batch played again changes nothing, and old buckets go."""
    at = tmp_path / "table"
    table = upserts.KeyedTable(spark, str(at), ["k"], ["t"], buckets=64, keep=2)
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    assert table.read() is None
    table.merge(spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("v")), 0)
    whole = size(at)
    batch = spark.createDataFrame([(5, 1, "new"), (5, 2, "newer"), (7, -1, "old"), (None, 1, "no key")], "k long, t long, v string")
    table.merge(batch, 1)
    assert size(at / "data/v1") < 0.1 * whole
    want = {5: "newer", None: "no key"}
    now = {r["k"]: r["v"] for r in table.read().where("k IN (5, 7) OR k IS NULL").collect()}
    assert now | want == now and now[7] != "old" and table.read().count() == 20_001
    before = sorted(str(p) for p in at.rglob("*") if p.is_file())
    table.merge(batch.withColumn("v", F.lit("again")), 1)
    assert sorted(str(p) for p in at.rglob("*") if p.is_file()) == before
    for n in range(2, 6):
        table.merge(spark.createDataFrame([(5, n + 5, f"v{n}")], "k long, t long, v string"), n)
    assert table.versions() == [4, 5] and size(at) < 1.2 * whole
    assert [table.read(v).where("k = 5").first()["v"] for v in (4, 5)] == ["v4", "v5"]
    assert {p.name for p in (at / "data").iterdir()} == {"v0", "v1", "v4", "v5"}
    table.merge(batch.limit(0), 6)
    assert table.versions() == [5, 6] and table.read().count() == 20_001


def test_upsert_that_fails_before_its_manifest(spark, tmp_path, monkeypatch):
    table = upserts.KeyedTable(spark, str(tmp_path / "t"), ["k"], ["t"], buckets=4)
    rows = lambda v: spark.createDataFrame([(1, 1, v)], "k long, t long, v string")
    table.merge(rows("a"), 0)
    with monkeypatch.context() as broken:
        broken.setattr(table, "_publish", lambda m: 1 / 0)
        try:
            table.merge(rows("b"), 1)
        except ZeroDivisionError:
            pass
    assert table.read().first()["v"] == "a"
    table.merge(rows("b"), 1)
    assert table.read().first()["v"] == "b" and table.versions() == [0, 1]


def test_told_once_and_late_rows(spark, tmp_path):
    at = lambda hour: F.timestamp_seconds(F.lit(hour * 3600))
    parts = [[(1, 10), (2, 10), (1, 10)], [(1, 11), (3, 40)], [(4, 5), (5, 41)], [(1, 42)]]
    for k, part in enumerate(parts):
        for n, hour in part:
            spark.range(1).select(F.lit(n).cast("long").alias("k"), at(hour).alias("clock")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{k}"))
    schema = "k long, clock timestamp"
    import os
    import shutil

    (tmp_path / "in").mkdir()
    q = None
    for k in range(len(parts)):
        for i, f in enumerate((tmp_path / f"{k}").glob("*.parquet")):
            shutil.copy(f, tmp_path / "in" / f"{k}-{i}.parquet")
            os.utime(tmp_path / "in" / f"{k}-{i}.parquet", (1_600_000_000 + k * 10 + i,) * 2)
        stream = hosts.told_once(hosts.event_stream(spark, str(tmp_path / "in"), schema, 100), "k", "clock", "2 hours")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        if k == 2:
            assert hosts.late_rows(q) == 1  # key 4 came 36 hours behind
    told = sorted((r["k"], r["clock"].hour) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert [n for n, _ in told] == [1, 1, 2, 3, 5]  # the first key is told anew once its notification is old
