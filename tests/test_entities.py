import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sightline.operators import results, state
from sightline.plans import station_queries
from sightline.streaming import entities, hosts

DATA = "/root/testdata/sf0.001"
ROW = "site long, t long, number long, camera string, track long, is_result boolean, in_zone boolean, code string, start string, end string, empty boolean, clock timestamp"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def run(spark, parts, folder, late="60 seconds", unit=1e6, **settings):
    """The log of a stream that gets one part a trigger, and the progress of its last trigger."""
    for k, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in Path(f"{folder}/in").glob("*.parquet"):
            if f.stat().st_mtime > 1_600_000_000 + 1000:
                os.utime(f, (1_600_000_000 + k * 10,) * 2)
    stream = hosts.event_stream(entities.prepared(spark), f"{folder}/in", ROW, 1)
    out = entities.result_stream(stream, "site", "clock", late, unit, **settings)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    again = entities.result_stream(stream, "site", "clock", late, unit, **settings)
    q = again.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()  # a restart reads on where the last run ended: nothing new
    return spark.read.parquet(f"{folder}/out"), Path(f"{folder}/c")


def rows(spark, plain):
    return spark.createDataFrame([(*r, None) for r in plain], ROW).withColumn("clock", F.timestamp_micros("t"))


def seen(site, at, number, camera="a", track=1, code=None, pair=(None, None), result=False, zone=True):
    return site, int((at + 1000) * 1e6), number, camera, track, result, zone, code, *pair, False


def ending(at=10_000_000):
    """A row of another site, far behind the others: the watermark passes them."""
    return [seen(99, at, 1)]


@needs_tables
def test_rows_shuffled_over_triggers_give_the_batch_log(spark, tmp_path):
    unit = 3_600_000_000
    table = station_queries.result_rows(spark, DATA).where("site < 6").withColumn("site", F.col("site").cast("long")).withColumn("track", F.col("track").cast("long"))
    table = table.withColumn("clock", F.timestamp_micros((F.col("t") / 3600).cast("long"))).select(*(c.split()[0] for c in ROW.split(", ")))
    moved = F.floor((F.col("t") / unit + F.pmod(F.xxhash64("number"), F.lit(40)) - F.lit(473_000)) / 150)
    parts = [table.where(moved == n) for n in sorted(r[0] for r in table.select(moved).distinct().collect())]
    assert len(parts) >= 4
    last = rows(spark, ending()).withColumn("clock", F.lit("2100-01-01").cast("timestamp"))
    log, _ = run(spark, [*parts, last], str(tmp_path), "60 seconds", unit, alive=120.0, rest=200.0)
    batch = results.result_log(table, "site", "t", "number", unit, alive=120.0, rest=200.0)
    assert sorted(log.collect(), key=repr) == sorted(batch.collect(), key=repr) and batch.count() > 100


def test_cases_of_identity_across_triggers(spark, tmp_path):
    """Two cameras see one thing in the shared zone, its code comes later, its name changes, a twin joins, a late result is told."""
    pair = ("3.1", "6.2")
    first = [seen(1, 0, 1, "a", 1), seen(1, 1.0, 2, "b", 7), seen(1, 2, 3, "a", 1, "47", pair, True)]
    second = [seen(1, 1.5, 4, "b", 7), seen(1, 3, 5, "a", 1, "47", pair, True), seen(1, 4, 6, "b", 7, None, pair, True), seen(1, 4.5, 7, "b", 7, None, pair, True)]
    third = [seen(1, 20, 8, "b", 7, None, pair, True), seen(1, 400, 9, "a", 2), seen(1, 401, 10, "a", 2, None, pair, True), seen(1, 402, 11, "a", 2, None, pair, True)]
    plain = [*first, *second, *third]
    random.Random(1).shuffle(second)
    log, _ = run(spark, [rows(spark, p) for p in (first, second, third, ending())], str(tmp_path), rest=1000.0)
    batch = results.result_log(rows(spark, plain), "site", "t", "number", 1e6, rest=1000.0).collect()
    assert sorted(log.collect(), key=repr) == sorted(batch, key=repr)
    assert {"late", "read", "confirmed"} <= {r["action"] for r in batch} and "ROLL-47" in {r["name"] for r in batch}


def state_rows(folder: Path) -> int:
    return sum(1 for _ in folder.glob("state/0/*/*"))


def test_an_idle_site_leaves_no_state(spark, tmp_path):
    idle = [seen(1, at, at, "a", at % 3) for at in range(20)] + [seen(1, 20 + at, 50 + at, "a", 1, "4", ("1", "2"), True) for at in range(3)]
    busy = [[seen(2, at + 100 * k, at, "b", 1) for at in range(0, 100, 2)] for k in range(8)]
    totals = {}
    for name, extra in (("with", idle), ("without", [])):
        folder = tmp_path / name
        stop = [rows(spark, [*extra, *busy[0]]), *(rows(spark, b) for b in busy[1:])]
        for k, df in enumerate(stop):
            df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            for f in Path(f"{folder}/in").glob("*.parquet"):
                if f.stat().st_mtime > 1_600_000_000 + 1000:
                    os.utime(f, (1_600_000_000 + k * 10,) * 2)
        stream = hosts.event_stream(entities.prepared(spark), f"{folder}/in", ROW, 1)
        q = entities.result_stream(stream, "site", "clock", "10 seconds", rest=300.0).writeStream.format("noop").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        totals[name] = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(totals["with"]) > max(totals["without"]) and totals["with"][-1] == totals["without"][-1] > 0


def test_a_rested_site_numbers_anew():
    fold = state.ResultFold(rest=500.0)
    fold.see("a", 1, False, 0.0)
    fold.see("a", 2, False, 400.0)
    fold.see("a", 3, False, 1000.0)
    assert list(fold.registry.entities) == ["ROLL-U1"]
    with pytest.raises(ValueError):
        state.ResultFold(rest=1.0)


def test_entries_restore_a_fold():
    r = random.Random(4)
    fold, other = state.ResultFold(rest=900.0), state.ResultFold(rest=900.0)
    now = 0.0
    for _ in range(1500):
        now += r.choice([0.0, 0.4, 1.0, 3.0, 40.0])
        camera, track, zone = r.choice("ab"), r.randrange(6), r.random() < 0.6
        other = entities.restored(entities.entity_entries(other), entities.track_entries(other), (other.registry.unnamed, other.registry.steps, other.latest), rest=900.0)
        if r.random() < 0.5:
            fold.see(camera, track, zone, now)
            other.see(camera, track, zone, now)
        else:
            args = (camera, track, r.choice([None, "47", "48"]), r.choice([None, ("1", "2"), ("1", "25")]), r.random() < 0.1, zone, now)
            assert fold.result(*args) == other.result(*args)
    assert entities.entity_entries(fold) == entities.entity_entries(other) and entities.track_entries(fold) == entities.track_entries(other)
