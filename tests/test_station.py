"""The station's folds and sinks: rows against plain replays, streams against batches, reports and readers."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import text as X
from sightline.operators import results, state, windows
from sightline.plans import catalogue, station_queries
from sightline.sources import tables
from sightline.streaming import hosts

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


class PlainRegistry:
    """The rules of identity by walking lists: no index, no order of recency."""

    def __init__(self, sync=1.5, twin=30.0, forget=180.0):
        self.sync, self.twin, self.forget, self.n = sync, twin, forget, 0
        self.found, self.tracks, self.codes = [], {}, {}

    def get(self, name):
        return next((e for e in self.found if e["id"] == name), None)

    def new(self, name, now, open_):
        if name is None:
            self.n += 1
            name = f"ROLL-U{self.n}"
        self.found.append({"id": name, "open": open_, "last": now, "code": None, "pair": None, "seen": {}})
        return self.found[-1]

    def sight(self, camera, track, zone, now):
        if (camera, track) not in self.tracks:
            for (c, _), name in self.tracks.items() if zone else ():
                e = self.get(name)
                if c != camera and e and e["open"] and not e["code"] and now - e["last"] <= self.sync and e["seen"].get(c, (0, False))[1]:
                    break
            else:
                e = self.new(None, now, True)
            self.tracks[camera, track] = e["id"]
        e = self.get(self.tracks[camera, track])
        e["last"], e["seen"][camera] = now, (track, zone)
        return e["id"]

    def confirm(self, camera, track, code, pair, zone, now):
        before = self.tracks.get((camera, track))
        target, old = None, self.get(before)
        if code:
            target = self.codes.get(code, f"ROLL-{code}")
        elif old and not old["open"]:
            target = before
        else:
            for e in self.found:
                if not e["open"] and not e["code"] and camera not in e["seen"] and now - e["last"] <= self.twin and e["pair"] and state.similarity("".join(pair), "".join(e["pair"])) >= 0.8:
                    target = e["id"]
                    break
        target = target or before
        e = self.get(target) or self.new(target, now, False)
        if before and before != target:
            if old:
                self.found.remove(old)
                e["seen"] = old["seen"] | e["seen"]
                self.codes.pop(old["code"], None)
            self.tracks = {k: target if v == before else v for k, v in self.tracks.items()}
        e["open"], e["code"], e["pair"], e["last"] = False, code, pair, now
        if code:
            self.codes[code] = target
        self.tracks[camera, track] = e["id"]
        e["seen"][camera] = (track, zone)
        return e["id"]

    def clean(self, now):
        for e in [e for e in self.found if now - e["last"] > self.forget]:
            self.found.remove(e)
            self.codes.pop(e["code"], None)
            self.tracks = {k: v for k, v in self.tracks.items() if v != e["id"]}


def rows_of(sql):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return c.execute(sql).fetchall()


@needs_tables
def test_identity_fold_rows_by_replay(spark):
    sites, want, hour = {}, {}, 3_600_000_000
    for u, event, v, t in rows_of("SELECT user_id, event_id, value, epoch_us(ts) FROM events ORDER BY ts, event_id"):
        r, now, camera = sites.setdefault(u // 10, PlainRegistry()), t / hour, f"cam{event % 2}"
        name = r.sight(camera, u, v < 40, now)
        if v > 20:
            name = r.confirm(camera, u, str(10 + u % 60) if event % 3 == 0 else None, (f"{v:.1f}", f"{u % 50}.5"), v < 40, now)
        if event % 7 == 0:
            r.tracks.pop((camera, u), None)
        r.clean(now)
        want[event] = name
    got = {r["event_id"]: r["entity"] for r in catalogue.QUERIES["identity_fold"](spark, DATA).collect()}
    assert got == want and len({k.split("-")[1][0] for k in want.values()}) > 1


@needs_tables
def test_result_log_and_summary_by_replay(spark):
    rows = sorted((tuple(r) for r in station_queries.result_rows(spark, DATA).collect()), key=lambda r: (r[1], r[2]))
    sites, log, table = {}, [], {}
    for site, t, number, camera, track, is_result, zone, code, start, end, empty in rows:
        now = t / 3_600_000_000
        registry, tracks = sites.setdefault(site, (PlainRegistry(), {}))
        for key in [k for k, x in tracks.items() if now - x["last"] > 120]:
            del tracks[key]
            registry.tracks.pop(key, None)
        registry.clean(now)
        key = (camera, track)
        if not is_result:
            tracks.setdefault(key, {"votes": (Counter(), Counter()), "voted": (None, None), "logged": None})["last"] = now
            registry.sight(camera, track, zone, now)
            continue
        if key not in tracks or empty:
            log.append((site, number, "empty" if key in tracks else "late", None))
            continue
        log.append((site, number, "read", None))
        x = tracks[key]
        for votes, value in zip(x["votes"], (code, (start, end) if start else None), strict=True):
            votes[value] += value is not None
        voted = []
        for votes in x["votes"]:
            ranked = sorted(((n, v) for v, n in votes.items() if v is not None), key=lambda p: -p[0]) + [(0, None)] * 2
            voted.append(ranked[0][1] if ranked[0][0] >= 2 and ranked[0][0] > ranked[1][0] else None)
        if tuple(voted) != x["voted"]:
            x["voted"] = tuple(voted)
            if voted[1]:
                name = registry.confirm(camera, track, voted[0], voted[1], zone, now)
                if x["logged"] and x["logged"] != name:
                    log.append((site, number, "drop", x["logged"]))
                    table.pop((site, x["logged"]), None)
                log.append((site, number, "confirmed_again" if x["logged"] else "confirmed", name))
                table[site, name] = (voted[0], *voted[1])
                x["logged"] = name
    got = catalogue.QUERIES["result_fold"](spark, DATA)
    assert Counter((r["site"], r["number"], r["action"], r["name"]) for r in got.collect()) == Counter(log)
    assert {a for *_, a, _ in log} == {"late", "empty", "read", "drop", "confirmed", "confirmed_again"}
    rows = catalogue.QUERIES["result_summary"](spark, DATA).collect()
    assert {(r["site"], r["name"]): (r["code"], r["start"], r["end"]) for r in rows} == table and len(rows) == len(table)
    assert all(r["status"] == ("read" if r["code"] else "partial") and 0 < r["confidence"] <= 1 and r["first"] * 3_600_000_000 <= r["t"] + 1 for r in rows)


def test_registry_rules():
    r = state.Registry()
    r.sight("a", 1, True, 1.0)
    r.sight("a", 2, True, 1.1)
    assert r.sight("b", 1, True, 2.0) == "ROLL-U1"  # the one assigned first, not the one seen last
    assert r.sight("b", 9, True, 2.1) == "ROLL-U1" and r.sight("b", 8, False, 2.1) == "ROLL-U3"
    r = state.Registry()
    assert r.confirm("a", 1, "47", ("3.1", "6.2"), 1.0, 5) == "ROLL-47"
    assert r.confirm("a", 1, None, ("3.1", "6.2"), 1.0, 6) == "ROLL-47" and r.confirm("b", 3, "47", None, 1.0, 7) == "ROLL-47"
    assert r.holds("a", 1) and not r.holds("a", 2)
    r.release("a", 1)
    assert not r.holds("a", 1) and list(r.entities) == ["ROLL-47"] and r.observe("a", 1, False, 8) is None
    assert r.cleanup(400) == ["ROLL-47"] and not (r.owner or r.since or r.by_code)


def plain_split(group, typical):
    if max(s[1] for s in group) - min(s[0] for s in group) <= 1.8 * typical or len(group) < 4:
        return [group]
    group = sorted(group, key=lambda s: s[2])
    gaps = [group[i][2] - group[i - 1][2] for i in range(1, len(group))]
    cut = max(i for i in range(1, len(group)) if gaps[i - 1] == max(gaps))
    a, b = group[:cut], group[cut:]
    ends = [(min(s[0] for s in g), max(s[1] for s in g)) for g in (a, b)]
    both = min(e[1] for e in ends) - max(e[0] for e in ends)
    if max(gaps) < 0.35 * typical or max(0, both) / max(1, min(y - x for x, y in ends)) > 0.28:
        return [group]
    return plain_split(a, typical) + plain_split(b, typical)


@needs_tables
def test_over_tall_split_rows_by_replay(spark):
    got, strokes = {}, {}
    for r in catalogue.QUERIES["over_tall_split"](spark, DATA).collect():
        cy = r["l_partkey"] % 60
        got.setdefault(r["l_orderkey"], {}).setdefault(r["line"], []).append((cy - r["l_linenumber"], cy + 5, cy))
        strokes.setdefault(r["l_orderkey"], []).append((cy - r["l_linenumber"], cy + 5, cy))
    for order, group in strokes.items():
        want = plain_split(group, 10.0)
        assert [sorted(got[order][i]) for i in range(len(want))] == [sorted(g) for g in want] and len(got[order]) == len(want)
    assert max(map(len, got.values())) >= 3


def test_zone_crop_and_names(spark):
    lit = lambda *v: tuple(map(F.lit, v))
    row = spark.range(1).select(
        G.padded_crop(lit(0, 0, 20, 10), F.lit(25), F.lit(12)), G.padded_crop(lit(90, 0, 95, 10), F.lit(25), F.lit(12)), X.label(F.lit("a b/c" * 9)),
        X.run_name(F.lit("2024-02-03 04:05:06").cast("timestamp"), F.array().cast("array<string>")), X.span(F.lit("4.5"), F.lit("?")), G.scale_factor(F.lit(None).cast("int"), F.lit(10), F.lit(400)),
    ).first()
    assert tuple(row[0]) == (0, 0, 25, 12) and row[1] is None and row[2] == ("abc" * 9)[:24] and row[3] == "20240203-040506_run" and row[4] is None
    assert row[5] == pytest.approx(2.4)


def test_displacement_looks_at_so_many_rows(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(10)], "k long, t long, x double, y double")
    got = [r["moved"] for r in windows.displacement(df, "k", ["t"], "t", "x", "y", 100, most=3).orderBy("t").collect()]
    assert got == [0.0, 1.0] + [2.0] * 8


def test_reports_images_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 1), ("a", "é,", 2)], "name string, code string, n int")
    tables.write_csv(df, str(tmp_path / "r"), ["n", "name", "code"], ["name"])
    text = [line for f in sorted((tmp_path / "r").glob("*.csv")) for line in f.read_text().splitlines()]
    assert [x for x in text if x != "n,name,code"] == ['2,a,"é,"', "1,b,"] and text[0] == "n,name,code"
    (tmp_path / "i").mkdir()
    for name, content in (("x.PNG", b"1"), ("y.txt", b"1"), ("z.jpg", b"")):
        (tmp_path / "i" / name).write_bytes(content)
    assert [r["path"].rsplit("/")[-1] for r in tables.images(spark, str(tmp_path / "i")).collect()] == ["x.PNG"]
    seen = Observation("seen")
    assert hosts.counted(df, seen, dropped=F.col("code").isNull()).count() == 2 and seen.get == {"processed": 2, "dropped": 1}
    assert math.isclose(state.Reads(Counter("aab"), Counter("x"), "a", "x").confidence, 0.833)
