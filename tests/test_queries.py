"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sightline.operators import state
from sightline.plans import catalogue, join_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in found.description]
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted(names) == cols and mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def rows_of(duck, sql):
    found = duck.execute(sql)
    return [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]


def test_greedy_match_rows_by_replay(spark, duck):
    from itertools import groupby

    want = set()
    boxes = [tuple(r) for r in join_queries._boxes(spark, DATA).select("l_orderkey", "l_linenumber", "x0", "y0", "x1", "y1").collect()]
    for order, rows in groupby(sorted(boxes), lambda r: r[0]):
        rows = [r[1:] for r in rows]
        a, o = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
        pairs = sorted(((state.box_iou(x[1:], y[1:]), i, j) for i, x in enumerate(a) for j, y in enumerate(o)), reverse=True)
        used = set()
        for s, i, j in pairs:
            if s >= 0.05 and not {("a", i), ("o", j)} & used:
                used |= {("a", i), ("o", j)}
                want.add((order, a[i][0], o[j][0]))
    assert {tuple(r) for r in catalogue.QUERIES["greedy_match"](spark, DATA).collect()} == want and want


def test_tracker_fold_rows_by_replay(spark, duck):
    trackers, want = {}, {}
    for r in rows_of(duck, "SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events ORDER BY t, event_id"):
        v, tracker = r["value"], trackers.setdefault(r["user_id"], state.Tracker(reach=15.0))
        want[r["event_id"]] = tracker.update([(v, v, v + 10, v + 10)], r["t"] / 1e6)[0][0]
    assert {r["event_id"]: r["track"] for r in catalogue.QUERIES["tracker_fold"](spark, DATA).collect()} == want


def test_sequence_ratio_rows(spark, duck):
    from difflib import SequenceMatcher

    want = {r["o_orderkey"]: round(SequenceMatcher(None, str(r["o_custkey"]), str(r["o_orderkey"])).ratio(), 6) for r in rows_of(duck, "SELECT o_orderkey, o_custkey FROM orders")}
    assert {r["o_orderkey"]: r["ratio"] for r in catalogue.QUERIES["sequence_ratio"](spark, DATA).collect()} == want


def test_twins_by_replay(spark, duck):
    day, want = 24 * 3_600_000_000, {}
    rows = rows_of(duck, "SELECT user_id, event_id, event_type, value, epoch_us(ts) AS t FROM events ORDER BY t, event_id")
    by_user = {}
    for r in rows:
        by_user.setdefault(r["user_id"], []).append(r)
    readings = {r["event_id"]: r["reading"] for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "string(round(value, 1)) AS reading").collect()}
    for some in by_user.values():
        for a in some:
            for b in some:
                if a["event_type"] != b["event_type"] and a["event_id"] != b["event_id"] and a["t"] - day <= b["t"] <= a["t"] and state.similarity(readings[a["event_id"]], readings[b["event_id"]]) >= 0.8:
                    want.setdefault(a["event_id"], b["event_id"])
    assert {r["event_id"]: r["other_event_id"] for r in catalogue.QUERIES["similarity_twin_join"](spark, DATA).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
