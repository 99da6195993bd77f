"""Golden cases of the folds, the registry and the text functions."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import text as X
from sightline.operators import joins as J
from sightline.operators import votes, windows
from sightline.operators.folds import fold_groups
from sightline.operators.state import Registry, Tracker, bounded_queue, greedy_match, similarity, throttle


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


#: Readings whose split must be this one, codes, look-alikes (section 5 of FIXTURES.md, in its order).
@pytest.mark.parametrize(
    ("text", "want"),
    [("48.3.65.433", ("48.3", "65.433")), ("28.4.48.5", ("28.4", "48.5")), ("30.8.42.6", ("30.8", "42.6")), ("45.65.433", ("45", "65.433")), ("4.3.17.8", ("4.3", "17.8")), ("54.7-9.2", ("54.7", "9.2")), ("14.7-66.56", ("14.7", "66.56")), ("9.123-22.12", ("9.123", "22.12")), ("", None), ("abc", None), ("7", None), (None, None)],
)
def test_pairs(spark, text, want):
    got = texts(spark, [text]).select(X.parse_pair(F.col("text")).alias("p")).first()["p"]
    assert (got and (got["start"], got["end"])) == want


def test_codes_and_normalising(spark):
    #: Fixed values, as above.
    codes = ["88", "7841", "102", "8", "12345", "", "088"]
    assert [r[0] for r in texts(spark, codes).orderBy("i").select(X.parse_code(F.col("text"))).collect()] == ["88", "7841", "102", None, None, None, "88"]
    raw = ["4S.3", "1O.2", "48·3·65·433"]
    assert [r[0] for r in texts(spark, raw).orderBy("i").select(X.normalise(F.col("text"))).collect()] == ["45.3", "10.2", "48.3.65.433"]


def test_reading_text(spark):
    row = spark.range(1).select(X.format_reading(F.lit("88"), F.lit("48.3"), F.lit("65.433")), X.format_reading(F.lit(None).cast("string"), F.lit(""), F.lit("1"))).first()
    assert tuple(row) == ("ply 88   48.3-65.433", "ply ?   ?")


def confirm(r, camera, track, code, start, end, now):
    return r.confirm(camera, track, code, (start, end) if start else None, 1.0, now)


#: Readings and times of the identity cases, down to test_forgetting (FIXTURES.md, rows I1 to I19).
def test_same_code_on_two_cameras():
    r = Registry()
    assert confirm(r, "c1", 1, "88", "1.0", "2.0", 10) == confirm(r, "c2", 1, "88", "1.0", "2.0", 10.4) == "ROLL-88"
    assert sorted(r.entities["ROLL-88"].cameras) == ["c1", "c2"]


@pytest.mark.parametrize(("zone", "t", "same"), [(True, 5.3, True), (False, 5.3, False), (True, 99, False), (True, 6.5, True)])
def test_links_in_the_zone(zone, t, same):
    r = Registry()
    assert (r.sight("c1", 1, zone, 5.0) == r.sight("c2", 1, zone, t)) is same


def test_refined_and_rekeyed():
    r = Registry()
    first = confirm(r, "c1", 1, None, "54.7", "9.2", 10)
    assert first.startswith("ROLL-U") and r.entities[first].status == "partial"
    assert confirm(r, "c1", 1, None, "54.7", "9.21", 11) == first and r.entities[first].pair == ("54.7", "9.21")
    assert confirm(r, "c1", 1, "88", "54.7", "9.21", 12) == "ROLL-88" and list(r.entities) == ["ROLL-88"]
    assert r.entities["ROLL-88"].status == "read"


@pytest.mark.parametrize(("pair", "t", "same"), [(("54.7", "9.21"), 10.5, True), (("81.2", "3.4"), 10.5, False), (("54.7", "9.21"), 24, True), (("54.7", "9.21"), 45, False)])
def test_twins(pair, t, same):
    r = Registry()
    a = confirm(r, "c2", 1, None, "54.7", "9.2", 10)
    assert (confirm(r, "c1", 1, None, *pair, t) == a) is same


def test_forgetting():
    r = Registry()
    r.sight("c1", 1, False, 0.5)
    assert r.cleanup(180.4) == [] and len(r.cleanup(180.6)) == 1


def test_folds():
    assert throttle([1_000_000, 1_400_000, 1_450_000], 450_000)[0] == [True, False, True]
    assert list(bounded_queue([0, 0, 0, 10], 2, 10)) == [True, True, False, True]
    assert greedy_match([(0.5, 1, 1), (0.5, 2, 1), (0.4, 1, 2)]) == [(2, 1), (1, 2)]
    assert similarity("54.7", "") == 0.0 and similarity("54792", "547921") == pytest.approx(10 / 11)
    t = Tracker()
    assert t.update([(0, 0, 10, 10)], 0)[0] == [1]
    for k in range(18):
        assert t.update([], k)[1] == []
    assert t.update([], 19)[1] == [1]


def test_tracker_pairs_by_overlap_and_distance_of_centres():
    t = Tracker(reach=50.0)
    assert t.update([(0, 0, 10, 10), (100, 0, 110, 10)], 0)[0] == [1, 2]
    assert t.update([(130, 40, 140, 50), (33, 36, 43, 46)], 1)[0] == [2, 1]  # 50 and 49 away along the diagonal
    assert t.update([(170, 90, 180, 100)], 2)[0] == [3]  # 50 down and 40 across: 64 away
    t = Tracker(reach=20.0)
    t.update([(0, 0, 10, 10), (0, 14, 10, 24)], 0)
    assert t.update([(0, 6, 10, 16)], 1)[0] == [1]  # overlap 0.25 and 6 away against 2 / 18 and 8 away


def test_votes(spark):
    df = spark.createDataFrame([("a", v) for v in "xx"] + [("b", "x")] + [("c", v) for v in "xxyy"] + [("d", v) for v in "xxxyy"] + [("d", None)], "k string, v string")
    assert dict(votes.winner(df, "k", "v").select("k", "winner").collect()) == {"a": "x", "b": None, "c": None, "d": "x"}


def test_reconcile_verdicts(spark):
    reads = spark.createDataFrame([("", "1", "2"), ("5", "1", "2"), ("88", "4.7", "9"), ("88", "4.70", "9")], "ply string, start string, end string")
    listed = spark.createDataFrame([("088", "4.7", "9"), ("88", "0", "0")], "ply_no string, start string, end string")
    got = J.reconcile(reads, listed, "ply", X.stripped_key(F.col("ply_no")), ["ply_no"], ["start", "end"])
    want = {("", "1"): "no_ply", ("5", "1"): "ply_absent", ("88", "4.7"): "exact", ("88", "4.70"): "values_differ"}
    rows = got.collect()
    assert len(rows) == 4 and {(r["ply"], r["start"]): r["verdict"] for r in rows} == want


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(x) for x in v)
    row = spark.range(1).select(G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), G.overlaps(b(0, 0, 10, 10), b(10, 0, 20, 10))).first()
    assert row[0] == pytest.approx(50 / 150) and row[1] is True


def test_asof(spark):
    rows = spark.createDataFrame([(5, 50), (25, 250), (95, 950)], "t long, v long")
    got = dict(windows.first_at_or_after(rows, "t", ["v"], 10).collect())
    assert got == {0: 50, 10: 250, 20: 250, **{i: 950 for i in range(30, 100, 10)}}
    assert windows.first_at_or_after(rows.limit(0), "t", ["v"], 10).count() == 0


def test_fold_groups_streams_in_order(spark):
    df = spark.createDataFrame([(i % 50, 1000 - i) for i in range(1000)], "k long, t long")
    out = fold_groups(df, ["k"], ["t"], [], lambda key, rows: [(key[0], [t for (t,) in rows])], "k long, ts array<long>").collect()
    assert len(out) == 50 and all(r["ts"] == sorted(r["ts"]) and len(r["ts"]) == 20 for r in out)
