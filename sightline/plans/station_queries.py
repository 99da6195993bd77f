"""Queries of a station: gates, zones, crops, ticks, names, and the fold of results; and their SQL."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import joins as J
from ..operators import results, state, windows
from ..operators.folds import fold_groups
from ..sources.tables import events, table
from .event_queries import E, H
from .join_queries import _B, _boxes

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _points(spark, d):
    return events(spark, d).withColumn("x", F.col("value")).withColumn("y", (F.col("event_id") * 37 % 100).cast("double"))


def displacement(spark, d):
    moved = windows.displacement(_points(spark, d), "user_id", ["t", "event_id"], "t", "x", "y", 6 * H)
    return moved.select("event_id", F.round("moved", 6).alias("moved"))


def detection_gates(spark, d):
    rows = _boxes(spark, d).join(table(spark, d, "lineitem").select(*LINE, "l_quantity", "l_discount").distinct(), LINE)
    ok = G.detected(F.col("l_quantity") * 20, F.col("l_linenumber"), G.box(""), F.lit(10_000), F.col("l_discount"), F.col("l_suppkey") % 25 + 5, G.box("o"))
    return rows.where(ok).select(*LINE).distinct()


def reading_eligibility(spark, d):
    """Rows that are sent to be read: of an active, sharp, high and moving track that is not fully read; 6 hours after the last one sent; 40 at most."""
    own = Window.partitionBy("user_id")
    e = windows.displacement(_points(spark, d), "user_id", ["t", "event_id"], "t", "x", "y", 24 * H)
    e = e.withColumn("hits", F.row_number().over(own.orderBy("t", "event_id"))).withColumn("seen", F.col("t") - F.min("t").over(own))
    e = e.withColumn("read_at", F.min(F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("t"))).over(own))
    still = (F.col("seen") > 24 * H) & (F.col("moved") < 60)
    open_ = F.col("read_at").isNull() | (F.col("t") <= F.col("read_at"))
    e = e.where((F.col("hits") >= 3) & (F.col("value") >= 28) & (10 + F.col("event_id") % 9 >= 14) & ~still & open_)

    def fold(_, rows):
        return ((event,) for _, event in islice(state.throttled(rows, 6 * H), 40))

    return fold_groups(e, ["user_id"], ["t", "event_id"], [], fold, "event_id long")


#: Kind of event and the shares of the frame that its camera's zone has.
SIDES = {"click": (0.2, 0.1, 0.6, 0.5), "view": (0.0, 0.25, 0.45, 1.0)}


def in_zone(e, kind):
    """The events of a kind whose box lies in the zone of its camera; e is a table or a stream."""
    x, y = F.col("value"), F.col("event_id") % 60
    box = (x, y, x + 10, y + 8)
    return e.where((F.col("event_type") == kind) & G.overlaps(box, G.zone(tuple(map(F.lit, SIDES[kind])), F.lit(100), F.lit(80), False)))


def zone_link_join(spark, d):
    """Each click in its zone with the first view of the same user in its zone in the six hours before."""
    e = events(spark, d)
    click, view = (in_zone(e, k).select("user_id", "event_id", "t") for k in SIDES)
    j = J.within(click, view, ["user_id"], "t", 6 * H, "other_")
    return J.first_in(j, ["event_id"], ["other_t", "other_event_id"]).select("event_id", "other_event_id")


def zone_rounding(spark, d):
    shares = tuple(F.expr(s) for s in ("l_discount / 2", "l_tax / 2", "l_discount / 2 + 0.43", "l_tax / 2 + 0.37"))
    whole, exact = (G.zone(shares, F.lit(1919), F.lit(1079), w) for w in (True, False))
    named = lambda z, p: (c.alias(f"{p}{n}") for c, n in zip(z, ("x0", "y0", "x1", "y1"), strict=True))
    return table(spark, d, "lineitem").select("l_orderkey", *named(whole, "w"), *named((F.round(c, 6) for c in exact), "e"))


def zone_fractions(spark, d):
    shares = G.zone_shares(G.box(""), F.lit(600), F.lit(300))
    return _boxes(spark, d).select(*LINE, *(c.alias(f"s{i}") for i, c in enumerate(shares)))


def padded_crop(spark, d):
    return _boxes(spark, d).select(*LINE, G.padded_crop(G.box(""), F.lit(90), F.lit(45)).alias("c")).select(*LINE, "c.x0", "c.y0", "c.x1", "c.y1")


def scale_factor(spark, d):
    high = F.when(F.col("l_linenumber") < 7, F.col("l_partkey") % 180)
    return _boxes(spark, d).select(*LINE, F.round(G.scale_factor(high, F.col("l_partkey") % 900, F.col("l_suppkey") * 7 % 500), 6).alias("factor"))


def over_tall_split(spark, d):
    """Lines of text (from 0, downwards) of the strokes of each order; a line stands for a stroke."""
    s = _boxes(spark, d).select(*LINE, (F.col("l_partkey") % 60).alias("cy"))

    def fold(key, rows):
        rows = list(rows)  # the strokes of one marking
        parts = state.split_tall([(cy - n, cy + 5, cy) for n, _, _, cy in rows], 10.0)
        return ((key[0], *rows[i][:3], line) for line, part in enumerate(parts) for i in part)

    return fold_groups(s, ["l_orderkey"], [*LINE[1:], "cy"], [], fold, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, line int")


def skipped_ticks(spark, d):
    """How many ticks each served tick has skipped, and all of its key up to it."""
    ticks = events(spark, d).select("user_id", F.floor(F.col("t") / (24 * H)).alias("tick")).distinct()
    w = Window.partitionBy("user_id").orderBy("tick")
    skipped = F.greatest(F.col("tick") - F.coalesce(F.lag("tick").over(w), F.col("tick") - 1) - 1, F.lit(0))
    return ticks.withColumn("skipped", skipped).withColumn("dropped", F.sum("skipped").over(w))


def tick_sample_once(spark, d):
    return windows.each_once_at_or_after(events(spark, d), "user_id", ["t", "event_id"], "t", 24 * H).select("user_id", "n", "event_id")


def run_directory(spark, d):
    """A run of each region, named for its nations."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", X.label(F.concat(F.col("n_name"), F.lit(" é-cam_/.mp4"))).alias("l")))).alias("a"))
    at = F.timestamp_seconds(F.col("n_regionkey") * 100_003)
    return n.select("n_regionkey", X.run_name(F.to_timestamp_ntz(at.cast("string")), F.transform("a", lambda x: x["l"])).alias("name"))


def status_label(spark, d):
    code = F.when(F.col("event_id") % 5 > 1, F.col("event_type")).when(F.col("event_id") % 5 == 1, "")
    return events(spark, d).select("event_id", X.status(F.col("value") < 10, code).alias("status"))


def reading_span(spark, d):
    start, end = F.when(F.col("event_id") % 9 > 0, F.concat(F.col("event_id") % 30, F.lit("."), F.col("event_id") % 8)), F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 90).cast("string")).otherwise("?")
    return events(spark, d).select("event_id", X.span(start, end).alias("span_m"))


def settled_entities(spark, d):
    """Entities that are no longer provisional: a key with a code on any row."""
    e = events(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("value") > 70, F.col("event_type"))).alias("code"), F.max("t").alias("last_seen"))
    return e.withColumn("status", X.status(F.col("code").isNull(), F.col("code"))).where("status <> 'pending'").select("user_id", "code", "last_seen")


def owner_check(spark, d):
    """The entity shown at each row: its own, unless another track was the last one of that entity seen in this camera."""
    e = events(spark, d).select("event_id", "event_type", "user_id", "t", (F.col("user_id") % 40).alias("entity"))
    last = e.groupBy("entity", "event_type").agg(F.max(F.struct("t", "event_id", "user_id")).alias("m")).select("entity", "event_type", F.col("m.user_id").alias("holder"))
    return e.join(last, ["entity", "event_type"]).select("event_id", F.when(F.col("holder") == F.col("user_id"), F.col("entity")).alias("shown"))


def result_rows(spark, d):
    """Sights and results of the tracks of sites of ten users, over two cameras."""
    u, n = F.col("user_id"), F.col("event_id")
    pair = n % 5 > 0
    return events(spark, d).select(
        F.floor(u / 10).alias("site"), "t", n.alias("number"), F.concat(F.lit("cam"), n % 2).alias("camera"), u.cast("int").alias("track"),
        (n % 3 > 0).alias("is_result"), (F.col("value") < 40).alias("in_zone"), F.when(n % 4 == 1, (10 + u % 60).cast("string")).alias("code"),
        F.when(pair, F.concat(u % 50, F.lit(".5"))).alias("start"), F.when(pair, F.concat(F.lit("60."), F.when(F.col("value") > 60, 5).otherwise(25))).alias("end"), (n % 11 == 0).alias("empty"),
    )


SETTINGS = {"alive": 120.0}


def result_fold(spark, d):
    return results.result_log(result_rows(spark, d), "site", "t", "number", H, **SETTINGS)


def result_summary(spark, d):
    return results.summary(result_fold(spark, d), "site")


QUERIES = {f.__name__: f for f in (displacement, detection_gates, reading_eligibility, zone_link_join, zone_rounding, zone_fractions, padded_crop, scale_factor, over_tall_split, skipped_ticks, tick_sample_once, run_directory, status_label, reading_span, settled_entities, owner_check, result_fold, result_summary)}

_L = ", ".join(LINE)
_MOVED = """p AS (SELECT *, value AS x, (event_id * 37 % 100)::DOUBLE AS y FROM e), w AS (SELECT *, list({{t: t, x: x, y: y}}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS h FROM p),
 f AS (SELECT * EXCLUDE (h), list_filter(h, lambda q: q.t >= t - {span}) AS h FROM w),
 m AS (SELECT * EXCLUDE (h), greatest(list_max(list_transform(h, lambda q: q.x)) - list_min(list_transform(h, lambda q: q.x)), list_max(list_transform(h, lambda q: q.y)) - list_min(list_transform(h, lambda q: q.y))) AS moved FROM f)"""
SQL = {
    "displacement": f"{E}, {_MOVED.format(span=6 * H)} SELECT event_id, round(moved, 6) AS moved FROM m",
    "detection_gates": f"WITH b AS (SELECT *, {_B} FROM lineitem) SELECT DISTINCT {_L} FROM b WHERE l_quantity * 20 >= 120 AND l_linenumber >= 2 AND x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / 10000 <= 0.06 AND l_discount >= 0.05 AND l_suppkey % 25 + 5 >= 14 AND x0 <= ox1 AND ox0 <= x1 AND y0 <= oy1 AND oy0 <= y1",
    "reading_eligibility": f"""WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t FROM events), {_MOVED.format(span=24 * H)},
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS hits, t - min(t) OVER (PARTITION BY user_id) AS seen, min(CASE WHEN event_type = 'purchase' AND value > 60 THEN t END) OVER (PARTITION BY user_id) AS read_at FROM m),
 g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM k WHERE hits >= 3 AND value >= 28 AND 10 + event_id % 9 >= 14 AND NOT (seen > {24 * H} AND moved < 60) AND (read_at IS NULL OR t <= read_at)),
 r AS (SELECT user_id, event_id, n, t AS last, true AS ok, 1 AS sent FROM g WHERE n = 1
  UNION ALL SELECT g.user_id, g.event_id, g.n, CASE WHEN g.t - r.last >= {6 * H} THEN g.t ELSE r.last END, g.t - r.last >= {6 * H}, r.sent + (g.t - r.last >= {6 * H})::INT FROM r JOIN g ON g.user_id = r.user_id AND g.n = r.n + 1)
 SELECT event_id FROM r WHERE ok AND sent <= 40""",
    "zone_link_join": f"""{E}, b AS (SELECT *, value + 10 AS x1, event_id % 60 AS y0, event_id % 60 + 8 AS y1 FROM e),
 c AS (SELECT * FROM b WHERE event_type = 'click' AND value <= 0.6::DOUBLE * 100 AND 0.2::DOUBLE * 100 <= x1 AND y0 <= 0.5::DOUBLE * 80 AND 0.1::DOUBLE * 80 <= y1),
 v AS (SELECT * FROM b WHERE event_type = 'view' AND value <= 0.45::DOUBLE * 100 AND 0 <= x1 AND y0 <= 80 AND 0.25::DOUBLE * 80 <= y1)
 SELECT c.event_id, v.event_id AS other_event_id FROM c JOIN v ON c.user_id = v.user_id AND v.t BETWEEN c.t - {6 * H} AND c.t QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY v.t, v.event_id) = 1""",
    "zone_rounding": "WITH s AS (SELECT l_orderkey, l_discount / 2 * 1919 AS ex0, l_tax / 2 * 1079 AS ey0, (l_discount / 2 + 0.43::DOUBLE) * 1919 AS ex1, (l_tax / 2 + 0.37::DOUBLE) * 1079 AS ey1 FROM lineitem) SELECT l_orderkey, trunc(ex0)::INT AS wx0, trunc(ey0)::INT AS wy0, trunc(ex1)::INT AS wx1, trunc(ey1)::INT AS wy1, round(ex0, 6) AS ex0, round(ey0, 6) AS ey0, round(ex1, 6) AS ex1, round(ey1, 6) AS ey1 FROM s",
    "zone_fractions": f"WITH b AS (SELECT *, {_B} FROM lineitem) SELECT {_L}, round(x0 / 600, 4) AS s0, round(y0 / 300, 4) AS s1, round(x1 / 600, 4) AS s2, round(y1 / 300, 4) AS s3 FROM b",
    "padded_crop": f"""WITH b AS (SELECT *, {_B} FROM lineitem), p AS (SELECT {_L}, greatest(x0 - trunc((x1 - x0) * 0.15::DOUBLE)::INT - 10, 0) AS x0, greatest(y0 - trunc((y1 - y0) * 0.4::DOUBLE)::INT - 10, 0) AS y0, least(x1 + trunc((x1 - x0) * 0.15::DOUBLE)::INT + 10, 90) AS x1, least(y1 + trunc((y1 - y0) * 0.4::DOUBLE)::INT + 10, 45) AS y1 FROM b)
 SELECT {_L}, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END::INT AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END::INT AS y0, CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END::INT AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END::INT AS y1 FROM p""",
    "scale_factor": f"""WITH f AS (SELECT *, least(greatest(80 / CASE WHEN l_linenumber < 7 THEN greatest((l_partkey % 180) / 2, 8) ELSE 25 END, 1), 6) AS f, greatest(l_partkey % 900, l_suppkey * 7 % 500) AS side FROM lineitem)
 SELECT {_L}, round(CASE WHEN side * f > 960 THEN f * 960 / (side * f) ELSE f END, 6)::DOUBLE AS factor FROM f""",
    "skipped_ticks": f"{E}, k AS (SELECT DISTINCT user_id, (t // {24 * H})::BIGINT AS tick FROM e), s AS (SELECT *, greatest(tick - coalesce(lag(tick) OVER (PARTITION BY user_id ORDER BY tick), tick - 1) - 1, 0) AS skipped FROM k) SELECT *, sum(skipped) OVER (PARTITION BY user_id ORDER BY tick)::BIGINT AS dropped FROM s",
    "tick_sample_once": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
 r AS (SELECT user_id, t // {24 * H} AS n, place FROM e WHERE place = 1
  UNION ALL SELECT r.user_id, r.n + 1, (SELECT min(e.place) FROM e WHERE e.user_id = r.user_id AND e.place > r.place AND e.t >= (r.n + 1) * {24 * H}) FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = r.user_id AND e.place > r.place AND e.t >= (r.n + 1) * {24 * H}))
 SELECT r.user_id, r.n::BIGINT AS n, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.place = r.place""",
    "run_directory": r"SELECT n_regionkey, concat(strftime(make_timestamp(n_regionkey::BIGINT * 100003000000), '%Y%m%d-%H%M%S'), '_', string_agg(left(regexp_replace(concat(n_name, ' é-cam_/.mp4'), '[^\p{L}\p{N}_-]', '', 'g'), 24), '+' ORDER BY n_nationkey)) AS name FROM nation GROUP BY 1",
    "status_label": "SELECT event_id, CASE WHEN value < 10 THEN 'pending' WHEN event_id % 5 > 1 THEN 'read' ELSE 'partial' END AS status FROM events",
    "reading_span": "SELECT event_id, CASE WHEN event_id % 9 > 0 AND event_id % 7 > 0 THEN round((event_id % 90)::DOUBLE - concat(event_id % 30, '.', event_id % 8)::DOUBLE, 3) END AS span_m FROM events",
    "settled_entities": f"{E} SELECT user_id, max(event_type) FILTER (value > 70) AS code, max(t) AS last_seen FROM e GROUP BY 1 HAVING code IS NOT NULL",
    "owner_check": f"{E}, h AS (SELECT *, user_id % 40 AS entity, first_value(user_id) OVER (PARTITION BY user_id % 40, event_type ORDER BY t DESC, event_id DESC) AS holder FROM e) SELECT event_id, CASE WHEN holder = user_id THEN entity END AS shown FROM h",
}
