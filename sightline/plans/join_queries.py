"""Joins, boxes, vectors and folds over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import arrays as A
from ..operators import chains, state
from ..operators import joins as J
from ..operators.folds import fold_groups
from ..sources.tables import clean_list, events, table
from .event_queries import E, H

BOX = {"x0": "l_partkey % 100", "y0": "l_suppkey % 50", "x1": "l_partkey % 100 + l_linenumber * 5", "y1": "l_suppkey % 50 + 20"}
OTHER = {"ox0": "l_orderkey % 100", "oy0": "l_linenumber * 7", "ox1": "l_orderkey % 100 + 25", "oy1": "l_linenumber * 7 + 30"}


def _boxes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.expr(v).alias(k) for k, v in (BOX | OTHER).items()))


def box_iou(spark, d):
    return _boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(G.iou(G.box(""), G.box("o")), 6).alias("iou"))


def zone_overlap(spark, d):
    return _boxes(spark, d).where(G.overlaps(G.box(""), G.box("o"))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def tight_bounds(spark, d):
    return _boxes(spark, d).groupBy("l_orderkey").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _list(spark, d):
    raw = table(spark, d, "customer").select(F.expr("CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(' ', CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '' END, c_custkey, ' ') END").alias("ply_no"), F.expr("CAST(c_custkey % 90 AS STRING)").alias("start"), F.expr("CAST(c_nationkey AS STRING)").alias("end"))
    return clean_list(raw, "ply_no")


def reference_list_clean(spark, d):
    return _list(spark, d)


def _reads(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey + o_orderkey % 2 * 100 AS STRING) END").alias("ply"), F.expr("CAST(o_custkey % 90 AS STRING)").alias("start"), F.expr("CAST(o_custkey % 25 AS STRING)").alias("end"))


def reconcile_left_join(spark, d):
    return J.reconcile(_reads(spark, d), _list(spark, d), "ply", X.stripped_key(F.col("ply_no")), ["ply_no"], ["start", "end"])


def verdict_histogram(spark, d):
    place = F.expr("CASE verdict WHEN 'exact' THEN 1 WHEN 'values_differ' THEN 2 WHEN 'ply_absent' THEN 3 ELSE 4 END")
    return reconcile_left_join(spark, d).groupBy("verdict").agg(F.count("*").alias("n")).withColumn("place", place)


_LIST_SQL = """l0 AS (SELECT trim(CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN '' ELSE concat(' ', CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '' END, c_custkey, ' ') END) AS ply_no, CAST(c_custkey % 90 AS VARCHAR) AS start, CAST(c_nationkey AS VARCHAR) AS "end" FROM customer), l AS (SELECT * FROM l0 WHERE ply_no <> '')"""
_RECONCILE_SQL = f"""{_LIST_SQL}, f AS (SELECT *, ltrim(ply_no, '0') AS k FROM l QUALIFY row_number() OVER (PARTITION BY ltrim(ply_no, '0') ORDER BY ply_no, start, "end") = 1),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey + o_orderkey % 2 * 100 AS VARCHAR) END AS ply, CAST(o_custkey % 90 AS VARCHAR) AS start, CAST(o_custkey % 25 AS VARCHAR) AS "end" FROM orders),
j AS (SELECT r.o_orderkey, r.ply, r.start, r."end", f.start AS listed_start, f."end" AS listed_end, CASE WHEN r.ply = '' THEN 'no_ply' WHEN f.k IS NULL THEN 'ply_absent' WHEN r.start = f.start AND r."end" = f."end" THEN 'exact' ELSE 'values_differ' END AS verdict FROM r LEFT JOIN f ON r.ply = f.k)"""


def pair_score_theta_join(spark, d):
    """Boxes of one order paired with its later lines where they overlap or their centres lie within 15, scored by both."""
    b = _boxes(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x0", "y0", "x1", "y1").distinct()
    o = b.select("l_orderkey", *(F.col(c).alias(f"o{c}") for c in ("l_partkey", "l_suppkey", "l_linenumber", "x0", "y0", "x1", "y1")))
    iou = G.iou(G.box(""), G.box("o"))
    (ax, ay), (bx, by) = G.centre(G.box("")), G.centre(G.box("o"))
    far = F.hypot(ax - bx, ay - by)
    score = F.round(F.lit(0.7) * iou + F.lit(0.3) * (1 - F.least(far / 15, F.lit(1.0))), 6)
    j = b.join(o, "l_orderkey").where(F.col("l_linenumber") < F.col("ol_linenumber")).withColumn("score", score).withColumn("iou", F.round(iou, 6)).where((F.col("iou") >= 0.05) | (far <= 15))
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "ol_partkey", "ol_suppkey", "l_linenumber", "ol_linenumber", "iou", "score")


def unmatched_anti(spark, d):
    e = events(spark, d)
    return table(spark, d, "customer").join(e.where("value > 100"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


def late_result_inner(spark, d):
    """Results that arrive within 3 days of their key's first row; later ones are discarded."""
    e = events(spark, d)
    alive = e.groupBy("user_id").agg((F.min("t") + 72 * H).alias("until"))
    return e.join(alive, "user_id").where("t <= until").select("event_id")


def superseded_anti(spark, d):
    e = events(spark, d)
    gone = e.where("event_type = 'click' AND value > 60").select(F.col("user_id"))
    return e.join(gone, "user_id", "left_anti").select("event_id")


def interval_link_join(spark, d):
    """Each click with the first view of the same user in the hour six before it."""
    e = events(spark, d).select("user_id", "event_id", "event_type", "t")
    kinds = ["click", "view"]
    a, b = (e.where(F.col("event_type") == k).drop("event_type") for k in kinds)
    j = J.within(a, b, ["user_id"], "t", 6 * H, "other_")
    return J.first_in(j, ["event_id"], ["other_t", "other_event_id"]).select("event_id", "other_event_id")


def entity_by_key(spark, d):
    e = events(spark, d).withColumn("code", F.concat(F.lit("ROLL-"), F.col("user_id") % 40))
    return e.groupBy("code").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count_distinct("event_type").alias("cameras"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))


def clipped_share(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(A.clipped_share(F.col("v"), 0.1), 6).alias("share"))


def laplacian_var(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(A.variance(A.laplacian(F.col("v"))), 6).alias("variance"))


def percentile_stretch(spark, d):
    out = A.stretch(F.col("v"), 0.01, 0.995)
    return _vectors(spark, d).select("vec_id", F.round(A.mean(out), 6).alias("mean"))


def minmax_normalise(spark, d):
    out = A.minmax(F.col("v"))
    return _vectors(spark, d).select("vec_id", F.round(A.mean(out), 4).alias("mean"))


def topk_positions(spark, d):
    """The eight positions with the largest sums over all vectors."""
    p = _vectors(spark, d).select(F.posexplode("v").alias("position", "x")).groupBy("position").agg(F.round(F.sum("x"), 5).alias("total"))
    return p.orderBy(F.desc("total"), "position").limit(8)


def greedy_match(spark, d):
    """One-to-one pairs of boxes of each order's odd and even lines, by overlap."""
    b = _boxes(spark, d).select("l_orderkey", F.struct("l_linenumber", "x0", "y0", "x1", "y1").alias("odd")).distinct()
    even = b.where("odd.l_linenumber % 2 = 0").withColumnRenamed("odd", "even")
    pairs = b.where("odd.l_linenumber % 2 = 1").join(even, "l_orderkey").withColumn("score", G.iou(G.box("odd."), G.box("even.")))
    taken = chains.greedy_pairs(pairs.where("score >= 0.05"), ["l_orderkey"], "score", "odd", "even")
    return taken.select("l_orderkey", F.col("odd.l_linenumber").alias("odd_line"), F.col("even.l_linenumber").alias("even_line"))


def tracker_fold(spark, d):
    """Tracks of each user's rows, whose boxes follow from their values."""
    def fold(_, rows):
        tracker = state.Tracker(reach=15.0)
        for t, event, v in rows:
            yield event, tracker.update([(v, v, v + 10, v + 10)], t / 1e6)[0][0]

    return fold_groups(events(spark, d), ["user_id"], ["t", "event_id"], ["value"], fold, "event_id long, track long")


def identity_fold(spark, d):
    """Entities of each site (ten neighbouring users, their tracks over two cameras): the state is one site's, folded in time order; a camera's track ends after every seventh row."""
    def fold(_, rows):
        r = state.Registry()
        for t, event, u, v in rows:
            now, camera = t / H, f"cam{event % 2}"
            name = r.sight(camera, u, v < 40, now)
            if v > 20:
                code = str(10 + u % 60) if event % 3 == 0 else None
                name = r.confirm(camera, u, code, (f"{v:.1f}", f"{u % 50}.5"), 1.0, now, v < 40)
            if event % 7 == 0:
                r.release(camera, u)
            r.cleanup(now)
            yield event, name

    rows = events(spark, d).withColumn("site", F.floor(F.col("user_id") / 10))
    return fold_groups(rows, ["site"], ["t", "event_id"], ["user_id", "value"], fold, "event_id long, entity string")


def sequence_ratio(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(J.sequence_ratio(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 6).alias("ratio"))


def readings(spark, d):
    return events(spark, d).select("user_id", "event_id", "event_type", "t", F.round("value", 1).cast("string").alias("reading"))


def twin_pairs(spark, d):
    """Rows with those of another type of their user in the day before."""
    e = readings(spark, d)
    return J.within(e, e, ["user_id"], "t", 24 * H, "other_").where("event_type <> other_event_type AND event_id <> other_event_id")


def similarity_twin_join(spark, d):
    """Each row with the first similar row of another type of its user in the day before."""
    e = readings(spark, d)
    return J.first_alike(e, e, ["user_id"], "t", "event_id", "reading", "event_type", 24 * H, 0.8)


def rekey_migrate(spark, d):
    """Entities re-keyed along chains of merges."""
    links = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey - 1 END").alias("parent")).where("node >= 0")
    return chains.led_to(links)


QUERIES = {f.__name__: f for f in (box_iou, zone_overlap, tight_bounds, reference_list_clean, reconcile_left_join, verdict_histogram, pair_score_theta_join, unmatched_anti, late_result_inner, superseded_anti, interval_link_join, entity_by_key, clipped_share, laplacian_var, percentile_stretch, minmax_normalise, topk_positions, greedy_match, tracker_fold, identity_fold, sequence_ratio, similarity_twin_join, rekey_migrate)}

_B = ", ".join(f"{v} AS {k}" for k, v in (BOX | OTHER).items())
_IW = "greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0)"
_IH = "greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0)"
_IOU = f"CASE WHEN {_IW} * {_IH} > 0 THEN ({_IW} * {_IH})::DOUBLE / (({{a}}x1 - {{a}}x0) * ({{a}}y1 - {{a}}y0) + ({{b}}x1 - {{b}}x0) * ({{b}}y1 - {{b}}y0) - {_IW} * {_IH}) ELSE 0 END"
_V = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SQL = {
    "box_iou": f"WITH b AS (SELECT *, {_B} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_IOU.format(a='', b='o')}, 6) AS iou FROM b",
    "zone_overlap": f"WITH b AS (SELECT *, {_B} FROM lineitem) SELECT l_orderkey, count(*) AS n FROM b WHERE x0 <= ox1 AND ox0 <= x1 AND y0 <= oy1 AND oy0 <= y1 GROUP BY 1",
    "tight_bounds": f"WITH b AS (SELECT *, {_B} FROM lineitem) SELECT l_orderkey, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1",
    "reference_list_clean": f"WITH {_LIST_SQL} SELECT * FROM l",
    "reconcile_left_join": f"WITH {_RECONCILE_SQL} SELECT * FROM j",
    "verdict_histogram": f"WITH {_RECONCILE_SQL} SELECT verdict, count(*) AS n, CASE verdict WHEN 'exact' THEN 1 WHEN 'values_differ' THEN 2 WHEN 'ply_absent' THEN 3 ELSE 4 END AS place FROM j GROUP BY 1",
    "pair_score_theta_join": f"""WITH b AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(f'{v} AS {k}' for k, v in BOX.items())} FROM lineitem),
 j AS (SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, o.l_partkey AS ol_partkey, o.l_suppkey AS ol_suppkey, a.l_linenumber, o.l_linenumber AS ol_linenumber, round({_IOU.format(a='a.', b='o.')}, 6) AS iou, {_IOU.format(a='a.', b='o.')} AS whole, sqrt(pow((a.x0 + a.x1) / 2 - (o.x0 + o.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (o.y0 + o.y1) / 2, 2)) AS far FROM b a JOIN b o ON a.l_orderkey = o.l_orderkey AND a.l_linenumber < o.l_linenumber)
 SELECT * EXCLUDE (far, whole), round(0.7 * whole + 0.3 * (1 - least(far / 15, 1.0)), 6)::DOUBLE AS score FROM j WHERE iou >= 0.05 OR far <= 15""",
    "unmatched_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE value > 100 AND user_id = c_custkey)",
    "late_result_inner": f"{E}, a AS (SELECT user_id, min(t) + {72 * H} AS until FROM e GROUP BY 1) SELECT event_id FROM e JOIN a USING (user_id) WHERE t <= until",
    "superseded_anti": "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 60)",
    "interval_link_join": f"{E} SELECT a.event_id, b.event_id AS other_event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.t BETWEEN a.t - {6 * H} AND a.t QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.t, b.event_id) = 1",
    "greedy_match": f"""WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey, l_linenumber, {', '.join(f'{v} AS {k}' for k, v in BOX.items())} FROM lineitem),
 s AS (SELECT a.l_orderkey, {{n: a.l_linenumber, x0: a.x0, y0: a.y0, x1: a.x1, y1: a.y1}} AS odd, {{n: o.l_linenumber, x0: o.x0, y0: o.y0, x1: o.x1, y1: o.y1}} AS even, {_IOU.format(a='a.', b='o.')} AS score
  FROM b a JOIN b o USING (l_orderkey) WHERE a.l_linenumber % 2 = 1 AND o.l_linenumber % 2 = 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, odd DESC, even DESC) AS i FROM s WHERE score >= 0.05),
 r AS (SELECT l_orderkey, i, odd, even, true AS ok, [odd] AS odds, [even] AS evens FROM p WHERE i = 1
 UNION ALL SELECT l_orderkey, i, odd, even, ok, CASE WHEN ok THEN odds || [odd] ELSE odds END, CASE WHEN ok THEN evens || [even] ELSE evens END
  FROM (SELECT p.l_orderkey, p.i, p.odd, p.even, odds, evens, NOT (list_contains(odds, p.odd) OR list_contains(evens, p.even)) AS ok FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.i = r.i + 1))
 SELECT l_orderkey, odd.n AS odd_line, even.n AS even_line FROM r WHERE ok""",
    "rekey_migrate": "WITH RECURSIVE up AS (SELECT c_custkey AS node, c_custkey AS place FROM customer UNION ALL SELECT node, place - 1 FROM up WHERE place % 5 <> 0) SELECT node, min(place) AS root FROM up GROUP BY 1",
    "entity_by_key": f"{E} SELECT concat('ROLL-', user_id % 40) AS code, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT event_type) AS cameras FROM e GROUP BY 1",
    "clipped_share": f"{_V} SELECT vec_id, round(len(list_filter(v, lambda x: x >= 0.1)) / len(v), 6) AS share FROM v",
    "laplacian_var": f"{_V}, l AS (SELECT vec_id, list_transform(range(2, len(v)), lambda i: v[i - 1] - 2 * v[i] + v[i + 1]) AS l FROM v) SELECT vec_id, round(list_aggregate(l, 'var_pop'), 6) AS variance FROM l",
    "percentile_stretch": f"{_V}, q AS (SELECT vec_id, v, list_aggregate(v, 'quantile_cont', 0.01) AS a, list_aggregate(v, 'quantile_cont', 0.995) AS b FROM v) SELECT vec_id, round(list_avg(list_transform(v, lambda x: greatest(least((x - a) / greatest(b - a, 1e-6), 1), 0))), 6) AS mean FROM q",
    "minmax_normalise": f"{_V} SELECT vec_id, round(list_avg(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)) * 255)), 4) AS mean FROM v",
    "topk_positions": f"{_V}, p AS (SELECT unnest(range(len(v))) AS position, unnest(v) AS x FROM v) SELECT position::INTEGER AS position, round(sum(x), 5) AS total FROM p GROUP BY 1 ORDER BY total DESC, 1 LIMIT 8",
}
