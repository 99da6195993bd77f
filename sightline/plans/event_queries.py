"""Queries over timed observations (events), and their SQL. H is an hour in microseconds."""

from __future__ import annotations

from itertools import tee

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import chains, quantiles, scans, state, votes, windows
from ..operators.folds import fold_groups
from ..sources.tables import events, table

H = 3_600_000_000
E = "WITH e AS (SELECT *, epoch_us(ts) AS t FROM events)"


def vote_counts(spark, d):
    return votes.counts(events(spark, d), "user_id", "event_type")


def vote_winner(spark, d):
    return votes.winner(events(spark, d), "user_id", "event_type").select("user_id", "winner")


def vote_confidence(spark, d):
    """Mean share of the winners over the confirmed fields (event_type and a band of value), 3 places; 0 without any."""
    e = events(spark, d).withColumn("band", F.floor(F.col("value") / 50).cast("int"))
    a = votes.winner(e, "user_id", "event_type").select("user_id", F.when(F.col("winner").isNotNull(), F.col("top_votes") / F.col("total")).alias("a"))
    b = votes.winner(e, "user_id", "band").select("user_id", F.when(F.col("winner").isNotNull(), F.col("top_votes") / F.col("total")).alias("b"))
    n = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    mean = F.when(n == 0, 0.0).otherwise((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / n)
    return a.join(b, "user_id").select("user_id", F.round(mean, 3).alias("confidence"))


def vote_leader(spark, d):
    return votes.leader(events(spark, d), "user_id", "event_type", "event_id")


def latest_per_key(spark, d):
    return votes.latest(events(spark, d), "user_id", ["t", "event_id"], ["event_type", "value"])


def seen_span(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("cameras"))


def per_key_summary(spark, d):
    e = events(spark, d)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"))


def latency_stats(spark, d):
    e = events(spark, d)
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("max"))


def ordered_concat(spark, d):
    day = F.floor(F.col("t") / (24 * H))
    e = events(spark, d).withColumn("day", day)
    return e.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))), lambda x: x["event_type"]), "; ").alias("detail"))


def rate_bucket(spark, d):
    e = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", "n", F.when(F.col("n") >= 72, "green").when(F.col("n") >= 60, "amber").otherwise("red").alias("bucket"))


def topk_per_group(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return events(spark, d).where("value > 10").withColumn("place", F.row_number().over(w)).where("place <= 2").select("user_id", "event_id", "place")


def relative_topk(spark, d):
    """Of the rows with 15 % or more of the group's largest value the three largest, in time order."""
    g = Window.partitionBy("user_id")
    top = events(spark, d).withColumn("most", F.max("value").over(g)).where("value >= 0.15 * most").withColumn("n", F.row_number().over(g.orderBy(F.desc("value"), "event_id"))).where("n <= 3")
    return top.withColumn("place", F.row_number().over(g.orderBy("t", "event_id"))).select("user_id", "event_id", "place")


def trailing_extent(spark, d):
    return windows.trailing_extent(events(spark, d), "user_id", "t", "value", 6 * H, "event_id").select("event_id", F.round("extent", 6).alias("extent"))


def stationary_filter(spark, d):
    """Rows that moved, or that were seen for no more than a day: the others are dropped."""
    e = windows.trailing_extent(events(spark, d), "user_id", "t", "value", 24 * H, "event_id")
    first = F.min("t").over(Window.partitionBy("user_id"))
    return e.withColumn("seen", F.col("t") - first).where(~((F.col("seen") > 24 * H) & (F.col("extent") < 20))).select("event_id")


def gap_sessions(spark, d):
    e = windows.islands(events(spark, d), "user_id", ["t", "event_id"], "t", 12 * H)
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def interval_merge_count(spark, d):
    e = events(spark, d).withColumn("until", F.col("t") + F.floor(F.col("value") * 200_000_000).cast("long"))
    return windows.merged_intervals(e, "user_id", "t", "until", "event_id")


def change_points(spark, d):
    return windows.change_points(events(spark, d), "user_id", ["t", "event_id"], "event_type").select("event_id", "before")


def locf_fill(spark, d):
    value = F.when(F.col("event_id") % 4 == 0, F.col("value"))
    return windows.forward_fill(events(spark, d), "user_id", ["t", "event_id"], value, "held").select("event_id", "held")


def run_collapse(spark, d):
    symbol = F.when(F.col("value") < 20, "-").otherwise(F.substring("event_type", 1, 1))
    return windows.collapse_runs(events(spark, d), "user_id", ["t", "event_id"], symbol, "-")


def tumbling_rate(spark, d):
    e = events(spark, d).withColumn("hour", F.floor(F.col("t") / (6 * H)))
    return e.groupBy("event_type", "hour").agg((F.count("*") / 6.0).alias("per_hour"))


def tick_gap_fill(spark, d):
    """How many frames each tick owes: one, and one for each tick skipped before it."""
    ticks = events(spark, d).select("user_id", F.floor(F.col("t") / (24 * H)).alias("tick")).distinct()
    w = Window.partitionBy("user_id").orderBy("tick")
    return ticks.withColumn("owed", F.greatest(F.lit(1), F.col("tick") - F.coalesce(F.lag("tick").over(w), F.col("tick") - 1)))


def tick_sample_asof(spark, d):
    return windows.first_at_or_after(events(spark, d), "t", ["event_id", "value"], H)


def ordered_scan(spark, d):
    """Every row in the order of time, with its number and its time since the first row, in seconds."""
    e = events(spark, d).select("event_id", "t")
    began = e.agg(F.min("t")).first()[0]
    return scans.numbered(e, ["t", "event_id"], "frame").select("frame", "event_id", ((F.col("t") - F.lit(began)) / 1e6).alias("media_t"))


def running_changes(spark, d):
    """For every row in the order of time: how many purchases there were so far, and the value of the last one."""
    e = events(spark, d).select("event_id", "t", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    total = scans.running_total(e, ["t", "event_id"], F.col("paid").isNotNull().cast("int"), "purchases")
    return scans.forward_filled(total, ["t", "event_id"], "paid", "last_paid").select("event_id", "purchases", "last_paid")


def modulo_sample(spark, d):
    return events(spark, d).where("event_id % 3 = 0").select("event_id", "value")


def gate_filter(spark, d):
    return events(spark, d).where("value >= 12 AND user_id % 5 <> 0 AND event_type <> 'error' AND value / 120 <= 0.6").select("event_id")


def eligibility_gate(spark, d):
    """Active (3 rows or more so far), fewer than 40 attempts, 6 hours since the row before."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d).withColumn("hits", F.row_number().over(w)).withColumn("idle", F.col("t") - F.lag("t").over(w))
    return e.where((F.col("hits") >= 3) & (F.col("hits") <= 40) & (F.col("idle") >= 6 * H)).select("event_id")


def min_interval_throttle(spark, d):
    def fold(key, rows):
        return ((key[0], event) for _, event in state.throttled(rows, 24 * H))

    return fold_groups(events(spark, d), ["user_id"], ["t", "event_id"], [], fold, "user_id long, event_id long")


def exact_percentiles(spark, d):
    """Percentiles of the prices of each return flag, a group of which may hold half of all rows."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = quantiles.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.95, 0.995])
    return out.select("l_returnflag", "share", F.round("quantile", 4).alias("price"))


def throttle_of_one_key(spark, d):
    """The rows at least six hours after the last accepted one, of all rows as one key."""
    e = events(spark, d).select("event_id", "t", F.lit(0).alias("all"))
    return chains.accepted(e, "all", "t", ["event_id"], 6 * H).select("event_id")


def bounded_queue_drop(spark, d):
    def fold(_, rows):
        ids, times = tee(rows)
        return zip((event for _, event in ids), state.bounded_queue((t for t, _ in times), 4, 18 * H), strict=True)

    return fold_groups(events(spark, d), ["user_id"], ["t", "event_id"], [], fold, "event_id long, accepted boolean")


def event_log_json(spark, d):
    e = events(spark, d).withColumn("t", F.floor(F.col("t") / 1_000_000))
    return e.select("event_id", F.to_json(F.struct("t", F.col("event_type").alias("event"), F.col("user_id").alias("track"))).alias("line"))


def summary_upsert(spark, d):
    """The summary after all upserts: the newest row per key, the span rounded or blank."""
    e = events(spark, d)
    newest = votes.latest(e, "user_id", ["t", "event_id"], ["event_type", "value"])
    first = e.groupBy("user_id").agg(F.min("t").alias("first_seen"))
    span = F.when(F.col("value") > 10, F.round(F.col("value") - 10, 3))
    return newest.join(first, "user_id").select("user_id", F.col("event_type").alias("status"), span.alias("span_m"), "first_seen", F.col("t").alias("last_seen"))


def first_report(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct("t", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("event_id"))


def latest_reading_wins(spark, d):
    """The newest reading per key, a missing one included."""
    e = events(spark, d).withColumn("reading", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return votes.latest(e, "user_id", ["t", "event_id"], ["reading"]).select("user_id", "reading")


def ttl_expiry(spark, d):
    """Rows after which the key's state had expired: the next row came more than a day later, or none came before the end."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d)
    end = e.agg(F.max("t").alias("end"))
    return e.withColumn("next", F.lead("t").over(w)).join(F.broadcast(end)).where(F.coalesce("next", "end") - F.col("t") > 24 * H).select("event_id")


QUERIES = {f.__name__: f for f in (vote_counts, vote_winner, vote_confidence, vote_leader, latest_per_key, seen_span, per_key_summary, latency_stats, ordered_concat, rate_bucket, topk_per_group, relative_topk, trailing_extent, stationary_filter, gap_sessions, interval_merge_count, change_points, locf_fill, run_collapse, tumbling_rate, tick_gap_fill, tick_sample_asof, ordered_scan, running_changes, modulo_sample, gate_filter, eligibility_gate, min_interval_throttle, exact_percentiles, throttle_of_one_key, bounded_queue_drop, event_log_json, summary_upsert, first_report, latest_reading_wins, ttl_expiry)}

_WIN = """SELECT user_id, max(n) AS top, coalesce(max(n) FILTER (r = 2), 0) AS second, sum(n) AS total, max(v) FILTER (r = 1) AS v FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS r FROM (SELECT user_id, {v} AS v, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1"""
SQL = {
    "vote_counts": "SELECT user_id, event_type, count(*) AS votes FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2",
    "vote_winner": f"WITH w AS ({_WIN.format(v='event_type')}) SELECT user_id, CASE WHEN top >= 2 AND top - second >= 1 THEN v END AS winner FROM w",
    "vote_confidence": f"""WITH a AS ({_WIN.format(v='event_type')}), b AS ({_WIN.format(v='floor(value / 50)')}),
 j AS (SELECT user_id, CASE WHEN a.top >= 2 AND a.top > a.second THEN a.top / a.total END AS x, CASE WHEN b.top >= 2 AND b.top > b.second THEN b.top / b.total END AS y FROM a JOIN b USING (user_id))
 SELECT user_id, round(CASE WHEN x IS NULL AND y IS NULL THEN 0 ELSE (coalesce(x, 0) + coalesce(y, 0)) / ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) END, 3)::DOUBLE AS confidence FROM j""",
    "vote_leader": "SELECT user_id, event_type AS leader FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1",
    "latest_per_key": f"{E} SELECT user_id, t, event_id, event_type, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1",
    "seen_span": f"{E} SELECT user_id, min(t) AS first_seen, max(t) AS last_seen, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS cameras FROM e GROUP BY 1",
    "per_key_summary": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total FROM events GROUP BY 1",
    "latency_stats": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events GROUP BY 1",
    "ordered_concat": f"{E} SELECT user_id, (t // {24 * H})::BIGINT AS day, string_agg(event_type, '; ' ORDER BY t, event_id) AS detail FROM e GROUP BY 1, 2",
    "rate_bucket": "SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 72 THEN 'green' WHEN count(*) >= 60 THEN 'amber' ELSE 'red' END AS bucket FROM events GROUP BY 1",
    "topk_per_group": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS place FROM events WHERE value > 10 QUALIFY place <= 2",
    "relative_topk": f"{E}, m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS most FROM e), k AS (SELECT * FROM m WHERE value >= 0.15 * most QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INTEGER AS place FROM k",
    "trailing_extent": f"{E} SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS extent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {6 * H} PRECEDING AND CURRENT ROW)",
    "stationary_filter": f"{E}, x AS (SELECT event_id, t - min(t) OVER (PARTITION BY user_id) AS seen, max(value) OVER w - min(value) OVER w AS extent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {24 * H} PRECEDING AND CURRENT ROW)) SELECT event_id FROM x WHERE NOT (seen > {24 * H} AND extent < 20)",
    "gap_sessions": f"{E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > {12 * H} THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT user_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) + 1 AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY 1, 2",
    "interval_merge_count": f"{E}, i AS (SELECT user_id, event_id, t, t + floor(value * 200000000)::BIGINT AS until FROM e), m AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i) SELECT user_id, count(*) FILTER (reach IS NULL OR t > reach) AS n_merged FROM m GROUP BY 1",
    "change_points": f"{E}, c AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e) SELECT event_id, before FROM c WHERE event_type IS NOT NULL AND event_type IS DISTINCT FROM before",
    "locf_fill": f"{E} SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e",
    "run_collapse": f"{E}, s AS (SELECT user_id, t, event_id, CASE WHEN value < 20 THEN '-' ELSE substr(event_type, 1, 1) END AS s FROM e), r AS (SELECT *, s <> '-' AND s IS DISTINCT FROM lag(s) OVER (PARTITION BY user_id ORDER BY t, event_id) AS new FROM s) SELECT user_id, coalesce(string_agg(s, '' ORDER BY t, event_id) FILTER (new), '') AS collapsed FROM r GROUP BY 1",
    "tumbling_rate": f"{E} SELECT event_type, (t // {6 * H})::BIGINT AS hour, count(*) / 6.0::DOUBLE AS per_hour FROM e GROUP BY 1, 2",
    "tick_gap_fill": f"{E}, k AS (SELECT DISTINCT user_id, (t // {24 * H})::BIGINT AS tick FROM e) SELECT user_id, tick, greatest(1, tick - coalesce(lag(tick) OVER (PARTITION BY user_id ORDER BY tick), tick - 1)) AS owed FROM k",
    "tick_sample_asof": f"{E}, k AS (SELECT unnest(range(min(t) // {H}, max(t) // {H} + 1)) * {H} AS tick FROM e) SELECT tick::BIGINT AS tick, event_id, value FROM k ASOF JOIN e ON tick <= t",
    "ordered_scan": f"{E} SELECT row_number() OVER (ORDER BY t, event_id)::BIGINT AS frame, event_id, (t - min(t) OVER ()) / 1e6::DOUBLE AS media_t FROM e",
    "running_changes": f"{E}, p AS (SELECT event_id, t, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM e) SELECT event_id, count(paid) OVER w AS purchases, last_value(paid IGNORE NULLS) OVER w AS last_paid FROM p WINDOW w AS (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)",
    "modulo_sample": "SELECT event_id, value FROM events WHERE event_id % 3 = 0",
    "gate_filter": "SELECT event_id FROM events WHERE value >= 12 AND user_id % 5 <> 0 AND event_type <> 'error' AND value / 120 <= 0.6",
    "eligibility_gate": f"{E} SELECT event_id FROM (SELECT event_id, row_number() OVER w AS hits, t - lag(t) OVER w AS idle FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE hits >= 3 AND hits <= 40 AND idle >= {6 * H}",
    "min_interval_throttle": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT user_id, event_id, n, t AS last, true AS ok FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - f.last >= {24 * H} THEN e.t ELSE f.last END, e.t - f.last >= {24 * H} FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
 SELECT user_id, event_id FROM f WHERE ok""",
    "exact_percentiles": "SELECT l_returnflag, share, round(CASE share WHEN 0.01 THEN p[1] WHEN 0.5 THEN p[2] WHEN 0.95 THEN p[3] ELSE p[4] END, 4) AS price FROM (SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, [0.01, 0.5, 0.95, 0.995]) AS p, unnest([0.01, 0.5, 0.95, 0.995]::DOUBLE[]) AS share FROM lineitem GROUP BY l_returnflag)",
    "throttle_of_one_key": f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t FROM events),
 r AS (SELECT min({{t: t, event_id: event_id}}) AS x FROM e UNION ALL SELECT x FROM (SELECT min({{t: e.t, event_id: e.event_id}}) AS x FROM r JOIN e ON e.t >= r.x.t + {6 * H}) WHERE x IS NOT NULL) SELECT x.event_id AS event_id FROM r""",
    "bounded_queue_drop": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT user_id, event_id, n, [t + {18 * H}] AS ends, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n,
   CASE WHEN len(list_filter(f.ends, lambda x: x > e.t)) < 4 THEN list_append(list_filter(f.ends, lambda x: x > e.t), greatest(e.t, coalesce(list_max(list_filter(f.ends, lambda x: x > e.t)), e.t)) + {18 * H}) ELSE list_filter(f.ends, lambda x: x > e.t) END,
   len(list_filter(f.ends, lambda x: x > e.t)) < 4 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
 SELECT event_id, accepted FROM f""",
    "event_log_json": """SELECT event_id, concat('{"t":', epoch_us(ts) // 1000000, ',"event":"', event_type, '","track":', user_id, '}') AS line FROM events""",
    "summary_upsert": f"{E}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1), f AS (SELECT user_id, min(t) AS first_seen FROM e GROUP BY 1) SELECT user_id, event_type AS status, CASE WHEN value > 10 THEN round(value - 10, 3) END AS span_m, first_seen, t AS last_seen FROM l JOIN f USING (user_id)",
    "first_report": f"{E} SELECT user_id, event_type, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) = 1",
    "latest_reading_wins": f"{E} SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS reading FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1",
    "ttl_expiry": f"{E} SELECT event_id FROM (SELECT event_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next, max(t) OVER () AS last FROM e) WHERE coalesce(next, last) - t > {24 * H}",
}
