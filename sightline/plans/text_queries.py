"""Queries over readings as text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table

N = "regexp_replace(translate(text, 'OoQDIli|!ZzSsGbTBgq,·•*', '0000111112255667899....'), '[^0-9.\\-‐‑‒–—―_/]', '', 'g')"
WF = "regexp_matches({0}, '^[0-9]+(\\.[0-9]{{1,3}})?$')"
PART_TEXT = "concat(p_partkey % 90, '.', p_size, CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '-' WHEN 2 THEN '/' ELSE ' — ' END, (p_partkey * 7) % 120, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 1000) END)"
DOTS = "concat(p_partkey % 90, '.', p_size, '.', (p_partkey * 7) % 120, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 10000) END)"


def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalise(F.col("text")).alias("normalised"))


def digits_only(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.digits_only(F.col("text")).alias("digits"))


def _part_codes(spark, d):
    return table(spark, d, "part").withColumn("text", F.expr("concat(CASE WHEN p_partkey % 5 = 0 THEN '00' ELSE '' END, p_partkey % 20000, CASE WHEN p_partkey % 7 = 0 THEN 'S' ELSE '' END)"))


def parse_code(spark, d):
    return _part_codes(spark, d).select("p_partkey", "text", X.parse_code(F.col("text")).alias("code"))


CODE_SQL = """CASE WHEN length({c}) BETWEEN 2 AND 4 THEN {c} END"""
_STRIP = "coalesce(nullif(ltrim({x}, '0'), ''), {x})"


def well_formed_number(spark, d):
    return table(spark, d, "part").withColumn("text", F.expr("concat(p_size, CASE p_partkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN '.' WHEN 2 THEN '.12345' ELSE '' END)")).select("p_partkey", "text", X.well_formed(F.col("text")).alias("ok"), X.in_range(F.col("text"), 0, 30).alias("within"))


def _dots(spark, d):
    return table(spark, d, "part").withColumn("text", F.expr(DOTS))


def split_candidates(spark, d):
    return _dots(spark, d).select("p_partkey", F.explode(X.split_candidates(F.col("text"))).alias("c")).select("p_partkey", "c.*")


def split_rank(spark, d):
    ranked = _dots(spark, d).select("p_partkey", F.posexplode(X.ranked(X.split_candidates(F.col("text")))).alias("place", "c"))
    return ranked.select("p_partkey", (F.col("place") + 1).cast("int").alias("place"), "c.start", "c.end")


_CANDIDATES = f"""
g AS (SELECT p_partkey, list_filter(string_split(text, '.'), lambda x: x <> '') AS g FROM t),
c AS (SELECT p_partkey, g, unnest(range(1, len(g)))::INTEGER AS cut FROM g),
s AS (SELECT p_partkey, cut, array_to_string(g[1:cut], '.') AS start, array_to_string(g[cut+1:], '.') AS "end" FROM c),
k AS (SELECT * FROM s WHERE {WF.format('start')} AND {WF.format('"end"')}),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY
  NOT (start::DOUBLE >= 0 AND start::DOUBLE < 100 AND "end"::DOUBLE >= 0 AND "end"::DOUBLE < 100), NOT ("end"::DOUBLE > start::DOUBLE),
  -(contains(start, '.')::INT + contains("end", '.')::INT), "end"::DOUBLE, cut) AS place FROM k)"""


def _pairs(spark, d):
    return table(spark, d, "part").withColumn("text", F.expr(PART_TEXT))


def parse_pair(spark, d):
    return _pairs(spark, d).select("p_partkey", X.parse_pair(F.col("text")).alias("p")).select("p_partkey", "p.start", "p.end", "p.explicit")


PARSE_PAIR_SQL = f"""
WITH raw AS (SELECT p_partkey, {N.replace('text', 'x')} AS n FROM (SELECT p_partkey, {PART_TEXT} AS x FROM part)),
x AS (SELECT p_partkey, n, regexp_extract(n, '^([^-—/]*)[-—/](.*)$', 1) AS a, regexp_extract(n, '^([^-—/]*)[-—/](.*)$', 2) AS b FROM raw),
e AS (SELECT *, regexp_matches(n, '[-—/]') AND {WF.format('a')} AND {WF.format('b')} AS explicit FROM x),
t AS (SELECT p_partkey, translate(n, '-—/', '...') AS text FROM e WHERE NOT explicit),
{_CANDIDATES.strip()}
SELECT p_partkey, a AS start, b AS "end", true AS explicit FROM e WHERE explicit
UNION ALL
SELECT t.p_partkey, r.start, r."end", CASE WHEN r.start IS NOT NULL THEN false END FROM t LEFT JOIN r ON r.p_partkey = t.p_partkey AND r.place = 1
"""

_LINE = "CASE WHEN l_linenumber % 2 = 0 THEN concat(l_partkey % 90, '.', l_suppkey % 50, '-', l_partkey % 99) WHEN l_linenumber % 5 = 1 THEN 'x' ELSE CAST(l_suppkey * 13 % 20000 AS STRING) END"


def assign_line_roles(spark, d):
    """Per order: the first line that is a pair, and the first other line that is a code."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LINE).alias("text"))
    lines = lines.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "text")))
    read = lines.select("l_orderkey", "l_linenumber", "text", X.parse_pair(F.col("text")).alias("pair"), X.parse_code(F.col("text")).alias("code"))
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "text", "pair", "code")))
    per = read.groupBy("l_orderkey").agg(own.alias("lines"))
    at = F.try_element_at(F.filter("lines", lambda x: x["pair"].isNotNull()), F.lit(1))
    per = per.withColumn("range_line", at)
    others = F.filter("lines", lambda x: F.col("range_line").isNull() | (x["l_linenumber"] != F.col("range_line.l_linenumber")))
    code = F.try_element_at(F.filter(others, lambda x: x["code"].isNotNull()), F.lit(1))["code"]
    leading = F.try_element_at(F.filter(F.transform(others, lambda x: F.regexp_extract(x["text"], r"^([0-9]{2,4})(?:[^0-9]|$)", 1)), lambda x: x != ""), F.lit(1))
    return per.select("l_orderkey", F.coalesce(code, leading).alias("code"), F.col("range_line.pair.start").alias("start"), F.col("range_line.pair.end").alias("end"))


ROLES_SQL = f"""
WITH l0 AS (SELECT l_orderkey, l_linenumber, {_LINE.replace('STRING', 'VARCHAR')} AS text FROM lineitem),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, text) AS l_linenumber, text FROM l0),
p AS (SELECT *, contains(text, '-') AS is_pair, CASE WHEN {_STRIP.format(x="regexp_replace(text, '[^0-9]', '', 'g')")} IS NOT NULL AND length({_STRIP.format(x="regexp_replace(text, '[^0-9]', '', 'g')")}) BETWEEN 2 AND 4 THEN {_STRIP.format(x="regexp_replace(text, '[^0-9]', '', 'g')")} END AS code FROM l),
r AS (SELECT l_orderkey, min(l_linenumber) FILTER (is_pair) AS line FROM p GROUP BY 1)
SELECT r.l_orderkey, coalesce(arg_min(p.code, p.l_linenumber) FILTER (p.code IS NOT NULL AND (r.line IS NULL OR p.l_linenumber <> r.line)),
  arg_min(regexp_extract(p.text, '^([0-9]{{2,4}})([^0-9]|$)', 1), p.l_linenumber) FILTER (regexp_matches(p.text, '^([0-9]{{2,4}})([^0-9]|$)') AND (r.line IS NULL OR p.l_linenumber <> r.line))) AS code,
  any_value(split_part(p.text, '-', 1)) FILTER (p.l_linenumber = r.line) AS start, any_value(split_part(p.text, '-', 2)) FILTER (p.l_linenumber = r.line) AS "end"
FROM r JOIN p USING (l_orderkey) GROUP BY r.l_orderkey
"""


def format_reading(spark, d):
    o = table(spark, d, "orders")
    code, start, end = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 90 AS STRING) END"), F.expr("CAST(o_custkey % 99 AS STRING)")
    return o.select("o_orderkey", X.format_reading(code, start, end).alias("reading"))


def result_shape_normalise(spark, d):
    """Two result shapes to one: words, the mean of their positions, and a score of 0 where there is none."""
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    shape = F.struct(F.col("text").alias("text"), F.array(F.col("turn") * 10, F.col("turn") * 10 + 4).alias("ys"), F.when(F.col("turn") % 2 == 0, 0.5).alias("score"))
    y = F.aggregate("s.ys", F.lit(0).cast("bigint"), lambda a, v: a + v) / F.size("s.ys")
    return c.select("conv_id", "turn", shape.alias("s")).select("conv_id", "turn", F.length("s.text").alias("n"), y.alias("y"), F.coalesce("s.score", F.lit(0.0)).alias("score"))


QUERIES = {f.__name__: f for f in (normalise_text, digits_only, parse_code, well_formed_number, split_candidates, split_rank, parse_pair, assign_line_roles, format_reading, result_shape_normalise)}

_CODE_TEXT = "concat(CASE WHEN p_partkey % 5 = 0 THEN '00' ELSE '' END, p_partkey % 20000, CASE WHEN p_partkey % 7 = 0 THEN 'S' ELSE '' END)"
SQL = {
    "normalise_text": f"SELECT doc_id, {N} AS normalised FROM documents",
    "digits_only": "SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS digits FROM conversations",
    "parse_code": f"WITH t AS (SELECT p_partkey, {_CODE_TEXT} AS text FROM part), n AS (SELECT *, {_STRIP.format(x="replace(text, 'S', '5')")} AS c FROM t) SELECT p_partkey, text, {CODE_SQL.format(c='c')} AS code FROM n",
    "well_formed_number": f"WITH t AS (SELECT p_partkey, concat(p_size, CASE p_partkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN '.' WHEN 2 THEN '.12345' ELSE '' END) AS text FROM part) SELECT p_partkey, text, {WF.format('text')} AS ok, coalesce(try_cast(text AS DOUBLE) >= 0 AND try_cast(text AS DOUBLE) < 30, false) AS within FROM t",
    "split_candidates": f"WITH t AS (SELECT p_partkey, {DOTS} AS text FROM part), {_CANDIDATES.strip()} SELECT p_partkey, cut, start, \"end\" FROM k",
    "split_rank": f"WITH t AS (SELECT p_partkey, {DOTS} AS text FROM part), {_CANDIDATES.strip()} SELECT p_partkey, place::INTEGER AS place, start, \"end\" FROM r",
    "parse_pair": PARSE_PAIR_SQL,
    "assign_line_roles": ROLES_SQL,
    "format_reading": "SELECT o_orderkey, concat('ply ', CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE CAST(o_custkey AS VARCHAR) END, '   ', CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE concat(o_orderkey % 90, '-', o_custkey % 99) END) AS reading FROM orders",
    "result_shape_normalise": "SELECT conv_id, turn, length(text)::INTEGER AS n, turn * 10 + 2.0::DOUBLE AS y, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM conversations WHERE text IS NOT NULL",
}
