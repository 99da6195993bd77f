"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the base patterns (assign, access, hex) and, beyond them, long mixed tokens (generic). Each candidate
value is hashed and the hashes are counted by distinct repositories (documents) and distinct owners (sources) over the
whole corpus. What the counts mean is told by the corpus itself: were a value's r repositories drawn from all, they would
have about E = N (1 - (1 - 1/N)^r) owners, N being the effective number of owners (of equal share, as likely to meet as
those of the corpus). A widely copied example has nearly as many; a value that its owner alone uses, in however many
repositories, has few. A value is live-looking if owners - 1 <= SPREAD (E - 1), so one of a single repository always is,
and a larger corpus does not move the class of a value. Base spans always stay and get their class; generic spans are
added only where the ownership says live.

Defined results: a null text counts as empty; a null owner counts as an owner of its own name ""; repeated rows each
get their row and count once per repository; of one owner all values are live; offsets are code points, ends exclusive;
texts are scanned whole, whatever their length; other columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, written

#: The base patterns, and the least length of the part that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more is the same whether the length is tested after or within the match
HEX = r"[0-9a-f]{16,}"
GENERIC = r"[A-Za-z0-9_+/-]{24,}"
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "generic"]
#: Of the owners beyond the first that a copied value would have, the share that a live one has at most.
SPREAD = 0.5
#: A generic token needs this many digits, letters and distinct characters.
DIGITS, LETTERS, DISTINCT = 4, 4, 10


def _spans(text: Column, pattern: str, hint: str, value_group: int, kind: int) -> Column:
    """The leftmost non-overlapping matches as array<struct<start, kind, end, value>>, by the lengths of what lies between them."""
    p = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    parts = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(value_group)).alias("value"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        hit = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(x["hit"].isNotNull(), F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(hint), found).otherwise(empty)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """row (unique), id_col, owner, base and generic spans of every row of df; texts are left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = lambda spans, least: F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat(kept(_spans(text, ASSIGN, ASSIGN_HINT, 2, 0), ASSIGN_LEAST), _spans(text, ACCESS, ACCESS, 0, 1), _spans(text, HEX, HEX, 0, 2)).alias("base"),
        F.filter(_spans(text, GENERIC, GENERIC, 0, 3), _mixed).alias("generic"),
    )


def _mixed(s: Column) -> Column:
    v = s["value"]
    digits, letters = F.length(F.regexp_replace(v, "[^0-9]", "")), F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    return (digits >= DIGITS) & (letters >= LETTERS) & (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT)


def ownership(values: DataFrame, id_col: str) -> DataFrame:
    """value_hash, repositories and owners (distinct) and n (rows) of values(value_hash, id_col, owner). Distinct counts are first made per value and repository or owner, so one value in a third of all rows is spread over tasks."""
    return values.groupBy("value_hash").agg(F.count_distinct(id_col).alias("repositories"), F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("n"))


def effective_owners(rows: DataFrame, id_col: str) -> float:
    """The number of owners of equal share whose repositories would share an owner as often as those of the corpus do."""
    by_owner = rows.groupBy("owner").agg(F.count_distinct(id_col).cast("double").alias("n"))
    total, squares = by_owner.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return total * total / squares if squares else 1.0


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", spread: float = SPREAD) -> DataFrame:
    """Of every row of df: id_col, base (array of struct start, kind, end), added (the same, generic and live), n_live and n_copied base spans."""
    rows = written(candidates(df, id_col, text_col, owner_col))
    free = F.filter("generic", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    each = rows.where((F.size("base") > 0) | (F.size("generic") > 0)).select("row", id_col, "owner", F.explode(F.concat("base", free)).alias("s"))
    each = each.select("row", id_col, "owner", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.sha2(F.col("s.value").cast("binary"), 256).alias("value_hash"))
    held = written(ownership(each, id_col))
    classed = skew_join(each, held.drop("n"), ["value_hash"], held.select("value_hash", "n"))
    n = effective_owners(rows, id_col)
    expected = n * (1 - F.pow(F.lit(1 - 1 / n), F.col("repositories")))
    live = F.col("owners") - 1 <= F.lit(spread) * (expected - 1) + 1e-9
    is_base = F.col("kind") < KINDS.index("generic")
    per_row = classed.where(is_base | live).groupBy("row").agg(
        F.count_if(is_base & live).alias("n_live"),
        F.count_if(is_base & ~live).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(~is_base, F.struct("start", "kind", "end")))).alias("added"),
    )
    bare = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    out = rows.select("row", id_col, bare.alias("base")).join(per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.withColumn("added", F.coalesce("added", F.filter("base", lambda _: F.lit(False)))).select(id_col, "base", "added", zero("n_live"), zero("n_copied"))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts by kind, base_sha256 and the joined spans of scan()'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *(count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )
