"""Readings as text: normalising, codes, number pairs. Column in, Column out.

Numbers stay text throughout ("4.70" is not "4.7"); casts happen in predicates only. Digits are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike characters and what they are read as; separators in the order in which they are tried.
LOOK_ALIKE = "OoQDIli|!ZzSsGbTBgq,·•*"
READ_AS = "0000111112255667899...."
SEPARATORS = "-‐‑‒–—―_/"
WELL_FORMED = r"^[0-9]+(\.[0-9]{1,3})?$"
PAIR = "struct<start:string,end:string,explicit:boolean>"


def normalise(text: Column) -> Column:
    """Look-alikes to digits, odd dots to dots; only digits, dots and separators stay."""
    return F.regexp_replace(F.translate(text, LOOK_ALIKE, READ_AS), rf"[^0-9.\{SEPARATORS}]", "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def stripped_key(code: Column) -> Column:
    """Without leading zeros; all zeros stay as they are."""
    bare = F.regexp_replace(code, "^0+", "")
    return F.when(bare == "", code).otherwise(bare)


def parse_code(text: Column) -> Column:
    """A code of two to four digits, else null."""
    code = stripped_key(F.regexp_replace(normalise(text), "[^0-9]", ""))
    return F.when(F.length(code).between(2, 4), code)


def well_formed(number: Column) -> Column:
    return number.rlike(WELL_FORMED)


def in_range(number: Column, low: float = 0.0, high: float = 100.0) -> Column:
    value = number.try_cast("double")
    return F.coalesce((value >= low) & (value < high), F.lit(False))


def split_candidates(text: Column) -> Column:
    """Every cut of the dot-separated groups into two well-formed numbers: array of struct cut, start, end."""
    groups = F.filter(F.split(text, r"\."), lambda g: g != "")
    n = F.size(groups)
    cuts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    made = F.transform(cuts, lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(groups, 1, i), ".").alias("start"), F.array_join(F.slice(groups, i + 1, n), ".").alias("end")))
    return F.filter(made, lambda c: well_formed(c["start"]) & well_formed(c["end"]))


def ranked(candidates: Column, prefer_rising: bool = True) -> Column:
    """The candidates, best first: both in range, rising, more decimals, smaller end, earlier cut."""
    def key(c: Column) -> Column:
        rising = c["end"].cast("double") > c["start"].cast("double")
        decimals = c["start"].contains(".").cast("int") + c["end"].contains(".").cast("int")
        return F.struct(
            (~(in_range(c["start"]) & in_range(c["end"]))).alias("outside"),
            (~rising & F.lit(prefer_rising)).alias("falling"),
            (-decimals).alias("decimals"),
            c["end"].cast("double").alias("to"),
            c["cut"].alias("cut"),
            c["start"].alias("start"),
            c["end"].alias("end"),
        )

    return F.transform(F.array_sort(F.transform(candidates, key)), lambda k: F.struct(k["cut"].alias("cut"), k["start"].alias("start"), k["end"].alias("end")))


def parse_pair(text: Column) -> Column:
    """The best pair of a text as struct start, end, explicit (an explicit separator made it), or null.

    Separators are tried in their fixed order at their first occurrence; one that doesn't part two numbers reads as a dot.
    """
    start = F.struct(normalise(text).alias("rest"), F.lit(None).cast(PAIR).alias("pair"))

    def try_one(acc: Column, sep: Column) -> Column:
        at = F.position(sep, acc["rest"])
        left = F.regexp_replace(F.substr(acc["rest"], F.lit(1), at - 1), r"^[. ]+|[. ]+$", "")
        right = F.regexp_replace(F.substr(acc["rest"], at + 1), r"^[. ]+|[. ]+$", "")
        hit = (at > 0) & well_formed(left) & well_formed(right)
        pair = F.when(acc["pair"].isNotNull(), acc["pair"]).when(hit, F.struct(left.alias("start"), right.alias("end"), F.lit(True).alias("explicit")))
        return F.struct(F.replace(acc["rest"], sep, F.lit(".")).alias("rest"), pair.alias("pair"))

    def finish(acc: Column) -> Column:
        best = F.try_element_at(ranked(split_candidates(acc["rest"])), F.lit(1))
        return F.coalesce(acc["pair"], F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end"), F.lit(False).alias("explicit"))))

    return F.aggregate(F.array(*map(F.lit, SEPARATORS)), start, try_one, finish)


def format_reading(code: Column, start: Column, end: Column) -> Column:
    """"ply X   a-b", with a question mark for what is missing."""
    known = lambda c: c.isNotNull() & (c != "")
    pair = F.when(known(start) & known(end), F.concat(start, F.lit("-"), end)).otherwise("?")
    return F.concat(F.lit("ply "), F.when(known(code), code).otherwise("?"), F.lit("   "), pair)


def span(start: Column, end: Column) -> Column:
    """End less start, of three places; null unless both are numbers."""
    return F.round(end.try_cast("double") - start.try_cast("double"), 3)


def status(provisional: Column, code: Column) -> Column:
    return F.when(provisional, "pending").when(F.coalesce(code, F.lit("")) != "", "read").otherwise("partial")


def label(name: Column) -> Column:
    """Letters, digits, - and _ of a name, 24 of them at most."""
    return F.left(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", ""), F.lit(24))


def run_name(at: Column, labels: Column) -> Column:
    """A folder name of a time and an array of labels."""
    joined = F.array_join(labels, "+")
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("_"), F.when(joined == "", "run").otherwise(joined))
