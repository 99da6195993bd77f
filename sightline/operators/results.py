"""The whole fold of results, one site's state at a time: a log of actions, and the summary that the log leads to.

Rows have a site, a time, a number (order of equal times), camera, track, is_result, in_zone, code, start, end, empty.
Batch and stream host the same fold of operators.state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state
from .folds import fold_groups

INPUT = ["camera", "track", "is_result", "in_zone", "code", "start", "end", "empty"]
ACTIONS = "action string, name string, code string, start string, end string, status string, confidence double, first double"


def actions(fold: state.ResultFold, rows: Iterable[tuple], unit: float) -> Iterator[tuple]:
    """Of rows (t, number, *INPUT) in order: t, number, place in the row's actions, and the action."""
    for t, number, camera, track, is_result, in_zone, code, start, end, empty in rows:
        if not is_result:
            fold.see(camera, track, in_zone, t / unit)
            continue
        pair = (start, end) if start is not None and end is not None else None
        for place, action in enumerate(fold.result(camera, track, code, pair, empty, in_zone, t / unit)):
            yield t, number, place, *action


def result_log(rows: DataFrame, site: str, t: str, number: str, unit: float, **settings) -> DataFrame:
    """site, t, number, place and ACTIONS. Sites are independent, many share a task; a site's rows are streamed in order."""

    def fold(key, some):
        return (key + a for a in actions(state.ResultFold(**settings), some, unit))

    kind = rows.schema[site].dataType.simpleString()
    return fold_groups(rows, [site], [t, number], INPUT, fold, f"`{site}` {kind}, t bigint, number bigint, place int, {ACTIONS}")


def summary(log: DataFrame, site: str) -> DataFrame:
    """The newest row of each name of a site, but for names that were dropped after it. A mergeable maximum, no sort."""
    fields = ["action", "code", "start", "end", "status", "confidence", "first", "t"]
    last = log.where("name IS NOT NULL").groupBy(site, "name").agg(F.max(F.struct("t", "number", "place", F.struct(*fields).alias("row"))).alias("m"))
    return last.where("m.row.action <> 'drop'").select(site, "name", *(F.col(f"m.row.{f}").alias(f) for f in fields[1:]))
