"""The fold of results over streams of sites, with one state entry per entity and per track, and event-time timers.

Rows wait in their site's state until the watermark has passed them, and are then folded in order of (t, number): rows
that come shuffled over triggers, but within the watermark's delay, give the log that operators.results gives the whole
table. What a trigger writes are the waiting rows and the entities and tracks that changed; a site's entities are read
when its rows fall due, and at most those of the last `forget` seconds are there.

A timer stands at the earliest waiting row, and behind the last one at which the site will have been idle long enough for
all its entities to be forgotten; once a site has been idle for `rest` seconds, nothing of it is left in the state and
numbers of unnamed entities start anew, in a batch as in a stream. Rows older than the watermark are dropped by Spark and
counted in its progress.
"""

from __future__ import annotations

import json
import math
from collections import Counter, OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators import results, state

#: What the query needs of a session: state that is kept entry by entry.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_ENTITY = "number int, provisional boolean, first double, last double, code string, start string, end string, confidence double, cameras string, members string, codes string"
_TRACK = "last double, votes string, code string, start string, end string, logged string"
_ROW = "t long, number long, " + ", ".join(f"{c} {'bigint' if c == 'track' else 'boolean' if c in ('is_result', 'in_zone', 'empty') else 'string'}" for c in results.INPUT)


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def entity_entries(fold: state.ResultFold) -> dict[tuple, tuple]:
    """(name,) to the values of _ENTITY, for every entity of a fold."""
    r, codes = fold.registry, {}
    for code, name in r.by_code.items():
        codes.setdefault(name, []).append(code)
    out = {}
    for name, e in r.entities.items():
        cameras = [[c, *s] for c, s in sorted(e.cameras.items())]
        members = sorted([c, t, r.since[c, t]] for c, t in e.members)
        out[name,] = (e.number, e.provisional, e.first, e.last, e.code, *(e.pair or (None, None)), e.confidence, _dump(cameras), _dump(members), _dump(sorted(codes.get(name, []))))
    return out


def track_entries(fold: state.ResultFold) -> dict[tuple, tuple]:
    """(camera, track) to the values of _TRACK; votes keep the order in which values came first."""
    return {key: (last, _dump([list(r.codes.items()), [[*p, n] for p, n in r.pairs.items()]]), r.code, *(r.pair or (None, None)), r.logged) for key, (last, r) in fold.tracks.items()}


def restored(entities: dict[tuple, tuple], tracks: dict[tuple, tuple], counters: tuple | None, **settings) -> state.ResultFold:
    """The fold whose entries these are."""
    fold = state.ResultFold(**settings)
    r = fold.registry
    for (name,), v in sorted(entities.items(), key=lambda x: x[1][3]):
        number, provisional, first, last, code, start, end, confidence, cameras, members, codes = v
        e = state.Entity(name, number, provisional, first, last, code, None if start is None else (start, end), confidence)
        e.cameras = {c: state.Sighting(*s) for c, *s in json.loads(cameras)}
        for camera, track, since in json.loads(members):
            e.members.add((camera, track))
            r.owner[camera, track], r.since[camera, track] = name, since
        r.entities[name] = e
        r.by_code |= dict.fromkeys(json.loads(codes), name)
    fold.tracks = OrderedDict()
    for key, (last, votes, code, start, end, logged) in sorted(tracks.items(), key=lambda x: x[1][0]):
        codes, pairs = json.loads(votes)
        reads = state.Reads(Counter(dict(codes)), Counter({(a, b): n for a, b, n in pairs}), code, None if start is None else (start, end), logged)
        fold.tracks[key] = last, reads
    if counters:
        r.unnamed, r.steps, fold.latest = counters
    return fold


class SiteProcessor(StatefulProcessor):
    """One site: waiting rows, entities and tracks by their keys, and counters."""

    def __init__(self, site: str, unit: float, settings: dict):
        self.site, self.unit, self.settings = site, unit, settings
        parse = _parse_datatype_string  # asks the driver, so not in init
        self.of_waiting, self.of_entity, self.of_track, self.of_counters = parse(_ROW), (parse("name string"), parse(_ENTITY)), (parse("camera string, track bigint"), parse(_TRACK)), parse("unnamed int, steps int, latest double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.of_waiting)
        self.entities = handle.getMapState("entities", *self.of_entity)
        self.tracks = handle.getMapState("tracks", *self.of_track)
        self.counters = handle.getValueState("counters", self.of_counters)

    def _timer(self, t: float) -> None:
        """A timer that fires once the watermark has passed t (in the rows' unit)."""
        self.handle.registerTimer(int(t * 1000 // self.unit) + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["t"], r["number"], *(r[c] for c in results.INPUT)) for r in rows]
        self.waiting.appendList(new)
        self._timer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * self.unit / 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[:2])
        rest = [r for r in rows if r[0] > passed]
        before = ({tuple(k): tuple(v) for k, v in m.iterator()} if m.exists() else {} for m in (self.entities, self.tracks))
        entities, tracks = before
        fold = restored(entities, tracks, tuple(self.counters.get()) if self.counters.exists() else None, **self.settings)
        out = [Row(**dict(zip(self._names(), (*key, *a), strict=True))) for a in results.actions(fold, due, self.unit)]
        fold.pass_time(passed / self.unit)
        self._write(self.entities, entities, entity_entries(fold))
        self._write(self.tracks, tracks, track_entries(fold))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if fold.idle and not rest:
            self.counters.clear()
        else:
            self.counters.update((fold.registry.unnamed, fold.registry.steps, fold.latest))
            then = min((r[0] for r in rest), default=fold.due * self.unit)
            if then < math.inf:
                self._timer(then)
        return iter(out)

    def _names(self) -> list[str]:
        return [self.site, "t", "number", "place", *(f.split()[0] for f in results.ACTIONS.split(", "))]

    @staticmethod
    def _write(held, before: dict[tuple, tuple], after: dict[tuple, tuple]) -> None:
        for key in before.keys() - after.keys():
            held.removeKey(key)
        for key, value in after.items():
            if before.get(key) != value:
                held.updateValue(key, value)

    def close(self) -> None:
        pass


def result_stream(stream: DataFrame, site: str, clock: str, late: str = "1 minute", unit: float = 1e6, **settings) -> DataFrame:
    """The actions of results.result_log of a stream, in any order within the delay `late` of the timestamp column clock.

    The stream has the columns of results.result_log, t and number; t counts units a second from 1970 and agrees with
    clock. The session's state store must be that of PROVIDER. settings: of operators.state.ResultFold, with a finite rest.
    """
    kind = stream.schema[site].dataType.simpleString()
    schema = f"`{site}` {kind}, t long, number long, place int, {results.ACTIONS}"
    rows = stream.select(site, "t", "number", *results.INPUT, F.col(clock).alias("clock")).withWatermark("clock", late)
    target: StructType = _parse_datatype_string(schema)
    return rows.groupBy(site).transformWithState(SiteProcessor(site, unit, settings), target, "Append", "EventTime")


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with the state store that result_stream needs."""
    for k, v in PROVIDER.items():
        spark.conf.set(k, v)
    return spark
