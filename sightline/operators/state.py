"""Folds over ordered rows that relational operators can't express, as plain functions; batch and streams host them.

Each fold sees one key's rows in order and keeps bounded state (tracks, a queue, identities of one site).
"""

from __future__ import annotations

import difflib
import math
from collections import Counter, OrderedDict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from typing import NamedTuple


def throttled(rows: Iterable[tuple], least: int, last: int | None = None) -> Iterator[tuple]:
    """The rows (time first) that come at least so long after the last accepted one."""
    for row in rows:
        if last is None or row[0] - last >= least:
            last = row[0]
            yield row


def throttle(times: Iterable[int], least: int, last: int | None = None) -> tuple[list[bool], int | None]:
    """Whether each time is at least so long after the last accepted one, and the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= least
        last = t if ok else last
        out.append(ok)
    return out, last


def bounded_queue(times: Iterable[int], capacity: int, service: int) -> Iterator[bool]:
    """One server, first come first served; who finds capacity others still there is dropped."""
    ends: deque = deque()
    for t in times:
        while ends and ends[0] <= t:
            ends.popleft()
        ok = len(ends) < capacity
        if ok:
            ends.append(max(t, ends[-1] if ends else t) + service)
        yield ok


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff and Obershelp's ratio of the digits; 0 if either is empty; order matters."""
    a, b = ("".join(c for c in x or "" if c in "0123456789") for x in (a, b))
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def greedy_match(scored: Iterable[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """One-to-one pairs (a, b), best score first; ties go to the higher a, then the higher b."""
    used_a, used_b, out = set(), set(), []
    for _, a, b in sorted(scored, reverse=True):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return out


def box_iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda x: max(0, x[2] - x[0]) * max(0, x[3] - x[1])
    return w * h / (size(a) + size(b) - w * h)


@dataclass
class Tracker:
    """Follows boxes of one camera: overlap or nearness of the centres pairs them, unpaired ones open tracks, missed tracks end."""

    max_misses: int = 18
    min_iou: float = 0.05
    reach: float = 120.0
    overlap_weight: float = 0.7  # fixed value; nearness has the rest
    next_id: int = 1
    tracks: dict[int, dict] = field(default_factory=dict)

    def update(self, boxes: list[tuple], now: float) -> tuple[list[int], list[int]]:
        """The track of each box, and the tracks that ended."""
        scored = []
        for tid, tr in self.tracks.items():
            for i, b in enumerate(boxes):
                overlap = box_iou(tr["box"], b)
                far = math.dist(*((x[0] + x[2], x[1] + x[3]) for x in (tr["box"], b))) / 2
                if overlap >= self.min_iou or far <= self.reach:
                    near = max(0.0, 1 - far / self.reach)
                    scored.append((near + self.overlap_weight * (overlap - near), tid, i))
        owner = {i: tid for tid, i in greedy_match(scored)}
        for i, b in enumerate(boxes):
            if i not in owner:
                owner[i] = self.next_id
                self.tracks[self.next_id] = {"hits": 0, "misses": 0, "first": now}
                self.next_id += 1
            tr = self.tracks[owner[i]]
            tr |= {"box": b, "hits": tr["hits"] + 1, "misses": 0, "last": now}
        seen, ended = set(owner.values()), []
        for tid in [t for t in self.tracks if t not in seen]:
            self.tracks[tid]["misses"] += 1
            if self.tracks[tid]["misses"] > self.max_misses:
                ended.append(tid)
                del self.tracks[tid]
        return [owner[i] for i in range(len(boxes))], ended


class Sighting(NamedTuple):
    track: int
    in_zone: bool
    at: float


@dataclass
class Entity:
    id: str
    number: int
    provisional: bool
    first: float
    last: float
    code: str | None = None
    pair: tuple[str, str] | None = None
    confidence: float = 0.0
    cameras: dict[str, Sighting] = field(default_factory=dict)
    members: set[tuple[str, int]] = field(default_factory=set)

    @property
    def status(self) -> str:
        return "pending" if self.provisional else "read" if self.code else "partial"


class Registry:
    """One identity per entity across cameras: by code, by sight in the shared zone, or by a similar pair.

    Rows come in time order. Entities are kept by the time they were last seen, so links, twins and expiry look at those
    of the last seconds only, whatever the number of entities. A code keeps its entity even while that entity's newest
    reading has none. A time of zero is a time like any other.
    """

    def __init__(self, prefix: str = "ROLL", sync: float = 1.5, twin: float = 30.0, forget: float = 180.0, alike: float = 0.8):
        self.prefix, self.sync, self.twin, self.forget, self.alike = prefix, sync, twin, forget, alike
        self.entities: OrderedDict[str, Entity] = OrderedDict()  # the one seen last comes last
        self.owner: dict[tuple[str, int], str] = {}
        self.since: dict[tuple[str, int], int] = {}  # the place of each track in the order of assignment
        self.by_code: dict[str, str] = {}
        self.unnamed = self.steps = 0

    def _step(self) -> int:
        self.steps += 1
        return self.steps

    def _unnamed(self) -> str:
        self.unnamed += 1
        return f"{self.prefix}-U{self.unnamed}"

    def _open(self, name: str, now: float, provisional: bool) -> Entity:
        e = self.entities[name] = Entity(name, self._step(), provisional, now, now)
        return e

    def _own(self, key: tuple[str, int], e: Entity) -> None:
        before = self.entities.get(self.owner.get(key, ""))
        if before:
            before.members.discard(key)
        self.owner[key] = e.id
        self.since.setdefault(key, self._step())
        e.members.add(key)

    def _seen(self, e: Entity, key: tuple[str, int], in_zone: bool, now: float) -> None:
        e.cameras[key[0]] = Sighting(key[1], in_zone, now)
        e.last = now
        self.entities.move_to_end(e.id)

    def _lately(self, now: float, span: float):
        for e in reversed(self.entities.values()):
            if now - e.last > span:
                return
            yield e

    def assign(self, camera: str, track: int, in_zone: bool, now: float) -> str:
        """The entity of an unread track: its own; or of the track of another camera that was assigned first among those
        in the zone of their camera whose entity is unread and seen lately; or a new one."""
        key = (camera, track)
        if key not in self.owner:
            waiting = []
            for e in self._lately(now, self.sync) if in_zone else ():
                if e.provisional and not e.code:
                    waiting += [(self.since[k], e) for k in e.members if k[0] != camera and k[0] in e.cameras and e.cameras[k[0]].in_zone]
            e = min(waiting, key=lambda w: w[0])[1] if waiting else self._open(self._unnamed(), now, True)
            self._own(key, e)
        return self.owner[key]

    def observe(self, camera: str, track: int, in_zone: bool, now: float) -> str | None:
        """A track is seen again; the entity it belongs to, if any."""
        name = self.owner.get((camera, track))
        if name in self.entities:
            self._seen(self.entities[name], (camera, track), in_zone, now)
        return name

    def sight(self, camera: str, track: int, in_zone: bool, now: float) -> str:
        self.assign(camera, track, in_zone, now)
        return self.observe(camera, track, in_zone, now)

    def confirm(self, camera: str, track: int, code: str | None, pair: tuple[str, str] | None, confidence: float, now: float, in_zone: bool = False) -> str:
        """A track's voted reading: the newest one holds, a missing code included."""
        key = (camera, track)
        before = self.owner.get(key)
        target = self._target(camera, before, code, pair, now)
        e = self.entities.get(target) or self._open(target, now, False)
        if before and before != target:
            self._merge(before, e)
        e.provisional, e.code, e.pair, e.confidence = False, code, pair, confidence
        if code:
            self.by_code[code] = target
        self._own(key, e)
        self._seen(e, key, in_zone, now)
        return target

    def _target(self, camera, before, code, pair, now) -> str:
        if code:
            return self.by_code.get(code) or f"{self.prefix}-{code}"
        settled = self.entities.get(before) if before else None
        if settled and not settled.provisional:
            return before
        if pair and all(pair):
            twins = [e for e in self._lately(now, self.twin) if not e.provisional and not e.code and camera not in e.cameras]
            for e in sorted(twins, key=lambda e: e.number):
                if e.pair and similarity("".join(pair), "".join(e.pair)) >= self.alike:
                    return e.id
        return before or self._unnamed()

    def _merge(self, old: str, into: Entity) -> None:
        gone = self.entities.pop(old, None)
        if gone:
            into.first = min(into.first, gone.first)
            into.cameras = gone.cameras | into.cameras
            for key in gone.members:
                self.owner[key] = into.id
            into.members |= gone.members
            if gone.code:
                self.by_code.pop(gone.code, None)

    def holds(self, camera: str, track: int) -> bool:
        """Whether a track shows its entity's name: not where a settled entity was last seen in this camera as another track."""
        e = self.entities.get(self.owner.get((camera, track), ""))
        return bool(e) and (e.provisional or camera not in e.cameras or e.cameras[camera].track == track)

    def _part(self, key: tuple[str, int]) -> None:
        self.owner.pop(key, None)
        self.since.pop(key, None)

    def release(self, camera: str, track: int) -> None:
        """A track has ended; its entity stays."""
        e = self.entities.get(self.owner.get((camera, track), ""))
        if e:
            e.members.discard((camera, track))
        self._part((camera, track))

    def cleanup(self, now: float) -> list[str]:
        gone = []
        while self.entities and now - next(iter(self.entities.values())).last > self.forget:
            name, e = self.entities.popitem(last=False)
            gone.append(name)
            if e.code:
                self.by_code.pop(e.code, None)
            for key in e.members:
                self._part(key)
        return gone


def top_voted(votes: Counter, least: int, margin: int):
    """The value of most votes, of equal ones the first, if it has enough and leads by the margin."""
    first, second = (votes.most_common(2) + [(None, 0)] * 2)[:2]
    return first[0] if first[1] >= max(least, 1) and first[1] - second[1] >= margin else None


@dataclass
class Reads:
    """The readings of one track."""

    codes: Counter = field(default_factory=Counter)
    pairs: Counter = field(default_factory=Counter)
    code: str | None = None
    pair: tuple[str, str] | None = None
    logged: str | None = None

    def add(self, code: str | None, pair: tuple[str, str] | None, least: int, margin: int) -> bool:
        """Counts a reading; whether what is voted has changed."""
        before = self.code, self.pair
        self.codes.update([code] if code else [])
        self.pairs.update([pair] if pair else [])
        self.code, self.pair = top_voted(self.codes, least, margin), top_voted(self.pairs, least, margin)
        return (self.code, self.pair) != before

    @property
    def confidence(self) -> float:
        shares = [v[w] / v.total() for v, w in ((self.codes, self.code), (self.pairs, self.pair)) if w is not None]
        return round(sum(shares) / len(shares), 3) if shares else 0.0


class ResultFold:
    """Results of one site, in time order, to a log of actions: late results are discarded, readings voted per track,
    changes of a track's voted reading confirm its entity, and the row of a name that an entity had before is dropped.

    A track lives as long as it is seen again within alive; later results of it are late. Actions: late, empty, read,
    drop, confirmed, confirmed_again. The summary is the newest confirmed row per name that no later drop removes. A site
    without rows for rest seconds (at least the registry's forget) starts anew, numbers of unnamed entities included.
    """

    def __init__(self, alive: float = 5.0, least: int = 2, margin: int = 1, registry: Registry | None = None, rest: float = math.inf):
        self.alive, self.least, self.margin, self.rest, self.latest = alive, least, margin, rest, -math.inf
        self.registry = registry or Registry()
        if rest < max(alive, self.registry.forget):
            raise ValueError("a site must rest at least as long as its tracks live and its entities are remembered")
        self.tracks: OrderedDict[tuple[str, int], tuple[float, Reads]] = OrderedDict()

    @property
    def due(self) -> float:
        """When time alone changes what is held: once all entities are forgotten, and once the site has rested. Infinite if never."""
        return self.latest + (self.registry.forget if self.registry.entities or self.tracks else self.rest)

    @property
    def idle(self) -> bool:
        """Whether nothing is held that a later row could meet."""
        return self.latest == -math.inf

    def pass_time(self, now: float) -> None:
        """What the passing of time alone does: tracks and entities end, and a site that has rested starts anew."""
        while self.tracks and now - next(iter(self.tracks.values()))[0] > self.alive:
            key, _ = self.tracks.popitem(last=False)
            self.registry.release(*key)
        self.registry.cleanup(now)
        if now - self.latest > self.rest:
            self.registry.unnamed = self.registry.steps = 0
            self.latest = -math.inf

    def see(self, camera: str, track: int, in_zone: bool, now: float) -> None:
        key = (camera, track)
        self._end(now)
        _, reads = self.tracks.pop(key, (now, None))
        self.tracks[key] = now, reads or Reads()
        self.registry.sight(camera, track, in_zone, now)

    def _end(self, now: float) -> None:
        self.pass_time(now)
        self.latest = now

    def result(self, camera: str, track: int, code: str | None, pair: tuple[str, str] | None, empty: bool, in_zone: bool, now: float) -> list[tuple]:
        """Actions as (action, name, code, start, end, status, confidence, first)."""
        self._end(now)
        key = (camera, track)
        if key not in self.tracks:
            return [("late", *[None] * 7)]
        if empty:
            return [("empty", *[None] * 7)]
        reads = self.tracks[key][1]
        changed = reads.add(code, pair, self.least, self.margin)
        out = [("read", None, code, *(pair or (None, None)), None, None, None)]
        if changed and reads.pair:
            again = reads.logged is not None
            name = self.registry.confirm(camera, track, reads.code, reads.pair, reads.confidence, now, in_zone)
            if again and reads.logged != name:
                out.append(("drop", reads.logged, *[None] * 6))
            reads.logged = name
            e = self.registry.entities[name]
            out.append(("confirmed_again" if again else "confirmed", name, e.code, *e.pair, e.status, e.confidence, e.first))
        return out


def split_tall(strokes: list[tuple[float, float, float]], typical: float) -> list[list[int]]:
    """Places of strokes (top, bottom, centre) by line of text: a tall group parts at its widest gap of centres, of equal
    gaps the lower one, as long as the gap is wide and the parts hardly overlap."""
    done, todo = [], [sorted(range(len(strokes)), key=lambda i: strokes[i][2])]
    extent = lambda part: (min(strokes[i][0] for i in part), max(strokes[i][1] for i in part))
    while todo:
        part = todo.pop()
        top, bottom = extent(part) if part else (0, 0)
        if bottom - top > TALL * typical and len(part) >= FEW:
            gap, at = max((strokes[b][2] - strokes[a][2], n) for n, (a, b) in enumerate(pairwise(part), 1))
            (a, b), (c, d) = extent(part[:at]), extent(part[at:])
            if gap >= WIDE_GAP * typical and max(0, min(b, d) - max(a, c)) / max(1, min(b - a, d - c)) <= OVERLAP:
                todo += [part[at:], part[:at]]
                continue
        done.append(part)
    return done


#: Fixed values of split_tall: heights and gaps in typical heights, strokes, share of the smaller part.
TALL, FEW, WIDE_GAP, OVERLAP = 1.8, 4, 0.35, 0.28
