import hashlib
import random
import zlib
from itertools import pairwise, product

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.llm import conversation_repair as c
from sightline.llm import queries

from .helpers import write

WHITE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, digest string, at int, later boolean"
RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else text.translate({ord(x): None for x in ".!?"}) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Plain search forward: the best (cost, audit, lines) by what the output's initials are so far, as a string of the grammar's state."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def better(held, key, new):
        if key not in held or new[:2] < held[key][:2]:
            held[key] = new
            return True
        return False

    def inserted(held):
        todo = list(held)
        while todo:
            s = todo.pop()
            cost, audit, lines = held[s]
            for x in follow[s]:
                if x != "s" and better(held, x, (cost + 3, audit + "I", [*lines, name[x] + ":"])):
                    todo.append(x)
        return held

    held = inserted({"": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks, strict=True):
        after = {}
        for s, (cost, audit, lines) in held.items():
            better(after, s, (cost + 4, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            extra = 3 if mark else 0
            for x in follow[s]:
                if role[:1] == x:
                    better(after, x, (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                if x != "s":
                    better(after, x, (cost + 3 + extra, audit + "R", [*lines, f"{name[x]}:{text}"]))
        held = inserted(after)
    return min(held[s] for s in ("", "a") if s in held)


def brute(original, rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in original):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(own)
        stamps = {r[0] for r in own if r[0] is not None}
        cost, audit, lines = cheapest(own, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(own))
        gaps = max(stamps) - min(stamps) + 1 - len(stamps) if stamps else 0
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def invented(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "well", "", " \t\n", "a. ", "b .\n", "é。", None, "Yes"]
    rows = []
    for conv in range(conversations):
        for t in range(r.randrange(1, longest)):
            rows.append((conv, t if r.random() < 0.8 else r.choice([None, t, t + 2]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]), r.choice(texts)))
    return rows


def test_against_plain_search(spark):
    rows = [*invented(1, 120, 9), *((None, t, "user", "x.") for t in range(5)), (500, None, None, None), (501, 0, "user", "w" * 50_000 + "."), (502, 5, "user", "a.")]
    got = c.repair(c.damage(frame(spark, rows)), gone=F.col("gone"))
    assert got.columns == RESULT
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, damaged(rows))
    assert {t for n, t in got.dtypes if n not in ("audit", "repaired_sha256")} == {"bigint"}


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(c, "FAN", 2)
    rows = [*invented(2, 3, 400), *((9, t, "user" if t % 2 == 0 else "assistant", f"n {t % 250}.") for t in range(700)), *((8, None, "user", "same.") for _ in range(300))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = c.repair(frame(spark, rows)).collect()
        turns = c.repaired_turns(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    want = brute(rows, plain)
    assert sorted(map(tuple, got), key=repr) == want
    lines = {}
    for t in sorted(turns, key=lambda t: t["position"]):
        lines.setdefault(t["conv_id"], []).append(t)
    for conv, *_, audit, sha in want:
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in lines.get(conv, [])).encode()).hexdigest() == sha
        assert "".join(t["edit"] for t in lines.get(conv, [])) == audit.replace("D", "")


def test_longer_than_a_whole_one(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"line {t}" + "." * (t % 7 > 0)) for t in range(c.WHOLE + 900)] + [(0, 0, "user", "a."), (2, 0, "user", "a.")]
    assert sorted(map(tuple, c.repair(frame(spark, rows)).collect()), key=repr) == brute(rows, rows)


def test_empty_table(spark):
    assert c.repair(c.damage(frame(spark, [])), gone=F.col("gone")).count() == 0
    assert c.repaired_turns(frame(spark, [])).count() == 0


def test_all_rows_dropped(spark):
    key = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = c.repair(c.damage(frame(spark, [(key, 0, "user", "a.")])), gone=F.col("gone")).collect()
    assert [tuple(x) for x in got] == [(key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("seed", range(5))
def test_product_is_associative(seed):
    r = random.Random(seed)
    kinds = [c.turn_matrix(i, f) for i, f in product("sua", ("", "blank", "truncated"))] + [c.turn_matrix("", "")]
    for _ in range(50):
        row = [r.choice(kinds) for _ in range(6)]
        left = right = None
        for m in row:
            left = m if left is None else c.product(left, m)
        for m in reversed(row):
            right = m if right is None else c.product(m, right)
        assert left == right == c.product(c.product(row[0], row[1]), c.product(c.product(row[2], row[3]), c.product(row[4], row[5])))
    assert c.product(c.CLOSURE, c.CLOSURE) == c.CLOSURE


def test_sql(spark, tmp_path):
    rows = [*invented(3, 60, 8), (None, 1, "user", "x."), (None, None, None, None)]
    folder = write(tmp_path, conversations=frame(spark, rows))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    sql = duckdb.sql(queries.OP11_SQL)
    assert sql.columns == RESULT
    assert sorted(sql.fetchall(), key=repr) == sorted(map(tuple, queries.op11_conversation_repair(spark, folder).collect()), key=repr)
