import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import packing as p

from .helpers import SCHEMA, frame, odd_texts, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def padding(n: int, room: int) -> int:
    return 0 if n & (n - 1) == 0 else room - n


def least(at, penalty, room):
    """Every set of cuts, by plain recursion over all windows."""
    best = {0: 0}
    for i in range(1, len(at)):
        best[i] = min((best[j] + padding(at[i] - at[j], room) for j in range(i) if at[i] - at[j] <= room), default=math.inf) + penalty[i]
    return best[len(at) - 1]


def check(rows, texts, room=4096):
    """Every id in one piece, no gap in a sequence, none too long; returns the share of padding."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = np.asarray(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= room
        padded, total = padded + padding(at, room), total + at
    return padded / max(1, total)


def test_pieces_of_odd_texts(spark):
    texts = [*odd_texts().items(), (300, "Étude <|endoftext|> é ΣΑΣ İ ﬁ a b c x\u001cy"), (301, words(9, 4000) + "."), (302, "日本語。" * 900)]
    assert check(p.pack(frame(spark, texts), PATH).collect(), texts) < 0.002
    assert check(p.pack(frame(spark, texts), PATH, room=100, order_by=["doc_id"]).collect(), texts, 100) < 0.2


def test_order_by_keeps_the_order(spark):
    texts = [(i, words(i, 50) + ".") for i in range(300)]
    random.Random(1).shuffle(texts)
    rows = p.pack(frame(spark, texts), PATH, order_by=["doc_id"]).collect()
    placed = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert placed == sorted(placed)


def test_empty_and_repeated(spark):
    assert p.pack(frame(spark, []), PATH).count() == 0
    rows = p.pack(frame(spark, [(1, "same text."), (1, "same text."), (None, None)]).coalesce(1), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["doc_tokens"]) for r in rows if r["start"] == 0) == [(0, 0, 1), (1, 0, 4), (1, 0, 4)]
    clash = frame(spark, [(1, "a")]).withColumnsRenamed({"h": "start", "row": "offset"})
    assert p.pack(clash, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert "h" in SCHEMA.names


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_the_cheapest(seed):
    r = random.Random(seed)
    room = r.choice([4, 7, 16, 30])
    at = [0]
    for _ in range(r.randrange(1, 40)):
        at.append(at[-1] + r.randint(1, room))
    penalty = [0, *(r.choice([0, 1, 4, 48]) for _ in at[1:])]
    cuts = p.cuts(np.asarray(at), np.asarray(penalty), room)
    cost = dict(zip(at, penalty, strict=True))
    assert cuts[0] == 0 and cuts[-1] == at[-1] and set(cuts) <= set(at) and max(np.diff(cuts)) <= room
    assert sum(padding(b - a, room) + cost[b] for a, b in zip(cuts, cuts[1:])) == least(at, penalty, room)  # noqa: B905


def test_places_are_close_enough():
    at, penalty = p.places([5000, 1, 3000], [np.asarray([700, 4990]), np.zeros(0, np.int64), np.asarray([2999])], 4096)
    assert at[0] == 0 and at[-1] == 8001 and np.diff(at).max() <= 2 * p.STEP
    cost = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    assert cost[5000] == cost[5001] == 0 and cost[700] == cost[8000] == p.SENTENCE and cost[764] == p.TORN


def test_long_text_in_slices(monkeypatch):
    e = p.WordEncoder(PATH)
    text = (words(4, 3000) + ". ").encode()
    whole = e.encode(text)
    monkeypatch.setattr(p, "SLICE", 100)
    parts = e.encode(text)
    assert parts[0] == whole[0] and parts[1].tolist() == whole[1].tolist()


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 50)
    e, library = p.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for seed in range(8):
        text = words(seed, 80) + "."
        assert np.frombuffer(e.encode(text.encode())[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(e.known) <= 50 + 81
