import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sightline.llm import lexical_search as s
from sightline.llm import queries

from .helpers import frame, odd_texts, words, write

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10, once=True):
    held = [(i, split(t)) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(split(text)), []
        for doc, t, c in held:
            m = 100 - 90 + (90 * len(t) * n_docs) // length
            score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x, times in asked.items() if x in c)
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, n + 1, d if there else None, -score) for n, (score, there, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def items(spark, pairs):
    return spark.createDataFrame([(i, t, 5, "x", 0.5) for i, t in pairs], "item_id long, text string, doc_id int, rank string, score double")


DOCS = [*odd_texts().items(), *((1000 + i, words(700 + i, 40, 60)) for i in range(150)), (None, words(5, 30, 60)), (1000, words(6, 30, 60))]
ITEMS = [(1, words(1, 25, 60)), (2, "W1 w1 w2, W3-w4_w5"), (3, None), (4, ""), (5, "!!"), (6, "é ß 日本 𠮷"), (None, "w7 w8"), (1, "w9"), (7, "absent"), (8, "A" * 5000), (9, words(1, 5000, 4000))]


@pytest.mark.parametrize("once", [True, False])
def test_against_brute_force(spark, once):
    got = s.rank(frame(spark, DOCS), items(spark, ITEMS), once=once)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, ITEMS, once=once)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_blocks_of_documents_and_items(spark, monkeypatch):
    monkeypatch.setattr(s, "ITEM_TERMS", 40)
    got = s.rank(frame(spark, DOCS).repartition(7), items(spark, ITEMS[:8]), k=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, ITEMS[:8], k=4)


def test_best_keeps_ties_from_the_left():
    r = random.Random(2)
    for _ in range(200):
        scores = np.asarray([r.randrange(4) for _ in range(r.randrange(1, 30))])
        k = r.randrange(1, 8)
        assert sorted(s.best(scores, k).tolist()) == sorted(sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:k])


@pytest.mark.parametrize(("docs", "asked"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "..")], [(1, "a")])])
def test_empty_tables(spark, docs, asked):
    assert s.rank(frame(spark, docs), items(spark, asked)).count() == 0


def test_sql(spark, tmp_path):
    folder = write(tmp_path, documents=frame(spark, DOCS), benchmark=items(spark, ITEMS))
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rows = duckdb.sql(queries.OP12_SQL)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(rows.fetchall(), key=repr) == sorted(map(tuple, queries.op12_ranked_lexical_search(spark, folder).collect()), key=repr)
