import random

import numpy as np
import pytest

from sightline.llm import line_dedup as ld
from sightline.llm import queries as q
from sightline.llm import simhash as sh
from sightline.llm import substring_dedup as sd

from .helpers import frame, lines, odd_texts, words, write


def brute_lines(rows):
    """Every line that an earlier line equals or comes within one edit of, by all pairs."""
    seen, gone = [], {}
    for i, text in sorted((i, t) for i, t in rows if t):
        for k, line in enumerate(text.split("\n")):
            w = ld.line_words(line)
            if not w:
                continue
            if any(w == x or min(len(w), len(x)) >= ld.NEAR_WORDS and ld.within_one(w, x) for x in seen):
                gone.setdefault(i, []).append(k)
            seen.append(w)
    return gone


def edited(line, seed):
    r, w = random.Random(seed), line.split()
    at = r.randrange(len(w))
    return " ".join([w[:at] + ["new"] + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + ["new"] + w[at:]][seed % 3])


def test_lines_against_all_pairs(spark, tmp_path):
    base = [words(i, 8 + i % 9) for i in range(40)]
    r = random.Random(1)
    texts = {i: "\n".join(edited(b, r.randrange(999)) if r.random() < 0.4 else b for b in r.sample(base, 6)) + "\nhi there\nA  b C" for i in range(60)}
    texts |= odd_texts()
    d = write(tmp_path, documents=frame(spark, texts))
    got = {x["doc_id"]: x for x in q.op1_line_dedup(spark, d).collect()}
    want = brute_lines(texts.items())
    assert set(got) == set(texts)
    for i, x in got.items():
        assert x["dropped_lines"] == ",".join(map(str, want.get(i, []))), i
    assert sum(x["n_dropped"] for x in got.values()) > 100


def test_apply_keeps_columns_and_cuts_text(spark):
    a = lines(1, 3)
    df = frame(spark, [(1, a), (2, a + "\nfresh words here now"), (3, a), (4, None), (5, "")])
    out = {r["doc_id"]: r for r in ld.apply(df).collect()}
    assert set(out) == {1, 2, 4, 5} and out[2]["text"] == "fresh words here now" and out[1]["text"] == a
    assert list(out[1].asDict()) == df.columns and out[1]["version"] == "v"


def test_one_hot_line_variants(spark):
    shape = "this is line number {} of the long log file today"
    df = frame(spark, [(i, shape.format(i)) for i in range(300)])
    assert ld.dropped_lines(df).count() == 299


def brute_groups(prints, radius=3):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark, tmp_path):
    texts = odd_texts() | {300 + i: words(9, 400) + f" tail{i}" for i in range(12)}
    d = write(tmp_path, documents=frame(spark, texts))
    prints = {i: sh.fingerprint(t) for i, t in texts.items()}
    groups = brute_groups(prints)
    rows = q.op4_simhash(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (format(prints[r["doc_id"]], "016x"), groups[r["doc_id"]])


@pytest.mark.parametrize("seed", range(3))
def test_trees_lose_no_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_ROWS", 64)
    monkeypatch.setattr(sh, "LEAF", 8)
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(300)]
    prints = {i: b for i, b in enumerate(base)}
    for i in range(400):  # chains that drift, and dense groups
        near = prints[r.randrange(len(prints))]
        for _ in range(r.randint(1, 4)):
            near ^= 1 << r.randrange(64)
        prints[300 + i] = near
    signed = [(i, p - (p >> 63 << 64)) for i, p in prints.items()]
    got = {x["doc_id"]: x["component_id"] for x in sh.near_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_groups(prints)


def test_similar_documents(spark):
    base = words(5, 300).split()
    near = [*base[:100], "changed", *base[101:200], "too", *base[201:]]
    far = [f"z{i}" if i % 4 == 0 else w for i, w in enumerate(base)]
    df = frame(spark, {1: " ".join(base), 2: " ".join(near), 3: " ".join(far), 4: None, 5: "", 6: "solo"})
    got = {r["doc_id"]: r["component_id"] for r in sh.similar_documents(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_similar_documents_of_a_template_against_all_pairs(spark):
    """Many documents of one template (0.55 to 0.85 alike) share bands without being copies; copies among them are found all the same."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(240)]

    def other(words_, n, seed):
        out, s = list(words_), random.Random(seed)
        for at in s.sample(range(len(out)), n):
            out[at] = f"x{seed}_{at}"
        return out

    texts = {i: other(base, 14, i) for i in range(60)}
    texts |= {100 + i: other(texts[r.randrange(60)], r.choice([1, 2, 3, 5]), 100 + i) for i in range(60)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {x["doc_id"]: x["component_id"] for x in sh.similar_documents(frame(spark, {i: " ".join(w) for i, w in texts.items()})).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert all(got[i] == i for i in texts if i not in linked)


def test_clashing_names_and_odd_rows_in_every_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    from sightline.llm import stages

    rows = [*odd_texts().items(), (9, odd_texts()[9]), (None, lines(3, 30)), (None, None)]
    df = frame(spark, rows)
    for name in ("_text", "_dropped", "_doc", "_version", "doc", "dropped", "cut_text", "gone", "fp", "component_id", "id", "hash", "c0", "Doc_ID_", "a b", "words", "line"):
        df = df.withColumn(name, F.lit(name))
    d = write(tmp_path, labels=spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, "one of the many items that no document here holds at all")], "item_id long, text string"))
    for stage in (stages.drop_toxic, stages.drop_repeated_lines, stages.drop_near_copies, stages.drop_leaks):
        out = stage(spark, df, d)
        assert out.columns == df.columns
        got = out.collect()
        assert {x["gone"] for x in got} == {"gone"} and {x["a b"] for x in got} == {"a b"}
        assert sum(x["doc_id"] is None for x in got) == 2
        assert len(got) == len(rows) or stage in (stages.drop_repeated_lines, stages.drop_near_copies)
        assert stage(spark, df.limit(0), d).count() == 0
    assert stages.encode_pieces(spark, df, d).count() == len(rows)


def test_passages(spark, tmp_path):
    shared = words(77, 70)
    fuzzy = shared.split()
    fuzzy[20], fuzzy[50] = "other", "word"
    texts = odd_texts() | {400: words(1000, 200) + " " + shared + " " + words(1001, 50), 401: words(1002, 30) + " " + shared, 402: " ".join(fuzzy) + " " + words(1003, 90), 403: words(1004, 300)}
    d = write(tmp_path, documents=frame(spark, [*texts.items(), (401, texts[401])]))
    rows = [r for r in q.op5_substring_dedup(spark, d).collect() if r["doc_id"] >= 400]
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(401, 400), (402, 400)}
    exact = next(r for r in rows if r["doc_id"] == 401)
    assert (exact["start"], exact["end"], exact["other_start"], exact["other_end"], exact["identity"]) == (30, 100, 200, 270, 1.0)
    assert all(r["n_equal"] >= 60 for r in rows)


@pytest.mark.parametrize("equal", [0.95, 0.9, 0.85])
def test_edited_passages_are_found_around_any_seed(equal):
    r = np.random.default_rng(7)
    some = lambda n: r.integers(0, 1 << 62, n)
    for n in (60, 80, 100):
        p = some(n)
        q = p.copy()
        at = r.choice(n, round((1 - equal) * n), replace=False)
        q[at] = some(len(at))
        whole = [i for i in range(n - sd.K + 1) if (p[i : i + sd.K] == q[i : i + sd.K]).all()]
        q = np.insert(np.delete(q, at[0]), at[1], some(1)) if len(whole) > 30 and abs(at[0] - at[1]) > 20 else q
        a, b = np.concatenate([some(40), q, some(40)]), np.concatenate([some(30), p, some(50)])
        seeds = [(x, y) for x in range(len(a) - 4) for y in range(len(b) - 4) if (a[x : x + 5] == b[y : y + 5]).all()]
        best = np.zeros((len(a) + 1, len(b) + 1), int)  # brute force: most equal words in order
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j]))
        found = [f for x, y in seeds for f in sd.similar(a, b, [x], [y])]
        assert len(found) >= 0.9 * len(seeds)
        for start, end, other_start, other_end, kept in found:
            assert sd.IDENTITY * max(end - start, other_end - other_start) <= kept <= best[-1, -1]
        assert max(f[4] for f in found) >= 0.93 * best[-1, -1]


@pytest.mark.parametrize("vocabulary", [6, 20, 60])
def test_the_bound_drops_no_passage(vocabulary, monkeypatch):
    r = np.random.default_rng(vocabulary)
    cases = []
    for _ in range(60):
        p = r.integers(0, vocabulary, 140)
        q = p.copy()
        q[r.random(140) < r.choice([0.1, 0.2, 0.3, 0.6])] = 999
        q = np.concatenate([r.integers(0, vocabulary, 20), np.insert(np.delete(q, 30), 90, 5)])
        seeds = [(x, y) for x in range(136) for y in range(x + 12, min(x + 28, 156)) if (p[x : x + 5] == q[y : y + 5]).all()]
        if seeds:
            x, y = seeds[int(r.integers(len(seeds)))]
            later = [s for s in seeds if s[0] > x + 20 and s[1] > y + 20][:1]
            cases.append((p, q, [x, *(s[0] for s in later)], [y, *(s[1] for s in later)]))
    with_bound = [sd.similar(*c) for c in cases]
    monkeypatch.setattr(sd, "possible", lambda *_: True)
    assert with_bound == [sd.similar(*c) for c in cases] and any(with_bound)


def test_extension_drops_no_exact_passage():
    r = np.random.default_rng(8)
    p = r.integers(0, 1 << 62, 180)
    q = p.copy()
    q[[i for i in range(180) if not 64 <= i < 116 and i % 10 in (2, 5, 8)]] = 1
    assert sd.similar(p, q, [80], [80])


def test_the_first_chain_is_the_best_of_all():
    r = np.random.default_rng(4)
    for _ in range(60):
        x, y = r.integers(0, 90, 11), r.integers(0, 90, 11)
        best = -1.0
        for some in range(1, 1 << 11):  # brute force: every set of matches that is a chain
            c = sorted((i for i in range(11) if some >> i & 1), key=lambda i: x[i])
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:])):  # noqa: B905
                best = max(best, sd.K * len(c) - sd.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:])))  # noqa: B905
        got = sd.chains(x, y)
        c = got[0]
        assert sd.K * len(c) - sd.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) == pytest.approx(best)
        assert sorted(i for c in got for i in c) == list(range(11))


def test_copies_of_a_text_have_one_passage(spark):
    a, b = words(1, 120), words(2, 30) + " " + words(1, 120) + " " + words(3, 30)
    rows = {(x["doc_id"], x["other_id"], x["start"], x["end"], x["n_equal"]) for x in sd.passages(frame(spark, [(5, a), (6, a), (6, a), (7, b), (8, b), (9, a + "\n"), (None, a)])).collect()}
    assert {r for r in rows if r[0] != 9} == {(6, 5, 0, 120, 120), (7, 5, 30, 150, 120), (8, 7, 0, 180, 180)}
    assert {r[1] for r in rows if r[0] == 9} == {5}


def test_a_hot_seed_is_spread(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sightline.llm import common

    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v")
    right = spark.range(3000).selectExpr("id AS k", "id * 2 AS w")
    got = common.skew_join(left.union(left), right.where("k % 2 = 0"), ["k"], left.union(left).groupBy("k").agg(F.count("*").alias("n")))
    want = sorted((k, v, 2 * k) for v in [*range(3000)] * 2 for k in [0 if v % 3 == 0 else v] if k % 2 == 0)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == want


def test_empty_tables(spark, tmp_path):
    d = write(tmp_path, documents=frame(spark, {}))
    for f in (q.op1_line_dedup, q.op4_simhash, q.op5_substring_dedup):
        assert f(spark, d).count() == 0
    assert sh.similar_documents(frame(spark, {})).count() == 0
