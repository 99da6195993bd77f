import random

import numpy as np
import pytest

from sightline.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.01, 0.5, 0.995, 1.0]


@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "huge"])
def test_against_sorted_values(spark, kind):
    r = random.Random(kind)
    make = {"even": r.random, "skewed": lambda: r.random() ** 40 * 1e12, "ties": lambda: float(r.randrange(3)), "huge": lambda: r.choice([-1.7e308, 1.7e308, r.random(), -1e-300])}[kind]
    plain = [(r.choice("aaaaab"), make()) for _ in range(1500)] + [("one", 4.0), (None, 1.0), (None, 2.0)]
    bad = [("a", None), ("a", float("nan")), ("a", float("inf")), ("none", None)]
    got = exact_quantiles(spark.createDataFrame(plain + bad, "k string, v double"), ["k"], "v", SHARES, bins=8, few=20)
    rows = {(x["k"], x["share"]): x["quantile"] for x in got.where("k IS NOT NULL").collect()}
    assert set(rows) == {(k, s) for k in ("a", "b", "one") for s in SHARES}
    for (k, s), q in rows.items():
        own = np.sort([v for key, v in plain if key == k])
        h = s * (len(own) - 1)
        a, b = own[int(np.floor(h))], own[int(np.ceil(h))]
        with np.errstate(over="ignore"):
            assert q == pytest.approx(a + (b - a) * (h - np.floor(h)), rel=1e-12)
