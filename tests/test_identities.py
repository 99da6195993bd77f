import random

import pytest

from sightline.operators import chains
from sightline.streaming.identities import Identities


def union_find(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(3))
def test_merged_equals_a_union_find(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100, 100), (201, 200), (200, 201)] + [(300, 301 + i) for i in range(30)] + [(400 + i, 401 + i) for i in range(20)]
    got = chains.merged(spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in got} == union_find(links) and len(got) == len(union_find(links))


def test_batches_equal_a_union_find(spark, tmp_path):
    r = random.Random(7)
    ids = Identities(spark, str(tmp_path / "ids"), buckets=8)
    assert ids.components() is None
    links = []
    for n in range(4):
        batch = [(r.randrange(80), r.randrange(80)) for _ in range(14)] + [(90 + n, 91 + n), (5, 5)]
        ids.merge(spark.createDataFrame(batch, "a long, b long"), n)
        links += batch
        assert {x["node"]: x["root"] for x in ids.components().collect()} == union_find(links)
    want = union_find(links)
    ids.merge(spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"), 3)  # played again
    assert {x["node"]: x["root"] for x in ids.components().collect()} == want
    asked = spark.createDataFrame([(5,), (93,), (777,), (5,), (None,)], "node long")
    assert {x["node"]: x["root"] for x in ids.find(asked).collect()} == {5: want[5], 93: want[93], 777: 777}
    version = ids.table.versions()[-1]
    ids.merge(spark.createDataFrame([(1001, 1000)], "a long, b long"), 4)
    assert len(list((tmp_path / f"ids/data/v{version + 1}").glob("bucket=*"))) <= 2  # only the buckets of what it names
