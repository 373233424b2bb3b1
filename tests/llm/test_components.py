import random

import pytest

from starmill.llm.components import components
from starmill.llm.store import Store

from .brute import Union


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "path": [(i, i + 1) for i in range(40)], "star": [(50, i) for i in range(50)], "empty": []}[kind]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Store(spark, "t")).collect()}
    alone = {a for a, b in edges if a == b}
    want = {n: u.find(n) for n in u.up}
    assert all(found.get(n, n) == c for n, c in want.items())
    assert set(found) >= set(want) - alone
