"""Every registered particle query against its SQL twin."""

import os

import duckdb
import pytest

from starmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The size at which queries are held against SQL by others as well.
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{MEDIUM}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _rows(columns, rows):
    plain = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(name, spark, duck):
    found = registry.queries()[name](spark, MEDIUM)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    a, b = _rows(found.columns, [tuple(r) for r in found.collect()]), _rows(want.columns, want.fetchall())
    assert len(a) == len(b) > 0
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or isinstance(p, float) and q is not None and abs(p - q) <= 2e-5 * max(1, abs(p)) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 500 and df.columns == ["id", "ax", "ay", "az", "pot"]
    assert set(e.oracle_sql()) <= set(e.queries())
