"""The registered corpus queries beside their SQL twins, and the byte limits of the repeated strings."""

import hashlib
import os
import random

import duckdb
import pytest

from starmill.llm import queries, suffix_index

from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, small):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        p = f"{small}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = c.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, small)
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    got = sorted(tuple(r[x] for x in columns) for r in found.collect())
    at = [want.columns.index(x) for x in columns]
    plain = sorted(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(got) == len(plain) > 0
    for a, b in zip(got, plain, strict=True):
        assert a == pytest.approx(b, abs=1e-8) if any(isinstance(v, float) for v in a) else a == b


def test_repeated_bytes_at_the_registered_length(spark, small):
    """op7 as it is registered, against plain slices of 400 bytes over every document of the smallest tables."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = brute.repeated_bytes([r["text"] for r in rows], suffix_index.LENGTH)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_suffix_index(spark, small).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}


@pytest.mark.parametrize(("size", "gone"), [(399, 0), (400, 400), (401, 401)])
def test_passages_around_the_registered_length(spark, size, gone):
    """A passage of over 50 words shorter than 400 bytes is no repeated string by the contract; one of 400 bytes is."""
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: "".join(rng.choice(letters) if i % 7 else " " for i in range(n))
    passage = "P" + text(size - 2) + "Q"
    assert len(passage.split()) > 50 and len(passage) == size
    texts = {1: f"{text(300)}1{passage}2{text(90)}", 2: f"{text(40)}3{passage}4{text(800)}"}
    found = suffix_index.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for r in found.collect():
        kept = texts[r["doc_id"]].replace(passage, "") if gone else texts[r["doc_id"]]
        assert hashlib.sha256(bytes(r["_kept"])).digest() == hashlib.sha256(kept.encode()).digest()
