"""Packing, periodic runs and fill-in-middle against plain versions, and on odd rows and empty tables."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starmill.llm import fill_in_middle, packing, periodic_runs, queries
from starmill.llm.pretokens import encoder

from .conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# 11 packing
def plain_best_fit(sizes, limit):
    """Bins that best-fit decreasing opens, one item after the other."""
    used, rooms = 0, []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, s)
        if i == len(rooms):
            used += 1
        room = limit if i == len(rooms) else rooms.pop(i)
        if room > s:
            bisect.insort(rooms, room - s)
    return used


def check_packing(rows, limit):
    """Every sequence is filled without a gap, and there are as many as best-fit decreasing opens."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(by) == plain_best_fit([r["length"] for r in rows], limit)


@pytest.mark.parametrize("limit", [1, 7, 100, 1024])
def test_plan_equals_one_item_after_the_other(limit):
    rng = random.Random(limit)
    for _ in range(60):
        sizes = [rng.randint(1, rng.choice([limit, max(1, limit // 3)])) for _ in range(rng.randrange(300))]
        plan = packing.best_fit(Counter(sizes), limit).tolist()
        placed = [(first + i // each, offset + i % each * length, length) for length, _, bins, each, first, offset in plan for i in range(bins * each)]
        assert Counter(p[2] for p in placed) == Counter(sizes)
        check_packing([{"sequence_id": b, "offset": o, "length": n} for b, o, n in placed], limit)


def test_packed_documents_hold_the_ids_of_the_library(spark, small, texts):
    rows = queries.op11_best_fit_packing(spark, small).collect()
    library = Tokenizer.from_file(BPE)
    want = {}
    for d, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_packing(rows, 1024)


def test_sequences_hold_every_document(spark, odd):
    rows = packing.pack_documents(odd, BPE, limit=32, with_ids=True)
    library = Tokenizer.from_file(BPE)
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    assert max(map(len, sequences.values())) <= 32
    whole = defaultdict(list)
    for r in rows.filter("doc_id <> 7").collect():
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        whole[r["doc_id"]].append((r["piece"], r["ids"]))
    for d, t in ODD:
        if d not in (7, None):
            assert sum((p for _, p in sorted(whole[d])), []) == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert rows.filter("doc_id = 7").count() == 2 and rows.filter("doc_id is null").count() == 2


def test_one_length_and_clashing_names(spark):
    rows = spark.range(3000).select(F.lit(5).alias("length"), F.col("id").alias("rank"), F.lit(1).alias("row"), F.lit("x").alias("bucket"))
    found = packing.pack(rows, 12).collect()
    assert len(found) == 3000 and set(found[0].asDict()) == {"length", "rank", "row", "bucket", "sequence_id", "offset"}
    check_packing(found, 12)
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 3000


def test_packing_nothing_and_too_long(spark, none):
    assert packing.pack_documents(none, BPE).isEmpty()
    with pytest.raises(Exception, match="a piece has no token"):
        packing.pack(spark.createDataFrame([(9,)], "length int"), 8).collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, texts):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), encoder(path)
    cases = [t or "" for _, t in ODD] + [*texts.values()][:60] + ["a\x1cb \x1d c\x85d", "  x   y\t\n z  ", "一二三 ⅷ ²³", "I'M i'm 'S don't'll", "_a_b __", "<|endoftext|><|endoftext|>"]
    for t in cases:
        assert np.frombuffer(own.ids(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# 12 periodic runs
def plain_runs(w, shortest):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(shortest, 2 * q):
                found.setdefault((a, i + q - a), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_plain_runs(shortest):
    rng = random.Random(shortest)
    for _ in range(1500):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6, 20])) for _ in range(rng.randrange(90))]
        if len(w) > 10 and rng.random() < 0.5:
            q, a = rng.randrange(1, 12), rng.randrange(len(w))
            for i in range(a + q, min(len(w), a + q * rng.randrange(2, 6) + rng.randrange(5))):
                w[i] = w[i - q]
        assert periodic_runs.find(w, shortest) == plain_runs(w, shortest)


@pytest.mark.parametrize("make", ["fibonacci", "one word", "cube free"])
def test_long_texts_of_few_words(make):
    if make == "fibonacci":
        a, b = "a", "ab"
        while len(b) < 3000:
            a, b = b, b + a
        w = [c.encode() for c in b[:3000]]
    else:
        w = [b"a" if make == "one word" else b"01"[bin(i).count("1") % 2 :][:1] for i in range(3000)]
    assert periodic_runs.find(w, 12) == plain_runs(w, 12)


def test_runs_of_documents(spark, small, texts):
    """The whole query on the smallest tables against slices and plain loops."""
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, small).collect()}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w, 12)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_runs_odd(spark, odd, none):
    rows = odd.withColumn("_runs", F.lit(1)).withColumn("a.b", F.lit(2))
    found = periodic_runs.find_runs(rows).collect()
    assert len(found) == len(ODD) and found[0]["a.b"] == 2
    by = {r["doc_id"]: r for r in found}
    assert by[9]["_runs"] == [(0, 90, 3)] and by[9]["_kept"] == "é ü ß."
    assert by[1]["_runs"] == [] and by[1]["_kept"] == "" and by[3]["_kept"] == "" and by[1]["text"] is None
    assert periodic_runs.find_runs(none).isEmpty()


# 13 fill in the middle
def test_elias_fano_selects_every_value():
    rng = random.Random(2)
    for _ in range(300):
        bound = rng.choice([0, 1, 5, 70, 1000, 10**6])
        values = np.array(sorted(rng.randint(0, bound) for _ in range(rng.randrange(200))), dtype=np.int64)
        kept = fill_in_middle.EliasFano(values, bound)
        assert [kept.select(i) for i in range(len(values))] == values.tolist()


def plain_middle(d, text):
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    draw = hashlib.sha256(f"42:{d}".encode()).hexdigest()
    h = [int(draw[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    return len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_middles_equal_plain_middles(spark):
    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "é 日本\t\x0b\U0001f600  b", "has <S> in it", "<P", "< M >", "x<", *("".join(rng.choice("ab é日\n\t <S>") for _ in range(rng.randrange(400))) for _ in range(300))]
    rows = [(i, texts[i % len(texts)]) for i in range(3 * len(texts))]
    found = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    found = found.withColumn("back", fill_in_middle.restored(F.col("_output"), F.col("_form"))).collect()
    assert len(found) == len(rows) and {r["_form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r["_n"], r["_form"], r["_prefix_chars"], r["_middle_chars"], r["_output"]) == plain_middle(r["doc_id"], r["text"])
        assert r["back"] == r["text"] == texts[r["doc_id"] % len(texts)]


def test_a_text_that_most_documents_have(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three four five ").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    found = {r["doc_id"]: r for r in fill_in_middle.transform(rows).collect()}
    assert len(found) == 3000
    assert all(found[d]["_output"] == plain_middle(d, "one two three four five " if d % 3 else f"own {d}")[4] for d in found)


def test_middles_odd(spark, odd, none):
    rows = odd.withColumnsRenamed({"n": "key", "line": "part", "id": "h0"}).withColumn("_form", F.lit(1)).withColumn("a.b", F.lit(2))
    found = fill_in_middle.transform(rows).collect()
    assert len(found) == len(ODD) and found[0]["a.b"] == 2 and found[0]["h0"] == 7
    assert all(r["_form"] == "plain" and r["_output"] == "" and r["_n"] == 0 for r in found if r["doc_id"] in (1, 2))
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((d, t or "") for d, t in ODD)
    assert fill_in_middle.transform(none).isEmpty()
    strings = fill_in_middle.transform(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))).collect()
    assert {r["_output"] for r in strings if r["doc_id"] == "d5"} == {plain_middle("d5", "one")[4]}
