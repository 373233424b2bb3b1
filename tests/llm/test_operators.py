"""Each operator against its plain version, and on odd rows and empty tables."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starmill.llm import fingerprints, line_dedup, minhash_forest, mixing, quality, queries, sentence_spans, suffix_index, textnp, tiling, token_counts, toxicity
from starmill.llm.store import Store

from . import brute
from .conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def texts_of(rows):
    return [t or "" for _, t in rows]


# 1 toxicity
def test_toxicity_learns_and_holds_out(spark, small):
    found = queries.op1_toxicity(spark, small)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())


def test_toxicity_on_a_planted_vocabulary(spark):
    rng = random.Random(1)
    plain = [f"w{rng.randrange(400)}" for _ in range(3000)]
    rows, labels = [], []
    for i in range(900):
        w = rng.sample(plain, 60)
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    w = toxicity.fit(docs, lab, usable=~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score(docs, w).join(lab, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert out.filter("predicted <> toxic").count() <= 0.02 * out.count()
    assert 0 < np.count_nonzero(w) < 2000


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (6, 1), (6, 1), (None, 1)], "doc_id long, toxic int")
    w = toxicity.fit(odd, labels)
    assert toxicity.score(odd, w).count() == len(ODD)
    blank = toxicity.fit(none, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, blank).collect()} == {0.5}
    assert toxicity.score(none, w).isEmpty()


# 2 token counts
def test_token_counts_equal_the_library(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows)
        got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, BPE).collect()]
        assert sorted(got) == want
    assert token_counts.count_tokens(none, BPE).isEmpty()
    assert token_counts.count_tokens(docs, BPE).filter("over_limit <> (n_tokens > 1024)").isEmpty()


def test_pretokens_of_random_strings():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(BPE), token_counts.Counter(BPE)
    rng = random.Random(2)
    parts = ["'s", "'", "t", " ", "  ", "\n", "re", "'re", "'ll", "a", "é", "1", "٣", "!", "<|endoftext|>", "\t", "日本", " 've", "\r\n", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(3000)]
    import pyarrow as pa

    got = np.concatenate([c.chunk(d, o) for _, _, d, o in textnp.chunks(pa.array(texts), 500)])
    assert got.tolist() == [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


# 3 tiling
def test_tiles_equal_the_textbook():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(6) for _ in range(20)] + item[10:] + [9] + item[:10] + [rng.randrange(6) for _ in range(9)]
        least = 3
        d, i = np.array(doc, np.uint64), np.array(item, np.uint64)
        seeds = [(a, t) for a in range(len(doc) - least + 1) for t in range(len(item) - least + 1) if doc[a : a + least] == item[t : t + least]]
        got = tiling.tile(d, i, np.array([s[0] for s in seeds], int), np.array([s[1] for s in seeds], int), least) if seeds else []
        assert sorted(got) == sorted(brute.tiles(doc, item, least))


def test_decontamination(spark, docs, small, odd, none):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    rows = [
        (1, "x y alpha beta gamma delta epsilon zeta, eta theta iota kappa lambda mu. z"),
        (2, "ETA theta iota kappa lambda mu; and then Alpha beta gamma delta epsilon zeta!"),
        (3, "alpha beta gamma delta other words"), (4, "nothing here"), (5, None), (6, "a tiny item indeed"), (6, "a tiny item indeed"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in tiling.matches(df, items).collect()}
    assert found[1, 1]["coverage"] == 1.0 and found[2, 1]["n_tiles"] == 2 and found[2, 1]["contaminated"] and found[6, 4]["contaminated"]
    assert sorted(r["doc_id"] for r in tiling.keep_clean(df, items).collect()) == [3, 4, 5]
    assert tiling.keep_clean(odd, items).count() == len(ODD) and tiling.keep_clean(odd, items).columns == odd.columns
    assert tiling.matches(none, items).isEmpty() and tiling.matches(df, items.limit(0)).isEmpty()
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    whole = tiling.matches(docs, bench).collect()
    parts = tiling.matches(docs, bench, block=100).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and whole


def test_decontamination_by_an_item_without_id(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta eta"), (7, "one two three four five six")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta eta it is"), (2, "clean words")], "doc_id long, text string")
    found = tiling.matches(df, items).collect()
    assert [(r["doc_id"], r["item_id"], r["contaminated"]) for r in found] == [(1, None, True)]
    assert [r["doc_id"] for r in tiling.keep_clean(df, items).collect()] == [2]


# 4 near duplicates
def test_near_duplicates(spark, docs, texts, odd, none):
    extra, rng = dict(texts), random.Random(4)
    for d in range(1000, 1060):
        w = texts[rng.randrange(200)].split() or ["lone"]
        for _ in range(max(1, len(w) // rng.choice([8, 25, 60, 200]))):
            w[rng.randrange(len(w))] = "edit"
        extra[d] = " ".join(w)
    df = spark.createDataFrame(list(extra.items()), "doc_id long, text string").repartition(4)
    want = brute.near_components(extra)
    got = {r["doc_id"]: r for r in minhash_forest.near_duplicates(df).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert any(c != d for d, (_, c) in want.items())


def test_near_duplicates_large_regions(spark, monkeypatch):
    """Regions above the size that is compared whole: one base with many variants and a passage that unlike texts share."""
    monkeypatch.setattr(minhash_forest, "REGION", 8)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for d in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"e{d}"
        texts[d] = " ".join(w)
    for d in range(100, 140):
        texts[d] = " ".join(base[:20] + [f"r{d}_{i}" for i in range(20)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(df).collect()}
    assert got == brute.near_components(texts)


def test_large_regions_are_finished_exactly(spark, monkeypatch):
    """More classes in every region than are compared whole, most of them unlike: each link is found by the rarest shingles."""
    monkeypatch.setattr(minhash_forest, "REGION", 4)
    monkeypatch.setattr(minhash_forest, "NEXT", 1)
    monkeypatch.setattr(minhash_forest, "LEAST", 1)
    rng = random.Random(16)
    base = [f"b{i}" for i in range(100)]
    texts = {d: " ".join([w for w in base if rng.random() < 0.985] + [f"own{d}_{i}" for i in range(14)]) for d in range(120)}
    want = brute.near_components(texts)
    assert 5 < len({c for _, c in want.values()}) < 115
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.near_duplicates(df).collect()} == want


def test_near_duplicates_of_null_ids_do_not_meet(spark):
    """A row without an id is linked by its own text only; ids may be strings."""
    rows = [(3, "one two three four five six"), (None, "one two three four five six"), (None, "quite another text without any likeness")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash_forest.near_duplicates(df).collect())
    assert got == [(0, 0, True), (0, 3, False), (3, 3, True)]
    assert sorted(r["text"][:3] for r in minhash_forest.keep_one(df).collect()) == ["one", "one", "qui"]
    words = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "two"), (None, "two")], "`my.id` string, text string")
    got = sorted((r["my.id"] or "", r["component_id"]) for r in minhash_forest.near_duplicates(words, "my.id").collect())
    assert got == [("", "c"), ("a", "a"), ("b", "a"), ("c", "c")]


def test_near_duplicates_odd(odd, none):
    rows = minhash_forest.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] and by[7] == [(1, 7, True)] * 2
    assert minhash_forest.near_duplicates(none).isEmpty()
    assert minhash_forest.keep_one(odd).columns == odd.columns


# 5 quality
def test_quality(spark, docs, small, odd, none):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    found = quality.classify(docs).join(labels, "doc_id")
    wrong = found.filter("good <> (quality = 1)").count()
    assert wrong <= 0.1 * found.count()
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.classify(odd).count() == len(ODD)
    assert quality.classify(none).isEmpty()


def test_posterior_finds_the_accuracies():
    rng = np.random.default_rng(7)
    n, k = 4000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    v = np.where(rng.random((n, k)) < 0.97, quality.GOOD, quality.BAD)
    fault = rng.integers(0, 4, n)
    for i in np.flatnonzero(~good):
        v[i, [fault[i], (fault[i] + 1) % k]] = quality.BAD
    v[rng.random((n, k)) < 0.1] = quality.NONE
    pats, back, counts = np.unique(quality.pattern(v), return_inverse=True, return_counts=True)
    p, rate = quality.posterior(pats, counts)
    assert ((p[back] >= 0.5) == good).mean() > 0.85 and rate[0].max() < 0.15


# 6 line dedup
def _line_brute(texts):
    """By edit distance alone: none of the operator's keys, hashes or constants but the words of a line and the tenth."""
    import regex

    def split(line):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    place = [(d, p, " ".join(w)) for d, t in sorted(texts.items()) for p, line in enumerate(t.split("\n")) if len(w := split(line)) >= 3]
    keys = list(dict.fromkeys(k for _, _, k in place))
    u, letters = brute.Union(keys), {k: Counter(k) for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            most = max(len(a), len(b)) // 10
            # letters too many on either side each need an edit
            if max((letters[a] - letters[b]).total(), (letters[b] - letters[a]).total()) <= most and edits(a, b) <= most:
                u.join(a, b)
    gone, seen = {}, set()
    for d, p, key in place:
        g = u.find(key)
        if g in seen:
            gone.setdefault(d, set()).add(p)
        seen.add(g)
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(d, ())) for d, t in texts.items()}


def test_line_dedup(spark, texts):
    rng = random.Random(8)
    some = {d: texts[d] for d in list(texts)[:60]}
    for d in range(500, 560):
        lines = texts[rng.randrange(60)].split("\n")
        line = rng.choice(lines).split()
        for _ in range(rng.randrange(3)):
            if line:
                line[rng.randrange(len(line))] = rng.choice(["of", "new", "X."])
        some[d] = "own words stay in this line %d\n%s\nMore lines. %d" % (d, " ".join(line).upper() if d % 2 else " ".join(line), d)
    long = " ".join(f"word{i}" for i in range(200))
    some[900], some[901] = long, long + " tail"
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}
    assert got == _line_brute(some)
    assert got[901] == ""


def test_line_dedup_hot_bucket(spark):
    """Many variants of one line: more than two classes in a bucket."""
    base = [f"stone{i}" for i in range(40)]
    texts = {d: " ".join(base[:d] + ["xx"] + base[d:]) for d in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}
    assert got == _line_brute(texts) and sum(t == "" for t in got.values()) == 11


@pytest.mark.parametrize("n", [5, 8, 20, 55])
def test_line_dedup_finds_edited_words(spark, n):
    """Copies with one word changed, within a tenth of the line: found whatever the length of the line."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 9)))
    lines = [[word() for _ in range(n)] for _ in range(150)]
    texts = {d: " ".join(w) for d, w in enumerate(lines)}
    for d, w in enumerate(lines):
        at = rng.randrange(n)
        texts[1000 + d] = " ".join([*w[:at], w[at][:-2] + "00", *w[at + 1 :]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}
    assert all(got[d] == texts[d] for d in range(150))
    assert sum(got[1000 + d] == "" for d in range(150)) >= 147


def test_line_dedup_finds_mistyped_lines(spark):
    """One letter wrong in many words: at least nine of ten copies that obey the rule are found in lines of any length, and no other line goes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 9)))
    texts, cells = {}, {}
    for n, k in ((5, 2), (8, 3), (12, 6), (20, 4), (20, 6), (20, 8), (40, 8), (40, 12), (100, 32), (700, 100)):
        for _ in range(10 if n == 700 else 40):
            line = [word() for _ in range(n)]
            copy = [w[:i] + "0" + w[i + 1 :] if at < k else w for at, w, i in zip(rng.sample(range(n), n), line, [2] * n, strict=True)]
            if 10 * k <= len(" ".join(line)):
                cells.setdefault((n, k), []).append(len(texts))
                texts |= {len(texts): " ".join(line), len(texts) + 1: " ".join(copy)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.remove_lines(df).filter("_gone > 0").collect()}
    assert all(d % 2 for d in gone)
    assert {c: True for c in cells} == {c: sum(d + 1 in gone for d in ds) >= 0.9 * len(ds) for c, ds in cells.items()}


def test_line_dedup_odd(odd, none):
    rows = line_dedup.remove_lines(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[10]["text"] == "Same line here.\nother words follow there" and by[10]["_gone"] == 1
    assert any(r["doc_id"] is None and r["text"] == "and more words" for r in rows)
    assert line_dedup.remove_lines(none).isEmpty()


# 7 suffix arrays
@pytest.mark.parametrize("big", [4096, 1])
def test_suffix_index(spark, texts, big):
    rng = random.Random(9)
    some = [(d, texts[d]) for d in list(texts)[:40]]
    shared = texts[1][:300]
    some += [(300 + i, f"{i} " * 5 + shared[i : 200 + i] + f" {rng.random()}" * 4) for i in range(12)]
    some += [(400, "ab" * 200), (401, "é" * 90), (402, None), (403, ""), (404, shared), (404, shared), (None, shared[:99])]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    found = suffix_index.remove_repeats(df, length=100, gram=20, batches=3, big=big)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(bytes(r["_kept"])), len(r["_removed"]), hashlib.sha256(bytes(r["_kept"])).hexdigest()) for r in found.collect())
    want = brute.repeated_bytes([t for _, t in some], 100)
    assert got == sorted((d if d is not None else -1, len((t or "").encode()) - w[0], w[1], w[2]) for (d, t), w in zip(some, want, strict=True))


def test_suffix_index_cuts_long_texts(spark, texts, monkeypatch):
    monkeypatch.setattr(textnp, "CHUNK_BYTES", 700)
    some = [(i, t) for i, t in enumerate([" ".join(list(texts.values())[:8]), texts[3], texts[5] + "x" + texts[6]])]
    found = suffix_index.remove_repeats(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), length=100, gram=20, batches=2)
    got = {r["doc_id"]: hashlib.sha256(bytes(r["_kept"])).hexdigest() for r in found.collect()}
    assert [got[i] for i in range(3)] == [w[2] for w in brute.repeated_bytes([t for _, t in some], 100)]


def test_suffix_levels_merge_geometrically(spark, docs):
    index = suffix_index.SuffixIndex(spark, 100, 20)
    sizes = []
    for i in range(5):
        index.add(docs.filter(F.col("doc_id") % 5 == i))
        sizes.append(sorted(index.levels))
    assert sizes == [[1], [2], [1, 2], [4], [1, 4]]


def test_suffix_index_odd(odd, none):
    found = suffix_index.remove_repeats(odd)
    assert found.count() == len(ODD) and found.columns[: len(odd.columns)] == odd.columns
    assert suffix_index.remove_repeats(none).isEmpty()


# 8 mixing
def test_mixing_meets_its_targets(spark, docs):
    targets = {"source": {f"src{i}": 0.05 for i in range(20)}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    found = mixing.mix(docs, targets, rounds=60)
    cells = found.groupBy("_topic", "lang").agg(F.sum("_tokens").alias("t"), F.max("_weight").alias("w"))
    assert cells.agg(F.count("*")).first()[0] > 4
    per = found.select("source", "lang", "_topic", "_weight", "_tokens").groupBy("source", "lang", "_topic").agg(F.max("_weight").alias("w"), F.sum("_tokens").alias("t"))
    total = per.groupBy("lang").agg(F.sum("w").alias("w")).collect()
    assert sum(r["w"] for r in total) == pytest.approx(1.0)
    for r in total:
        assert r["w"] == pytest.approx(targets["lang"][r["lang"]], abs=0.06)
    expected = found.agg((F.sum(F.col("_tokens") * F.col("_probability")) / F.sum("_tokens")).alias("e")).first()[0]
    assert expected == pytest.approx(mixing.KEEP, abs=1e-6) and found.filter("_probability > 1 OR _probability < 0").isEmpty()


def test_raking_equals_a_plain_loop(spark, docs):
    store = Store(spark, "test")
    placed = mixing.with_cells(docs, store)
    cells = placed.groupBy(*[F.col(f"_{a}").alias(a) for a in mixing.AXES]).agg(F.sum("_tokens").alias("tokens"))
    rows = [r.asDict() for r in cells.collect()]
    w = {tuple(r[a] for a in mixing.AXES): float(r["tokens"]) for r in rows}
    shares = []
    for i in range(3):
        sums = {}
        for k, v in w.items():
            sums[k[i]] = sums.get(k[i], 0) + v
        root = {x: v**mixing.TEMPER for x, v in sums.items()}
        shares.append({x: v / sum(root.values()) for x, v in root.items()})
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            sums = {}
            for k, v in w.items():
                sums[k[i]] = sums.get(k[i], 0) + v
            w = {k: v * shares[i][k[i]] / sums[k[i]] if sums[k[i]] else 0.0 for k, v in w.items()}
    for raked in (mixing.rake(cells), mixing._rake_by_sums(cells, None, mixing.ROUNDS, mixing.TEMPER, store)):
        for r in raked.collect():
            assert r["weight"] == pytest.approx(w[tuple(r[a] for a in mixing.AXES)], abs=1e-9)
    # the raked marginals are the targets
    for i in range(3):
        for x, share in shares[i].items():
            assert sum(v for k, v in w.items() if k[i] == x) == pytest.approx(share, abs=0.02)


def _plain_probabilities(cells, keep):
    """Water filling by bisection: the scale at which the expected tokens are the budget."""
    total = sum(t for t, _ in cells)
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        got = sum(min(t, mid * w) for t, w in cells if t)
        lo, hi = (mid, hi) if got < keep * total else (lo, mid)
    return [min(1.0, lo * w / t) if t else 1.0 for t, w in cells]


def test_calibration_equals_bisection(spark):
    rng = random.Random(12)
    for n in (1, 7, 40):
        rows = [(f"s{i}", "en", "", rng.randrange(0, 900), rng.random() ** 3) for i in range(n)]
        whole = sum(r[4] for r in rows if r[3]) or 1.0
        rows = [(*r[:4], r[4] / whole if r[3] else 0.0) for r in rows]
        raked = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double")
        want = dict(zip([r[0] for r in rows], _plain_probabilities([r[3:] for r in rows], 0.5), strict=True))
        for found in (mixing.calibrate(raked, 0.5), mixing._calibrate_by_sums(raked, 0.5, Store(spark, "test"))):
            assert {r["source"]: r["probability"] for r in found.collect()} == pytest.approx(want, abs=1e-6)


def test_mixing_of_many_cells_is_that_of_few(spark, docs):
    few, many = (mixing.mix(docs, few=n).select("doc_id", F.round("_probability", 9).alias("p"), "_sampled").collect() for n in (mixing.FEW, 0))
    assert sorted(few) == sorted(many)


def test_mixing_odd(odd, none):
    found = mixing.mix(odd.withColumn("source", F.when(F.col("doc_id") > 5, F.col("source"))))
    assert found.count() == len(ODD) and found.filter("_probability IS NULL OR _sampled IS NULL").isEmpty()
    assert mixing.mix(none).isEmpty()


# 9 fingerprints
def test_fingerprints(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        t, nxt, n = t or "", rows[(i + 1) % len(rows)][1] or "", len(t or "")
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.of_text(t) and r["edited_fingerprint"] == fingerprints.of_text(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > np.mean([r["near_next"] for r in got.values()])
    assert fingerprints.compare_with_edits(odd).count() == len(ODD) and fingerprints.compare_with_edits(none).isEmpty()
    one = spark.createDataFrame([(5, "only line")], "doc_id long, text string")
    r = fingerprints.compare_with_edits(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"only only"[:5] + b"only").hexdigest() and r["near_next"] == 1.0


def test_fingerprints_add_up():
    a, b = "first paragraph here\nsecond one", "third"
    assert fingerprints.of_text("second one\nfirst paragraph here") == fingerprints.of_text(a)
    assert fingerprints.add(fingerprints.of_text(a), fingerprints.of_text(b)) == fingerprints.of_text(a + "\n" + b)
    assert fingerprints.remove(fingerprints.of_text(a + "\n" + b), fingerprints.of_text(b)) == fingerprints.of_text(a)
    assert fingerprints.of_text(a) != fingerprints.of_text(a + " ") and len(fingerprints.of_text(a)) == fingerprints.HEX


# 10 sentence spans
def test_sentence_spans(spark, docs, texts, odd, none):
    rng = random.Random(10)
    extra = dict(texts)
    for d in range(700, 730):
        t = texts[rng.randrange(200)]
        extra[d] = f"Own start of {d}. " + t[: rng.randrange(50, 900)] + f"\nOwn end {d}, with some words."
    df = spark.createDataFrame(list(extra.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["_n"], r["_gone"]) for r in sentence_spans.remove_repeats(df).collect()}
    want = brute.span_removals(extra, sentence_spans.SENTENCES, sentence_spans.WORDS, sentence_spans.LONG, sentence_spans.PIECE, _word_hash)
    assert got == want and any(g for _, g in want.values())
    found = sentence_spans.remove_repeats(odd)
    assert found.count() == len(ODD) and found.filter("doc_id = 1").first()["text"] is None
    assert sentence_spans.remove_repeats(none).isEmpty()


@functools.cache
def _word_hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(textnp.words(data, np.array([0, len(data)])).hash[0])


def test_every_repeated_passage_of_fifty_words_is_hit(spark):
    """Passages of 50 words without any punctuation, cut from one long sentence at any place, between words of their own."""
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    source = [word() for _ in range(400)]
    texts = {0: " ".join(source)}
    for d in range(1, 120):
        at = rng.randrange(350)
        texts[d] = " ".join([word() for _ in range(rng.randrange(30))] + source[at : at + 50] + [word() for _ in range(rng.randrange(30))])
    got = {r["doc_id"]: r["text"] for r in sentence_spans.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[0] == texts[0]
    for d in range(1, 120):
        shared = len(set(texts[d].split()) & set(source))
        assert len(set(got[d].split()) & set(source)) <= 0.55 * shared


def test_output_names_give_way(spark):
    df = spark.createDataFrame([(1, "a line of words here", "s", "en", 1, 2, 3, 4)], "doc_id long, text string, source string, lang string, _n long, _gone long, _kept long, _topic long")
    assert sentence_spans.remove_repeats(df).first()["_gone"] == 0
    assert line_dedup.remove_lines(df).first()["_gone"] == 0
    assert bytes(suffix_index.remove_repeats(df).first()["_kept"]) == b"a line of words here"
    assert mixing.mix(df).first()["_sampled"] in (True, False)


@pytest.fixture(scope="module")
def worded(spark):
    """Ids that are words, and columns with dots in their names."""
    long = " ".join(f"stone{i}" for i in range(80))
    rows = [("b", long, "s", "en", 1), ("a", long, "s", "en", 2), (None, long, None, "en", 3), ("c", "quite another line of words here", "t", None, 4), ("d", None, "t", "de", 5)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, lang string, `a.b` int")


def test_ids_may_be_words(spark, worded):
    assert {r["doc_id"]: r["_gone"] for r in line_dedup.remove_lines(worded).collect()} == {"a": 0, "b": 1, None: 1, "c": 0, "d": 0}
    assert {r["doc_id"]: len(bytes(r["_kept"])) for r in suffix_index.remove_repeats(worded).collect()}["b"] == 0
    assert {r["doc_id"]: bool(r["_gone"]) for r in sentence_spans.remove_repeats(worded).collect()} == {"a": False, "b": True, None: True, "c": False, "d": False}
    assert {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(worded).collect()} == {"a": "a", "b": "a", None: "a", "c": "c", "d": "d"}
    items = spark.createDataFrame([("x.1", "another line of words here")], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in tiling.matches(worded, items).collect()] == [("c", "x.1")]
    assert mixing.mix(worded).count() == 5


def test_columns_may_have_dots(worded):
    for found in (line_dedup.remove_lines(worded), suffix_index.remove_repeats(worded), sentence_spans.remove_repeats(worded), mixing.mix(worded), minhash_forest.keep_one(worded), quality.classify(worded, all_columns=True), tiling.keep_clean(worded, worded.select("doc_id", "text").limit(0), item_col="doc_id")):
        assert "a.b" in found.columns and found.filter("`a.b` = 4").count() == 1


def test_lines_of_one_passage(spark, monkeypatch):
    """Many unlike lines that hold one passage: their pairs are not all looked at, and real copies among them are found."""
    monkeypatch.setattr(line_dedup, "WIDE", 4)
    rng = random.Random(30)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([3, 4, 5, 6, 8])))
    passage = [word() for _ in range(30)]
    texts = {d: " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for d in range(40)}
    for d in range(10):
        w = texts[d].split()
        w[5] = "changed"
        texts[100 + d] = " ".join(w)
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [d for d, t in got.items() if t == ""] and {d for d, t in got.items() if t == ""} == set(range(100, 110))


# ids and names of any kind, for all operators
def _ways(odd):
    """Odd rows with ids that are strings, and with dots in the names."""
    dotted = odd.withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"})
    return [(odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), "doc_id", "text"), (dotted, "doc.id", "the.text")]


def test_ids_and_names_of_any_kind(spark, odd):
    labels = spark.createDataFrame([("d1", 1), ("d4", 0), ("d6", 1)], "doc_id string, toxic int")
    for rows, key, text in _ways(odd):
        known = labels.withColumnRenamed("doc_id", key)
        known = known.withColumn(key, F.substring(F.col(f"`{key}`"), 2, 9).cast("long")) if key == "doc.id" else known
        w = toxicity.fit(rows, known, key, text)
        for found in (toxicity.score(rows, w, key, text), token_counts.count_tokens(rows, BPE, key, text), quality.classify(rows, None, key, text), fingerprints.fingerprints(rows, key, text), fingerprints.compare_with_edits(rows, key, text)):
            assert key in found.columns and found.count() == len(ODD)


def test_edits_of_string_ids_follow_their_order(spark):
    rows = [(f"k{i:03d}", f"text {i} of some words") for i in range(300)]
    found = {r["doc_id"]: r for r in fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id string, text string").repartition(5)).collect()}
    texts, ids = dict(rows), sorted(dict(rows), reverse=True)
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        n = len(t)
        assert found[d]["edited_sha256"] == hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()


def test_spans_of_many_rows_without_ids(spark):
    """Rows of null id are documents of their own: of a shared passage one occurrence stays, and the work grows with the rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(200)) + "."
    rows = [(None, " ".join(word() for _ in range(30)) + ". " + passage + " " + " ".join(word() for _ in range(30)) + ".") for _ in range(400)]
    found = sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    middle = " ".join(passage.split()[60:140])
    assert sum(middle in r["text"] for r in found) == 1 and sum(r["_gone"] > 0 for r in found) == 399
    own = sentence_spans.remove_repeats(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert sum(r["_gone"] for r in own) == sum(r["_gone"] for r in found)
    one = sentence_spans.remove_repeats(spark.createDataFrame([(7, passage)] * 300, "doc_id long, text string"))
    assert one.filter("_gone > 0").isEmpty()


def test_training_rows_are_bounded(spark):
    """Rows of one id are one row to learn from, however many there are."""
    docs = spark.createDataFrame([(1, f"vile words {i % 3}") for i in range(500)] + [(i, "plain words") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 12)], "doc_id long, toxic int")
    twice = toxicity.fit(docs, labels)
    once = toxicity.fit(docs.dropDuplicates(["doc_id"]).withColumn("text", F.when(F.col("doc_id") == 1, "vile words 0").otherwise(F.col("text"))), labels)
    assert np.array_equal(twice, once)


def test_likeness_estimates_shared_runs(spark):
    """Against exact counts of three-word runs: one minus the squared length of the difference over the sum of squared lengths."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(400)]
    texts = []
    for k in range(40):
        own = list(base)
        for i in rng.sample(range(400), 10 * k):
            own[i] = word()
        texts.append(" ".join(own))

    def runs(t):
        w = t.split()
        return Counter(zip(w, w[1:], w[2:], strict=False))

    equal, like = fingerprints._vectors(fingerprints.pa.array(texts))
    exact, found = [], []
    for k in range(1, 40):
        a, b = runs(texts[0]), runs(texts[k])
        gap = sum((a[g] - b[g]) ** 2 for g in a.keys() | b.keys())
        exact.append(1 - gap / (sum(v * v for v in a.values()) + sum(v * v for v in b.values())))
        found.append(fingerprints.likeness((equal[:1], like[:1]), (equal[k : k + 1], like[k : k + 1]))[0])
    error = np.abs(np.clip(exact, 0, 1) - np.array(found))
    assert error.mean() < 0.12 and error.max() < 0.45
    assert np.corrcoef(exact, found)[0, 1] > 0.85
