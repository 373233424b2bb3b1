"""Classifiers, tiling and the pipeline's stages against plain versions written from their definitions, without hashing, blocks or vectors."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from starmill.llm import quality, queries, tiling, toxicity
from starmill.llm.store import Store

from . import brute
from .test_operators import _line_brute


class PlainFtrl:
    """FTRL-proximal by the textbook, a weight for each feature by its name."""

    def __init__(self, alpha, l1, l2, beta=1.0):
        self.z, self.n = defaultdict(float), defaultdict(float)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, f):
        z = self.z[f]
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[f])) / self.alpha + self.l2)

    def chance(self, row):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(self.weight(f) * v for f, v in row.items())))))

    def learn(self, row, label):
        w = {f: self.weight(f) for f in row}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[f] * v for f, v in row.items())))))
        for f, v in row.items():
            g = (p - label) * v
            self.z[f] += g - (math.sqrt(self.n[f] + g * g) - math.sqrt(self.n[f])) / self.alpha * w[f]
            self.n[f] += g * g


def _lower(text):
    return (text or "").encode().translate(brute.LOWER)


# 1 toxicity
def toxic_features(text):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", _lower(text))
    found = {("bias",)} | {("word", a) for a in w} | {("begins", k, a[:k]) for a in w for k in (4, 5)}
    return dict.fromkeys(found | {("pair", a, b) for a, b in zip(w, w[1:], strict=False)} | {("skip", a, b) for a, b in zip(w, w[2:], strict=False)}, 1.0)


def test_toxicity_equals_plain_ftrl(spark, small, docs, texts):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("o")).collect()}
    outside = {r["doc_id"] for r in docs.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()}
    known = [d for d in labels if d in texts and d not in outside]
    rows = {d: toxic_features(t) for d, t in texts.items()}
    plain = PlainFtrl(toxicity.ALPHA, toxicity.L1, 0.5)
    for _ in range(toxicity.PASSES):
        for d in sorted(known, key=lambda d: order[d]):
            plain.learn(rows[d], labels[d])
    found = {r["doc_id"]: r for r in queries.op1_toxicity(spark, small).collect()}
    assert len(found) == len(texts)
    # features of the operator share 2**20 places, so a few of them meet
    far = [d for d in texts if abs(found[d]["score"] - plain.chance(rows[d])) > 0.02]
    assert len(far) <= 0.02 * len(texts)
    assert sum(found[d]["predicted"] != int(plain.chance(rows[d]) >= 0.7) for d in texts) <= 1


# 5 quality
SIGNS = {i for i in range(33, 127) if not chr(i).isalnum()}


def facts(text):
    """Of every word: its bytes, and what labellers and shapes look at."""
    out, last = [], None
    for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode()):
        upper, letter = sum(65 <= c <= 90 for c in w), sum(97 <= c | 32 <= 122 or c >= 0xC0 for c in w)
        signs = [c in SIGNS for c in w]
        out.append({"w": w, "upper": upper, "letter": letter, "sign": sum(signs), "closing": len(w) > 1 and signs[-1] and signs[-2], "same": w == last, "lone": all(signs)})
        last = w
    return out


def plain_votes(text):
    f = facts(text)
    n = len(f)
    if n < quality.MIN_WORDS:
        return [quality.NONE] * len(quality.LABELLERS)
    total = lambda k: sum(x[k] for x in f)
    solid = sum(len(x["w"]) for x in f)
    share = {
        "signs": total("sign") / solid, "capitals": total("upper") / max(1, total("letter")), "repeats": total("same") / n, "variety": 1 - len({x["w"] for x in f}) / min(n, 8 * math.sqrt(n)),
        "columns": total("lone") / n, "closing": total("closing") / n, "letters": 1 - total("letter") / solid,
    }
    out = []
    for name in quality.LABELLERS:
        if name == "length":
            mean = solid / n
            out.append(quality.GOOD if 3 <= mean <= 12 else quality.BAD if mean < 2 or mean > 20 else quality.NONE)
        else:
            bad, good = quality.LIMITS[name]
            out.append(quality.BAD if share[name] >= bad else quality.GOOD if share[name] <= good else quality.NONE)
    return out


def plain_posterior(votes, rounds=60):
    """P(good) of each pattern of votes by expectation-maximisation, one document after the other's pattern; classes: good, and a way to be bad for each labeller."""
    counts = Counter(map(tuple, votes))
    k = len(quality.LABELLERS)
    resp = {}
    for v in counts:
        bad = [x == quality.BAD for x in v]
        ours = 0.95 * 0.2 ** sum(bad)
        fault = [float(b) for b in bad] if any(bad) else [1.0] * k
        resp[v] = [ours, *((1 - ours) * f / sum(fault) for f in fault)]
    for _ in range(rounds):
        weight = [sum(resp[v][c] * n for v, n in counts.items()) for c in range(k + 1)]
        share = [(w + 0.1) / (sum(weight) + 0.1 * (k + 1)) for w in weight]
        rate = [[0.0] * k for _ in range(k + 1)]
        for c in range(k + 1):
            for j in range(k):
                bad = sum(resp[v][c] * n for v, n in counts.items() if v[j] == quality.BAD) + (0.02 if c == 0 else 1.2 if c - 1 == j else 0.2)
                good = sum(resp[v][c] * n for v, n in counts.items() if v[j] == quality.GOOD) + (2.0 if c == 0 else 0.3)
                rate[c][j] = bad / (bad + good)
        new = {}
        for v in counts:
            p = [share[c] * math.prod(rate[c][j] if v[j] == quality.BAD else 1 - rate[c][j] if v[j] == quality.GOOD else 1 for j in range(k)) for c in range(k + 1)]
            new[v] = [x / sum(p) for x in p]
        done = max(abs(a - b) for v in counts for a, b in zip(new[v], resp[v], strict=True)) < 1e-9
        resp = new
        if done:
            break
    return {v: r[0] for v, r in resp.items()}


def plain_shapes(text):
    names = []
    for x in facts(text):
        size = len(x["w"])
        case = 0 if not x["upper"] else 1 if x["upper"] < max(x["letter"], 2) else 2
        names.append((case, min(size // 4, 3), min(x["sign"], 3), x["closing"], x["same"], x["lone"], x["letter"] == 0))
    count = Counter([(a,) for a in names] + list(zip(names, names[1:], strict=False)))
    norm = math.sqrt(sum(count.values()))
    return {"bias": 1.0} | {f: math.sqrt(n) / norm for f, n in count.items()}


def plain_quality(texts, order):
    """id -> (posterior of the votes, score) of every text; all are learnt from."""
    votes = {d: tuple(plain_votes(t)) for d, t in texts.items()}
    good = plain_posterior(votes.values())
    rows = {d: plain_shapes(t) for d, t in texts.items()}
    model = PlainFtrl(0.5, 0.5, 0.1)
    for _ in range(quality.PASSES):
        for d in sorted(texts, key=lambda d: order[d]):
            model.learn(rows[d], good[votes[d]])
    return {d: (good[votes[d]], model.chance(rows[d])) for d in texts}


@pytest.fixture(scope="module")
def judged(docs, texts):
    return plain_quality(texts, {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("o")).collect()})


def test_quality_equals_plain_em_and_ftrl(spark, small, judged):
    found = {r["doc_id"]: r for r in queries.op5_quality(spark, small).collect()}
    assert len(found) == len(judged)
    for d, (weak, score) in judged.items():
        assert found[d]["weak_score"] == pytest.approx(weak, abs=1e-6)
        assert found[d]["score"] == pytest.approx(score, abs=0.02)
        assert found[d]["good"] == (score >= quality.KEEP) or abs(score - quality.KEEP) < 0.02


# 3 decontamination
def plain_matches(texts, items):
    """(document, item) -> (words, tiled words, tiles, longest) of all pairs with a common run of five words (of all, in shorter items)."""
    split = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", _lower(t))
    out = {}
    for i, t in items.items():
        item = split(t)
        least = min(5, len(item))
        if not item:
            continue
        runs = {tuple(item[k : k + least]) for k in range(len(item) - least + 1)}
        for d, text in texts.items():
            doc = split(text)
            if any(tuple(doc[k : k + least]) in runs for k in range(len(doc) - least + 1)):
                tiles = brute.tiles(doc, item, least)
                out[d, i] = (len(item), sum(x[2] for x in tiles), len(tiles), max(x[2] for x in tiles))
    return out


def contaminated(texts, items):
    return {d for (d, _), m in plain_matches(texts, items).items() if m[1] / m[0] >= tiling.COVERAGE}


def test_matches_equal_plain_tiling(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(60)}"
    items = {i: " ".join(word() for _ in range(rng.choice([3, 12, 30]))) for i in range(12)} | {90: "", 91: "same words here of all", 92: "same words here of all"}
    texts = {}
    for d in range(60):
        parts = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(12)].split()
            cut = sorted(rng.sample(range(len(w) + 1), 2))
            pieces = [w[cut[0] :], w[: cut[0]]] if rng.random() < 0.5 else [w[cut[0] : cut[1]]]
            parts += [x for p in pieces for x in p] + [word()]
        texts[d] = " ".join(parts)
    texts |= {100: "Same, words here of ALL!", 101: "", 102: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (tiling.BLOCK, 40):
        got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_tiled"], r["n_tiles"], r["longest"]) for r in tiling.matches(df, bench, block=block).collect()}
        assert got == plain_matches(texts, items)
        assert {r["doc_id"] for r in tiling.keep_clean(df, bench, block=block).collect()} == set(texts) - contaminated(texts, items)


# the pipeline
def test_every_stage_equals_its_plain_version(spark, small, docs):
    """Each stage on what its predecessor kept: rows, and texts after the second. Documents short enough for plain edit distances."""
    pipeline = pytest.importorskip("corpus_pipeline")
    store = Store(spark, "plain")
    now = store.keep(docs.filter("length(text) < 1200"), "short")
    order = {r["doc_id"]: r["o"] for r in now.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("o")).collect()}
    judged = plain_quality({r["doc_id"]: r["text"] for r in now.collect()}, order)
    assert len(judged) > 60
    for (name, stage), check in zip(pipeline.STAGES, ("quality", "lines", "near", "bench", "mix"), strict=True):
        before = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        kept = store.keep(stage(spark, now, small), check)
        after = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        if check == "quality":
            close = {d for d, (_, s) in judged.items() if abs(s - quality.KEEP) < 0.02}
            assert set(after) - close == {d for d in before if judged[d][1] >= quality.KEEP} - close and all(after[d] == before[d] for d in after)
        elif check == "lines":
            assert after == _line_brute(before)
        elif check == "near":
            assert after == {d: before[d] for d, (_, c) in brute.near_components({d: t or "" for d, t in before.items()}).items() if c == d}
        elif check == "bench":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
            bad = contaminated({d: t for d, t in before.items() if d not in after}, items)
            assert after == {d: t for d, t in before.items() if d not in bad}
            # of those that stay, none covers an item; tiles of long documents are found by the operator's own report
            clean = tiling.matches(kept, spark.read.parquet(f"{small}/benchmark.parquet")).filter("contaminated")
            assert clean.isEmpty()
        else:
            c = duckdb.connect()
            documents = now.select("doc_id", "text", "source", "lang").toArrow()
            c.register("documents", documents)
            want = {r[0]: r[1:] for r in c.sql(f"SELECT doc_id, topic, tokens, weight, probability FROM ({queries.ORACLE_SQL['op8_mixing']}) WHERE sampled").fetchall()}
            got = {r["doc_id"]: (r["topic"], r["tokens"], round(r["weight"], 9), round(r["probability"], 9)) for r in kept.collect()}
            assert set(got) == set(want)
            assert all(got[d][:2] == want[d][:2] and got[d][2:] == pytest.approx(want[d][2:], abs=1e-8) for d in got)
        now = kept
