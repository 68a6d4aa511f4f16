"""op1 and op8 over whole tables against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import toxicity
from cadenza.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def finds(text):
    """(start, kind, end, value) of all candidates."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(out)
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        clear = all(m.end() <= s or e <= m.start() for s, _, e, _ in base)
        if clear and any(c.isascii() and c.isdigit() for c in m[0]) and any(c.isascii() and c.isalpha() for c in m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def bits(value):
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def test_secret_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    owners, repos = defaultdict(set), defaultdict(set)
    for d in docs:
        for *_, value in finds(d.text or ""):
            owners[value].add(d.source)
            repos[value].add((d.source, "/".join(x for x in (d.source, d.lang) if x is not None)))
    want = {}
    for d in docs:
        found = finds(d.text or "")
        copied = {v for *_, v in found if len(owners[v]) >= 3 or len(repos[v]) >= 5}
        live = {v for *_, v in found if v not in copied and bits(v) >= 3.0}
        shown = [x for x in found if x[1] < 3 or x[3] in live]
        kinds = ("assign", "access", "hex", "opaque")
        named = lambda rows: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, _ in rows)  # noqa: B023, E731
        base = [x for x in found if x[1] < 3]
        counts = Counter(x[1] for x in base)
        want[d.doc_id] = (
            counts[0], counts[1], counts[2], hashlib.sha256(named(base).encode()).hexdigest(), named(shown), sum(x[3] in copied for x in shown), sum(x[3] in live for x in shown),
            max((len(owners[x[3]]) for x in shown), default=0), max((len(repos[x[3]]) for x in shown), default=0),
        )
    got = QUERIES["op1_secret_ownership"](spark, SF).collect()
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_copied", "n_live", "most_owners", "most_repos")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in got} == want and len(got) == len(docs)


def bucket(chars):
    """The hashed place of one n-gram, a character at a time."""
    code = 0
    for c in chars:
        code = (code + ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
        code ^= code >> 29
    return (code * 0xD1B54A32D192ED03 % 2**64) >> 44


def test_toxicity_query_over_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows[:60] + [r for r in rows if not r.text]:
        padded = f" {d.text or ''} ".lower()
        seen = {bucket(padded[i : i + n]) for n in range(2, 9) for i in range(len(padded) - n + 1)}
        score = 1 / (1 + math.exp(-(sum(float(model.weights[b]) for b in seen) + model.bias)))
        assert got[d.doc_id]["score"] == pytest.approx(score, abs=1e-6)
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    truth = dict(map(tuple, labels.select("doc_id", "toxic").collect()))
    held = [r["predicted"] == truth[i] for i, r in got.items() if r["held_out"] and truth.get(i) is not None]
    assert held and np.mean(held) >= 0.9


def test_weights_are_scaled_by_log_count_ratios():
    """An n-gram that both classes have alike weighs nothing; of those that one class has, the sign is that class's."""
    texts = ["qq zz both"] * 10 + ["xx yy both"] * 10
    model = toxicity.fit(texts, np.array([1] * 10 + [0] * 10))
    assert model.weights[bucket("bo")] == 0 and model.weights[bucket("qq")] > 0 > model.weights[bucket("xx")]
    ratio = math.log((10 + 1) / (10 + 2)) - math.log((0 + 1) / (10 + 2))
    learnt = model.weights[bucket("qq")] / (0.05 * ratio)
    assert learnt == pytest.approx(model.weights[bucket("zz")] / (0.05 * ratio), rel=1e-5)


def test_clashing_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumns({c: F.lit(7) for c in ("held_out", "predicted", "score", "__tx_label", "toxic")})
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.repeat(F.lit("long words "), 50_000)))
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert toxicity.scores(docs, model).count() == 51
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("held_out = 7 AND predicted = 7 AND toxic = 7").count() == kept.count() > 0


def test_an_id_with_many_rows_is_learned_from_once(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number {i}") for i in range(1, 60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    taught = toxicity.train(docs, labels)
    copies = docs.unionByName(spark.range(100_000).selectExpr("7L AS doc_id", "concat('vile words number 7', repeat('x', CAST(id % 3 AS INT))) AS text"))
    seen = {}
    for r in copies.filter("doc_id = 7").select("text", F.xxhash64("text").alias("h")).distinct().collect():
        seen[r.h] = r.text
    one = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit(seen[min(seen)])).otherwise(F.col("text")))
    many = toxicity.train(copies, labels)
    same = toxicity.train(one, labels)
    assert (many.weights == same.weights).all() and many.bias == same.bias
    assert taught.score("vile words") > 0.5 > taught.score("kind words")
    few = toxicity.train(docs, labels, most_chars=400)
    assert 0 < np.count_nonzero(few.weights) < np.count_nonzero(taught.weights)
    assert not np.count_nonzero(toxicity.train(docs, labels, most_chars=1).weights)


def test_long_texts_are_scored_by_pieces(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    model.weights[:] = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32) / 50
    text = "".join(np.random.default_rng(2).choice(list("abcdefgh ß"), toxicity.PIECE * 2 + 9))
    for t in (text, text[: toxicity.PIECE - 2], text[: toxicity.PIECE - 1], text[: toxicity.PIECE], "", None):
        want = model.logit(np.unique(toxicity.grams(t)))
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-12)


def plain_regression(texts, y, half, features):
    """Log-count ratios, choice of features and regression with dictionaries and loops; the halves' models move the bias."""
    sets = [{bucket(p[i : i + n]) for n in range(2, 9) for i in range(len(p) - n + 1)} for p in (f" {t} ".lower() for t in texts)]

    def model(rows):
        pos, neg = [sets[i] for i in rows if y[i]], [sets[i] for i in rows if not y[i]]
        df = [Counter(b for s in g for b in s) for g in (neg, pos)]
        ratio = {b: math.log((df[1][b] + 1) / (len(pos) + 2)) - math.log((df[0][b] + 1) / (len(neg) + 2)) for b in range(1 << 20) if df[0][b] + df[1][b]}
        least = min(5, max(2, len(pos) / 10))
        worth = {b: abs(r) * math.sqrt(df[0][b] + df[1][b]) for b, r in ratio.items() if df[0][b] + df[1][b] >= least}
        keep = sorted(worth, key=lambda b: (-worth[b], b))[:features]
        keep = [b for b in keep if worth[b] > 0]
        w, bias = dict.fromkeys(keep, 0.0), 0.0
        m, v = dict.fromkeys([*keep, -1], 0.0), dict.fromkeys([*keep, -1], 0.0)
        x = {i: [b for b in sets[i] if b in w] for i in rows}
        for step in range(1, 301):
            grad = dict.fromkeys(keep, 0.0)
            at = 0.0
            for i in rows:
                z = sum(0.05 * ratio[b] * w[b] for b in x[i]) + bias
                g = (1 / (1 + math.exp(-z)) - y[i]) * (0.5 / len(pos) if y[i] else 0.5 / len(neg))
                at += g
                for b in x[i]:
                    grad[b] += 0.05 * ratio[b] * g
            for b in (*keep, -1):
                g = at if b == -1 else grad[b] + 1e-5 * w[b]
                m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.99 * v[b] + 0.01 * g * g
                move = 0.05 * m[b] / (1 - 0.9**step) / (math.sqrt(v[b] / (1 - 0.99**step)) + 1e-8)
                if b == -1:
                    bias -= move
                else:
                    w[b] -= move
        return {b: 0.05 * ratio[b] * w[b] for b in keep}, bias

    everyone = range(len(texts))
    weights, bias = model(everyone)
    z = {}
    for k in (0, 1):
        other, shift = model([i for i in everyone if half[i] == k])
        z |= {i: sum(other.get(b, 0.0) for b in sets[i]) + shift for i in everyone if half[i] != k}
    edges = sorted(z.values())
    places = [edges[0] - 2, *((a + b) / 2 for a, b in zip(edges, edges[1:])), edges[-1] + 0.5]
    places[0] = edges[0] - 0.5
    errors = [sum((z[i] > c) != bool(y[i]) for i in everyone) for c in places]
    best = [c for c, e in zip(places, errors) if e == min(errors)]
    return weights, bias - sum(best) / len(best)


def test_fit_against_plain_loops():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcde"), 3)) for _ in range(12)]
    texts = [" ".join(rng.choice(words[:8] if i % 3 else words[4:], 4)) for i in range(42)]
    y = [int(i % 3 == 0) for i in range(42)]
    y[4], y[9] = 1, 0
    made = toxicity.fit(texts, np.array(y), features=60)
    weights, bias = plain_regression(texts, y, [i % 2 for i in range(42)], 60)
    assert {int(b) for b in np.flatnonzero(np.abs(made.weights) > 1e-7)} <= set(weights)
    assert made.bias == pytest.approx(bias, abs=1e-6)
    for b, w in weights.items():
        assert float(made.weights[b]) == pytest.approx(w, abs=1e-6)
