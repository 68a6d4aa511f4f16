"""Exact and near duplicates against brute force, with nulls, blanks, repeated rows and clashing columns."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import components, exact_dedup, simhash

BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill by the river "
TEXTS = [None, "", "  \t\n", "a b c", "abc", "a  b c ", BASE * 4, BASE * 4 + " ", BASE * 4 + "end", "x" * 50_000, "é à ü " * 30, "é à ü " * 30, "one", "Straße", "STRASSE"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", i * 2) for i, t in enumerate(TEXTS)] + [(3, "a b c", "src", 6), (3, "a b c", "src", 6), (None, "abc", None, None), (None, None, "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, seg long")


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(docs):
    rows = [r.asDict() for r in docs.collect()]
    got = exact_dedup.duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for r in rows:
        groups.setdefault(normal(r["text"]), []).append(r)
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        kept = False
        for r in members:
            own = not kept and r["doc_id"] == best["doc_id"] and len(r["text"] or "") == len(best["text"] or "")
            kept |= own
            want.append((r["doc_id"], best["doc_id"], len(members), own, hashlib.sha256(key.encode()).hexdigest()))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 20])
def test_exact_keeps_one_row_a_group_and_all_columns(docs, max_bits):
    docs = docs.withColumns({c: F.lit(1) for c in ("slot", "n", "best", "bucket", "map", "size", "__xd_key", "__xd_doc", "__xd_maybe", "__xd_id")})
    kept = exact_dedup.exact_dedup(docs, max_bits=max_bits)
    assert kept.columns == docs.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(r["text"]) for r in docs.collect()})


def test_exact_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 4000).cast("string").alias("text"))
    probed = exact_dedup.possible_repeats(exact_dedup.digests(keys), 1 << 17)
    maybe = probed.filter("__xd_maybe").count()
    assert probed.filter("__xd_maybe AND doc_id % 4000 < 1000").count() == 2000 and maybe < 3500


def test_hot_group_and_empty_table(spark, docs):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.duplicate_groups(hot)
    assert out.filter("kept").count() == 2001 and out.filter("group_size = 1000").count() == 1000
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_filter_stays_sharp_at_any_size(spark):
    """2**15 bits are enough for 2048 rows: 30,000 different rows have 16 bitmaps, which meet them by number, and unique rows still pass straight."""
    keys = spark.range(30_000).select(F.when(F.col("id") < 600, F.col("id") % 300).otherwise(F.col("id")).alias("doc_id"))
    keys = keys.withColumn("text", F.concat(F.lit("text "), "doc_id"))
    probed = exact_dedup.possible_repeats(exact_dedup.digests(keys), 1 << 15)
    assert probed.count() == 30_000
    assert probed.filter("doc_id < 300 AND NOT __xd_maybe").count() == 0
    assert probed.filter("doc_id >= 600 AND __xd_maybe").count() < 300
    kept = exact_dedup.exact_dedup(keys, max_bits=1 << 15)
    assert kept.count() == kept.select("doc_id").distinct().count() == 29_700
    groups = exact_dedup.duplicate_groups(keys, max_bits=1 << 15)
    assert groups.filter("group_size = 2").count() == 600 and groups.filter("kept").count() == 29_700


def test_plan_and_jobs_do_not_grow_with_the_rows(spark):
    seen = []
    for n in (4000, 60_000):
        keys = exact_dedup.digests(spark.range(n).selectExpr("id AS doc_id", "concat('text ', id % 3900) AS text"))
        group = f"exact-{n}"
        spark.sparkContext.setJobGroup(group, group)
        out = exact_dedup.possible_repeats(exact_dedup.stage(keys, "keys"), 1 << 15)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext._jsc.clearJobGroup()
        assert out.filter("NOT __xd_maybe").count() <= 3800
        seen.append((jobs, len(out._jdf.queryExecution().optimizedPlan().toString().splitlines())))
    assert seen[0] == seen[1]


def test_without_ids(spark):
    left = exact_dedup.without_ids(spark.range(100).toDF("doc_id"), spark.range(0, 100, 3).toDF("gone"))
    assert sorted(r[0] for r in left.collect()) == [i for i in range(100) if i % 3]


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("text", [*TEXTS, "a b c d", "a b c d e", "A\x0bB\x0cC D e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    a = np.array(fps, dtype=np.int64).view(np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = sorted((root(i), root(int(j))))
            label[y] = x
    return [root(i) for i in range(len(fps))]


def clustered(seed, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 8):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            for b in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                at ^= 1 << b
            out.append(at)
    hub = int(rng.integers(0, 1 << 63))
    out += [hub ^ 1 << int(b) ^ 1 << int(c) for b, c in rng.integers(0, 62, (120, 2))]
    return [int(np.uint64(x & (1 << 64) - 1).astype(np.int64)) for x in dict.fromkeys(out)]


@pytest.mark.parametrize(("seed", "chunk", "levels"), [(1, 1024, 3), (2, 16, 0), (3, 4, 1), (4, 8, 3)])
def test_links_have_the_components_of_all_pairs(spark, seed, chunk, levels):
    fps = clustered(seed)
    frame = spark.createDataFrame([(f, 1 + i % 3, i) for i, f in enumerate(fps)], "fp long, n long, least long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 4, chunk, levels)).collect()}
    want = brute_components(fps, 4)
    classes = {}
    for f, w in zip(fps, want):
        classes.setdefault(w, set()).add(f)
    for members in classes.values():
        if len(members) > 1:
            assert {got[f] for f in members} == {min(members)}
        else:
            assert got.get(next(iter(members)), next(iter(members))) == next(iter(members))


def test_unequal_thresholds_cover_all_pairs():
    rng = np.random.default_rng(0)
    groups = np.array_split(rng.permutation(64), 4)
    for thresholds in ([1, 0, 0, 0], [2, 0, 0, -1], [3, -1, -1, 0]):
        masks = [m for g, t in zip(groups, thresholds) if t >= 0 for m in simhash.masks(sorted(g.tolist()), t)]
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(int(np.int64(m).astype(np.uint64)) & flips == 0 for m in masks)


def test_allocation_is_the_cheapest():
    cost = np.random.default_rng(1).random((4, 6)).cumsum(axis=1)
    from itertools import product

    for total in (-4, -1, 0, 1, 4):
        best = min(sum(cost[i][t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, 5), repeat=4) if sum(ts) == total)
        found, chosen = simhash.allocate(cost, total)
        assert found == pytest.approx(best) and sum(chosen) == total


def test_distance_shares():
    h = np.random.default_rng(2).integers(0, 9, 16)
    want = np.zeros(5)
    for i in range(16):
        for j in range(16):
            want[bin(i ^ j).count("1")] += h[i] * h[j]
    assert np.allclose(simhash.distance_shares(h), want / want.sum())


def test_components_of_long_chains(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000
    assert components.components(edges.limit(0)).count() == 0


def test_near_groups_and_survivors(spark, docs):
    marks = simhash.near_groups(simhash.fingerprints(docs)).toPandas()
    assert len(marks) == docs.count()
    known = marks[marks.doc_id.notna()]
    fps = known.fp.tolist()
    roots = brute_components(fps, 4)
    least = known.groupby(pd.Series(roots, index=known.index)).doc_id.transform("min")
    assert (least == known.component_id).all()
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == marks.component_id.nunique()
    clash = docs.withColumns({c: F.lit(1) for c in ("fp", "root", "component_id", "n", "key", "bucket", "map")})
    again = simhash.near_dedup(clash)
    assert again.columns == clash.columns and again.count() == kept.count()
    assert simhash.near_dedup(docs.limit(0)).count() == 0
