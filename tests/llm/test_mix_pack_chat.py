"""Mixing, packing, perspectives, the pipeline and the registered queries."""

import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.llm import mixing, packing, perspectives, tokens
from cadenza.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (1 + i % 37), ("big" if i % 3 else "small") if i % 50 else None, i) for i in range(1500)] + [(9000, None, "small", 0), (9001, "", "void", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pass long")


def exponent(tokens_, budget, entropy, repeats):
    return mixing.bisect_exponent(mixing.local_sums(tokens_), len(tokens_), min(tokens_), max(tokens_), budget, entropy, repeats)


def by_scan(tokens_, budget, entropy, repeats):
    """The exponent by a plain scan of weights, independent of the operator's own sums."""

    def facts(a):
        w = (np.array(tokens_) / max(tokens_)) ** a
        w /= w.sum()
        some = w[w > 0]
        return -(some * np.log(some)).sum() / np.log(len(w)), (w * budget / np.array(tokens_)).max()

    grid = np.arange(0, 60, 0.001)
    met = 0.0 if entropy is None else next(a for a in grid if facts(a)[0] <= entropy)
    if repeats is None or facts(met)[1] <= repeats:
        return met
    way = grid[(grid >= min(met, 1)) & (grid <= max(met, 1))]
    allowed = [a for a in way if facts(a)[1] <= repeats]
    if not allowed:  # not even the shares keep to the limit, which no other weights repeat less than
        return 1.0
    return min(allowed) if met < 1 else max(allowed)


@pytest.mark.parametrize("case", [([900, 60, 40], 1000, 0.9, None), ([900, 60, 40], 1000, 0.9, 1.2), ([105, 100, 95], 300, 0.95, None), ([105, 100, 95], 300, 0.95, 1.5), ([900, 60, 40], 1000, None, 2.0), ([900, 60, 40], 1000, None, None), ([900, 60, 40], 1000, 0.2, None)])
def test_exponent_meets_targets(case):
    assert exponent(*case) == pytest.approx(by_scan(*case), abs=2e-3)


def test_exponent_sharpens_near_level_sources_and_keeps_equal_ones():
    assert exponent([105, 100, 95], 300, 0.95, None) > 1
    assert exponent([5, 5], 10, 0.9, None) == 1.0  # any exponent gives the same weights: none meets 0.9
    assert exponent([7], 7, 0.5, 4.0) == 1.0
    assert exponent([9, 1], 10, 1.0, None) == 0.0


def test_sums_over_sources_are_the_same_by_shuffle(spark):
    t = [900, 60, 40, 40]
    far = mixing.shuffled_sums(spark.createDataFrame([(x,) for x in t], "t long"), 900)
    for a in (0.0, 0.4, 1.0, 7.5):
        assert far(a) == pytest.approx(mixing.local_sums(t)(a))


def test_many_sources_mix_alike(docs):
    few, many = (mixing.mix_order(docs, **k).toPandas() for k in ({}, {"max_sources": 2}))
    key = lambda d: sorted(zip(d["doc_id"], d["pass"]))
    assert key(few) == key(many)


def test_query_tempers_the_whole_table(spark):
    """sf0.01: words counted in plain Python; realised shares meet entropy 0.95 within one document a source."""
    d = "/root/testdata/sf0.01"
    totals, longest = defaultdict(int), defaultdict(int)
    for r in spark.read.parquet(f"{d}/documents.parquet").select("source", "text").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        totals[r.source], longest[r.source] = totals[r.source] + n, max(longest[r.source], n)
    names = sorted(totals, key=str)
    tokens_, budget = [totals[s] for s in names], sum(totals.values())
    a = by_scan(tokens_, budget, 0.95, 4.0)
    assert a != pytest.approx(1.0, abs=0.05)
    got = QUERIES["op10_temperature_mixing"](spark, d).toPandas()
    taken = got.groupby("source").n_tokens.sum()
    w = np.array([t**a for t in map(float, np.array(tokens_) / max(tokens_))])
    for s, want in zip(names, w / w.sum() * budget):
        assert want * 0.995 - 1 <= taken.get(s, 0) <= want * 1.005 + longest[s]
    share = np.array([taken.get(s, 0) for s in names]) / taken.sum()
    entropy = -(share[share > 0] * np.log(share[share > 0])).sum() / np.log(len(names))
    assert entropy == pytest.approx(0.95, abs=0.01)
    counts = got.groupby(["source", "pass"]).doc_id.count()
    docs_of = spark.read.parquet(f"{d}/documents.parquet").groupBy("source").count().toPandas().set_index("source")["count"]
    partial = [s for (s, p), n in counts.items() if n < docs_of[s]]
    assert partial and got["pass"].max() >= 1


@pytest.mark.parametrize("settings", [{"block_rows": 1000}, {"block_rows": 7}, {"block_rows": 20, "budget": 3000}, {"target_entropy": None, "repeats": 3.0, "budget": 90_000}])
def test_quotas_are_met_to_one_document(docs, settings):
    got = mixing.mix_order(docs, **settings).toPandas()
    source = docs.toPandas()
    n = {r.doc_id: len(re.findall(r"\S+", r.text or "")) for r in source.itertuples()}
    totals, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    name = lambda s: s if isinstance(s, str) else None
    for r in source.itertuples():
        totals[name(r.source)] += n[r.doc_id]
        longest[name(r.source)] = max(longest[name(r.source)], n[r.doc_id])
    chosen = mixing.DEFAULTS | settings
    for r in got.itertuples():
        taken[name(r.source)] += r.n_tokens
    some = {s: t for s, t in totals.items() if t}
    budget = chosen["budget"] or sum(some.values())
    a = by_scan(list(some.values()), budget, chosen["target_entropy"], chosen["repeats"])
    raised = {s: (t / max(some.values())) ** a for s, t in some.items()}
    for s, x in raised.items():
        want = x / sum(raised.values()) * budget
        assert want * 0.99 - 1 <= taken[s] <= want * 1.01 + longest[s]
    assert set(source[source.source == "void"].doc_id) <= set(got.doc_id)  # no tokens: once
    assert got.groupby(["doc_id", "pass"]).size().max() == 1


def test_passes_are_different_permutations_and_the_last_is_a_prefix(docs):
    got = mixing.mix_order(docs, budget=60_000, target_entropy=None, repeats=None, block_rows=50).toPandas()
    big = got[got.source == "big"].sort_values(["pass", "super_key", "block_key", "row_key"])
    orders = [g.doc_id.tolist() for _, g in big.groupby("pass")]
    assert len(orders) >= 2 and sorted(orders[0]) == sorted(set(orders[0])) and orders[0] != orders[1][: len(orders[0])]


def test_mix_keeps_columns_and_empty_tables(docs):
    assert mixing.mix(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit(1) for c in ("s", "e1", "t", "d", "k", "__mx_row", "__mx_doc", "__mx_k1", "__mx_id")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == mixing.mix(docs).count() and mixed.filter("__mx_row = 1 AND __mx_doc = 1 AND __mx_k1 = 1").count() == mixed.count()
    long = docs.limit(3).withColumn("text", F.repeat(F.lit("word "), 400_000))
    assert mixing.mix(long).filter("length(text) = 2000000").count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_order(docs.limit(0)).count() == 0


def test_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.vocabulary())
    slow.encode_special_tokens = True
    for text in ("", "plain text, it's 42!", "é à ü ß x", "日本語 текст", "<|endoftext|> a\x85b\x1c c", "\n\n  tabs\t\t", "𝔘𝔫𝔦"):
        assert tokens.encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_cuts():
    assert packing.cuts(5, 8) == [(0, 5)] and packing.cuts(8, 8) == [(0, 8)]
    assert packing.cuts(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cuts(16, 8) == [(0, 8), (8, 8)]


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 40, 300)
    where, offset = packing.sum_of_squares(lengths, 40)
    count, fill = defaultdict(int), {}
    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        if w in fill:  # no other open sequence with room would have given a lower sum
            gap = 40 - fill[w]
            cost = lambda g: (2 * (count[g - n] - count[g] + 1)) if g > n else 1 - 2 * count[g]  # noqa: B023, E731
            assert cost(gap) == min(cost(g) for g in range(n, 40) if count[g])
            count[gap] -= 1
        else:
            assert not any(count[g] for g in range(n, 41))
        assert o == fill.get(w, 0)
        fill[w] = o + n
        assert fill[w] <= 40
        if fill[w] < 40:
            count[40 - fill[w]] += 1


def test_packing(spark):
    texts = [None, "", "hello world", "long " * 700, "x y z " * 90, "hello world"] + [f"text {i} " * (i % 50) for i in range(300)]
    docs = spark.createDataFrame([(i if i != 5 else 2, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, length int, offset string")
    got = packing.pack(packing.pieces(docs, 256), 256, shard_rows=64).toPandas()
    ids = [np.array([*tokens.encode(t or ""), 0], dtype="<u4") for t in texts]
    want = sorted((i if i != 5 else 2, k, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, x in enumerate(ids) for k, (s, n) in enumerate(packing.cuts(len(x), 256)))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 256) * 1.03 + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


TURNS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> there"), (1, 2, "bob", "hello"), (1, 2, "ann", None), (1, 3, "cleo\nx", "é!"), (1, 1, "ann", "hi <|im_end|> there"), (2, None, None, "alone"), (3, 0, "system", "only"), (None, 0, "ann", "lost"), (None, 1, "bob", "found"), (5, 0, None, "x"), (5, 0, " ", "x"), (5, 0, "unknown", "x"), (5, 0, "unknown", None), (5, 0, "unknown", ""), (5, 0, "unknown", "")]


def chat(turns):
    out, convs = {}, defaultdict(list)
    for c, t, role, text in set(turns):
        clean = lambda s: s.replace("<|", "< |")
        convs[c].append((t is not None, t or 0, (re.sub(r"[\r\n]+", " ", clean(role or "")).strip() or "unknown"), text or ""))
    for c, rows in convs.items():
        for p in sorted({r[2] for r in rows} - {"system"}) or [None]:
            text, mask = "", []
            for _, _, who, body in sorted(rows):
                role = "system" if who == "system" else "assistant" if who == p else f"user name={who}"
                text += f"<|im_start|>{role}\n"
                end = len(text) + len(body.replace("<|", "< |") + "<|im_end|>")
                mask += [(len(text), end)] if who == p else []
                text += body.replace("<|", "< |") + "<|im_end|>\n"
            out[c, p] = (text, mask)
    return out


def test_perspectives(spark):
    turns = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, part string")
    got = {(r["conv_id"], r["participant"]): (r["text"], [(m["start"], m["end"]) for m in r["mask"]]) for r in perspectives.perspectives(turns).collect()}
    assert got == chat(TURNS)
    split = perspectives.perspectives(turns, part_turns=2).toPandas()
    joined = split.assign(participant=split.participant.fillna("-"), conv_id=split.conv_id.fillna(-1)).sort_values("part").groupby(["conv_id", "participant"]).text.agg("".join)
    assert joined.to_dict() == {(-1 if c is None else c, p or "-"): t for (c, p), (t, _) in chat(TURNS).items()}
    assert perspectives.perspectives(turns.limit(0)).count() == 0


def test_hot_conversation_spreads_over_parts(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    out = perspectives.perspectives(turns, part_turns=100).toPandas()
    assert len(out) == 60 and (out.n_turns == 100).all()
    whole = "".join(out[out.participant == "a"].sort_values("part").text)
    assert [int(x) for x in re.findall(r"\n(\d+)<", whole)] == list(range(3000))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # a column of whole numbers with nulls is floats on one side
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() or hasattr(v, "dtype") else v
    rows = lambda pdf: sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_run_over_the_whole_table(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = QUERIES[name](spark, sf_dir).count()
    # paragraphs are fewer than documents, and a mix repeats some documents and leaves out others (test_query_tempers_the_whole_table)
    assert rows > 0 if "license" in name or "mixing" in name else rows >= n


def test_pipeline_against_its_stages_by_hand(spark, sf_dir):
    """Every stage's survivors follow from its own input by the plain definitions."""
    import corpus_pipeline as c
    from cadenza.llm import toxicity
    from cadenza.llm._common import stage, table

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    frames = [docs]
    for name, step in c.STAGES:
        frames.append(stage(step(spark, frames[-1], sf_dir), "test"))
        if name != "packing":
            assert frames[-1].columns == docs.columns
    ids = [sorted(r[0] for r in f.select("doc_id").collect()) for f in frames[:4]]
    assert ids[1] == sorted(r.doc_id for r in docs.collect() if model.score(r.text) < 0.5)
    best: dict = {}
    for r in frames[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert ids[2] == sorted(i for _, i in best.values())
    from test_dedup import brute_components, slow_print

    rows = sorted((r.doc_id, slow_print(r.text)) for r in frames[2].collect())
    roots = brute_components([int(np.uint64(f).astype(np.int64)) for _, f in rows], 4)
    assert ids[3] == sorted({min(i for (i, _), r in zip(rows, roots) if r == root) for root in set(roots)})
    packed = frames[5].toPandas()
    assert packed[packed.piece == 0].doc_id.value_counts().to_dict() == frames[4].toPandas().doc_id.value_counts().to_dict()
    assert c.run(spark, sf_dir).count() == len(packed)


def test_many_rows_alike_fill_no_sequence_beyond_its_size(spark):
    alike = spark.range(70_000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "2048L AS length", "5L AS ids_crc32")
    alike = alike.unionByName(spark.range(3000).selectExpr("8L AS doc_id", "0 AS piece", "0L AS start", "700L AS length", "5L AS ids_crc32"))
    rest = spark.range(20_000).selectExpr("id + 100 AS doc_id", "0 AS piece", "0L AS start", "1 + id % 2048 AS length", "id AS ids_crc32")
    got = packing.pack(alike.unionByName(rest)).toPandas()
    assert len(got) == 93_000
    by = got.sort_values(["sequence_id", "offset"])
    number, offset, ends = (x.to_numpy() for x in (by["sequence_id"], by["offset"], by["offset"] + by["length"]))
    first = np.append(True, number[1:] != number[:-1])  # whole numbers: they are above 2**53
    assert (offset[first] == 0).all() and (offset[1:] == ends[:-1])[~first[1:]].all() and ends.max() <= 2048
    assert by["sequence_id"].nunique() <= -(-int(by["length"].sum()) // 2048) * 1.01
