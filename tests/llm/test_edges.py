"""Nulls, empty tables, clashing names and very long texts, through the pipeline and single operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import licenses, secrets, simhash
from cadenza.llm._common import stage

SF = "/root/testdata/sf0.001"
CLASHES = ("__xd_key", "__xd_doc", "__mx_doc", "__mx_row", "__sh_id", "fp", "seg", "key", "root", "size", "shard", "length", "offset", "sequence_id", "piece", "start", "hub", "far")


@pytest.fixture(scope="module")
def docs(spark):
    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    row = lambda i, **k: whole.limit(1).withColumns({"doc_id": F.lit(i).cast("long"), **{c: F.lit(v).cast(dict(whole.dtypes)[c]) for c, v in k.items()}})
    odd = [row(900_001, text=None), row(900_002, text=""), row(900_003, text="one two three four five", source=None, lang=None), row(None, text="nobody's text is here now"), row(900_004, text="tail " * 60_000, n_chars=None)]
    for more in odd:
        whole = whole.unionByName(more)
    return stage(whole.withColumns({c: F.lit(5) for c in CLASHES}), "odd")


def through(spark, docs):
    frames = [docs]
    for _, step in corpus_pipeline.STAGES:
        frames.append(stage(step(spark, frames[-1], SF), "edge"))
    return frames


def test_pipeline_with_nulls_clashes_and_a_long_text(spark, docs):
    frames = through(spark, docs)
    for f in frames[1:-1]:
        assert f.columns == docs.columns
        assert f.filter(" AND ".join(f"{c} = 5" for c in CLASHES)).count() == f.count() > 0
    assert frames[1].filter("text IS NULL").count() == 1  # an empty text is not toxic
    assert frames[2].filter("text IS NULL OR text = ''").count() == 1  # equal to the empty one
    assert frames[3].filter("length(text) = 300000").count() == 1
    packed = frames[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0 and packed.count() > 0


def test_pipeline_of_an_empty_table(spark, docs):
    frames = through(spark, docs.limit(0))
    assert all(f.count() == 0 for f in frames)


def test_licence_scan_agrees_with_the_model_beyond_ascii_and_in_long_paragraphs(spark):
    model = licenses.train(licenses.sample(spark.read.parquet(f"{SF}/documents.parquet")))
    kelvin = "Licensed under the MIT License, as Kelvin said.".replace("k", "K")
    long = "plain words of no meaning at all " * 20_000
    texts = [kelvin, long, long + "Licensed under the Apache License, Version 2.0", "LICENSED UNDER THE MIT LICENSE.", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["probability"]) for r in licenses.scan(frame, model).collect()}
    for i, t in enumerate(texts):
        family, p = model.predict(t or "")
        assert (i in got) == (family != "none")
        if i in got:
            assert got[i][0] == family and got[i][1] == pytest.approx(p, abs=1e-5)


def test_secret_scan_of_a_very_long_text():
    value = "Zx9Kq2Lm8Vb4Nc6Tr1Yp3w"
    text = "token=abcdefgh " * 30_000 + value + " " + "deadbeef" * 5_000
    found = secrets.find(text)
    assert sum(k == 0 for _, k, _, _ in found) == 30_000 and [x for x in found if x[1] == 3] == [(450_000, 3, 450_022, value)]
    assert [(e - s) for s, k, e, _ in found if k == 2] == [40_000]


def test_near_dedup_of_repeated_ids_with_clashing_names(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, base), (1, "something else entirely, by its words and by their order, as far as anyone can tell"), (2, base), (3, base.upper()), (None, base), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(9) for c in ("__sh_id", "__sh_fp", "__sh_root", "__sh_doc", "fp", "root", "component_id")})
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.filter("__sh_id = 9 AND __sh_doc = 9 AND __sh_root = 9 AND fp = 9").count() == kept.count()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(1, base), (1, rows[1][1]), (4, "")])


def test_texts_without_strong_words_are_of_class_none(spark):
    """All n-grams of weak words at once, and of random ones, never outweigh the bias of none."""
    import random

    model = licenses.train(licenses.sample(spark.read.parquet(f"{SF}/documents.parquet")))
    strong = set(licenses.strong_words(model))
    weak = sorted({w for g in model.features for w in g.split()} - strong)
    assert strong and weak
    rng = random.Random(4)
    texts = [" ".join(f"{a} {b}" for a in weak for b in weak), *(" ".join(rng.choices(weak, k=rng.randrange(1, 60))) for _ in range(200))]
    assert {model.predict(t)[0] for t in texts} == {"none"}


@pytest.mark.parametrize("name", ["op5_perspective_rotation", "op6_license_paragraphs", "op9_exact_dedup"])
def test_native_queries_have_no_python_in_their_plans(spark, name, monkeypatch):
    """Neither the last plan nor any that is staged on the way runs Python workers."""
    from cadenza.llm import _common, exact_dedup, perspectives
    from cadenza.llm.queries import QUERIES

    plans = []
    real = _common.stage

    def watched(df, label, by=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, by)

    for module in (exact_dedup, perspectives):
        monkeypatch.setattr(module, "stage", watched)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert not any(node in plan for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
