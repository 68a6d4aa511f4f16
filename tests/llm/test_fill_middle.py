"""Fill-in-the-middle against a plain version on code points, over whole tables and odd texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import fill_middle

ODD = [None, "", "a", "é", "😀", "<P>", "a<", "<P", "x<<S>y", "<M", "<S<M", "né" * 700, "日本語" * 900, "😀" * 600 + "<M>", "x" * 511 + "<P>", "x" * 510 + "<S>", "x" * 509 + "<M>", "x" * 511 + "<", "x" * 512, "a😀" * 300, "\x00\x00", "<" * 2000, "tail " * 100_000]


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(t), sha(t))
    a, b, c = t[:p], t[p:q], t[q:]
    out = f"<S>{c}<P>{a}<M>{b}" if h4 % 100 < 20 else f"<P>{a}<S>{c}<M>{b}"
    return (doc_id, n, "spm" if h4 % 100 < 20 else "psm", p, q - p, sha(out), sha(t))


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[5])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    got = [tuple(r) for r in fill_middle.op12_fill_middle(spark, f"/root/testdata/{sf}").collect()]
    want = [plain(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_texts(spark, tmp_path):
    rows = [(i if i else None, t, "x") for i, t in enumerate(ODD)] + [(3, "é", "x")] * 3
    rows += [(1000 + i, "".join(random.Random(i).choices("a<PSM>é日😀 ", k=random.Random(-i).randrange(1500))), "x") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, output string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in fill_middle.op12_fill_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted((plain(i, t) for i, t, _ in rows), key=key)


def test_outputs_are_texts(spark):
    frame = spark.createDataFrame([(i, "one two three") for i in range(40)], "doc_id long, text string")
    for r in fill_middle.transform(frame).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect():
        assert r["back"] == "one two three"
        if r["form"] == "psm":
            assert r["output"].startswith("<P>" + "one two three"[: r["prefix_chars"]] + "<S>")
    assert fill_middle.transform(frame.limit(0)).collect() == []


def test_other_sentinels_and_rates(spark):
    frame = spark.createDataFrame([(i, f"ab¤c{i}") for i in range(40)] + [(99, "a¦b")], "doc_id long, text string")
    marks = ("¦", "§§", "¶")
    out = fill_middle.transform(frame, percent=100, spm_percent=100, sentinels=marks).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in out if r["doc_id"] < 99} == {"spm"} and {r["form"] for r in out if r["doc_id"] == 99} == {"plain"}
    assert all(r["back"] == (f"ab¤c{r['doc_id']}" if r["doc_id"] < 99 else "a¦b") for r in out)


def test_automaton_steps_alike_from_any_lane():
    automaton = fill_middle.Automaton()
    rng = random.Random(7)
    texts = ["".join(rng.choices("<PSM>aé日😀", k=rng.randrange(3000))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    scan = fill_middle.Scan(automaton, np.frombuffer(b"".join(raw) or b"\xff", dtype=np.uint8), edges)
    assert scan.units.tolist() == [len(t) for t in texts]
    assert scan.marked.tolist() == [any(s in t for s in fill_middle.SENTINELS) for t in texts]
    for share in (0, 0.3, 1):
        at = np.array([int(len(t) * share) for t in texts])
        cut = scan.cut(np.arange(len(texts)), at)
        assert [c - e for c, e in zip(cut.tolist(), edges.tolist())] == [len(t[:k].encode()) for t, k in zip(texts, at.tolist())]
