"""Alignment of two tokenizers against a version on sets of byte offsets, over whole tables and odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", " a", "a ", "  a  b ", "a▁b", "<|endoftext|> <s> </s> <0x41>", "é è", "日本語 と 中文", "😀 x", "a\nb \n c", "x\xa0 y", "don't can't we'll", "1 2 34", "\x00 \x1c a", "\x1c b", "a \x1c", "tail " * 30_000, "x" * 5000, "( ) [ ]", "Ω mega ԰ x Ԯ y", "<s>", "　a b"]


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def piece_bytes(p, i):
    return bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()


def plain(rows, sides):
    """(doc_id, n_a, ..., groups_sha256) of each row, by ends of tokens and nothing else; whole texts are encoded at once."""
    one, two = sides
    letters, pieces = alignment.byte_letters(), [piece_bytes(two, i) for i in range(two.get_piece_size())]
    per_row, count = [], Counter()
    for doc, text in rows:
        if not text:
            per_row.append((doc, None))
            continue
        a, b = one.encode(" " + text, add_special_tokens=False), two.encode(text)
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens]
        raw_b = [pieces[i] for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            per_row.append((doc, None))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in raw]).tolist(), range(len(raw)))) for raw in (raw_a, raw_b)]
        ids, groups, links, i, j = a.ids, [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][at] + 1, ends[1][at] + 1
            groups.append(",".join(map(str, ids[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((ids[k - 1], b[m - 1]))
            i, j = k, m
        count.update(links)
        per_row.append((doc, (len(ids), len(b), groups, links)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc, x in per_row:
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sides, sf):
    got = [tuple(r) for r in alignment.op11_token_alignment(spark, f"/root/testdata/{sf}").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(plain(rows, sides), key=key)
    assert sum(r[3] for r in got) > 10_000


def test_odd_texts(spark, sides, tmp_path):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again")]
    for i in range(400):
        rng = random.Random(i)
        rows.append((1000 + i, "".join(rng.choices(["a", "b c", " ", "  ", "é", "日", "😀", "\n", "'s", "1", "▁" if i % 7 == 0 else "_", "<s>", ".", "the ", "\x1d"], k=rng.randrange(60)))))
    spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, links int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in alignment.op11_token_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, sides), key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_scores(empty).collect() == []


def test_general_interface(spark):
    frame = spark.createDataFrame([(1, "Unbelievable alignments, tokenized twice."), (2, None)], "doc_id long, text string")
    pair = alignment.tokenizers()
    for r in alignment.align(frame).collect():
        a, b = ([raw[i] for i in r[name]] for raw, name in ((pair.a_bytes, "a_ids"), (pair.b_bytes, "b_ids")))
        spans = lambda xs: list(zip(np.cumsum([0, *map(len, xs)])[:-1].tolist(), np.cumsum(list(map(len, xs))).tolist()))
        meet = [(i, j) for i, (p, q) in enumerate(spans(a)) for j, (s, t) in enumerate(spans(b)) if p < t and s < q]
        assert [tuple(o) for o in r["overlaps"]] == meet and len(meet) >= len(r["a_cuts"])
        for i, j in zip(r["a_cuts"], r["b_cuts"]):
            assert b"".join(a[:i]) == b"".join(b[:j])


def test_windows_of_owners_join():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(1, 9, 200), rng.integers(1, 9, 200)
        short = int(min(a.sum(), b.sum()))
        fit = lambda x: np.diff(np.unique(np.concatenate([[0], np.minimum(np.cumsum(x), short)])))
        whole = alignment.overlaps(fit(a), fit(b))
        for window in (1, 3, 17, 256):
            for x, y in zip(whole, alignment.overlaps(fit(a), fit(b), window)):
                assert x.tolist() == y.tolist()


def test_bound_of_pairs(spark):
    pair = alignment.tokenizers()
    bound = alignment.pair_bound(pair.a_bytes, pair.b_bytes)
    assert 50_000 < bound < 1_000_000
    seen = alignment.digest(spark.read.parquet(f"{SF}/documents.parquet")).selectExpr("explode(links) AS l").distinct().collect()
    size = len(pair.b_bytes)
    for r in seen:
        a, b = pair.a_bytes[r.l // size], pair.b_bytes[r.l % size]
        assert a.endswith(b) or b.endswith(a)


def test_memory_of_parts_is_bounded():
    parts = alignment.Parts(alignment.tokenizers(), remembered=50)
    whole = alignment.Parts(alignment.tokenizers())
    for k in range(30):
        text = " ".join(f"word{k}x{i}" for i in range(20)) + " " + "y" * 100 + " word1x1"
        assert parts.of([text]) == whole.of([text]) and len(parts.known) <= 80
