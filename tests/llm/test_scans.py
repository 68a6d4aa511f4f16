"""Secrets, toxicity, licences, media."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.llm import licenses, mpeg, secrets, toxicity

KEY = "AKIA" + "ABCDEFGHIJ234567"
SECRETS = [None, "", "token: abc", "é password = 'hunter22' x", "API-KEY api_key=\"abcdef123\" Secret:xyz-123", KEY + " " + KEY[:19], "deadbeef" * 4 + "g" + "0" * 23, "token=token:abcdefgh token=token=abcdef", "paſſword=abcdefg", "id Zx9Kq2Lm8Vb4Nc6Tr1Yp3w end"]


def brute(text):
    out = []
    for kind, pattern, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text or "", re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def scan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, row long")
    return secrets.secrets(secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))).collect()


def test_base_spans(spark):
    got = {r["doc_id"]: r for r in scan(spark, [(i, t, f"s{i}", "en", 1) for i, t in enumerate(SECRETS)])}
    for i, text in enumerate(SECRETS):
        base = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("opaque")] == base
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    assert got[9]["spans"] == "opaque:3:25"


def test_ownership_separates_examples_from_live_values(spark):
    shared, own = "Qw3Er5Ty7Ui9Op1As2Df4Gh6", "Zx9Kq2Lm8Vb4Nc6Tr1Yp3w"
    rows = [(i, f"use {shared} here", f"owner{i % 5}", "en", i) for i in range(40)] + [(100, f"my {own}", "owner1", "en", 1), (101, f"my {own}", "owner1", "de", 1), (100, f"my {own}", "owner1", "en", 1), (None, None, None, None, None)]
    got = scan(spark, rows)
    assert len(got) == len(rows)
    assert all(r["spans"] == "" for r in got if r["doc_id"] is not None and r["doc_id"] < 100)
    assert [r["n_live"] for r in got if r["doc_id"] in (100, 101)] == [1, 1, 1]
    assert scan(spark, []) == []


def labelled(n=240, seed=0):
    rng = np.random.default_rng(seed)
    bad = ["idiotic", "scummy", "wretch"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("aeiourstn"), 5)) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[int(rng.integers(40))] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(900, None, "x", 0.1), (900, "", "x", 0.1)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(5000, 1, 1), (901, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).toPandas()
    assert len(got) == len(rows) + 2 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    known = got[got.doc_id < 900]
    assert (known.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in known.doc_id]).all()
    held = known[known.held_out]
    truth = dict((i, y) for i, _, y in rows)
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    kept = toxicity.reject_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_toxicity_ignores_held_out_labels_and_handles_none(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    made = [toxicity.train(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, flip)]
    assert (made[0].weights == made[1].weights).all() and made[0].bias == made[1].bias
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert set(toxicity.scores(docs, none).toPandas().predicted) == {0}
    assert toxicity.scores(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def model():
    return licenses.train(["plain words of prose and nothing else here"] * 40 + ["the river ran past the old mill"] * 40)


def test_licences_match_the_model_and_are_confirmed(spark, model):
    bodies = [None, "", "prose only\nmore prose", "text\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0.", "Licensed under the Zorblat License, version 3.", "All rights reserved.", "All rights reserved."]
    docs = spark.createDataFrame([(min(i, 6), t, "x", "y") for i, t in enumerate(bodies)], "doc_id long, text string, family string, gram string")
    got = sorted((r["doc_id"], r["paragraph"], r["label"]) for r in licenses.scan(docs, model).collect())
    assert got == [(3, 1, "mit"), (4, 0, "cc-by-nc"), (4, 2, "apache-2.0"), (5, 0, "unknown"), (6, 0, "proprietary"), (6, 0, "proprietary")]
    for r in licenses.scan(docs, model).collect():
        family, p = model.predict((bodies[r["doc_id"]] or "").split("\n")[r["paragraph"]])
        assert family == r["family"] and p == pytest.approx(r["probability"], abs=1e-6)
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_licence_scan_has_no_python_on_its_path(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_notice_is_recognised(model):
    assert sum(model.predict(t)[0] == f for f, t in licenses.TEMPLATES) >= 0.9 * len(licenses.TEMPLATES)


@pytest.mark.parametrize("text", [None, "", "a", "x" * 191, "x" * 192, "é" * 500, "tail  "])
def test_media_round_trip(text):
    payload, n = mpeg.padded(text)
    media = mpeg.store(payload)
    audio = mpeg.parse(media)
    assert mpeg.payload_of(media, audio) == payload and n == len((text or "").encode())
    frames = len(payload) // 192
    assert len(audio.offsets) == frames and audio.samples == 1152 * frames and audio.rate == 32000
    assert audio.checked == frames + 1 and not audio.bad_checksums and not audio.skipped
    assert audio.vbr["kind"] == "Info" and audio.vbr["frames"] == frames and audio.tags[0][0] == "ID3v2"
    assert audio.seek(0) == audio.offsets[0] and audio.seek(10**9) == audio.offsets[-1]


def test_resynchronisation_and_damage():
    payload, _ = mpeg.padded("some text that fills several frames " * 40)
    media = mpeg.store(payload)
    audio = mpeg.parse(media)
    cut = audio.offsets[3]
    noisy = b"\xff\xfbjunk" * 3 + media[244:cut] + b"\xff\x00noise\xff" + media[cut:] + b"TAG".ljust(128, b"\0")
    found = mpeg.parse(noisy)
    assert mpeg.payload_of(noisy, found)[:192] == payload[:192] and len(found.offsets) == len(audio.offsets)
    assert found.skipped == 18 + 8 and found.tags[-1][0] == "ID3v1"
    broken = bytearray(media)
    broken[audio.offsets[2] + 7] ^= 1
    assert mpeg.parse(bytes(broken)).bad_checksums == 1
    for junk in (b"", b"\xff", b"\xff" * 500, b"ID3\x03\0\0\x7f\x7f\x7f\x7f"):
        assert mpeg.parse(junk).offsets == []


def test_headers_of_all_layers():
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0x00))).length == 417
    assert mpeg.header(bytes((0xFF, 0xFD, 0x84, 0x00))).samples == 1152
    assert mpeg.header(bytes((0xFF, 0xFF, 0x54, 0x00))).samples == 384
    assert mpeg.header(bytes((0xFF, 0xF3, 0x90, 0x00))).samples == 576
    assert mpeg.header(bytes((0xFF, 0xEB, 0x90, 0x00))) is None and mpeg.header(b"\xff\xfb\xf0\x00") is None


def test_vbri_table():
    head = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(32)
    body = b"VBRI" + bytes(6) + (9999).to_bytes(4, "big") + (77).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2) + (5).to_bytes(2, "big") + (6).to_bytes(2, "big")
    frame = (head + body).ljust(417, b"\0")
    audio = mpeg.parse(frame + bytes((0xFF, 0xFB, 0x90, 0x00)).ljust(417, b"\0"))
    assert audio.vbr == {"kind": "VBRI", "bytes": 9999, "frames": 77, "toc": [15, 18]} and audio.samples == 1152


def test_media_column(spark):
    docs = spark.createDataFrame([(1, "same", "a"), (2, "same", "b"), (3, None, "c")], "doc_id long, text string, media string")
    got = mpeg.media_column(docs, keep_media=True).toPandas().set_index("doc_id")
    assert got.loc[1].drop("media").tolist() == got.loc[2].drop("media").tolist()
    assert got.loc[3].n_bytes == 0 and got.loc[3].payload_bytes == 192 and got.loc[3].tail_crc32 == zlib.crc32(b" " * 16)
    assert mpeg.media_column(docs.limit(0)).count() == 0
    assert isinstance(got, pd.DataFrame)
