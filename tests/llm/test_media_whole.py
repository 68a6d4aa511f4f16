"""Payloads that hold the marks of end tags."""

import hashlib

import pyarrow as pa
import pytest

from cadenza.llm import mpeg

MARKED = ["x" * 65 + "TAG", "x" * 161 + "APETAGEX", "y" * 192 * 3 + "x" * 65 + "TAG", "x" * 65 + "TAG" + "x" * 93 + "APETAGEX" + "\xff" * 4]


@pytest.mark.parametrize("text", MARKED)
def test_marks_of_end_tags_stay_in_the_payload(text):
    payload, _ = mpeg.padded(text)
    media = mpeg.store(payload)
    audio = mpeg.parse(media)
    assert mpeg.payload_of(media, audio) == payload
    assert [t[0] for t in audio.tags] == ["ID3v2"] and not audio.skipped


@pytest.mark.parametrize("text", MARKED)
def test_real_end_tags_are_still_found_behind_them(text):
    payload, _ = mpeg.padded(text)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    media = mpeg.store(payload) + ape + b"TAG".ljust(128, b"\0")
    audio = mpeg.parse(media)
    assert mpeg.payload_of(media, audio) == payload
    assert [t[0] for t in audio.tags] == ["ID3v2", "ID3v1", "APE"] and not audio.skipped


def test_damaged_frames_are_bounded_by_the_byte_count():
    payload, _ = mpeg.padded("y" * 192 * 3 + MARKED[0])
    media = bytearray(mpeg.store(payload))
    media[28 + 216 * 2] = 0
    assert mpeg.payload_of(bytes(media), mpeg.parse(bytes(media))) == payload[:192] + payload[384:]


def test_column_holds_whole_payloads(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    for r in mpeg.media_column(docs).collect():
        payload, n = mpeg.padded(MARKED[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())


def test_a_payload_that_is_not_read_back_raises(spark, monkeypatch):
    class Docs:  # takes the function that tasks would run
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(mpeg, "payload_of", lambda data, audio: b"")
    run = mpeg.media_column(Docs())
    with pytest.raises(ValueError, match="document 1"):
        list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["text"]})])))
