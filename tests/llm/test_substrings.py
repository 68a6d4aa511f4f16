import hashlib

import numpy as np
import pytest

from cadenza.llm import substrings
from cadenza.llm.gsaca import suffix_arrays

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, rng.integers(2, 7), rng.integers(0, 80)) for _ in range(12)] + [np.ones(40, int), np.tile([1, 2], 20), np.tile([3, 2, 1], 15)]
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    got = suffix_arrays(symbols, bounds)
    for a, b in zip(bounds, bounds[1:]):
        s = symbols[a:b].tolist()
        assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def word(n):
    return "".join(RNG.choice(list("abcdefgh "), n))


def corpus():
    a, b, c = word(900), word(450), word(260)
    near = [word(150) + a[:400] + str(i) + a[401:] for i in range(40)]
    return [None, "", "short", a, a, b, "x" + a[100:500] + "y", a[:199], a[:200], b[:250] + c, c + b[200:], "z" * 700, "ab" * 300, "é" * 150 + b[:300], word(1000), c[:30] + c[31:], *near, "é" * 99, "é" * 101]


def brute(texts, length=200):
    raws, seen = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("chunk", "settings"), [(1 << 20, {}), (1 << 20, {"block_segments": 1}), (600, {"block_segments": 4}), (1 << 20, {"block_segments": 2}), (1 << 20, {"filter_bits": 1 << 15})])
def test_removal_matches_brute_force(spark, monkeypatch, chunk, settings):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs, **settings).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_long_texts_come_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CHUNK", 500)
    text = word(3000)
    batch = pa.RecordBatch.from_pydict({"text": [text, None, "tiny"]})
    parts = list(substrings._slices(batch, 200))
    windows = sorted(p.base + s + k for p in parts for q in [substrings.Segments(p.raw, p.bounds)] for s, n in zip(q.start.tolist(), q.n.tolist()) for k in range(n) if p.names[0] == hashlib.md5(text.encode()).digest())
    assert windows == list(range(2801))


def test_kept_bytes_and_empty_table(spark):
    shared = word(300)
    docs = spark.createDataFrame([(1, "head " + shared), (2, shared + " tail"), (3, "alone"), (3, "alone")], "doc_id long, text string")
    rows = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in substrings.remove_repeats(docs, keep_text=True).collect())
    assert rows == [(1, "head "), (2, " tail"), (3, "alone"), (3, "alone")]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_hot_keys_are_halved_until_suffix_arrays_take_them(spark, monkeypatch):
    """Default settings, 400 near copies of one text that differ in one letter each, anywhere: keys with far more than 128 different pieces."""
    a, sorted_rows, widths = word(900), [], []
    near = [a[:i] + letter + a[i + 1 :] for i, letter in zip(RNG.integers(0, 900, 400).tolist(), RNG.choice(list("ABCDEFGH"), 400))]
    near += [a[380:640] + str(i) for i in range(150)] + [str(i) + a[300:530] for i in range(150)]
    real_settle, real_halved = substrings.settle, substrings.halved
    monkeypatch.setattr(substrings, "settle", lambda blocks, length: (sorted_rows.append(blocks.groupBy("key").count().agg({"count": "max"}).first()[0] or 0), real_settle(blocks, length))[1])
    monkeypatch.setattr(substrings, "halved", lambda pieces, width, length: (widths.append(width), real_halved(pieces, width, length))[1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(near))] == brute(near)
    assert widths and widths[0] == 32 and max(sorted_rows) <= 128


class Tasks:
    """Stands for a DataFrame whose task is then run here, on given batches."""

    sparkSession = None

    def __getattr__(self, name):
        return lambda *columns: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def peak_mb(tasks, batches):
    """Peak of Python's and NumPy's memory while a task works on batches, and the rows that it gives."""
    import tracemalloc

    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in tasks.run(iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_memory_of_sorting_blocks_is_bounded(monkeypatch):
    """5 MB of small blocks in one task, of two pieces that share 230 bytes: a worker that sorted 2 MB of them at a time held 180 MB for it."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "partitions", lambda spark: 1)
    letters = np.frombuffer(b"abcdefgh", np.uint8)[RNG.integers(0, 8, (10_000, 270))]
    rows = [(k, b"d", 0, True, row[side : side + 250].tobytes()) for k, row in enumerate(letters) for side in (0, 20)]
    batches = pa.table([pa.array(c) for c in zip(*rows)], names=["key", "doc", "start", "once", "piece"]).to_batches(10_000)
    tasks = Tasks()
    substrings.settle(tasks, 200)
    peak, ranges = peak_mb(tasks, batches)
    assert ranges == 20_000 and peak < 90


@pytest.mark.parametrize("level", [0, 1, None])
def test_memory_of_hashing_texts_is_bounded(level):
    """2000 texts of 2 kB in one batch: a worker that hashed 1 MB of them at a time held over 50 MB for it."""
    import pyarrow as pa

    texts = np.frombuffer(b"abcdefgh", np.uint8)[RNG.integers(0, 8, (2000, 2000))]
    batch = pa.record_batch([pa.array([t.tobytes().decode() for t in texts])], ["text"])
    tasks, every = Tasks(), lambda key: key & np.uint64(3) == 0
    substrings.undecided(tasks, [every, every], 200, "text") if level is None else substrings.segments(tasks, level, [every, every], 200, "text")
    peak, rows = peak_mb(tasks, [batch])
    assert rows > 2000 and peak < 30


def test_suffix_arrays_take_four_bytes_a_position():
    got = suffix_arrays(np.array([2, 1, 2, 0, 1, 0]), np.array([0, 4, 6]))
    assert got.dtype == np.int32 and got.tolist() == [3, 1, 2, 0, 5, 4]
    assert not len(suffix_arrays(np.zeros(0, np.int32), np.array([0])))
