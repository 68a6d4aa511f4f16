"""Transforms of streams against the same transforms of whole tables: any micro-batches, order, repeats and restarts."""

import numpy as np
import pytest

from cadenza.meta import ANALYTIC, NYQUIST, ObsMeta, Signal
from cadenza.operators import frames
from cadenza.streaming import frames as streaming
from cadenza.streaming.subint import run_to_table

COMPLEX, REAL = "idat long, ichan int, ipol int, re double, im double", "idat long, ichan int, ipol int, v double"


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as micro-batches, one file each; gives the stream of them."""
    made = [0]

    def put(rows, schema, cuts):
        for chunk in np.split(np.arange(len(rows)), cuts):
            if len(chunk):
                spark.createDataFrame([rows[k] for k in chunk], schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={made[0]:03d}"))
                made[0] += 1

    def read(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))

    return put, read


def rows_of(nchan, npol, ndat, real=False, seed=0):
    rng = np.random.default_rng(seed)
    return [(t, c, p, *rng.normal(size=1 if real else 2).tolist()) for t in range(ndat) for c in range(nchan) for p in range(npol)]


def meta(nchan, npol, ndat, real=False):
    return ObsMeta(nchan=nchan, npol=npol, ndim=1 if real else 2, ndat=ndat, rate=1000.0, centre_frequency=1400.0, bandwidth=4.0 * nchan, state=NYQUIST if real else ANALYTIC)


def same(a, b):
    """Bit for bit."""
    key = lambda df: sorted(map(tuple, df.collect()))
    x, y = key(a), key(b)
    assert len(x) == len(y) > 0 and x == y


OPERATORS = {
    "filterbank": lambda s: frames.channelize(s, 4, freq_res=8, pos=2, neg=1),
    "power": lambda s: frames.power_filterbank(s, 8),
    "convolution": lambda s: frames.convolve(s, lambda i: np.exp(1j * np.arange(32) * (i + 1)), 32, 5, 3),
    "matrices": lambda s: frames.convolve(s, lambda i: np.einsum("n,ij->nij", np.exp(1j * np.arange(16)), [[1, 2j], [0.5, 1 + i]]), 16, 2, 2),
    "polyphase": lambda s: frames.polyphase(s, np.hanning(24), 8),
    "synthesis": lambda s: frames.inverse_filterbank(s, 8, 2),
    "dedispersion": lambda s: frames.dedisperse(s, 0.5, 64),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_gives_the_table_s_rows(spark, feed, tmp_path, name, monkeypatch):
    monkeypatch.setattr(streaming.map_stream, "__defaults__", (3, None))  # short lanes
    put, read = feed
    rows = rows_of(2, 2, 300)
    put(rows, COMPLEX, sorted(np.random.default_rng(1).choice(len(rows), 5, replace=False).tolist()))
    m = meta(2, 2, 300)
    run_to_table(OPERATORS[name](Signal(read(COMPLEX), m)).df, str(tmp_path / "out"), str(tmp_path / "cp"))
    same(spark.read.parquet(str(tmp_path / "out")), OPERATORS[name](Signal(spark.createDataFrame(rows, COMPLEX), m)).df)


def test_real_samples_any_order_repeats_and_restart(spark, feed, tmp_path):
    put, read = feed
    rows = rows_of(1, 1, 900, real=True)
    m = meta(1, 1, 900, real=True)
    rng = np.random.default_rng(2)
    first, second = rows[:400], rows[380:]  # twenty come twice
    put([first[k] for k in rng.permutation(len(first))], REAL, [7, 150, 151])
    run = lambda: run_to_table(frames.channelize(Signal(read(REAL), m), 4, freq_res=16, pos=3, neg=3).df, str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    early = spark.read.parquet(str(tmp_path / "out")).count()
    put([second[k] for k in rng.permutation(len(second))], REAL, [100, 300])
    run()  # from the checkpoint
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < early < out.count()
    same(out, frames.channelize(Signal(spark.createDataFrame(rows, REAL), m), 4, freq_res=16, pos=3, neg=3).df)


def test_a_part_with_a_gap_is_left_out(spark, feed, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming.map_stream, "__defaults__", (2, None))
    put, read = feed
    rows = [r for r in rows_of(1, 1, 256) if r[0] != 100]
    put(rows, COMPLEX, [50, 90])
    run_to_table(frames.channelize(Signal(read(COMPLEX), meta(1, 1, 256)), 16).df, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r[0] for r in out.select("idat").distinct().collect()}
    assert got == set(range(16)) - {6}


def test_state_is_less_than_a_part_and_a_step(spark, feed, tmp_path):
    put, read = feed
    put(rows_of(2, 1, 2000), COMPLEX, list(range(100, 4000, 500)))
    run_to_table(frames.convolve(Signal(read(COMPLEX), meta(2, 1, 2000)), lambda i: np.ones(64), 64, 8, 8).df, str(tmp_path / "out"), str(tmp_path / "cp"))
    state = spark.read.format("statestore").load(str(tmp_path / "cp")).select("value.*").collect()
    assert len(state) == 2 and all(len(r["groupState"]["at"]) < 64 + 48 for r in state)
