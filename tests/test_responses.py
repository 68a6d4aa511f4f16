"""The as-of join against a scan, and responses that change with time against transforms one by one."""

import numpy as np
import pytest

from cadenza.functions.response import interpolated
from cadenza.meta import ANALYTIC, ObsMeta, Signal
from cadenza.operators import responses


@pytest.mark.parametrize("bucket", [1, 7, 64, 5000])
def test_as_of(spark, bucket):
    rng = np.random.default_rng(bucket)
    at = [(c, int(t)) for c in range(4) for t in rng.integers(0, 1000, 60)] + [(0, 0), (1, 999)]
    epochs = [(c, int(e)) for c in range(3) for e in rng.integers(-200, 1300, [3, 40, 1][c])]
    epochs += [(2, 999), (1, 5), (1, 5), (1, 6)]
    left, right = spark.createDataFrame(at, "c int, t long"), spark.createDataFrame(epochs, "c int, e long")
    got = sorted(map(tuple, responses.as_of(left, right, "t", "e", ("c",), 999, bucket).select("c", "t", "e").collect()), key=str)
    of = lambda c, t: max((e for k, e in epochs if k == c and e <= t), default=min((e for k, e in epochs if k == c), default=None))
    assert got == sorted(((c, t, of(c, t)) for c, t in at), key=str)


def signal(spark, rng, nchan=2, npol=2, ndat=160):
    x = rng.normal(size=(ndat, nchan, npol)) + 1j * rng.normal(size=(ndat, nchan, npol))
    rows = [(t, c, p, float(x[t, c, p].real), float(x[t, c, p].imag)) for t in range(ndat) for c in range(nchan) for p in range(npol)]
    meta = ObsMeta(nchan=nchan, npol=npol, ndim=2, ndat=ndat, rate=1000.0, centre_frequency=1400.0, bandwidth=2.0, state=ANALYTIC)
    return Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), meta), x


def values(s):
    return {(r.idat, r.ichan, r.ipol): complex(r.re, r.im) for r in s.df.collect()}


def in_force(table, c, start):
    before = [e for k, e in table if k == c and e <= start]
    return table[c, max(before) if before else min(e for k, e in table if k == c)]


@pytest.mark.parametrize("points", [32, 8])
def test_responses_by_time_and_channel(spark, points):
    rng = np.random.default_rng(points)
    s, x = signal(spark, rng)
    table = {(c, e): rng.normal(size=points) + 1j * rng.normal(size=points) for c, es in enumerate(([10, 50, 51, 120], [0, 97])) for e in es}
    df = spark.createDataFrame([(e, c, h.real.tolist(), h.imag.tolist()) for (c, e), h in table.items()], "epoch long, ichan int, re array<double>, im array<double>")
    got = values(responses.respond(s, df, 32, 5, 3, bucket=20))
    assert len(got) == 6 * 24 * 4
    for c in range(2):
        for p in range(2):
            for start in range(0, 129, 24):
                h = interpolated(in_force(table, c, start), 32)
                y = np.fft.ifft(np.fft.fft(x[start : start + 32, c, p]) * h)[5:29]
                assert [got[start + k, c, p] for k in range(24)] == pytest.approx(y.tolist())


def test_matrices_act_on_both_polarizations(spark):
    rng = np.random.default_rng(5)
    s, x = signal(spark, rng)
    table = {(c, e): rng.normal(size=(2, 2, 16)) + 1j * rng.normal(size=(2, 2, 16)) for c in range(2) for e in (0, 33, 90 + c)}
    rows = [(e, c, 2 * i + j, h[i, j].real.tolist(), h[i, j].imag.tolist()) for (c, e), h in table.items() for i in range(2) for j in range(2)]
    df = spark.createDataFrame(rows, "epoch long, ichan int, element int, re array<double>, im array<double>")
    got = values(responses.respond(s, df, 16, 2, 2, bucket=32))
    for c in range(2):
        for start in range(0, 145, 12):
            h = in_force(table, c, start)
            y = np.fft.ifft(np.einsum("ijn,jn->in", h, np.fft.fft(x[start : start + 16, c].T, axis=1)), axis=1)[:, 2:14]
            for p in range(2):
                assert [got[start + k, c, p] for k in range(12)] == pytest.approx(y[p].tolist())


def test_plan_has_no_python_broadcast_of_responses(spark):
    """Responses travel in joins, whatever their number: none is held in a function."""
    s, _ = signal(spark, np.random.default_rng(6))
    many = spark.range(5000).selectExpr("id AS epoch", "CAST(id % 2 AS INT) AS ichan", "array(1D, 2D, 3D, 4D) AS re", "array(0D, 0D, 0D, 0D) AS im")
    out = responses.respond(s, many, 16)
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "epoch" in plan
    assert out.df.count() == 160 * 4
