"""Silence, information files, stored scales, bandpass by windows, and the undoing of a filterbank's ripple."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.response import deripple
from cadenza.meta import ANALYTIC, ObsMeta, Signal
from cadenza.operators import frames, rescale
from cadenza.sources.generators import dummy
from cadenza.sources.headers import presto_info
from cadenza.streaming.subint import run_to_table, streaming_bandpass


@pytest.mark.parametrize(("ndim", "values"), [(1, ["v"]), (2, ["re", "im"])])
def test_silence_has_every_sample_once(spark, ndim, values):
    s = dummy(spark, ObsMeta(nchan=3, npol=2, ndim=ndim, ndat=50))
    assert s.df.columns == ["idat", "ichan", "ipol", *values]
    rows = [tuple(r) for r in s.df.collect()]
    assert sorted(rows) == [(t, c, p, *[0] * ndim) for t in range(50) for c in range(3) for p in range(2)]


def test_information_files():
    text = " Data file name without suffix          =  x_DM2\n Width of each time series bin (sec)    =  6.4e-05\n no pair here\n Notes = a = b\n\n"
    assert presto_info(text) == {"Data file name without suffix": "x_DM2", "Width of each time series bin (sec)": "6.4e-05", "Notes": "a = b"}
    assert presto_info("") == {}


def test_scales_are_kept_by_interval(spark, tmp_path):
    df = spark.range(600).selectExpr("id div 6 AS idat", "cast(id div 2 % 3 AS int) AS ichan", "cast(id % 2 AS int) AS ipol", "cast(id * 37 % 101 AS double) AS v")
    s, path = Signal(df, ObsMeta(nchan=3, npol=2, ndat=100)), str(tmp_path / "scales")
    scales = rescale.mean_std(s, 40)
    rescale.write_scales(scales, path)
    back = spark.read.parquet(path)
    key = lambda d: sorted((r["iv"], r["ichan"], r["ipol"], r["offset"], r["scale"]) for r in d.collect())
    assert key(back) == key(scales) and len(key(back)) == 3 * 6
    v = {k: [i * 37 % 101 for i in range(600) if i // 6 // 40 == k and i // 2 % 3 == 1 and i % 2 == 0] for k in range(3)}
    want = {k: (-np.mean(x), 1 / np.std(x)) for k, x in v.items()}
    for iv, c, p, offset, scale in key(back):
        if (c, p) == (1, 0):
            assert (offset, scale) == pytest.approx(want[iv])


def test_bandpass_by_windows(spark, tmp_path):
    """Windows of a minute, whose sums are those of a batch; the last ones wait for the watermark."""
    rows = spark.range(4000).selectExpr("timestamp_micros(id * 100000) AS ts", "cast(id % 3 AS int) AS ichan", "cast(id div 3 % 2 AS int) AS ipol", "id * 7 % 11 AS v")
    folder = str(tmp_path / "in")
    for k, (a, b) in enumerate([(0, 150), (150, 400)]):
        rows.filter(F.col("ts").between(F.timestamp_seconds(F.lit(a)), F.timestamp_seconds(F.lit(b - 0.05)))).coalesce(1).write.parquet(f"{folder}/b={k}")
    spark.createDataFrame([(0, 0, 0, 0)], "s long, ichan int, ipol int, v long").selectExpr("timestamp_seconds(100000) AS ts", "ichan", "ipol", "v").coalesce(1).write.parquet(f"{folder}/b=2")
    spark.createDataFrame([(0, 0, 0, 0)], "s long, ichan int, ipol int, v long").selectExpr("timestamp_seconds(200000) AS ts", "ichan", "ipol", "v").coalesce(1).write.parquet(f"{folder}/b=3")
    stream = spark.readStream.schema("ts timestamp, ichan int, ipol int, v long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/b=*")
    run_to_table(streaming_bandpass(stream, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(int(r["s"]), r["ichan"], r["ipol"]): (r["power"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("s", F.unix_timestamp("start")).filter("s < 400").collect()}
    want: dict = {}
    for i in range(4000):
        k = (i // 600 * 60, i % 3, i // 3 % 2)
        power, n = want.get(k, (0, 0))
        want[k] = (power + i * 7 % 11, n + 1)
    assert got == want


def test_ripple_is_undone(spark):
    """Channels weighted by a prototype filter's response, put together with its inverse: as if they had not been."""
    taps, nfft, nchan = np.array([0.2, 1.0, 0.2]), 16, 4  # no zeros
    inverse = deripple(taps, nfft, nfft // 2)
    h = np.abs(np.fft.fftshift(np.fft.fft(taps, nfft)))
    assert inverse * h == pytest.approx(np.ones(nfft))
    rng = np.random.default_rng(9)
    z = rng.normal(size=(nfft * 3, nchan)) + 1j * rng.normal(size=(nfft * 3, nchan))
    spectra = np.fft.fftshift(np.fft.fft(z.reshape(3, nfft, nchan), axis=1), axes=1) * h[:, None]
    rippled = np.fft.ifft(np.fft.ifftshift(spectra, axes=1), axis=1).reshape(-1, nchan)

    def made(x, response):
        rows = [(t, c, 0, float(x[t, c].real), float(x[t, c].imag)) for t in range(len(x)) for c in range(nchan)]
        s = Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, re double, im double"), ObsMeta(nchan=nchan, ndim=2, ndat=len(x), state=ANALYTIC))
        out = frames.inverse_filterbank(s, nfft, response=response).df.orderBy("idat").collect()
        return np.array([complex(r["re"], r["im"]) for r in out])

    plain = made(z, None)
    assert len(plain) == nfft * 3 * nchan
    assert np.allclose(made(rippled, np.tile(inverse, nchan)), plain) and not np.allclose(made(rippled, None), plain)
