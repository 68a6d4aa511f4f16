"""Blocks of files that grow: each is read once, across batches and restarts, and a partial one waits."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, ObsMeta, Signal
from cadenza.operators import frames
from cadenza.sources.blocks import follow_blocks
from cadenza.streaming.subint import run_to_table


def grow(path, raw):
    with open(path, "ab") as f:
        f.write(raw)


def test_each_block_is_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = {name: np.random.default_rng(k).bytes(4 + 8 * 25) for k, name in enumerate(("a.raw", "b.raw", "c.raw"))}
    run = lambda: run_to_table(follow_blocks(spark, str(folder), 8, start=4, suffix=".raw", split=32), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    blocks = lambda name, n: [(f"{folder}/{name}", k, data[name][4 + 8 * k : 12 + 8 * k]) for k in range(n)]
    grow(folder / "b.raw", data["b.raw"][:47])  # five blocks and a part of one
    grow(folder / "note.txt", b"not data")
    run()
    assert got() == blocks("b.raw", 5)
    grow(folder / "b.raw", data["b.raw"][47:50])
    grow(folder / "a.raw", data["a.raw"])
    run()  # from the checkpoint
    run()
    assert got() == blocks("a.raw", 25) + blocks("b.raw", 5)
    grow(folder / "b.raw", data["b.raw"][50:])
    grow(folder / "c.raw", data["c.raw"][:20])
    run()
    assert got() == blocks("a.raw", 25) + blocks("b.raw", 25) + blocks("c.raw", 2)


def test_a_growing_file_is_channelized_as_it_comes(spark, tmp_path):
    """From bytes to spectra without a table between: blocks, samples, transforms across micro-batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    codes = np.random.default_rng(5).integers(-100, 100, (400, 2)).astype("<i2")
    raw = codes.tobytes()
    meta = ObsMeta(nchan=1, npol=1, ndim=2, ndat=400, rate=1000.0, centre_frequency=1400.0, bandwidth=1.0, state=ANALYTIC)

    def run():
        stream = follow_blocks(spark, str(folder), 40)
        two = lambda at: F.conv(F.hex(F.concat(F.substring("raw", at + 1, 1), F.substring("raw", at, 1))), 16, 10).cast("int")
        signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v).cast("double")
        rows = stream.select((F.col("block") * 10).alias("first"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), signed(two(4 * k + 1)).alias("re"), signed(two(4 * k + 3)).alias("im")) for k in range(10)))).alias("s"))
        samples = rows.select((F.col("first") + F.col("s.k")).alias("idat"), F.lit(0).alias("ichan"), F.lit(0).alias("ipol"), "s.re", "s.im")
        run_to_table(frames.channelize(Signal(samples, meta), 16).df, str(tmp_path / "out"), str(tmp_path / "cp"))

    grow(folder / "x", raw[:700])
    run()
    grow(folder / "x", raw[700:])
    run()
    z = codes[:, 0] + 1j * codes[:, 1]
    want = np.fft.fftshift(np.fft.fft(z.reshape(25, 16), axis=1), axes=1)
    out = np.zeros((25, 16), complex)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 400
    for r in rows:
        out[r.idat, r.ichan] = complex(r.re, r.im)
    assert np.allclose(out, want)
