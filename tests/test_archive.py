"""Files that appear whole or not at all, and profiles through a fold-mode archive."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.meta import ObsMeta
from cadenza.sources import archive
from cadenza.sources.blocks import read_blocks, write_in_place

META = ObsMeta(nchan=3, npol=2, rate=1000.0, centre_frequency=1400.0, bandwidth=30.0, start_us=1_704_067_200_250_000, state="PPQQ", source="J3", telescope="PKS", dm=12.5, path=("detect", "fold"))


def blocks(spark, n):
    return spark.range(n).repartition(3).selectExpr("id AS block", "encode(lpad(CAST(id AS STRING), 8, '.'), 'utf-8') AS raw")


def test_a_file_is_written_by_tasks_and_replaced_at_the_end(spark, tmp_path):
    path = str(tmp_path / "x.raw")
    open(path, "wb").write(b"old")
    write_in_place(blocks(spark, 40), path, b"HEAD", 8, 320, b"TAIL")
    want = b"HEAD" + b"".join(str(k).rjust(8, ".").encode() for k in range(40)) + b"TAIL"
    assert open(path, "rb").read() == want and os.listdir(tmp_path) == ["x.raw"]
    assert read_blocks(spark, [(path, 4, 8, 324)]).count() == 40
    write_in_place(blocks(spark, 0), path, b"H", 8, 0)
    assert open(path, "rb").read() == b"H"


def test_a_job_that_fails_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "x.raw")
    open(path, "wb").write(b"old")
    bad = blocks(spark, 40).withColumn("raw", F.when(F.col("block") == 33, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="lost"):
        write_in_place(bad, path, b"HEAD", 8, 320)
    assert open(path, "rb").read() == b"old" and os.listdir(tmp_path) == ["x.raw"]
    with pytest.raises(Exception, match="312 bytes were written instead of 320"):
        write_in_place(blocks(spark, 39), path, b"HEAD", 8, 320)
    assert open(path, "rb").read() == b"old" and os.listdir(tmp_path) == ["x.raw"]


def profiles(spark, divisions, nbin=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(d, c, p, b, float(rng.normal() * 10.0 ** rng.integers(-2, 5)), int(rng.integers(0, 9))) for d in divisions for c in range(3) for p in range(2) for b in range(nbin)]
    return spark.createDataFrame([r for r in rows if r[5]], "division long, ichan int, ipol int, ibin int, total double, hits long")


def test_profiles_come_back_within_a_step(spark, tmp_path):
    path = str(tmp_path / "p.ar")
    df = profiles(spark, [100, 101, 103])
    assert archive.write_archive(df, path, META, 16, 89_000, 10_000_000) == 4
    out, meta = archive.read_archive(spark, path)
    assert (meta.nchan, meta.npol, meta.source, meta.telescope, meta.dm, meta.start_us, meta.path) == (3, 2, "J3", "PKS", 12.5, META.start_us, ("detect", "fold"))
    assert meta.rate == pytest.approx(16 / 0.089)
    want, hits = np.zeros((3, 2, 3, 16)), np.zeros((3, 2, 3, 16))
    at = {100: 0, 101: 1, 103: 2}
    for r in df.collect():
        want[at[r.division], r.ipol, r.ichan, r.ibin] = r.total / r.hits
        hits[at[r.division], r.ipol, r.ichan, r.ibin] = r.hits
    step = (want.max(3) - want.min(3)) / 65_534
    got = out.collect()
    assert len(got) == 3 * 96 and {r.division for r in got} == set(at)
    share = hits.sum(axis=(1, 3)) / hits.sum(axis=(1, 3)).max(axis=1, keepdims=True)
    for r in got:
        k = at[r.division]
        assert abs(r.value - want[k, r.ipol, r.ichan, r.ibin]) <= step[k, r.ipol, r.ichan] * 1.01
        assert r.weight == pytest.approx(share[k, r.ichan], rel=1e-6)


def test_short_divisions_and_empty_tables(spark, tmp_path):
    df = profiles(spark, [5, 6, 7])
    n = {r[0]: r[1] for r in df.groupBy("division").agg(F.sum("hits")).collect()}
    most = max(n.values())
    short = df.filter("division <> 6 OR ibin < 8")
    archive.write_archive(short, str(tmp_path / "s.ar"), META, 16, 89_000, 10_000_000, expected=most, least=0.8)
    assert {r[0] for r in archive.read_archive(spark, str(tmp_path / "s.ar"))[0].select("division").distinct().collect()} == {5, 7}
    assert archive.write_archive(df.limit(0), str(tmp_path / "e.ar"), META, 16, 89_000, 10_000_000) == 0
    assert archive.read_archive(spark, str(tmp_path / "e.ar"))[0].count() == 0
