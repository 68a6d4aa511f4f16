import numpy as np
import pytest

from cadenza.meta import ANALYTIC, INTENSITY, ObsMeta, Signal
from cadenza.operators import digitize
from cadenza.sources import generators, headers, raw
from cadenza.sources.blocks import read_blocks


def volts(spark, n=300):
    df = spark.range(n).selectExpr("id AS idat", "explode(array(0, 1)) AS ichan").selectExpr("idat", "ichan", "explode(array(0, 1)) AS ipol")
    df = df.selectExpr("idat", "ichan", "ipol", "cast((idat * 3 + ichan * 5 + ipol) % 200 - 100 AS int) AS re", "cast((idat * 7 + ipol) % 150 - 75 AS int) AS im")
    return Signal(df, ObsMeta(nchan=2, npol=2, ndim=2, nbit=8, ndat=n, rate=2e5, state=ANALYTIC, centre_frequency=1400.0, bandwidth=-64.0, start_us=1_600_000_000_000_000))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_raw_round_trip(spark, tmp_path):
    s, path = volts(spark), str(tmp_path / "x.raw")
    raw.write_raw(s, path, 64)
    (back,) = raw.read_raw(spark, [path])
    assert same(back.df, s.df.select("idat", "ichan", "ipol", "re", "im"))
    assert (back.meta.rate, back.meta.ndat, back.meta.start_us, back.meta.bandwidth) == pytest.approx((2e5, 300, s.meta.start_us, -64.0))


def test_raw_source_reads_blocks(spark, tmp_path):
    s, path = volts(spark), str(tmp_path / "x.raw")
    raw.write_raw(s, path)
    blocks = read_blocks(spark, [(path, 4096, 512, 4096 + 2400)], split=512)
    assert blocks.rdd.getNumPartitions() == 5 and sorted(len(r["raw"]) for r in blocks.collect()) == [352, 512, 512, 512, 512]
    (back,) = raw.read_raw(spark, [path], block=512)
    assert same(back.df, s.df.select("idat", "ichan", "ipol", "re", "im"))


@pytest.mark.parametrize("nbit", [2, 4, 8, 16])
def test_filterbank_round_trip(spark, tmp_path, nbit):
    path, top = str(tmp_path / "x.fil"), (1 << nbit) - 1
    df = spark.range(64).selectExpr("id AS idat", "explode(array(0, 1, 2, 3)) AS ichan").selectExpr("idat", "ichan", "0 AS ipol", f"cast((idat * 37 + ichan * 11) % {top + 1} AS int) AS v")
    s = Signal(df, ObsMeta(nchan=4, nbit=nbit, ndat=64, rate=1000.0, state=INTENSITY, centre_frequency=1400.0, bandwidth=-100.0))
    raw.write_filterbank(s, path)
    back = raw.read_filterbank(spark, path)
    assert same(back.df, s.df) and back.meta.frequency(0) == pytest.approx(s.meta.frequency(0)) and back.meta.ndat == 64


def test_headers():
    h = headers.parse_ascii("NCHAN 4 # channels\nFREQ 1400.5\nSTATE Analytic\nTSAMP 0.5\nUTC_START 2020-01-02-03:04:05\n\0\0rest")
    meta = headers.ascii_meta(h)
    assert (meta.nchan, meta.nbit, meta.ndim, meta.rate) == (4, 2, 2, 2e6)
    assert meta.start_us == 1_577_934_245_000_000
    with pytest.raises(ValueError):
        headers.read_filterbank_header(b"\x0c\0\0\0HEADER_WRONG")
    words = headers.vdif_header(np.array([5, 1 << 24 | 7, 2 << 24 | 629, 1 << 31 | 7 << 26 | 3 << 16], dtype="<u4").tobytes())
    assert (words["seconds"], words["frame"], words["nchan"], words["bytes"], words["complex"], words["nbit"], words["thread"]) == (5, 7, 4, 5032, 1, 8, 3)


def test_generators(spark):
    s = generators.gaussian_noise(spark, 2000, 3, nchan=2)
    row = s.df.selectExpr("count(*) n", "avg(re) m", "var_pop(im) v").first()
    assert row["n"] == 4000 and abs(row["m"]) < 0.1 and abs(row["v"] - 1) < 0.1


def test_two_bit_levels_are_monotone():
    levels = digitize.optimal_two_bit_levels(64)
    assert len(levels) == 65 and all(low <= high for _, low, high in levels)
    assert digitize.level_table(2) == [-0.75, -0.25, 0.25, 0.75]


def test_excision_limits_hold_noise():
    low, high = digitize.excision_limits(512)
    assert low < 0.6827 * 512 < high


@pytest.mark.parametrize(("nbit", "is_complex"), [(2, 0), (8, 1)])
def test_vdif(spark, tmp_path, nbit, is_complex):
    rng, frames, payload, want = np.random.default_rng(5), b"", 64, set()
    per = payload * 8 // (nbit * 2 * (1 + is_complex))
    for second in (100, 101):
        for frame in range(3):
            for thread in (0, 1):
                codes = rng.integers(0, 1 << nbit, per * 2 * (1 + is_complex))
                packed = (codes.reshape(-1, 8 // nbit) << np.arange(8 // nbit) * nbit).sum(1).astype(np.uint8).tobytes()
                bad = second == 101 and frame == 2
                head = np.array([bad << 31 | second, frame, 1 << 24 | (payload + 32) // 8, is_complex << 31 | nbit - 1 << 26 | thread << 16, 0, 0, 0, 0], dtype="<u4").tobytes()
                frames += head + packed
                v = codes.reshape(per, 2, -1) - (1 << nbit - 1)
                if not bad:
                    want |= {((second - 100) * 3 * per + frame * per + i, c, thread, *v[i, c].tolist()) for i in range(per) for c in (0, 1)}
    path = tmp_path / "x.vdif"
    path.write_bytes(frames)
    got = raw.read_vdif(spark, str(path), 3.0 * per, frames_per_row=5)
    assert {tuple(r) for r in got.df.collect()} == want and got.df.count() == len(want) and got.meta.nchan == 2


def test_fold_bins():
    from cadenza.operators.folding import choose_nbin

    assert [choose_nbin(p, 100) for p in (100, 400, 2000, 10**9)] == [1, 2, 16, 1024]


def test_parallel_streams_must_follow_each_other(spark):
    s = volts(spark, 20)
    low = Signal(s.df, s.meta.but(centre_frequency=1400.0))
    high = Signal(s.df, s.meta.but(centre_frequency=1400.0 + s.meta.bandwidth))
    both = generators.parallel([low, high])
    assert both.meta.nchan == 4 and both.df.count() == 2 * s.df.count()
    assert [both.meta.frequency(i) for i in range(4)] == pytest.approx([low.meta.frequency(0), low.meta.frequency(1), high.meta.frequency(0), high.meta.frequency(1)])
    with pytest.raises(ValueError):
        generators.parallel([low, low])


def test_text_lines(spark, tmp_path):
    raw.write_text(volts(spark, 30), str(tmp_path / "t"))
    lines = [tuple(map(int, r["value"].split())) for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert sorted(lines) == sorted(map(tuple, volts(spark, 30).df.select("idat", "ichan", "ipol", "re", "im").collect()))


def test_many_files_are_one_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from cadenza.meta import PPQQ, ObsMeta, Signal
    from cadenza.sources import raw

    meta = ObsMeta(nchan=2, npol=1, nbit=8, rate=1000.0, centre_frequency=1400.0, bandwidth=2.0, start_us=1_704_067_200_000_000, state=PPQQ, telescope="A", source="B")
    df = spark.range(300).selectExpr("id AS idat", "explode(sequence(0, 1)) AS ichan", "0 AS ipol").withColumn("v", F.expr("CAST((idat * 7 + ichan * 3) % 100 AS INT)"))
    names = []
    for k, (low, high) in enumerate([(0, 90), (90, 100), (100, 260), (260, 300)]):
        part = Signal(df.filter(f"idat >= {low} AND idat < {high}").withColumn("idat", F.col("idat") - low), meta.but(ndat=high - low, start_us=meta.start_us + low * 1000))
        names.append(str(tmp_path / f"{9 - k}.raw"))
        raw.write_raw(part, names[-1], samples=32)
    whole = raw.read_multi(spark, sorted(names), block=64)
    assert whole.meta.ndat == 300 and whole.meta.start_us == meta.start_us
    key = lambda x: sorted(map(tuple, x.select("idat", "ichan", "ipol", "v").collect()))
    assert key(whole.df) == key(df)
    assert whole.df._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    with pytest.raises(ValueError, match="do not follow"):
        raw.read_multi(spark, [names[0], names[2]])
