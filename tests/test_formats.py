"""The format registry, and formats against files made by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, INTENSITY, ObsMeta, Signal
from cadenza.operators import digitize, rescale
from cadenza.sources import fits, headers, raw, registry


def powers(spark, n=256, nchan=4, npol=2, nbit=8):
    top = 1 << nbit
    df = spark.range(n * nchan * npol).selectExpr(f"id div {nchan * npol} AS idat", f"cast(id div {npol} % {nchan} AS int) AS ichan", f"cast(id % {npol} AS int) AS ipol", f"cast(id * 37 % 101 % {top} AS int) AS v")
    return Signal(df, ObsMeta(nchan=nchan, npol=npol, nbit=nbit, ndat=n, rate=1000.0, state={1: INTENSITY, 2: "PPQQ"}[npol], centre_frequency=1400.0, bandwidth=-100.0, start_us=1_600_000_000_250_000, source="J0000", telescope="dish"))


def rows(df, digits=4):
    return sorted((r["idat"], r["ichan"], r["ipol"], *(round(float(r[c]), digits) for c in df.columns if c not in ("idat", "ichan", "ipol"))) for r in df.collect())


@pytest.mark.parametrize("nbit", [2, 4, 8])
def test_psrfits_round_trip_applies_scales(spark, tmp_path, nbit):
    s, path = powers(spark, nbit=nbit), str(tmp_path / "x.sf")
    scales = s.df.select(F.expr("idat div 64").alias("ib"), "ichan", "ipol").distinct().withColumns({"scale": F.col("ichan") * 0.5 + F.col("ib") + 1.0, "offset": F.col("ipol") * 8.0 - F.col("ib")})
    fits.write_psrfits(s, scales, path, 64)
    found = registry.format_of(path)
    assert found.name == "psrfits"
    back = registry.open_signal(spark, path)
    want = s.df.withColumn("ib", F.expr("idat div 64")).withColumn("v", F.col("v") * (F.col("ichan") * 0.5 + F.col("ib") + 1.0) + F.col("ipol") * 8.0 - F.col("ib")).drop("ib")
    assert rows(back.df) == rows(want)
    assert (back.meta.ndat, back.meta.nchan, back.meta.npol, back.meta.start_us, back.meta.source, back.meta.state) == (256, 4, 2, s.meta.start_us, "J0000", "PPQQ")
    assert back.meta.frequency(0) == pytest.approx(s.meta.frequency(0)) and back.meta.rate == pytest.approx(1000.0)


def test_digitized_search_file_restores_the_signal(spark, tmp_path):
    """Table scales, codes by them, and back: within half a step."""
    s, path = powers(spark), str(tmp_path / "y.sf")
    real = Signal(s.df.withColumn("v", F.col("v") * 3.0 + 10), s.meta)
    scales = digitize.table_scale_offset(real, 64, 1)
    coded = digitize.table_digitize(real, scales, 64)
    fits.write_psrfits(coded, scales, path, 64)
    back = fits.read_psrfits(spark, path)
    both = back.df.join(real.df.withColumnRenamed("v", "w"), ["idat", "ichan", "ipol"]).join(scales.withColumnRenamed("ib", "k"), ["ichan", "ipol"]).filter("k = idat div 64")
    assert both.count() == 256 * 8 and both.filter("abs(v - w) > 0.51 * scale").count() == 0


def guppi_file(nblock=3, nchan=2, per=40, overlap=8):
    rng = np.random.default_rng(3)
    stream = rng.integers(-100, 100, (nblock * (per - overlap) + overlap, nchan, 2, 2)).astype(np.int8)
    out = b""
    for k in range(nblock):
        data = stream[k * (per - overlap) :][:per].transpose(1, 0, 2, 3).tobytes()
        pairs = {"OBSNCHAN": nchan, "NPOL": 4, "NBITS": 8, "TBIN": 0.001, "OBSFREQ": 1400.0, "OBSBW": 64.0, "BLOCSIZE": len(data), "OVERLAP": overlap, "STT_IMJD": 59000, "STT_SMJD": 10, "DIRECTIO": 1, "SRC_NAME": "'J1'"}
        cards = b"".join(f"{k:<8}= {v!s:>20}".ljust(80).encode() for k, v in pairs.items()) + b"END".ljust(80)
        out += cards.ljust(-(-len(cards) // 512) * 512) + data
    return out, stream[: nblock * (per - overlap)]


def test_guppi_leaves_overlaps_out(spark, tmp_path):
    data, stream = guppi_file()
    path = tmp_path / "x.0000.raw"
    path.write_bytes(data)
    assert registry.format_of(str(path)).name == "guppi"
    s = registry.open_signal(spark, str(path), {"telescope": "other"})
    assert (s.meta.ndat, s.meta.nchan, s.meta.npol, s.meta.state, s.meta.telescope, s.meta.source) == (96, 2, 2, ANALYTIC, "other", "J1")
    want = sorted((t, c, p, *map(float, stream[t, c, p])) for t in range(96) for c in range(2) for p in range(2))
    assert rows(s.df) == want


def test_registry_knows_raw_filterbank_and_vdif(spark, tmp_path):
    s = powers(spark, npol=1)
    raw.write_filterbank(s, str(tmp_path / "a"))
    raw.write_raw(powers(spark), str(tmp_path / "b"))
    frame = lambda k: np.array([5, k, (64 + 32) // 8, 7 << 26, 0, 0, 0, 0], dtype="<u4").tobytes() + bytes(64)
    (tmp_path / "c").write_bytes(b"".join(map(frame, range(4))))
    (tmp_path / "d").write_bytes(b"nothing that anyone knows" * 10)
    names = [registry.format_of(str(tmp_path / x)).name for x in "abc"]
    assert names == ["filterbank", "raw", "vdif"]
    assert rows(registry.open_signal(spark, str(tmp_path / "a")).df) == rows(s.df)
    with pytest.raises(ValueError, match="no known format"):
        registry.format_of(str(tmp_path / "d"))


def test_unlisted_keywords_are_passed_over():
    text = lambda x: struct.pack("<i", len(x)) + x.encode()
    head = text("HEADER_START") + text("nchans") + struct.pack("<i", 4) + text("ghost") + struct.pack("<i", 7) + text("spirit") + struct.pack("<d", 2.5) + text("nbits") + struct.pack("<i", 8) + text("HEADER_END")
    values, size = headers.read_filterbank_header(head + b"\1\2")
    assert values == {"nchans": 4, "ghost": 7, "spirit": 2.5, "nbits": 8} and size == len(head)


def test_files_that_follow_each_other(spark, tmp_path):
    s = powers(spark, n=100)
    later = Signal(s.df, s.meta.but(start_us=s.meta.start_us + 100_000))
    raw.write_raw(later, str(tmp_path / "first.raw"))
    raw.write_raw(s, str(tmp_path / "second.raw"))
    whole = registry.open_signals(spark, [str(tmp_path / "first.raw"), str(tmp_path / "second.raw")])
    assert whole.meta.ndat == 200 and whole.meta.start_us == s.meta.start_us
    assert rows(whole.df) == sorted(rows(s.df) + [(t + 100, *x) for t, *x in rows(s.df)])


def test_vdif_epoch_counts_half_years():
    assert headers.vdif_start_us({"epoch": 41, "seconds": 3}) == headers.micros(headers.datetime(2020, 7, 1, 0, 0, 3, tzinfo=headers.UTC))


def test_metadata_and_operators_applied_are_written(spark, tmp_path):
    s = rescale.rescale(powers(spark))
    folded = s.df.groupBy("ichan").agg(F.sum("v").alias("total")).withColumn("division", F.lit(0))
    raw.write_profiles(folded, str(tmp_path / "p"), meta=s.meta)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "p.meta")).collect()]
    assert "applied rescale" in lines and "nchan 4" in lines
    assert raw.division_name(0, 2, length_us=30_000_000) == "pulsar_1970-01-01-00:01:00.000000" and raw.division_name(0, 3, turns=10, source="x") == "x_pulse_0000000030"


def test_search_file_path_and_dump(spark, tmp_path):
    """Voltages to a search-mode file by the pipeline: within half a step of the detected filterbank that a dump on the way holds."""
    from cadenza.plans import pipeline

    rng = np.random.default_rng(8)
    z = rng.normal(size=(2048, 2)) + 1j * rng.normal(size=(2048, 2))
    rows_ = [(t, 0, p, float(z[t, p].real), float(z[t, p].imag)) for t in range(2048) for p in (0, 1)]
    df = spark.createDataFrame(rows_, "idat long, ichan int, ipol int, re double, im double")
    s = Signal(df, ObsMeta(nchan=1, npol=2, ndim=2, ndat=2048, rate=1e6, state=ANALYTIC, centre_frequency=1400.0, bandwidth=1.0, source="J2"))
    path, kept = str(tmp_path / "z.sf"), str(tmp_path / "kept")
    detected = pipeline.build(s, [pipeline.Step("power_filterbank", {"nchan": 4}), pipeline.Step("dump", {"path": kept})])
    assert detected.meta.path[-1] == "dump" and detected.df.count() == spark.read.parquet(kept).count() == 512 * 4 * 2
    coded = pipeline.fits_path(s, path, 4, samples=64, time=2)
    back = registry.open_signal(spark, path)
    assert (back.meta.ndat, back.meta.nchan, back.meta.npol, coded.meta.nbit) == (256, 4, 2, 8) and back.meta.rate == pytest.approx(125_000)
    power = np.abs(np.fft.fftshift(np.fft.fft(z.reshape(512, 4, 2), axis=1), axes=1)) ** 2
    want = power.reshape(256, 2, 4, 2).sum(1)
    got = np.zeros_like(want)
    for r in back.df.collect():
        got[r["idat"], r["ichan"], r["ipol"]] = r["v"]
    step = want.reshape(4, 64, 4, 2).std(1) * 12 / 256
    inside = np.abs(want.reshape(4, 64, 4, 2) - want.reshape(4, 64, 4, 2).mean(1, keepdims=True)) < 5.9 * want.reshape(4, 64, 4, 2).std(1, keepdims=True)
    assert (np.abs(got - want).reshape(4, 64, 4, 2) <= 0.51 * step[:, None])[inside].all()
