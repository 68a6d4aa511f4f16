"""Synthetic signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, ObsMeta, Signal


def impulse_train(spark: SparkSession, ndat: int, period: int, amplitude: int = 1, phase: int = 0, meta: ObsMeta | None = None) -> Signal:
    """amplitude at every sample whose index is phase modulo period, else 0."""
    v = F.when(F.col("id") % period == phase, F.lit(amplitude)).otherwise(0)
    df = spark.range(ndat).select(F.col("id").alias("idat"), F.lit(0).alias("ichan"), F.lit(0).alias("ipol"), v.alias("v"))
    return Signal(df, (meta or ObsMeta()).but(ndat=ndat))


def gaussian_noise(spark: SparkSession, ndat: int, seed: int, nchan: int = 1, npol: int = 1, meta: ObsMeta | None = None) -> Signal:
    """Complex normal noise, unit deviation in each part; a function of the seed and of the partitioning of range()."""
    df = spark.range(ndat).select(F.col("id").alias("idat"), F.explode(F.sequence(F.lit(0), F.lit(nchan * npol - 1))).alias("k"))
    df = df.select("idat", (F.col("k") / npol).cast("int").alias("ichan"), (F.col("k") % npol).cast("int").alias("ipol"), F.randn(seed).alias("re"), F.randn(seed + 1).alias("im"))
    return Signal(df, (meta or ObsMeta()).but(ndat=ndat, nchan=nchan, npol=npol, ndim=2, state=ANALYTIC))


def impulsive_noise(spark: SparkSession, ndat: int, seed: int, share: float, amplitude: float) -> Signal:
    """Real normal noise of unit deviation in which a share of the samples, at random, is ``amplitude`` times as strong."""
    strong = F.when(F.rand(seed + 1) < share, amplitude).otherwise(1.0)
    df = spark.range(ndat).select(F.col("id").alias("idat"), F.lit(0).alias("ichan"), F.lit(0).alias("ipol"), (F.randn(seed) * strong).alias("v"))
    return Signal(df, ObsMeta(ndat=ndat, state=NYQUIST))


def dummy(spark: SparkSession, meta: ObsMeta) -> Signal:
    """Zeros of a signal's shape, for timing what follows."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(meta.nchan * meta.npol - 1)))
    df = spark.range(meta.ndat).select(F.col("id").alias("idat"), cells.alias("k"))
    values = [F.lit(0).alias(c) for c in (("re", "im") if meta.ndim == 2 else ("v",))]
    return Signal(df.select("idat", F.expr(f"cast(k div {meta.npol} as int)").alias("ichan"), (F.col("k") % meta.npol).alias("ipol"), *values), meta)


def multiplex(streams: list[DataFrame], packet: int) -> DataFrame:
    """Round-robin interleave of packets of ``packet`` consecutive samples (idat) of each stream."""
    n, out = len(streams), None
    for k, df in enumerate(streams):
        at = (F.expr(f"idat div {packet}") * n + k) * packet + F.col("idat") % packet
        df = df.withColumn("idat", at)
        out = df if out is None else out.unionByName(df)
    return out


def dual(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two synchronous one-polarization inputs as polarizations 0 and 1."""
    return first.withColumn("ipol", F.lit(0)).unionByName(second.withColumn("ipol", F.lit(1)))


def parallel(signals: list[Signal]) -> Signal:
    """Synchronous streams of neighbouring bands, in order, as the channels of one signal."""
    first, out, at = signals[0].meta, None, 0
    for s in signals:
        m = s.meta
        if (m.rate, m.ndat, m.start_us, m.npol, m.ndim, m.state) != (first.rate, first.ndat, first.start_us, first.npol, first.ndim, first.state) or abs(m.channel_width - first.channel_width) > 1e-9:
            raise ValueError("streams differ in time, polarizations, state or channel width")
        if at and abs(m.frequency(0) - signals[0].meta.frequency(0) - at * m.channel_width) > 1e-6:
            raise ValueError("bands do not follow each other")
        df = s.df.withColumn("ichan", (F.col("ichan") + at).cast("int"))
        out, at = df if out is None else out.unionByName(df), at + m.nchan
    width = first.channel_width
    return signals[0].then("parallel", out, nchan=at, bandwidth=width * at, centre_frequency=first.frequency(0) + width * (at - 1) / 2)
