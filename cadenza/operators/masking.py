"""Masking by time intervals and by weights of blocks of samples. Zero weight marks bad data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import weights
from cadenza.functions.response import bandpass_mask
from cadenza.meta import Signal


def parse_intervals(lines: list[str]) -> list[tuple[float, float]]:
    """(MJD, seconds) of each line of a mask file headed ``# MJD duration``; comments and blank lines are skipped."""
    out = []
    for line in lines:
        words = line.split("#")[0].split()
        if words:
            out.append((float(words[0]), float(words[1])))
    return out


def mask_times(s: Signal, intervals: DataFrame, bucket: int = 1024, broadcast_rows: int = 100_000) -> Signal:
    """Zeroes samples in [start, end) of intervals(start, end), in samples.

    Intervals are cut at buckets of time, which makes the interval join an equi-join, and united within each; a few buckets are broadcast.
    """
    by_bucket = united(intervals, bucket, s.meta.ndat).groupBy("b").agg(F.collect_list(F.struct("start", "end")).alias("iv"))
    n = by_bucket.limit(broadcast_rows + 1).count()
    if not n:
        return s.then("mask_times", s.df)
    rows = s.df.withColumn("b", F.expr(f"idat div {bucket}"))
    joined = rows.join(F.broadcast(by_bucket) if n <= broadcast_rows else by_bucket, "b", "left")
    hit = F.coalesce(F.exists("iv", lambda i: (F.col("idat") >= i["start"]) & (F.col("idat") < i["end"])), F.lit(False))
    return s.then("mask_times", joined.select("idat", "ichan", "ipol", F.when(hit, F.lit(0)).otherwise(F.col("v")).cast(dict(s.df.dtypes)["v"]).alias("v")))


def united(intervals: DataFrame, bucket: int, ndat: int) -> DataFrame:
    """(b, start, end): the parts of the intervals in each bucket of time, overlapping or touching ones united. A window holds one bucket's different
    parts, whatever the number of intervals."""
    rows = intervals.select(F.greatest(F.lit(0), F.col("start").cast("long")).alias("s"), F.least(F.lit(ndat), F.col("end").cast("long")).alias("e")).filter("e > s")
    rows = rows.select("s", "e", F.explode(F.sequence(F.expr(f"s div {bucket}"), F.expr(f"(e - 1) div {bucket}"))).alias("b"))
    parts = rows.select("b", F.greatest("s", F.col("b") * bucket).alias("start"), F.least("e", (F.col("b") + 1) * bucket).alias("end")).distinct()
    w = Window.partitionBy("b").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    parts = parts.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("b", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def rfi_filter(s: Signal, window: int = 51) -> tuple[Signal, list[float]]:
    """Zeroes the channels that bandpass_mask() finds in the power integrated over time and polarization; with the mask itself.

    The bandpass is one row a channel and goes to the driver, where the rounds of masking run; the mask comes back as a literal.
    """
    rows = s.df.groupBy("ichan").agg(F.sum("v").alias("p")).toPandas().set_index("ichan")["p"]
    spectrum = np.array([float(rows.get(i, 0.0)) for i in range(s.meta.nchan)])
    good = bandpass_mask(spectrum, window).tolist()
    keep = F.element_at(F.array(*map(F.lit, good)), F.col("ichan") + 1) > 0
    v = F.when(keep, F.col("v")).otherwise(F.lit(0)).cast(dict(s.df.dtypes)["v"])
    return s.then("rfi_filter", s.df.withColumn("v", v)), good


# --- weights: iw (block of ndat_per_weight samples), ichan, ipol, weight -------------------------------------------------


def mask_weights(rows: DataFrame) -> DataFrame:
    """A block that is bad in one channel or polarization is bad in all."""
    bad = rows.groupBy("iw").agg((F.min("weight") == 0).alias("bad"))
    return rows.join(bad, "iw").select("iw", "ichan", "ipol", F.when(F.col("bad"), 0).otherwise(F.col("weight")).alias("weight"))


def convolve_weights(rows: DataFrame, nfft: int, step: int, ndat_per_weight: int, ndat: int) -> DataFrame:
    """Weights of blocks before transforms of nfft samples every step: blocks that hold what a transform keeps are bad if one that it reads is.

    A block knows the parts that read it, so no window runs over a whole channel.
    """
    return weights.convolve(rows, ndat, nfft, step, ndat_per_weight)


def scrunch_weights(rows: DataFrame, n: int, ndat_per_weight: int = 1) -> tuple[DataFrame, int]:
    """Weights after sums of n samples, and their new block length: blocks of n samples or more stay, of shorter ones n make one, the rest at
    the end one more."""
    return weights.scrunch(rows, n, ndat_per_weight)


def apply_weights(s: Signal, rows: DataFrame | None = None, ndat_per_weight: int = 1) -> Signal:
    """Zeroes the samples of blocks with weight 0: of the signal's own weights, or of rows."""
    if rows is not None:
        s = s.with_weights(rows, ndat_per_weight)
    v = lambda c: F.when(F.col("weight") == 0, F.lit(0)).otherwise(F.col(c)).cast(dict(s.df.dtypes)[c]).alias(c)
    return s.then("apply_weights", s.weighed().select("idat", "ichan", "ipol", *(v(c) for c in ("v", "re", "im") if c in s.df.columns)))
