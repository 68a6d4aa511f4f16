"""Sums over time, frequency and polarization, moments, and correlations. One partial and final aggregate each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.meta import INTENSITY, PP, PPQQ, QQ, STOKES, Signal


def _floordiv(c: str, n: int) -> Column:
    return F.expr(f"{c} div {int(n)}")


def scrunch(s: Signal, time: int = 1, freq: int = 1) -> Signal:
    """Sums of ``time`` samples and ``freq`` channels in one shuffle; tails shorter than a factor are dropped, and the band with them."""
    if time < 1 or freq < 1:
        raise ValueError("factors are positive")
    nchan, ndat = s.meta.nchan // freq, s.meta.ndat // time
    if not nchan:
        raise ValueError("the frequency factor is more than the number of channels")
    lost = s.meta.channel_width * (s.meta.nchan - nchan * freq)
    band = {"bandwidth": s.meta.bandwidth - lost, "centre_frequency": s.meta.centre_frequency - lost / 2} if lost else {}
    df = s.df.filter((F.col("idat") < ndat * time) & (F.col("ichan") < nchan * freq))
    keys = [_floordiv("idat", time).alias("idat"), _floordiv("ichan", freq).cast("int").alias("ichan"), F.col("ipol")]
    df = df.groupBy(*keys).agg(F.sum("v").alias("v"))
    weights = s.weights and s.weights.scrunch(time, ndat).merge(freq, 1, s.meta.nchan, s.meta.npol)
    return s.then("scrunch", df, weights, **band, nchan=nchan, ndat=ndat, rate=s.meta.rate / time, scale=s.meta.scale * time * freq)


def tscrunch(s: Signal, factor: int) -> Signal:
    return scrunch(s, time=factor)


def fscrunch(s: Signal, factor: int) -> Signal:
    return scrunch(s, freq=factor)


def pscrunch(s: Signal, state: str = INTENSITY) -> Signal:
    """Intensity p0 + p1, PP p0, QQ p1, or PPQQ both, of a detected signal of two or four polarizations that is not Stokes."""
    if s.meta.ndim != 1 or s.meta.npol not in (2, 4) or s.meta.state == STOKES:
        raise ValueError("pscrunch takes detected polarizations")
    if state == INTENSITY:
        df = s.df.filter("ipol < 2").groupBy("idat", "ichan").agg(F.sum("v").alias("v")).select("idat", "ichan", F.lit(0).alias("ipol"), "v")
    else:
        keep = {PP: [0], QQ: [1], PPQQ: [0, 1]}[state]
        df = s.df.filter(F.col("ipol").isin(keep)).withColumn("ipol", F.col("ipol") - keep[0])
    if state == INTENSITY:
        weights = s.carry("merge", 1, 2, s.meta.nchan, 2)
    else:
        weights = s.carry("select", (0, s.meta.nchan - 1), (keep[0], keep[-1]))
    return s.then("pscrunch", df, weights, npol=2 if state == PPQQ else 1, state=state)


def stats(s: Signal) -> DataFrame:
    """n, sum, sum of squares, mean and population deviation by channel and polarization."""
    agg = s.df.groupBy("ichan", "ipol").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("total_sq"))
    mean = F.col("total") / F.col("n")
    return agg.withColumns({"mean": mean, "sigma": F.sqrt(F.greatest(F.lit(0.0), F.col("total_sq") / F.col("n") - mean * mean))})


def fourth_moment(stokes: Signal) -> DataFrame:
    """A sample's four Stokes parameters and their ten products: 14 columns."""
    p = stokes.df.groupBy("idat", "ichan").agg(*(F.max(F.when(F.col("ipol") == i, F.col("v"))).alias(f"s{i}") for i in range(4)))
    return p.select("*", *((F.col(f"s{i}") * F.col(f"s{j}")).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)))


def lag_pairs(x: str, nlag: int, size: int) -> Column:
    """Pairs (e, o) of a block's sorted samples with o less than nlag samples after e, for each e of the block proper (column b), not of its halo."""
    own = lambda e: (e["idat"] - e["idat"] % size) == F.col("b") * size
    near = lambda e, i: F.filter(F.slice(x, i + 1, nlag), lambda o: (o["idat"] < e["idat"] + nlag) & own(e))
    return F.flatten(F.transform(x, lambda e, i: F.transform(near(e, i), lambda o: F.struct(e.alias("e"), o.alias("o")))))


def autocorrelation(s: Signal, nlag: int) -> DataFrame:
    """Sum of v(t) v(t + lag) by channel, polarization and lag below nlag.

    Samples are dealt into blocks of time with a halo of nlag - 1, so lags meet within a block, without a self-join on time.
    """
    size = max(nlag * 16, 1024)
    block = F.expr(f"idat div {size}")
    halo = F.when((F.col("idat") % size < nlag - 1) & (F.col("idat") >= size), F.array(block - 1, block)).otherwise(F.array(block))
    rows = s.df.select("idat", "ichan", "ipol", "v", F.explode(halo).alias("b"))
    series = rows.groupBy("ichan", "ipol", "b").agg(F.array_sort(F.collect_list(F.struct("idat", "v"))).alias("x"))
    out = series.select("ichan", "ipol", F.explode(lag_pairs("x", nlag, size)).alias("p")).select("ichan", "ipol", "p.*")
    return out.groupBy("ichan", "ipol", (F.col("o.idat") - F.col("e.idat")).alias("lag")).agg(F.sum(F.col("e.v") * F.col("o.v")).alias("acf"))


def superpose(signals: list[Signal]) -> Signal:
    """Sum, sample by sample, of signals of the same shape."""
    df = reduce(DataFrame.unionByName, (x.df for x in signals)).groupBy("idat", "ichan", "ipol").agg(F.sum("v").alias("v"))
    weights = None
    if any(x.weights for x in signals):
        if not all(x.weights for x in signals):
            raise ValueError("all signals have weights, or none has")
        weights = reduce(lambda a, b: a.add(b, signals[0].meta.nchan, signals[0].meta.npol), (x.weights for x in signals))
    return signals[0].then("superpose", df, weights)


def serial(signals: list[Signal]) -> Signal:
    """Signals that follow each other in time, as one."""
    from cadenza.meta import combined_ndat

    n, out, at = combined_ndat([s.meta for s in signals]), [], 0
    for s in signals:
        out.append(s.df.withColumn("idat", F.col("idat") + at))
        at += s.meta.ndat
    return signals[0].then("serial", reduce(DataFrame.unionByName, out), ndat=n)


def difference_rms(a: Signal, b: Signal) -> DataFrame:
    """Root mean square difference by channel and polarization, and the number of samples that differ."""
    both = a.df.alias("a").join(b.df.alias("b"), ["idat", "ichan", "ipol"]).select("ichan", "ipol", (F.col("a.v") - F.col("b.v")).alias("d"))
    return both.groupBy("ichan", "ipol").agg(F.sqrt(F.sum(F.col("d") * F.col("d")) / F.count("d")).alias("rms"), F.sum((F.col("d") != 0).cast("long")).alias("differ"))
