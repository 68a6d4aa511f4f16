"""Square-law and full-polarization detection of voltages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, COHERENCE, INTENSITY, NYQUIST, PP, PPQQ, QQ, STOKES, Signal


def detect(s: Signal, state: str = INTENSITY) -> Signal:
    """Powers, as column v, of complex samples (re, im) or real ones (v). Intensity sums polarizations; Coherence is PP, QQ, Re and Im of conj(p) q; Stokes is I, Q, U, V."""
    if s.meta.state not in (NYQUIST, ANALYTIC):
        raise ValueError("the signal is detected already")
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im") if s.meta.state == ANALYTIC else F.col("v") * F.col("v")
    if state == INTENSITY:
        df = s.df.select("idat", "ichan", power.alias("v"))
        if s.meta.npol > 1:
            df = df.groupBy("idat", "ichan").agg(F.sum("v").alias("v"))
        df = df.select("idat", "ichan", F.lit(0).alias("ipol"), "v")
        return s.then("detect", df, s.carry("merge", 1, s.meta.npol, s.meta.nchan, s.meta.npol), state=state, npol=1, ndim=1)
    if state in (PP, QQ, PPQQ):
        keep = {PP: [0], QQ: [1], PPQQ: [0, 1]}[state]
        df = s.df.filter(F.col("ipol").isin(keep)).select("idat", "ichan", (F.col("ipol") - keep[0]).alias("ipol"), power.alias("v"))
        return s.then("detect", df, s.carry("select", (0, s.meta.nchan - 1), (keep[0], keep[-1])), state=state, npol=len(keep), ndim=1)
    if state not in (COHERENCE, STOKES) or s.meta.state != ANALYTIC or s.meta.npol != 2:
        raise ValueError("cross products need two complex polarizations")
    pol = lambda i, c: F.max(F.when(F.col("ipol") == i, F.col(c)))
    pair = s.df.groupBy("idat", "ichan").agg(pol(0, "re").alias("a"), pol(0, "im").alias("b"), pol(1, "re").alias("c"), pol(1, "im").alias("d"))
    a, b, c, d = map(F.col, "abcd")
    pp, qq, re, im = a * a + b * b, c * c + d * d, a * c + b * d, a * d - b * c
    four = (pp, qq, re, im) if state == COHERENCE else (pp + qq, pp - qq, 2 * re, 2 * im)
    df = pair.select("idat", "ichan", F.posexplode(F.array(*four)).alias("ipol", "v"))
    return s.then("detect", df, s.carry("over_pols", s.meta.nchan, 2, 4), state=state, npol=4, ndim=1)
