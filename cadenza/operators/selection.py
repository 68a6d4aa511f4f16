"""Selecting and reshaping channels, polarizations and times. All are narrow: filters and projections that reach the scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, COHERENCE, INTENSITY, NYQUIST, PP, PPQQ, QQ, Signal


def chan_pol_select(s: Signal, chan: tuple[int, int] | None = None, pol: tuple[int, int] | None = None) -> Signal:
    """Keeps ranges of channels and polarizations, both ends included, numbered anew from 0."""
    c0, c1 = chan or (0, s.meta.nchan - 1)
    p0, p1 = pol or (0, s.meta.npol - 1)
    if not (0 <= c0 <= c1 < s.meta.nchan and 0 <= p0 <= p1 < s.meta.npol):
        raise ValueError("range is outside the signal")
    df = s.df.filter(F.col("ichan").between(c0, c1) & F.col("ipol").between(p0, p1))
    df = df.withColumns({"ichan": F.col("ichan") - c0, "ipol": F.col("ipol") - p0})
    centre = (s.meta.frequency(c0) + s.meta.frequency(c1)) / 2
    n = c1 - c0 + 1
    return s.then("chan_pol_select", df, s.carry("select", (c0, c1), (p0, p1)), nchan=n, npol=p1 - p0 + 1, bandwidth=s.meta.channel_width * n, centre_frequency=centre)


def fzoom(s: Signal, centre: float, width: float) -> Signal:
    """Keeps the channels that overlap a band, which must lie within the signal's."""
    low, high = centre - abs(width) / 2, centre + abs(width) / 2
    half = abs(s.meta.channel_width) / 2
    edges = [(s.meta.frequency(i) - half, s.meta.frequency(i) + half) for i in range(s.meta.nchan)]
    if low < min(e[0] for e in edges) - 1e-9 or high > max(e[1] for e in edges) + 1e-9:
        raise ValueError("band is not within the signal's")
    keep = [i for i, (a, b) in enumerate(edges) if b > low and a < high]
    out = chan_pol_select(s, (keep[0], keep[-1]))
    return replace(out, meta=out.meta.but(path=(*s.meta.path, "fzoom")))


def poln_select(s: Signal, ipol: int) -> Signal:
    states = {"PPQQ": (PP, QQ), "Coherence": (PP, QQ), "Stokes": (INTENSITY,)}.get(s.meta.state, ())
    state = s.meta.state if s.meta.state in (NYQUIST, ANALYTIC) else states[ipol] if ipol < len(states) else "Other"
    df = s.df.filter(F.col("ipol") == ipol).withColumn("ipol", F.lit(0))
    return s.then("poln_select", df, s.carry("select", (0, s.meta.nchan - 1), (ipol, ipol)), npol=1, state=state)


def poln_reshape(s: Signal, npol: int) -> Signal:
    """Detected products stored as two polarizations of two dimensions, as real columns: polarization 0 holds PP and QQ, polarization 1 the real and
    imaginary parts of the cross product. Four columns are all of these (Coherence), two are PP and QQ (PPQQ), one is PP + QQ (Intensity)."""
    states = {4: COHERENCE, 2: PPQQ, 1: INTENSITY}
    if npol not in states:
        raise ValueError("npol is 4, 2 or 1")
    if s.meta.npol != 2 or s.meta.ndim != 2:
        raise ValueError("two polarizations of two dimensions are needed")
    if npol == 1:
        df = s.df.filter("ipol = 0").select("idat", "ichan", F.lit(0).alias("ipol"), (F.col("re") + F.col("im")).alias("v"))
    else:
        df = s.df if npol == 4 else s.df.filter("ipol = 0")
        df = df.select("idat", "ichan", F.posexplode(F.array("re", "im")).alias("d", "v"), "ipol")
        df = df.select("idat", "ichan", (F.col("ipol") * 2 + F.col("d")).alias("ipol"), "v")
    return s.then("poln_reshape", df, s.carry("over_pols", s.meta.nchan, 2, npol), npol=npol, ndim=1, state=states[npol])


def truncate(s: Signal, end_us: int) -> Signal:
    n = s.meta.sample_at(min(end_us, s.meta.end_us))
    return s.then("truncate", s.df.filter(F.col("idat") < n), s.carry("first", n), ndat=n)


def chomp(s: Signal, ndat: int | None = None, multiple: int | None = None) -> Signal:
    """The first ndat samples, or as many as a multiple allows."""
    n = min(ndat if ndat is not None else s.meta.ndat, s.meta.ndat)
    n -= n % multiple if multiple else 0
    return s.then("chomp", s.df.filter(F.col("idat") < n), s.carry("first", n), ndat=n)


def resize(s: Signal, change: int) -> Signal:
    n = max(0, s.meta.ndat + change)
    return s.then("resize", s.df.filter(F.col("idat") < n), s.carry("first", n), ndat=n)


def delay_start(s: Signal, start_us: int) -> Signal:
    """Drops what comes before a time; samples are numbered from there."""
    k = s.meta.sample_at(start_us)
    df = s.df.filter(F.col("idat") >= k).withColumn("idat", F.col("idat") - k)
    return s.then("delay_start", df, s.carry("after", k), ndat=s.meta.ndat - k, start_us=s.meta.start_us + round(k / s.meta.rate * 1e6))


def channel_order(s: Signal, order: list[int]) -> Signal:
    """Stored channel i becomes channel order[i]; the map is a literal, as long as nchan."""
    lookup = F.array(*map(F.lit, order))
    return s.then("channel_order", s.df.withColumn("ichan", F.element_at(lookup, F.col("ichan") + 1)), s.carry("reorder", order, s.meta.npol))
