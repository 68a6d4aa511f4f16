"""Folding at a period, with sub-integrations by time or by turns, and cyclic spectra.

Phases come from integers (microseconds modulo the period), so every engine and every partitioning gives the same bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.meta import ObsMeta, Signal
from cadenza.operators.integration import lag_pairs


def choose_nbin(period_us: float, sample_us: float, most: int = 1024) -> int:
    """Largest power of two of bins that are at least 1.2 samples wide."""
    n = 1
    while n * 2 <= min(most, period_us / (1.2 * sample_us)):
        n *= 2
    return n


def phase_bin(us: Column, period_us: int, nbin: int, epoch_us: int = 0) -> Column:
    """Bin of a time: floor(frac(phase) nbin), in whole numbers throughout."""
    if nbin * period_us >= 1 << 63:
        raise ValueError("a period times its bins is less than 2**63 microseconds")
    return F.call_function("div", F.pmod(us - epoch_us, F.lit(period_us)) * nbin, F.lit(period_us).cast("long")).cast("int")


def turn(us: Column, period_us: int, epoch_us: int = 0) -> Column:
    """Number of whole turns since the epoch."""
    return F.call_function("div", (us - epoch_us).cast("long") - F.pmod((us - epoch_us).cast("long"), F.lit(period_us).cast("long")), F.lit(period_us).cast("long"))


def fold_period_us(meta: ObsMeta, period_us: int | None = None) -> int:
    """The period asked for, or else that of a calibrator's signal."""
    if period_us is None and meta.mode == "CAL" and meta.cal_frequency > 0:
        return round(1e6 / meta.cal_frequency)
    if not period_us:
        raise ValueError("a period is needed: the observation is not of a calibrator of known frequency")
    return period_us


def folded_meta(s: Signal, period_us: int, nbin: int) -> ObsMeta:
    """What describes a fold: as many samples as bins, one a bin's width."""
    return s.meta.but(ndat=nbin, rate=nbin * 1e6 / period_us, path=(*s.meta.path, "fold"))


def sample_us(s: Signal) -> Column:
    """Time of the middle of a sample."""
    return F.lit(s.meta.start_us) + F.round((F.col("idat") + 0.5) * (1e6 / s.meta.rate)).cast("long")


def fold(df: DataFrame, us: Column, period_us: int, nbin: int, keys: tuple[str, ...] = ("ichan", "ipol"), epoch_us: int = 0, division: Column | None = None, weight: Column | None = None, zeroed: bool = False) -> DataFrame:
    """(division,) keys, ibin, total, hits. Samples of weight 0 are skipped; with zeroed, a sample counts as a hit only where v is not 0.

    One partial and final aggregate over divisions x channels x bins; nothing else shuffles.
    """
    rows = df.filter(weight != 0) if weight is not None else df
    by = [*([division.alias("division")] if division is not None else []), *keys, phase_bin(us, period_us, nbin, epoch_us).alias("ibin")]
    hits = F.sum((F.col("v") != 0).cast("long")) if zeroed else F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.sum("v").alias("total"), hits.alias("hits"))


def fold_signal(s: Signal, period_us: int, nbin: int, **settings) -> DataFrame:
    """fold() of a signal's samples at their times; those of weight 0 are skipped, in their own channel and polarization. With zeroed in the
    settings, bad samples count as zeros instead."""
    rows = s.df if s.weights is None or settings.get("zeroed") else s.weights.good(s.df)
    return fold(rows, sample_us(s), period_us, nbin, **settings)


def fold_many(df: DataFrame, us: Column, folds: list[tuple[int, int]], keys: tuple[str, ...] = ("ichan", "ipol"), epoch_us: int = 0) -> DataFrame:
    """ifold, keys, ibin, total, hits for each (period_us, nbin), in one pass and one aggregate over the samples."""
    bins = F.array(*(F.struct(F.lit(i).alias("ifold"), phase_bin(us, period, nbin, epoch_us).alias("ibin")) for i, (period, nbin) in enumerate(folds)))
    rows = df.select(*keys, "v", F.explode(bins).alias("at")).select(*keys, "v", "at.*")
    return rows.groupBy("ifold", *keys, "ibin").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("hits"))


def predicted(df: DataFrame, us: Column, segments: DataFrame, start_us: int, length_us: int, broadcast_rows: int = 100_000) -> DataFrame:
    """df with turn and phase (in [0, 1)) by a predictor: segments (functions.predictor.SCHEMA) of length_us each, from start_us on.

    A time knows its segment's number, so the interval join is an equi-join on one number; segments are broadcast only while they are few. Times
    outside all segments go. Turns are whole numbers and phases fractions throughout: neither loses digits to the other.
    """
    few = segments.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = df.withColumn("__us", us).withColumn("segment", turn(F.col("__us"), length_us, start_us))
    rows = rows.join(F.broadcast(segments) if few else segments, "segment")
    dt = (F.col("__us") - F.col("mid_us")) / 60e6
    value = F.aggregate(F.reverse("coeffs"), F.lit(0.0), lambda acc, c: acc * dt + c)
    whole = F.col("fraction") + 60 * F.col("f0") * dt + value
    rows = rows.withColumn("__whole", whole)
    rows = rows.withColumns({"turn": F.col("turns") + F.floor("__whole"), "phase": F.col("__whole") - F.floor("__whole")})
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), "turn", "phase")


def fold_predicted(rows: DataFrame, nbin: int, keys: tuple[str, ...] = ("ichan", "ipol"), turns: int | None = None, reference_phase: float = 0.0, weight: Column | None = None, zeroed: bool = False) -> DataFrame:
    """As fold(), of rows with turn and phase from predicted(); with turns, a division is that many turns. reference_phase is taken to phase 0."""
    rows = rows.filter(weight != 0) if weight is not None else rows
    shifted = F.col("phase") - F.lit(reference_phase)
    at = F.least(F.floor((shifted - F.floor(shifted)) * nbin), F.lit(nbin - 1)).cast("int")
    number = F.col("turn") + F.floor(shifted).cast("long")
    by = [*([((number - F.pmod(number, F.lit(turns))) / turns).cast("long").alias("division")] if turns else []), *keys, at.alias("ibin")]
    hits = F.sum((F.col("v") != 0).cast("long")) if zeroed else F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.sum("v").alias("total"), hits.alias("hits"))


def bookkeeping(df: DataFrame, folded: DataFrame, rate: float, keys: tuple[str, ...] = (), division: Column | None = None) -> DataFrame:
    """(division,) keys, ndat_total, ndat_folded, integration_us: samples offered, samples folded (hits), and the time that these cover."""
    by = [*([division.alias("division")] if division is not None else []), *keys]
    names = [*(["division"] if division is not None else []), *keys]
    offered, taken = df.groupBy(*by).agg(F.count(F.lit(1)).alias("ndat_total")), folded.groupBy(*names).agg(F.sum("hits").alias("ndat_folded"))
    both = offered.join(taken, names, "left") if names else offered.crossJoin(taken)  # without names both are one row
    return both.withColumn("ndat_folded", F.coalesce("ndat_folded", F.lit(0).cast("long"))).withColumn("integration_us", F.col("ndat_folded") * (1e6 / rate))


def by_seconds(us: Column, length_us: int, start_us: int = 0) -> Column:
    """Division number of fixed lengths of time. Of sample_us(), the middle of a sample, edges fall on the nearest sample."""
    return turn(us, length_us, start_us)


def by_turns(us: Column, period_us: int, turns: int, epoch_us: int = 0) -> Column:
    return turn(us, period_us * turns, epoch_us)


def combine(parts: list[DataFrame], metas: list[ObsMeta] | None = None) -> DataFrame:
    """Folds of the same shape, added; with their metadata, only of signals that may be combined."""
    if metas and any(not metas[0].combinable(m) for m in metas[1:]):
        raise ValueError("the signals differ in more than time")
    keys = [c for c in parts[0].columns if c not in ("total", "hits")]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("hits").alias("hits"))


def drop_short(profiles: DataFrame, expected: int, least: float = 0.9) -> DataFrame:
    """Sub-integrations with fewer hits than a share of those expected go."""
    whole = profiles.groupBy("division").agg(F.sum("hits").alias("n")).filter(F.col("n") >= least * expected).select("division")
    return profiles.join(whole, "division", "left_semi")


def profile(folded: DataFrame) -> DataFrame:
    return folded.withColumn("mean", F.col("total") / F.col("hits"))


def cyclic_fold(s: Signal, period_us: int, nbin: int, nlag: int, epoch_us: int = 0, products: int = 2) -> DataFrame:
    """ichan, ipol, ibin, lag, re, im, hits: x(t) conj(x(t + lag)) folded at the middle of its two samples.

    products is 1 for the sum of two polarizations, 2 for each of its own, 4 for these and, as polarizations 2 and 3, p(t) conj(q(t + lag)) and
    q(t) conj(p(t + lag)). Blocks of time carry a halo of nlag - 1 samples, so that lags meet inside a block.
    """
    if products not in (1, 2, 4) or products != 2 and s.meta.npol != 2:
        raise ValueError("products are 1, 2 or 4, of two polarizations unless 2")
    size = max(16 * nlag, 1024)
    b = F.expr(f"idat div {size}")
    halo = F.when((F.col("idat") % size < nlag - 1) & (F.col("idat") >= size), F.array(b - 1, b)).otherwise(F.array(b))
    if products == 4:
        each = lambda c, p: F.max(F.when(F.col("ipol") == p, F.col(c))).alias(f"{c}{p}")
        values = ["re0", "im0", "re1", "im1"]
        rows = s.df.groupBy("idat", "ichan").agg(*(each(c, p) for p in (0, 1) for c in ("re", "im"))).withColumn("ipol", F.lit(0))
        made = [(0, "0", "0"), (1, "1", "1"), (2, "0", "1"), (3, "1", "0")]
    else:
        values, rows, made = ["re", "im"], s.df, [(None, "", "")]
    rows = rows.select("idat", "ichan", "ipol", *values, F.explode(halo).alias("b"))
    series = rows.groupBy("ichan", "ipol", "b").agg(F.array_sort(F.collect_list(F.struct("idat", *values))).alias("x"))
    pairs = series.select("ichan", "ipol", F.explode(lag_pairs("x", nlag, size)).alias("p")).select("ichan", "ipol", "p.*")
    lag = (F.col("o.idat") - F.col("e.idat")).cast("int")
    us = F.lit(s.meta.start_us) + F.round((F.col("e.idat") + F.col("o.idat") + 1) * (0.5e6 / s.meta.rate)).cast("long")
    e, o = (lambda side: lambda c, k: F.col(f"{side}.{c}{k}"))("e"), (lambda side: lambda c, k: F.col(f"{side}.{c}{k}"))("o")
    product = lambda p, i, j: F.struct((F.col("ipol") * (0 if products == 1 else 1) if p is None else F.lit(p)).alias("ipol"), (e("re", i) * o("re", j) + e("im", i) * o("im", j)).alias("re"), (e("im", i) * o("re", j) - e("re", i) * o("im", j)).alias("im"))
    found = pairs.select("ichan", lag.alias("lag"), phase_bin(us, period_us, nbin, epoch_us).alias("ibin"), F.explode(F.array(*(product(*m) for m in made))).alias("c"))
    return found.groupBy("ichan", "c.ipol", "ibin", "lag").agg(F.sum("c.re").alias("re"), F.sum("c.im").alias("im"), F.count(F.lit(1)).alias("hits"))


def cyclic_spectrum(folded: DataFrame, nlag: int) -> DataFrame:
    """ichan, ipol, ibin, ifreq, power: the spectrum of 2 nlag - 2 points of each bin's normalised lags (Hermitian)."""
    n = 2 * nlag - 2
    k = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ifreq"))
    angle = F.col("ifreq") * F.col("lag") * F.lit(2 * 3.141592653589793 / n)
    twice = F.when((F.col("lag") == 0) | (F.col("lag") == nlag - 1), 1).otherwise(2)
    term = twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)) / F.col("hits")
    return k.groupBy("ichan", "ipol", "ibin", "ifreq").agg(F.sum(term).alias("power"))
