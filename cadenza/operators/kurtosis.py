"""Spectral kurtosis: sums by block, estimators, three detectors, several resolutions, and excision."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.sk_limits import limits
from cadenza.meta import Signal

CELL = ("iw", "ichan", "ipol")


def sums(s: Signal, m: int, skip_zero: bool = True) -> DataFrame:
    """S1, S2 and the number of valid samples of each block of m; only whole blocks."""
    rows = s.df.filter("v <> 0") if skip_zero else s.df
    whole = s.meta.ndat // m * m
    return rows.filter(F.col("idat") < whole).groupBy(F.expr(f"idat div {m}").alias("iw"), "ichan", "ipol").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count(F.lit(1)).alias("n"))


def coarser(fine: DataFrame, factor: int, overlap: int = 1) -> DataFrame:
    """Sums of ``factor`` blocks; with overlap > 1 a block starts every factor / overlap."""
    if factor % overlap:
        raise ValueError("the overlap divides the factor")
    step = factor // overlap
    last = F.expr(f"iw div {step}")
    first = F.greatest(F.lit(0).cast("long"), last - (overlap - 1))
    rows = fine.withColumn("iw", F.explode(F.sequence(first, last)) if overlap > 1 else last)
    return rows.groupBy(*CELL).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))


def estimate(s1: Column, s2: Column, n: Column, nd: int = 1) -> Column:
    """(n Nd + 1) / (n - 1) * (n S2 / S1^2 - 1); null below two samples or without power."""
    value = (n * nd + 1) / (n - 1) * (n.cast("double") * s2 / (s1.cast("double") * s1) - 1)
    return F.when((n > 1) & (s1 != 0), value)


def within(blocks: DataFrame, include: list[tuple[int, int]] | None = None, exclude: list[tuple[int, int]] | None = None) -> DataFrame:
    """The blocks of channels in one of the included ranges (all without any) and in none of the excluded ones; ends included. Detectors judge and average
    only these."""
    ranged = lambda ranges: reduce(Column.__or__, (F.col("ichan").between(a, b) for a, b in ranges))
    out = blocks.filter(ranged(include)) if include else blocks
    return out.filter(~ranged(exclude)) if exclude else out


def time_freq(blocks: DataFrame, lower: float, upper: float, nd: int = 1) -> DataFrame:
    """iw, ichan, bad: a cell is bad if one of its polarizations is outside the limits."""
    sk = estimate(F.col("s1"), F.col("s2"), F.col("n"), nd)
    return blocks.groupBy("iw", "ichan").agg(F.max(F.coalesce((sk < lower) | (sk > upper), F.lit(True)).cast("int")).alias("bad"))


def freq(blocks: DataFrame, sigma: float, nd: int = 1) -> DataFrame:
    """ichan, bad by the kurtosis of whole channels, each against the thresholds of its own number of samples, computed once a distinct number."""
    total = blocks.groupBy("ichan", "ipol").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [limits(n, sigma, nd) for n in pdf["n"]]
            yield pdf.assign(lower=[c.lower for c in found], upper=[c.upper for c in found])

    known = total.filter("n > 1").select("n").distinct().mapInPandas(cuts, "n long, lower double, upper double")
    sk = estimate(F.col("s1"), F.col("s2"), F.col("n"), nd)
    good = F.coalesce(sk.between(F.col("lower"), F.col("upper")), F.lit(False))
    return total.join(known, "n", "left").groupBy("ichan").agg(F.max((~good).cast("int")).alias("bad"))


def time(blocks: DataFrame, reach: float, nd: int = 1) -> DataFrame:
    """iw, bad by the mean over channels, against 1 +/- reach / sqrt(effective number of channels); weights are the valid counts (Kish)."""
    sk = blocks.withColumn("sk", estimate(F.col("s1"), F.col("s2"), F.col("n"), nd)).filter("sk IS NOT NULL")
    mean = sk.groupBy("iw", "ipol").agg((F.sum(F.col("sk") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("n_eff"))
    return mean.groupBy("iw").agg(F.max((F.abs(F.col("mean") - 1) > F.lit(reach) / F.sqrt("n_eff")).cast("int")).alias("bad"))


def excise(s: Signal, mask: DataFrame, m: int, keys: tuple[str, ...] = ("iw", "ichan")) -> Signal:
    """Zeroes the samples of bad cells; the mask has one row a cell, m samples each."""
    rows = s.df.withColumn("iw", F.expr(f"idat div {m}")).join(mask.filter("bad = 1").select(*keys, "bad"), list(keys), "left")
    v = F.when(F.col("bad") == 1, F.lit(0)).otherwise(F.col("v")).cast(dict(s.df.dtypes)["v"])
    return s.then("excise", rows.select("idat", "ichan", "ipol", v.alias("v")))


@dataclass(frozen=True)
class Resolution:
    """M samples a block, of which ``overlap`` start within each M; ranges of channels as in within()."""

    m: int
    overlap: int = 1
    include: tuple[tuple[int, int], ...] = ()
    exclude: tuple[tuple[int, int], ...] = ()


def parse_config(text: str) -> list[Resolution]:
    """Resolutions of a configuration in JSON, or YAML where a parser is installed: one or a list of M, overlap, include and exclude; a range is a pair or a
    list of pairs, ends included."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    pairs = lambda x: tuple(tuple(map(int, r)) for r in (x if x and isinstance(x[0], (list, tuple)) else [x] if x else []))
    out = []
    for one in found if isinstance(found, list) else [found]:
        if "M" not in one:
            raise ValueError("a resolution has no M")
        out.append(Resolution(int(one["M"]), int(one.get("overlap", 1)), pairs(one.get("include")), pairs(one.get("exclude"))))
    return out


def adaptive(s: Signal, resolutions: list[int | Resolution], sigma: float = 5.0, nd: int = 1, omit_outliers: bool = True) -> DataFrame:
    """iw (of the finest step), ichan, bad: united masks of the resolutions, from the finest up; with omit_outliers cells that a finer one
    found are left out of the coarser sums. A step is the finest distance between the starts of blocks."""
    chosen = sorted((Resolution(r) if isinstance(r, int) else r for r in resolutions), key=lambda r: r.m)
    finest = min(r.m // r.overlap for r in chosen)
    if any(r.m % r.overlap or r.m // r.overlap % finest or r.m % finest for r in chosen):
        raise ValueError("blocks and their distances are multiples of the finest distance")
    blocks, found = sums(s, finest), None
    for r in chosen:
        factor, now = r.m // finest, within(blocks, list(r.include), list(r.exclude))
        if found is not None and omit_outliers:
            now = now.join(found, ["iw", "ichan"], "left_anti")
        now = coarser(now, factor, r.overlap) if factor > 1 else now
        cut = limits(r.m, sigma, nd)
        bad = time_freq(now, cut.lower, cut.upper, nd).filter("bad = 1").select("iw", "ichan")
        if factor > 1:
            first = F.col("iw") * (factor // r.overlap)
            bad = bad.select(F.explode(F.sequence(first, first + factor - 1)).alias("iw"), "ichan").distinct()
        found = bad if found is None else found.unionByName(bad).distinct()
    return found.withColumn("bad", F.lit(1))


def zap_weight(blocks: DataFrame, lower: float, upper: float, mega_lower: float, mega_upper: float, most: int = 30) -> DataFrame:
    """Cells outside the limits are bad; a block with more than ``most`` channels outside the wider ones is bad in all channels."""
    sk = blocks.withColumn("sk", estimate(F.col("s1"), F.col("s2"), F.col("n")))
    cell = sk.groupBy("iw", "ichan").agg(F.max((~F.col("sk").between(lower, upper)).cast("int")).alias("out"), F.max((~F.col("sk").between(mega_lower, mega_upper)).cast("int")).alias("mega"))
    whole = cell.groupBy("iw").agg((F.sum("mega") > most).alias("all"))
    return cell.join(whole, "iw").select("iw", "ichan", F.when(F.col("all"), 1).otherwise(F.coalesce("out", F.lit(1))).alias("bad"))
