"""Weights that travel with a signal, and the rule by which each kind of operator carries them.

A weight holds for a block of samples of one or several neighbouring channels and polarizations; 0 marks bad data. The table has a row
a block, so it is smaller than the samples by the block's length; rules join, group or shift that table, and samples are only
touched where a consumer leaves bad ones out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("iw", "ichan", "ipol", "weight")


def merged(total: Column, samples: Column) -> Column:
    """0 if one is 0, else their integer mean."""
    return F.when(F.min("weight") == 0, F.lit(0).cast("long")).otherwise(F.floor(total / samples)).cast("long").alias("weight")


@dataclass(frozen=True)
class Weights:
    """df has iw, ichan, ipol, weight. Sample idat of channel c and polarization p has the weight of block (idat + offset) div per, of channel
    (c + chan_offset) div chans and polarization (p + pol_offset) div pols of the table."""

    df: DataFrame
    per: int
    offset: int = 0
    chans: int = 1
    pols: int = 1
    chan_offset: int = 0
    pol_offset: int = 0

    def __post_init__(self):
        if self.per < 1 or self.chans < 1 or self.pols < 1 or not 0 <= self.offset:
            raise ValueError("blocks have a sample, a channel and a polarization at least")

    def blocks(self, ndat: int) -> int:
        """How many blocks a signal of so many samples has."""
        return -(-(ndat + self.offset) // self.per)

    def keys(self, idat: Column, ichan: Column, ipol: Column) -> dict[str, Column]:
        div = lambda c, more, n: c if n == 1 and not more else ((c + more - F.pmod(c + more, F.lit(n))) / n)
        return {"iw": div(idat, self.offset, self.per).cast("long"), "ichan": div(ichan, self.chan_offset, self.chans).cast("int"), "ipol": div(ipol, self.pol_offset, self.pols).cast("int")}

    def each(self, nchan: int, npol: int) -> Weights:
        """The same weights, a row for each channel and polarization of the signal."""
        if self.chans == self.pols == 1 and not self.chan_offset and not self.pol_offset:
            return self
        spread = lambda c, n, more, most: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) * n - more), F.least(F.lit(most - 1), F.col(c) * n + (n - 1 - more))).cast("array<int>"))
        inside = lambda c, n, more, most: (F.col(c) * n + (n - 1 - more) >= 0) & (F.col(c) * n - more < most)
        df = self.df.filter(inside("ichan", self.chans, self.chan_offset, nchan) & inside("ipol", self.pols, self.pol_offset, npol))
        df = df.withColumn("ichan", spread("ichan", self.chans, self.chan_offset, nchan)).withColumn("ipol", spread("ipol", self.pols, self.pol_offset, npol))
        return Weights(df.select(*COLUMNS), self.per, self.offset)

    # --- selection -------------------------------------------------------------------------------------------------------

    def select(self, chan: tuple[int, int], pol: tuple[int, int]) -> Weights:
        """Of the channels and polarizations from the first to the last of each pair, numbered anew."""
        (c0, c1), (p0, p1) = [((a + more) // n, (b + more) // n) for (a, b), more, n in ((chan, self.chan_offset, self.chans), (pol, self.pol_offset, self.pols))]
        df = self.df.filter(F.col("ichan").between(c0, c1) & F.col("ipol").between(p0, p1))
        df = df.select("iw", (F.col("ichan") - c0).alias("ichan"), (F.col("ipol") - p0).alias("ipol"), "weight")
        return replace(self, df=df, chan_offset=(chan[0] + self.chan_offset) % self.chans, pol_offset=(pol[0] + self.pol_offset) % self.pols)

    def reorder(self, order: Sequence[int], npol: int) -> Weights:
        """Of channel i at channel order[i]."""
        w = self.each(len(order), npol)
        return replace(w, df=w.df.withColumn("ichan", F.element_at(F.array(*map(F.lit, order)), F.col("ichan") + 1)))

    def first(self, ndat: int) -> Weights:
        return replace(self, df=self.df.filter(F.col("iw") < self.blocks(ndat)))

    def after(self, samples: int) -> Weights:
        """Of what follows the first samples."""
        gone, offset = divmod(samples + self.offset, self.per)
        return replace(self, df=self.df.filter(F.col("iw") >= gone).withColumn("iw", F.col("iw") - gone), offset=offset)

    # --- sums ------------------------------------------------------------------------------------------------------------

    def scrunch(self, time: int, ndat: int) -> Weights:
        """Of sums of ``time`` samples, ndat of them in all. Where blocks hold whole sums they stay; else each sum gets the mean, by samples, of
        the blocks that it touches, and 0 if one of them is 0."""
        if time == 1:
            return self
        if self.per % time == 0 and self.offset % time == 0:
            return replace(self, per=self.per // time, offset=self.offset // time)
        low, high = F.col("iw") * self.per - self.offset, F.col("iw") * self.per + (self.per - 1 - self.offset)
        low, high = F.greatest(F.lit(0).cast("long"), low), F.least(F.lit(ndat * time - 1).cast("long"), high)
        rows = self.df.select(*COLUMNS, low.alias("low"), high.alias("high")).filter("low <= high")
        rows = rows.withColumn("at", F.explode(F.sequence(F.expr(f"low div {time}"), F.expr(f"high div {time}"))))
        n = F.least("high", F.col("at") * time + (time - 1)) - F.greatest("low", F.col("at") * time) + 1
        df = rows.groupBy(F.col("at").alias("iw"), "ichan", "ipol").agg(merged(F.sum(F.col("weight") * n), F.sum(n)))
        return replace(self, df=df, per=1, offset=0)

    def merge(self, chans: int, pols: int, nchan: int, npol: int) -> Weights:
        """Of sums of neighbouring channels and polarizations, from a signal of nchan and npol ones."""
        if chans == pols == 1:
            return self
        w = self.each(nchan, npol)
        whole = w.df.filter((F.col("ichan") < nchan // chans * chans) & (F.col("ipol") < npol // pols * pols))
        df = whole.groupBy("iw", F.expr(f"ichan div {chans}").cast("int").alias("ichan"), F.expr(f"ipol div {pols}").cast("int").alias("ipol")).agg(merged(F.sum("weight"), F.count(F.lit(1))))
        return Weights(df, w.per, w.offset)

    def over_pols(self, nchan: int, npol: int, out: int) -> Weights:
        """Of products of all polarizations: the same for each of ``out`` ones."""
        return replace(self.merge(1, npol, nchan, npol), pols=out)

    def add(self, other: Weights, nchan: int, npol: int) -> Weights:
        """Of the sum of two signals: 0 if one is 0, else half their sum."""
        if (self.per, self.offset) != (other.per, other.offset):
            raise ValueError("the blocks of the two signals differ")
        rows = self.each(nchan, npol).df.unionByName(other.each(nchan, npol).df)
        return Weights(rows.groupBy("iw", "ichan", "ipol").agg(merged(F.sum("weight"), F.count(F.lit(1)))), self.per, self.offset)

    # --- delays and transforms -------------------------------------------------------------------------------------------

    def delay(self, shift: Sequence[int], nchan: int, npol: int, ndat: int) -> Weights:
        """Of signals whose sample idat + shift[channel * npol + polarization] moves to idat: blocks of the same length from the new start on, 0
        if one of the two that a block falls on is 0, else the mean by samples."""
        w = self.each(nchan, npol)
        moved = F.element_at(F.array(*(F.lit(x).cast("long") for x in shift)), F.col("ichan") * npol + F.col("ipol") + 1) + w.offset
        low, high = F.col("iw") * w.per - moved, F.col("iw") * w.per - moved + (w.per - 1)
        rows = w.df.select(*COLUMNS, F.greatest(F.lit(0).cast("long"), low).alias("low"), F.least(F.lit(ndat - 1).cast("long"), high).alias("high")).filter("low <= high")
        rows = rows.withColumn("at", F.explode(F.sequence(F.expr(f"low div {w.per}"), F.expr(f"high div {w.per}"))))
        n = F.least("high", F.col("at") * w.per + (w.per - 1)) - F.greatest("low", F.col("at") * w.per) + 1
        return Weights(rows.groupBy(F.col("at").alias("iw"), "ichan", "ipol").agg(merged(F.sum(F.col("weight") * n), F.sum(n))), w.per)

    def convolve(self, ndat: int, nfft: int, step: int) -> Weights:
        """Of transforms of nfft samples every step: all blocks that hold what is kept of a transform are bad if one that it reads is."""
        return replace(self, df=convolve(self.df, ndat, nfft, step, self.per, self.offset))

    def transform(self, ndat: int, nfft: int, step: int, time: int, out: int, chans: int = 1) -> Weights:
        """Of transforms that make one sample of ``time``, ``out`` in all, and ``chans`` channels of each."""
        return replace(self.convolve(ndat, nfft, step).scrunch(time, out), chans=self.chans * chans, chan_offset=self.chan_offset * chans)

    def stretch(self, up: int, down: int) -> Weights:
        """Of up samples for every down ones."""
        if self.per * up % down or self.offset * up % down:
            raise ValueError("blocks are a whole number of new samples")
        return replace(self, per=self.per * up // down, offset=self.offset * up // down)

    # --- use -------------------------------------------------------------------------------------------------------------

    def joined(self, rows: DataFrame, weights: DataFrame, how: str) -> DataFrame:
        keys = self.keys(F.col("idat"), F.col("ichan"), F.col("ipol"))
        rows = rows.withColumns({f"__{k}": c for k, c in keys.items()})
        weights = weights.select(*(F.col(c).alias(f"__{c}" if c != "weight" else c) for c in weights.columns))
        return rows.join(weights, [f"__{k}" for k in keys], how).drop(*(f"__{k}" for k in keys))

    def attach(self, rows: DataFrame) -> DataFrame:
        """Samples with their weights; null where none is known."""
        return self.joined(rows, self.df.select(*COLUMNS), "left")

    def good(self, rows: DataFrame) -> DataFrame:
        """Samples without those of weight 0. Only bad blocks are joined: few, so Spark may send them to the samples."""
        return self.joined(rows, self.df.filter("weight = 0").select("iw", "ichan", "ipol"), "left_anti")


def convolve(weights: DataFrame, ndat: int, nfft: int, step: int, per: int, offset: int = 0) -> DataFrame:
    """weights (iw, ichan, ipol, weight), 0 in all blocks that hold samples [p step, p step + step) of a part p that reads a block of weight 0.

    Parts are those that fit in ndat samples. Blocks of nfft samples or more stay as they are. Parts are judged on the weights given;
    judged one after the other on what earlier ones have left, they come out alike wherever a step is a block long at least.
    """
    parts = (ndat - nfft) // step + 1 if ndat >= nfft else 0
    if per >= nfft or not parts:
        return weights
    # parts that read a bad block, then blocks that these parts keep
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("iw") * per - offset - nfft) / step) + 1)
    high = F.least(F.lit(parts - 1).cast("long"), F.expr(f"(iw * {per} + {per - 1 - offset}) div {step}"))
    bad = weights.filter("weight = 0").select("ichan", "ipol", low.alias("low"), high.alias("high")).filter("low <= high")
    bad = bad.select("ichan", "ipol", F.explode(F.sequence("low", "high")).alias("part")).distinct()
    kept = F.sequence(F.expr(f"(part * {step} + {offset}) div {per}"), F.expr(f"(part * {step} + {step - 1 + offset}) div {per}"))
    hit = bad.select(F.explode(kept).alias("iw"), "ichan", "ipol").distinct().withColumn("__hit", F.lit(True))
    out = weights.join(hit, ["iw", "ichan", "ipol"], "left")
    return out.select("iw", "ichan", "ipol", F.when(F.col("__hit"), 0).otherwise(F.col("weight")).cast(dict(weights.dtypes)["weight"]).alias("weight"))


def scrunch(weights: DataFrame, n: int, per: int = 1) -> tuple[DataFrame, int]:
    """Weights after samples were summed by n, and the new block length. Blocks that hold a sum or more stay, per div n samples long; else n weights make
    one, 0 if one is 0 and else their integer mean, what is left at the end makes one more, and blocks are one sample long."""
    if per >= n:
        return weights, per // n
    df = weights.groupBy(F.expr(f"iw div {n}").alias("iw"), "ichan", "ipol").agg(merged(F.sum("weight"), F.count(F.lit(1))))
    return df, 1
