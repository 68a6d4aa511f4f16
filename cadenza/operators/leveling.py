"""Setting gains and levels by feedback, until samples have the mean and variance that a digitizer wants.

Each integration gives the mean and variance of every digitizer (channel, polarization and, of complex samples, part) as its settings have left them. A gain
is multiplied by the root of the wanted over the found variance where they differ by the tolerance or more; a level takes up the mean where that is beyond
its own tolerance and no digitizer so far, in order, is far off. Far off is a variance more than five tolerances away; the loop ends with the first
integration in which none is. Digitizers of one group are judged together. With settings a sample becomes gain x (v - level).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.meta import Signal

FAR = 5  # tolerances
DIGITIZER = ("ichan", "ipol", "idim")
SETTINGS = "iteration long, epoch long, ichan int, ipol int, idim int, n long, mean double, variance double, gain double, level double, far boolean, settled boolean"


@dataclass(frozen=True)
class Target:
    """What the loop works towards: samples of a variance, within tolerances of it and of a mean of zero."""

    variance: float = 1.0
    variance_tolerance: float = 0.01
    mean_tolerance: float = 0.01
    watch: bool = False  # go on when all is well
    most: int = 0  # iterations, any number where 0
    stop_after_good: bool = False  # change nothing any more once a digitizer is well

    def __post_init__(self) -> None:
        if self.variance <= 0 or self.variance_tolerance <= 0:
            raise ValueError("a variance and its tolerance are positive")


def changes(mean: np.ndarray, variance: np.ndarray, target: Target) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factor of the gain, whether the level takes up the mean, far off) of digitizers in order. One without samples or variance is passed over."""
    known = variance > 0
    off = np.where(known, np.abs(variance - target.variance), 0.0)
    far = off > FAR * target.variance_tolerance
    with np.errstate(divide="ignore", over="ignore"):
        factor = np.where(off >= target.variance_tolerance, np.sqrt(target.variance / np.where(known, variance, 1.0)), 1.0)
    usable = np.isfinite(factor)
    trim = known & usable & ~np.logical_or.accumulate(far) & (np.abs(mean) > target.mean_tolerance)
    return np.where(usable, factor, 1.0), trim, far


class Loop:
    """Settings of a group's digitizers, and what has become of the loop. ``held`` is all of it as plain lists, for state."""

    def __init__(self, digitizers: int, target: Target, held: tuple | None = None) -> None:
        self.target = target
        iteration, done, setting, far, gain, level = held or (0, False, True, False, [1.0] * digitizers, [0.0] * digitizers)
        self.iteration, self.done, self.setting, self.far = int(iteration), bool(done), bool(setting), bool(far)
        self.gain, self.level = np.array(gain, dtype=float), np.array(level, dtype=float)

    def held(self) -> tuple:
        return self.iteration, self.done, self.setting, self.far, self.gain.tolist(), self.level.tolist()

    def step(self, epoch: int, keys: pd.DataFrame, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> pd.DataFrame:
        """One integration's statistics of samples without settings; the new settings hold from sample ``epoch`` on."""
        some = n > 0
        variance = np.where(some, self.gain**2 * m2 / np.maximum(n, 1), 0.0)
        found = np.where(some, self.gain * (mean - self.level), 0.0)
        self.iteration += 1
        far = np.zeros(len(n), dtype=bool)
        if self.setting:
            factor, trim, far = changes(found, variance, self.target)
            self.level = np.where(trim, mean, self.level)
            self.gain = self.gain * factor
            self.far = bool(far.any())
            good = (variance > 0) & (np.abs(variance - self.target.variance) < self.target.variance_tolerance)
            self.setting = not (self.target.stop_after_good and good.any())
        self.done = not self.target.watch and not self.far or self.iteration == self.target.most
        out = {"iteration": self.iteration, "epoch": epoch, **{c: keys[c].to_numpy() for c in DIGITIZER}, "n": n, "mean": found, "variance": variance, "gain": self.gain, "level": self.level, "far": far, "settled": not self.far}
        return pd.DataFrame(out)


def digitizers(s: Signal) -> pd.DataFrame:
    """ichan, ipol, idim of a signal's digitizers, in order."""
    at = np.indices((s.meta.nchan, s.meta.npol, s.meta.ndim)).reshape(3, -1)
    return pd.DataFrame(dict(zip(DIGITIZER, at)))


def by_part(s: Signal, rows: DataFrame) -> DataFrame:
    """A row a digitizer and sample: idim and v in place of re and im."""
    if s.meta.ndim == 1:
        return rows.withColumn("idim", F.lit(0))
    kept = [c for c in rows.columns if c not in ("re", "im")]
    parts = F.array(*(F.struct(F.lit(k).alias("idim"), F.col(c).cast("double").alias("v")) for k, c in enumerate(("re", "im"))))
    return rows.select(*kept, F.inline(parts))


def set_levels(s: Signal, integrate: int, target: Target = Target(), together: bool = True) -> DataFrame:
    """Settings by integration of ``integrate`` samples of time, of what is left at the end too. Samples of blocks without weight don't count.

    The samples are summed once, before any exchange; the loop runs over a row an integration and digitizer, of all digitizers together (one is far off, and
    no level after it is touched) or of each for itself, where each is a task's group of its own.
    """
    rows = s.df if s.weights is None else s.weighed().filter("weight <> 0")
    by = [F.expr(f"idat div {integrate}").alias("k"), *DIGITIZER]
    sums = by_part(s, rows).groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    all_of_them, ndat = digitizers(s), s.meta.ndat

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = all_of_them if together else pd.DataFrame([key], columns=list(DIGITIZER))
        number = pd.MultiIndex.from_frame(keys).get_indexer(pd.MultiIndex.from_frame(pdf[list(DIGITIZER)]))
        loop, out = Loop(len(keys), target), []
        order = np.argsort(pdf["k"].to_numpy(), kind="stable")
        ks, starts = np.unique(pdf["k"].to_numpy()[order], return_index=True)
        for k, here in zip(ks.tolist(), np.split(order, starts[1:])):
            n, mean, m2 = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys)), np.zeros(len(keys))
            at = number[here]
            n[at], mean[at] = pdf["n"].to_numpy()[here], pdf["mean"].to_numpy()[here]
            m2[at] = pdf["variance"].to_numpy()[here] * n[at]
            out.append(loop.step(min((k + 1) * integrate, ndat), keys, n, mean, m2))
            if loop.done:
                break
        return pd.concat(out)

    return sums.withColumn("group", F.lit(0)).groupBy(*(["group"] if together else DIGITIZER)).applyInPandas(run, SETTINGS)


def apply_levels(s: Signal, settings: DataFrame, chunk: int) -> Signal:
    """gain x (v - level) with the last settings that hold before each sample; without any, the sample itself. Epochs are multiples of ``chunk`` samples, or
    the signal's end. Settings are spread to a row a chunk and meet the samples in one equi-join."""
    w = Window.partitionBy(*DIGITIZER).orderBy("epoch")
    end = -(-s.meta.ndat // chunk)
    known = settings.filter(F.col("epoch") < s.meta.ndat).select(*DIGITIZER, F.expr(f"epoch div {chunk}").alias("__k"), "gain", "level", F.lead(F.expr(f"epoch div {chunk}"), 1, end).over(w).alias("__next"))
    spread = known.filter("__next > __k").withColumn("__k", F.explode(F.sequence("__k", F.col("__next") - 1))).drop("__next")
    parts = ["v"] if s.meta.ndim == 1 else ["re", "im"]
    value = lambda k, c: F.max(F.when(F.col("idim") == k, F.col(c)))
    wide = spread.groupBy("ichan", "ipol", "__k").agg(*(value(k, c).alias(f"__{c}{k}") for k in range(len(parts)) for c in ("gain", "level")))
    rows = s.df.withColumn("__k", F.expr(f"idat div {chunk}")).join(wide, ["ichan", "ipol", "__k"], "left")

    def set_to(c: str, k: int) -> Column:
        return ((F.col(c) - F.coalesce(f"__level{k}", F.lit(0.0))) * F.coalesce(f"__gain{k}", F.lit(1.0))).alias(c)

    return s.then("apply_levels", rows.select("idat", "ichan", "ipol", *(set_to(c, k) for k, c in enumerate(parts))))
