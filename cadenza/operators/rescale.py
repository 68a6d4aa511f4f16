"""Normalisation by mean and deviation or by median and absolute deviation, by channel and polarization."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.meta import Signal
from cadenza.operators.blocks import looking_back, lower_median

KEYS = ("ichan", "ipol")


def _interval(s: Signal, nsample: int | None) -> DataFrame:
    return s.df.withColumn("iv", F.expr(f"idat div {nsample}") if nsample else F.lit(0).cast("long"))


def mean_std(s: Signal, nsample: int | None = None) -> DataFrame:
    """Offset and scale of each interval: minus the mean, and one over the population deviation (1 where that is 0)."""
    a = _interval(s, nsample).groupBy("iv", *KEYS).agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    return a.select("iv", *KEYS, (-F.col("m")).alias("offset"), F.when(F.col("var") > 0, 1 / F.sqrt("var")).otherwise(1.0).alias("scale"))


def median_mad(s: Signal, nsample: int | None = None, scale_factor: float = 1.4826) -> DataFrame:
    """Offset minus the lower median, scale from the median absolute deviation (1 where that is 0).

    Intervals are gathered for their medians; without them, a whole channel's medians come from histograms.
    """
    rows, by = _interval(s, nsample), ("iv", *KEYS)
    if nsample:
        middle = lambda df, c, name: df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(name))
    else:
        middle = lambda df, c, name: lower_median(df, by, c).withColumnRenamed("median", name)
    med = middle(rows, "v", "med")
    dev = rows.join(med, list(by)).withColumn("d", F.abs(F.col("v") - F.col("med")))
    mad = middle(dev, "d", "mad").join(med, list(by))
    return mad.select("iv", *KEYS, (-F.col("med")).alias("offset"), F.when(F.col("mad") > 0, 1 / (F.col("mad") * scale_factor)).otherwise(1.0).alias("scale"))


def rescale(s: Signal, method=mean_std, nsample: int | None = None) -> Signal:
    """(v + offset) * scale. With nsample None one scale holds for all; else each interval has its own.

    Scales are one row an interval, channel and polarization, joined on those keys (Spark broadcasts them while they are small).
    """
    rows = _interval(s, nsample).join(method(s, nsample), ["iv", *KEYS])
    return s.then("rescale", rows.select("idat", *KEYS, ((F.col("v") + F.col("offset")) * F.col("scale")).alias("v")), scale=1.0)


def write_scales(scales: DataFrame, path: str) -> None:
    """Offsets and scales of mean_std() or median_mad() as Parquet, a folder an interval."""
    scales.write.mode("overwrite").partitionBy("iv").parquet(path)


def constant_rescale(s: Signal, method=mean_std, nsample: int = 1) -> Signal:
    """The first interval's offset and scale hold for all samples."""
    first = method(Signal(s.df.filter(F.col("idat") < nsample), s.meta)).drop("iv")
    rows = s.df.join(F.broadcast(first), list(KEYS))
    return s.then("rescale", rows.select("idat", *KEYS, ((F.col("v") + F.col("offset")) * F.col("scale")).alias("v")), scale=1.0)


def _decayed(v: np.ndarray, keep: float, start: float) -> np.ndarray:
    """b(t) = keep b(t-1) + (1 - keep) v(t), by runs of samples: a triangular matrix of powers serves all runs, and only their ends are chained."""
    run = min(64, len(v))
    powers = keep ** np.arange(1, run + 1)
    lags = np.subtract.outer(np.arange(run), np.arange(run))
    matrix = np.where(lags >= 0, (1 - keep) * keep ** np.maximum(lags, 0), 0.0)
    whole = np.append(v, np.zeros(-len(v) % run)).reshape(-1, run) @ matrix.T
    at, begun = start, np.empty(len(whole))
    for k, end in enumerate(whole[:, -1].tolist()):
        begun[k] = at
        at = at * powers[-1] + end
    return (whole + begun[:, None] * powers).ravel()[: len(v)]


SUMMARY = "ichan int, ipol int, b long, first double, end double, factor double"


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """start of each block, in order, and end and factor of them all as one block."""
    pdf = pdf.sort_values("b")
    at, starts, factor = float(pdf["start"].iloc[0]), [], 1.0
    for end, f in zip(pdf["end"], pdf["factor"]):
        starts.append(at)
        at, factor = at * f + end, factor * f
    return pdf.assign(start=starts, through=at, whole=factor)


def baseline_decay(s: Signal, decay: float, size: int = 4096) -> Signal:
    """Subtracts an exponentially decaying baseline b(t) = b(t-1) + (v(t) - b(t-1)) / decay, b(0) = v(0), of each channel and polarization.

    The recurrence is linear, so it is an affine map a block of ``size`` samples (its end value for a zero start, and a factor). Maps of ``size`` blocks are
    composed into one, these few are chained by channel, then the blocks within each, and then all blocks run at once.
    """
    keep = 1 - 1 / decay
    rows = s.df.withColumn("b", F.expr(f"idat div {size}"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("idat")["v"].to_numpy(dtype=float)
        return pd.DataFrame({"ichan": [pdf["ichan"].iloc[0]], "ipol": [pdf["ipol"].iloc[0]], "b": [pdf["b"].iloc[0]], "first": [v[0]], "end": [_decayed(v, keep, 0.0)[-1]], "factor": [keep ** len(v)]})

    summary = rows.groupBy(*KEYS, "b").applyInPandas(ends, SUMMARY).withColumn("sb", F.expr(f"b div {size}"))

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _chained(pdf.assign(start=0.0)).iloc[:1]
        return pd.DataFrame({"ichan": out["ichan"], "ipol": out["ipol"], "sb": out["sb"], "first": out["first"], "end": out["through"], "factor": out["whole"]})

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sb").rename(columns={"sb": "b"})
        return _chained(pdf.assign(start=float(pdf["first"].iloc[0]))).rename(columns={"b": "sb", "start": "begun"})[["ichan", "ipol", "sb", "begun"]]

    above = summary.groupBy(*KEYS, "sb").applyInPandas(composed, SUMMARY.replace("b long", "sb long"))
    begun = above.groupBy(*KEYS).applyInPandas(begin, "ichan int, ipol int, sb long, begun double")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        return _chained(pdf.assign(start=pdf["begun"]))[["ichan", "ipol", "b", "start"]]

    started = summary.join(begun, [*KEYS, "sb"]).groupBy(*KEYS, "sb").applyInPandas(starts, "ichan int, ipol int, b long, start double")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idat")
        v = pdf["v"].to_numpy(dtype=float)
        return pdf.assign(v=v - _decayed(v, keep, float(pdf["start"].iloc[0])))[["idat", "ichan", "ipol", "v"]]

    df = rows.join(started, [*KEYS, "b"]).groupBy(*KEYS, "b").applyInPandas(apply, "idat long, ichan int, ipol int, v double")
    return s.then("baseline_decay", df)


def running_mean(s: Signal, width: int) -> Signal:
    """Mean of the last ``width`` samples of each channel and polarization."""
    return s.then("running_mean", looking_back(s.df, "idat", width - 1, KEYS, {"v": F.avg("v")}))
