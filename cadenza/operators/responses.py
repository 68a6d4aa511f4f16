"""Responses that change with time and channel, as tables, and the as-of join that finds the one in force.

A table of responses has a row an epoch and channel: epoch (sample from which it holds), ichan, and arrays re and im of its points, in FFT order. A part of a
signal takes the last response that starts at or before the part's first sample, or its channel's first one where none does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.response import interpolated
from cadenza.meta import ANALYTIC, Signal
from cadenza.operators import frames

BUCKET = 1 << 16  # samples of a stretch of time whose epochs stand together


def as_of(left: DataFrame, right: DataFrame, at: str, epoch: str, keys: tuple[str, ...], last: int, bucket: int = BUCKET) -> DataFrame:
    """left with column ``epoch``: by keys the greatest value of right's not above left's column ``at`` (0 to last), or else the least.

    Both sides know their bucket of time, so they meet in an equi-join on it. What a bucket takes over from earlier ones is found from one row a bucket that
    has epochs, and handed to the empty buckets behind it: a window holds a key's buckets with epochs, never its rows.
    """
    of = lambda c: F.expr(f"{c} div {bucket}")
    known = right.select(*keys, F.col(epoch).cast("long").alias("__e"))
    # the first one also stands before all buckets, from where it is handed on
    first = known.groupBy(*keys).agg(F.min("__e").alias("__e")).withColumn("__b", F.lit(-1).cast("long"))
    inside = known.filter(F.col("__e") <= last).withColumn("__b", F.when(F.col("__e") < 0, F.lit(-1).cast("long")).otherwise(of("__e"))).unionByName(first)
    summary = inside.groupBy(*keys, "__b").agg(F.array_sort(F.collect_set("__e")).alias("__es"))
    w = Window.partitionBy(*keys).orderBy("__b")
    summary = summary.withColumns({"__before": F.element_at(F.lag("__es").over(w), -1), "__next": F.coalesce(F.lead("__b").over(w), F.lit(last // bucket + 1))})
    # a bucket with epochs and the empty ones behind it
    spread = summary.withColumn("__at", F.explode(F.sequence("__b", F.col("__next") - 1)))
    own = F.col("__at") == F.col("__b")
    spread = spread.select(*keys, F.col("__at").alias("__b"), F.when(own, F.col("__es")).alias("__es"), F.when(own, F.col("__before")).otherwise(F.element_at("__es", -1)).alias("__before"))
    rows = left.withColumn("__b", of(at)).join(spread, [*keys, "__b"], "left")
    found = F.array_max(F.filter("__es", lambda e: e <= F.col(at)))
    return rows.withColumn(epoch, F.coalesce(found, F.col("__before"))).drop("__b", "__es", "__before")


def respond(s: Signal, responses: DataFrame, nfft: int, pos: int = 0, neg: int = 0, bucket: int = BUCKET) -> Signal:
    """Overlap-save convolution of complex samples with the response in force at each part; pos samples at the start and neg at the end go.

    Responses of fewer than nfft points, as many in all rows, are interpolated by zero-padding their impulse responses. Points of four values each, the rows
    of a matrix one after the other, act on two polarizations together. The table may be of any size: it meets the parts in joins on channel, bucket and epoch.
    """
    if s.meta.state != ANALYTIC:
        raise ValueError("responses act on complex samples")
    step = nfft - pos - neg
    if step <= 0:
        raise ValueError("the transform is not longer than its wrap-around")
    matrix = s.meta.npol == 2 and "element" in responses.columns
    table = responses.select("epoch", "ichan", *(["element"] if matrix else []), F.col("re").cast("array<double>").alias("h_re"), F.col("im").cast("array<double>").alias("h_im"))
    if matrix:  # four rows an epoch become one
        cell = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("element", "h_re", "h_im"))), lambda x: x[c])).alias(c)
        table = table.groupBy("epoch", "ichan").agg(cell("h_re"), cell("h_im"))
    parts = frames.to_frames(s, nfft, step, keys=("ichan",) if matrix else ("ichan", "ipol")).withColumn("start", F.col("ipart") * step)
    parts = as_of(parts, table, "start", "epoch", ("ichan",), max(0, s.meta.ndat - 1), bucket).join(table, ["ichan", "epoch"]).drop("start", "epoch")

    def one(k: frames.Columns, x: np.ndarray) -> list[np.ndarray]:
        h = k["h_re"] + 1j * k["h_im"]
        at = k["ipart"] * step + np.arange(step)
        if not matrix:
            y = np.fft.ifft(np.fft.fft(x) * interpolated(h, nfft))[:, pos : nfft - neg]
            return [at, k["ichan"], k["ipol"], y.real, y.imag]
        h = interpolated(h.reshape(len(h), 2, 2, -1), nfft)
        y = np.fft.ifft(np.einsum("rijn,rnj->rni", h, np.fft.fft(x.reshape(len(x), nfft, 2), axis=1)), axis=1)[:, pos : nfft - neg]
        return [at[:, :, None], k["ichan"][:, :, None], np.arange(2), y.real, y.imag]

    ndat = frames.n_parts(s.meta.ndat, nfft, step) * step
    weights = s.carry("over_pols", s.meta.nchan, 2, 2) if matrix else s.weights
    weights = weights and weights.transform(s.meta.ndat, nfft, step, 1, ndat)
    return s.then("respond", frames.map_frames(parts, one, frames.SAMPLE), weights, ndat=ndat, start_us=s.meta.start_us + round(pos / s.meta.rate * 1e6))
