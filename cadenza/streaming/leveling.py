"""The level-setting loop on a stream: statistics wait in state until an integration is whole, then new settings come out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.meta import ObsMeta, Signal
from cadenza.operators.leveling import DIGITIZER, SETTINGS, Loop, Target, by_part, digitizers

PARTIAL = "recorder long, block long, ichan int, ipol int, idim int, rows long, n long, mean double, m2 double"
HELD = "iteration long, done boolean, setting boolean, far boolean, gain array<double>, level array<double>, next long, skip long, tn array<long>, tmean array<double>, tm2 array<double>, blocks array<long>, rows array<long>, n array<long>, mean array<double>, m2 array<double>"


def merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and sums of squared deviations of two sets of samples together."""
    n = a[0] + b[0]
    apart, whole = b[1] - a[1], np.maximum(n, 1)
    return n, a[1] + apart * b[0] / whole, a[2] + b[2] + apart**2 * a[0] * b[0] / whole


def partial_sums(samples: DataFrame, block: int) -> DataFrame:
    """Statistics by block of samples and digitizer of what each Arrow batch holds: all that is shuffled. Rows with weight 0 are counted, not summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(block=pdf["idat"] // block, used=pdf["weight"] != 0)
            by = ["recorder", "block", *DIGITIZER]
            rows = pdf.groupby(by)["v"].size().rename("rows")
            some = pdf[pdf["used"]].groupby(by)["v"].agg(n="size", mean="mean", m2=lambda v: float(((v - v.mean()) ** 2).sum()))
            yield rows.to_frame().join(some).fillna({"n": 0, "mean": 0.0, "m2": 0.0}).astype({"n": "int64"}).reset_index()

    return samples.mapInPandas(run, PARTIAL)


def streaming_level_setting(samples: DataFrame, meta: ObsMeta, integrate: int, block: int, target: Target = Target(), settle: int = 0) -> DataFrame:
    """Settings of samples(idat, ichan, ipol, v or re and im; recorder and weight where there are some), as SETTINGS with the recorder first.

    An integration takes whole blocks of ``block`` samples, in order, until the first digitizer has ``integrate`` samples with weight; the ``settle`` blocks
    behind it are left out, as a device takes time to follow. Blocks may come in any order and in parts: one is taken when all its samples are there and the
    one before has been taken. A block that was taken before raises. What a recorder keeps is the sums of the integration and of blocks not taken yet; after
    the loop has ended it keeps the last settings, and samples pass by. A last block or integration that is not whole waits.
    """
    s = Signal(samples, meta)
    keys = digitizers(s)
    count, of_block = len(keys), len(keys) * block
    fill = {"recorder": F.lit(0).cast("long"), "weight": F.lit(1)}
    rows = by_part(s, samples.withColumns({c: v for c, v in fill.items() if c not in samples.columns}))
    rows = rows.select(F.col("recorder").cast("long").alias("recorder"), "idat", *(F.col(c).cast("int").alias(c) for c in DIGITIZER), F.col("v").cast("double").alias("v"), F.coalesce(F.col("weight"), F.lit(0)).alias("weight"))
    zeros = lambda: (np.zeros(count, dtype=np.int64), np.zeros(count), np.zeros(count))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            *loop_held, after, skip, tn, tmean, tm2, blocks, seen, n, mean, m2 = state.get
        else:
            loop_held, after, skip, (tn, tmean, tm2), blocks, seen, n, mean, m2 = None, 0, 0, zeros(), [], [], [], [], []
        loop, total = Loop(count, target, loop_held), (np.array(tn, dtype=np.int64), np.array(tmean), np.array(tm2))
        split = lambda x, k: np.array(x[k * count : (k + 1) * count])
        waiting = {b: [seen[k], (split(n, k).astype(np.int64), split(mean, k), split(m2, k))] for k, b in enumerate(blocks)}
        out = []
        for pdf in batches:
            if loop.done or not len(pdf):
                continue
            if (pdf["block"] < after).any():
                raise ValueError(f"recorder {key[0]}: samples are late or repeated")
            at = pd.MultiIndex.from_frame(keys).get_indexer(pd.MultiIndex.from_frame(pdf[list(DIGITIZER)]))
            for i, (b, r) in enumerate(zip(pdf["block"].tolist(), pdf["rows"].tolist())):
                one = waiting.setdefault(b, [0, zeros()])
                one[0] += r
                part = zeros()
                for full, c in zip(part, ("n", "mean", "m2")):
                    full[at[i]] = pdf[c].iloc[i]
                one[1] = merged(one[1], part)
        while not loop.done and after in waiting and waiting[after][0] == of_block:
            sums = waiting.pop(after)[1]
            total = merged(total, sums) if after >= skip else total
            after += 1
            if total[0][0] >= integrate:
                out.append(loop.step(after * block, keys, *total))
                total, skip = zeros(), after + settle
        if loop.done:
            waiting, total = {}, zeros()
        order = sorted(waiting)
        flat = lambda i: [x for b in order for x in waiting[b][1][i].tolist()]
        state.update((*loop.held(), after, skip, *(x.tolist() for x in total), order, [waiting[b][0] for b in order], flat(0), flat(1), flat(2)))
        if out:
            yield pd.concat(out).assign(recorder=key[0])

    return partial_sums(rows, block).groupBy("recorder").applyInPandasWithState(step, f"recorder long, {SETTINGS}", HELD, "append", "NoTimeout")
