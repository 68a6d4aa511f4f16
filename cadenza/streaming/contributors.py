"""Sub-integrations to which several contributors add: each comes out when all have passed it, or when a timer gives up waiting.

Contributors (recorders, bands, readers of interleaved blocks) see the stream each in its own order of divisions. A division is complete when every
contributor has sent something of a later one, or has ended. What comes after a division was given out, late or of a contributor that was given up, makes a
further, partial record of it, so every sample is in exactly one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEFORE, ENDED = -(1 << 62), 1 << 62  # progress of a contributor that has sent nothing yet, and of one that has ended
OUT = "division long, part long, ichan int, ipol int, ibin long, total double, hits long"
HELD = "progress array<long>, given array<long>, numbers array<long>, bins array<long>, totals array<double>, hits array<long>"


def streaming_contributions(samples: DataFrame, contributors: int, period_us: int, nbin: int, length_us: int, epoch_us: int = 0, patience_ms: int | None = None, remembered: int = 4096) -> DataFrame:
    """Folds samples(contributor from 0, us, ichan, ipol, v) by divisions of length_us: division, part, ichan, ipol, ibin, total, hits.

    A row without us says that its contributor has ended for its channel and polarization: when all have, nothing is left in state. With patience_ms
    a channel that hears nothing for so long gives out what it holds; such a query never ends by itself. The state of a channel is its open
    divisions, a few bins each, a number a contributor, and how often each of the last ``remembered`` divisions was given out.
    """
    if contributors < 1:
        raise ValueError("there is a contributor at least")

    def given_out(key: tuple, whole: pd.DataFrame, parts: dict[int, int]) -> pd.DataFrame:
        part = whole["division"].map(lambda d: parts.get(d, 0))
        for d in whole["division"].unique().tolist():
            parts[d] = parts.get(d, 0) + 1
        return pd.DataFrame({"division": whole["division"], "part": part, "ichan": key[0], "ipol": key[1], "ibin": whole["ibin"], "total": whole["total"], "hits": whole["hits"]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        progress, given, *bins = state.get if state.exists else ([BEFORE] * contributors, [], [], [], [], [])
        progress, parts = list(progress), dict(zip(given[::2], given[1::2]))
        held = pd.DataFrame(dict(zip(("division", "ibin", "total", "hits"), map(list, bins))))
        late = patience_ms is not None and state.hasTimedOut
        if not late:
            rows = pd.concat([b for b in batches if len(b)])
            if not rows["contributor"].between(0, contributors - 1).all():
                raise ValueError(f"contributors are numbered from 0 to {contributors - 1}")
            for c in rows.loc[rows["us"].isna(), "contributor"].unique().tolist():
                progress[c] = ENDED
            rows = rows[rows["us"].notna()]
            since = rows["us"].to_numpy(dtype=np.int64) - epoch_us
            fresh = pd.DataFrame({"division": since // length_us, "ibin": since % period_us * nbin // period_us, "total": rows["v"].to_numpy(dtype=float), "hits": 1})
            for c, d in fresh["division"].groupby(rows["contributor"].to_numpy()).max().items():
                progress[c] = max(progress[c], int(d))
            held = pd.concat([held, fresh])
        whole = held.astype({"division": "int64", "ibin": "int64", "total": "float64", "hits": "int64"}).groupby(["division", "ibin"], as_index=False).sum()
        done = np.ones(len(whole), dtype=bool) if late else (whole["division"] < min(progress)).to_numpy()
        if done.any():
            yield given_out(key, whole[done], parts)
        kept = whole[~done]
        newest = max(parts, default=0)
        if min(progress) == ENDED:
            state.remove()
            return
        state.update((progress, [x for d, n in sorted(parts.items()) if d > newest - remembered for x in (d, n)], *(kept[c].tolist() for c in ("division", "ibin", "total", "hits"))))
        if patience_ms is not None and len(kept):
            state.setTimeoutDuration(patience_ms)

    rows = samples.select("ichan", "ipol", F.col("contributor").cast("int").alias("contributor"), F.col("us").cast("long").alias("us"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("ichan", "ipol").applyInPandasWithState(step, OUT, HELD, "append", "NoTimeout" if patience_ms is None else "ProcessingTimeTimeout")
