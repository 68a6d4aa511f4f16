"""Structured Streaming versions of the windowed operators.

Of ``streaming_fold`` a sub-integration is complete when the watermark has passed its end, and later samples are dropped; ``streaming_turns`` gives
what comes late as a second, partial record of its division.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.folding import phase_bin


def streaming_fold(samples: DataFrame, period_us: int, nbin: int, seconds: int, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Folds samples(ts timestamp, ichan, ipol, v) by sub-integrations of ``seconds``: start, ichan, ipol, ibin, total, hits."""
    us = F.unix_micros(F.col(time))
    rows = samples.withWatermark(time, late)
    by = [F.window(time, f"{seconds} seconds").alias("w"), "ichan", "ipol", phase_bin(us, period_us, nbin).alias("ibin")]
    return rows.groupBy(*by).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("hits")).select(F.col("w.start").alias("start"), "ichan", "ipol", "ibin", "total", "hits")


def streaming_levels(samples: DataFrame, seconds: int, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Mean and population variance of each channel and polarization by window."""
    rows = samples.withWatermark(time, late)
    agg = rows.groupBy(F.window(time, f"{seconds} seconds").alias("w"), "ichan", "ipol").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    return agg.select(F.col("w.start").alias("start"), "ichan", "ipol", "n", "mean", "variance")


def streaming_bandpass(samples: DataFrame, seconds: int, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Power of each channel and polarization of detected samples, summed over windows of ``seconds``."""
    rows = samples.withWatermark(time, late)
    agg = rows.groupBy(F.window(time, f"{seconds} seconds").alias("w"), "ichan", "ipol").agg(F.sum("v").alias("power"), F.count("v").alias("n"))
    return agg.select(F.col("w.start").alias("start"), "ichan", "ipol", "power", "n")


def streaming_scrunch(samples: DataFrame, factor: int, stride: int | None = None) -> DataFrame:
    """Sums (double) of ``factor`` consecutive samples of each channel and polarization, as they arrive; the tail waits in state for the next batch.

    The state of a channel is its last sample's number, how many samples the sum holds so far, that sum, and the number of the next output. A
    channel's samples come in order across batches; one that is late or repeated raises, and where ``stride``, their distance, is given also one that is
    missing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, held, total, first = state.get if state.exists else (None, 0, 0.0, 0)
        rows = pd.concat([b for b in batches if len(b)]).sort_values("idat")
        at, v = rows["idat"].to_numpy(), rows["v"].to_numpy(dtype=float)
        steps = np.diff(at if before is None else np.append(before, at))
        if (steps != stride if stride else steps < 1).any():
            raise ValueError(f"channel {key[0]}, polarization {key[1]}: samples are missing, repeated or late")
        places = np.arange(held, held + len(v)) // factor
        sums = np.bincount(places, v)
        sums[0] += total
        whole = (held + len(v)) // factor
        rest = float(sums[whole]) if whole < len(sums) else 0.0
        state.update((int(at[-1]), held + len(v) - whole * factor, rest, first + whole))
        yield pd.DataFrame({"idat": first + np.arange(whole), "ichan": key[0], "ipol": key[1], "v": sums[:whole]})

    return samples.groupBy("ichan", "ipol").applyInPandasWithState(step, "idat long, ichan int, ipol int, v double", "before long, held long, total double, first long", "append", "NoTimeout")


def streaming_turns(samples: DataFrame, period_us: int, nbin: int, turns: int, patience: int = 1, epoch_us: int = 0, remembered: int = 4096) -> DataFrame:
    """Folds samples(us, ichan, ipol, v) by sub-integrations of ``turns`` turns: division, part, ichan, ipol, ibin, total, hits.

    A division is given out when samples of the division ``patience`` after it have come to its channel. Samples that come later still make a second, partial
    record of it (part 1, 2, ...), which adds to the first: nothing is dropped. The state of a channel is its open divisions, a few bins each, and how
    often each of the last ``remembered`` divisions was given out: what comes later than that is numbered from 1 again.
    """
    length = period_us * turns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest, given, numbers, bins, totals, hits = (x if not isinstance(x, list) else list(x) for x in state.get) if state.exists else (-(1 << 62), [], [], [], [], [])
        rows = pd.concat([b for b in batches if len(b)])
        since = rows["us"].to_numpy() - epoch_us
        fresh = pd.DataFrame({"division": since // length, "ibin": since % period_us * nbin // period_us, "total": rows["v"].to_numpy(dtype=float), "hits": 1})
        held = pd.DataFrame({"division": numbers, "ibin": bins, "total": totals, "hits": hits})
        whole = pd.concat([held, fresh]).astype({"division": "int64", "ibin": "int64", "hits": "int64"}).groupby(["division", "ibin"], as_index=False).sum()
        newest = max(newest, int(fresh["division"].max()))
        done = whole[whole["division"] <= newest - patience]
        parts = dict(zip(given[::2], given[1::2]))
        part = done["division"].map(lambda d: parts.get(d, 0 if d > newest - remembered else 1))
        yield pd.DataFrame({"division": done["division"], "part": part, "ichan": key[0], "ipol": key[1], "ibin": done["ibin"], "total": done["total"], "hits": done["hits"]})
        for d in done["division"].unique().tolist():
            parts[d] = parts.get(d, 0) + 1
        kept = whole[whole["division"] > newest - patience]
        state.update((newest, [x for pair in sorted(parts.items()) if pair[0] > newest - remembered for x in pair], kept["division"].tolist(), kept["ibin"].tolist(), kept["total"].tolist(), kept["hits"].tolist()))

    out = "division long, part long, ichan int, ipol int, ibin long, total double, hits long"
    held = "newest long, given array<long>, numbers array<long>, bins array<long>, totals array<double>, hits array<long>"
    return samples.groupBy("ichan", "ipol").applyInPandasWithState(step, out, held, "append", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is available now into Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
