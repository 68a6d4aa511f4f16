"""Frame operators on streams: what a transform still needs of earlier micro-batches waits in state.

Parts are dealt to lanes, stretches of ``lane_parts`` parts of one channel and polarization, and a lane's samples meet in one group. So a stream of
few channels still spreads over tasks, and neighbouring lanes share no more than the overlap of two parts. In a group, samples may come in any order and
more than once: those in a row from the next part's start on are transformed, those from the part after these on wait. The state of a lane is thus less
than one part and a step of a stream that comes in order, and never more than the lane.

Any cut into micro-batches, and any restart from a checkpoint, gives the rows that the same operator gives of the whole table. A part that never gets
all its samples is left out, as there.

A lane's state goes with its last part. Where gaps leave lanes open for ever, or whole parts may come again, patience_ms keeps a lane, finished or not,
until it has heard nothing for so long; such a query never ends by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.meta import Signal

LANE_PARTS = 256
AT_ONCE = 1 << 20  # samples transformed in one call
TYPES = {"long": np.int64, "int": np.int32, "double": np.float64}


def map_stream(s: Signal, nfft: int, step: int, keys: tuple[str, ...], values: list[str], fn: Callable, schema: str, lane_parts: int = LANE_PARTS, patience_ms: int | None = None) -> DataFrame:
    """fn, as in operators.frames.map_frames(), over the parts of a streaming signal: nfft samples every step."""
    names, types = zip(*((n, TYPES[t]) for n, t in (c.split() for c in schema.split(", "))))
    sizes = {"ichan": s.meta.nchan, "ipol": s.meta.npol}
    rest = [c for c in ("ichan", "ipol") if c not in keys]
    wide = math.prod(sizes[c] for c in rest)  # values of one sample that a part needs together
    place = F.col("idat") * wide
    for k, c in enumerate(rest):
        place = place + F.col(c) * math.prod(sizes[r] for r in rest[k + 1 :])
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("idat") - nfft) / step) + 1)
    high = F.expr(f"idat div {step}")
    rows = s.df.select("idat", *keys, place.cast("long").alias("at"), *(F.col(c).cast("double").alias(c) for c in values), low.alias("low"), high.alias("high")).filter("low <= high")
    rows = rows.withColumn("lane", F.explode(F.sequence(F.expr(f"low div {lane_parts}"), F.expr(f"high div {lane_parts}")))).select("lane", *keys, "at", *values)

    def transformed(key: dict[str, int], parts: np.ndarray, x: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        many = max(1, AT_ONCE // (nfft * wide))
        for k in range(0, len(parts), many):
            own = starts[k : k + many, None]
            of = {"ipart": parts[k : k + many, None]} | {c: np.full(own.shape, v) for c, v in key.items()}
            out = np.broadcast_arrays(*fn(of, x[own + np.arange(nfft * wide)]))
            yield pd.DataFrame({n: a.ravel().astype(t) for n, a, t in zip(names, out, types)})

    def one(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if patience_ms is not None and state.hasTimedOut:
            state.remove()
            return
        lane, *own = (int(k) for k in key)
        parts = np.arange(lane * lane_parts, (lane + 1) * lane_parts)
        done, at, *held = state.get if state.exists else ([], [], *([] for _ in values))
        fresh = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({c: [] for c in ("at", *values)})])
        at = np.concatenate([np.asarray(at, dtype=np.int64), fresh["at"].to_numpy(dtype=np.int64)])
        x = [np.concatenate([np.asarray(h, dtype=np.float64), fresh[c].to_numpy(dtype=np.float64)]) for h, c in zip(held, values)]
        at, first = np.unique(at, return_index=True)
        x = [v[first] for v in x]
        open_ = parts[~np.isin(parts, done)]
        low, high = (np.searchsorted(at, (open_ * step + k) * wide) for k in (0, nfft))
        whole = high - low == nfft * wide
        z = x[0] if len(x) == 1 else x[0] + 1j * x[1]
        yield from transformed(dict(zip(keys, own)), open_[whole], z, low[whole])
        # what parts that are still open read waits; each sample is met by its first and last part
        waits, left = np.zeros(len(at) + 1, dtype=np.int64), ~whole
        np.add.at(waits, low[left], 1)
        np.add.at(waits, high[left], -1)
        waits = np.cumsum(waits)[:-1] > 0
        done = np.setdiff1d(parts, open_[left])
        if patience_ms is None and not left.any():
            state.remove()
            return
        state.update((done.tolist(), at[waits].tolist(), *(v[waits].tolist() for v in x)))
        if patience_ms is not None:
            state.setTimeoutDuration(patience_ms)

    held = ", ".join(["done array<long>", "at array<long>", *(f"{c} array<double>" for c in values)])
    return rows.groupBy("lane", *keys).applyInPandasWithState(one, schema, held, "append", "NoTimeout" if patience_ms is None else "ProcessingTimeTimeout")
