"""Phase predictors in time and frequency: by stretches of time, sums of products of Chebyshev polynomials.

A segment gives phase = turns + sum of coeffs[i][j] T_i(x) T_j(y), x the time from -1 at its start to 1 at its end, y the frequency from -1 at f_low to 1 at
f_high. The whole turns stay a whole number, so phases lose no digits however long the series. Evaluation is Clenshaw's recurrence on columns; a fit sums its
normal equations in the tasks and solves them by segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.response import dispersion_delay
from cadenza.operators import folding

SCHEMA = "segment long, start_us long, length_us long, f_low double, f_high double, turns long, coeffs array<array<double>>"


def clenshaw(coeffs: Column, x: Column) -> Column:
    """Sum of coeffs[n] T_n(x), from the last term to the first; 0 of no terms."""
    step = lambda acc, c: F.struct((c + 2 * x * acc["a"] - acc["b"]).alias("a"), acc["a"].alias("b"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(F.reverse(coeffs), zero, step, lambda acc: acc["a"] - x * acc["b"])


def _unit(value: Column, low: Column, high: Column) -> Column:
    return 2 * (value - low) / (high - low) - 1


def predicted(df: DataFrame, us: Column, mhz: Column, segments: DataFrame, start_us: int, length_us: int, broadcast_rows: int = 10_000) -> DataFrame:
    """df with turn and phase (in [0, 1)), for folding.fold_predicted(). Times outside all segments go; so do frequencies outside a segment's band."""
    few = segments.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = df.withColumns({"__us": us, "__mhz": mhz}).withColumn("segment", folding.turn(F.col("__us"), length_us, start_us))
    rows = rows.join(F.broadcast(segments) if few else segments, "segment").filter(F.col("__mhz").between(F.col("f_low"), F.col("f_high")))
    x = 2 * (F.col("__us") - F.col("start_us")) / F.col("length_us") - 1
    rows = rows.withColumns({"__x": x, "__y": _unit(F.col("__mhz"), F.col("f_low"), F.col("f_high"))})
    by_time = F.transform("coeffs", lambda row: clenshaw(row, F.col("__y")))
    rows = rows.withColumn("__by_time", by_time).withColumn("__whole", clenshaw(F.col("__by_time"), F.col("__x")))
    rows = rows.withColumns({"turn": F.col("turns") + F.floor("__whole"), "phase": F.col("__whole") - F.floor("__whole")})
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), "turn", "phase")


def fit(samples: DataFrame, start_us: int, length_us: int, f_low: float, f_high: float, ntime: int, nfreq: int) -> DataFrame:
    """Segments fitted to samples(us, mhz, turn, phase) by least squares; a segment with fewer samples than coefficients is left out.

    A task adds up the products of the basis for each of its segments; only these sums shuffle, (ntime nfreq)**2 numbers a segment and task at most.
    """
    n = ntime * nfreq
    rows = samples.select("us", "mhz", "turn", "phase").withColumn("segment", folding.turn(F.col("us"), length_us, start_us))
    rows = rows.join(rows.groupBy("segment").agg(F.min("turn").alias("turns")), "segment")
    rows = rows.select("segment", "turns", (2 * (F.col("us") - start_us - F.col("segment") * length_us) / length_us - 1).alias("x"), _unit(F.col("mhz"), F.lit(f_low), F.lit(f_high)).alias("y"), (F.col("turn") - F.col("turns") + F.col("phase")).alias("z"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            segment, turns, x, y, z = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            each = lambda v, k: np.cos(np.arange(k) * np.arccos(np.clip(v, -1, 1))[:, None])  # noqa: E731  T_0 to T_{k-1}
            basis = np.concatenate([(each(x, ntime)[:, :, None] * each(y, nfreq)[:, None, :]).reshape(len(x), n), z[:, None]], axis=1)
            for k in np.unique(segment):
                own = basis[segment == k]
                key = (int(k), int(turns[segment == k][0]))
                held[key] = held.get(key, 0) + np.vstack([own.T @ own, np.full((1, n + 1), len(own))])
        for (k, whole), m in held.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(flat.size, k)), pa.array(np.full(flat.size, whole)), pa.array(np.arange(flat.size)), pa.array(flat)], ["segment", "turns", "at", "s"])

    def solve(part: pa.Table) -> pa.Table:
        m = np.zeros((n + 2) * (n + 1))
        m[part["at"].to_numpy()] = part["s"].to_numpy()
        m = m.reshape(n + 2, n + 1)
        k = part["segment"][0].as_py()
        keep = m[-1, 0] >= n
        c = np.linalg.lstsq(m[:n, :n], m[:n, n], rcond=None)[0].reshape(ntime, nfreq).tolist()
        columns = ([k], [start_us + k * length_us], [length_us], [f_low], [f_high], [part["turns"][0].as_py()], [c])
        table = pa.table(dict(zip(("segment", "start_us", "length_us", "f_low", "f_high", "turns", "coeffs"), columns)))
        return table if keep else table.slice(0, 0)

    total = rows.mapInArrow(sums, "segment long, turns long, at long, s double").groupBy("segment", "turns", "at").agg(F.sum("s").alias("s"))
    return total.groupBy("segment").applyInArrow(solve, SCHEMA)


def generate(spark: SparkSession, polynomials: tuple[DataFrame, int, int], dm: float, start_us: int, length_us: int, segments: int, f_low: float, f_high: float, ntime: int = 12, nfreq: int = 4) -> DataFrame:
    """A predictor over a band from one at infinite frequency (functions.predictor.table()): the phase at a time and frequency is that of the time less the
    dispersion delay, taken at Chebyshev nodes and fitted. Nodes whose delayed time no polynomial covers are left out."""
    node = lambda k, n: (F.cos(math.pi * (k + 0.5) / n) + 1) / 2
    many, fine = 2 * ntime, 2 * nfreq
    at = spark.range(segments * many * fine).select(F.col("id"), F.expr(f"id div {many * fine}").alias("k"), F.expr(f"id div {fine} % {many}").alias("i"), (F.col("id") % fine).alias("j"))
    nodes = at.select("id", (F.col("k") * length_us + start_us + F.round(node(F.col("i"), many) * (length_us - 1))).cast("long").alias("us"), (f_low + node(F.col("j"), fine) * (f_high - f_low)).alias("mhz"))
    late = dispersion_delay(dm, 1.0) * 1e6 / (F.col("mhz") * F.col("mhz"))
    # the delay's fraction of a microsecond is met by going between two whole ones
    both = nodes.withColumns({"late": late}).withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("__at", (F.col("us") - F.floor("late") - F.col("d")).cast("long"))
    table, first, length = polynomials
    seen = folding.predicted(both, F.col("__at"), table, first, length)
    pair = seen.groupBy("id", "us", "mhz", "late").pivot("d", [0, 1]).agg(F.first(F.struct("turn", "phase")))
    step = F.col("1.turn") - F.col("0.turn") + F.col("1.phase") - F.col("0.phase")
    whole = F.col("0.phase") + step * (F.col("late") - F.floor("late"))
    exact = pair.filter("`0` IS NOT NULL AND `1` IS NOT NULL").select("us", "mhz", (F.col("0.turn") + F.floor(whole)).alias("turn"), (whole - F.floor(whole)).alias("phase"))
    return fit(exact, start_us, length_us, f_low, f_high, ntime, nfreq)
