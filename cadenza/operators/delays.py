"""Integer sample delays by channel and polarization."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.response import dispersion_delay
from cadenza.meta import Signal


def dispersion_delays(s: Signal, dm: float | None = None) -> list[tuple[int, int]]:
    """(ichan, delay): samples behind the centre frequency, to the nearest one."""
    dm = s.meta.dm if dm is None else dm
    reference = dispersion_delay(dm, s.meta.centre_frequency)
    return [(i, int((dispersion_delay(dm, s.meta.frequency(i)) - reference) * s.meta.rate // 1 + (((dispersion_delay(dm, s.meta.frequency(i)) - reference) * s.meta.rate) % 1 >= 0.5))) for i in range(s.meta.nchan)]


def sample_delay(s: Signal, delays: list[tuple[int, ...]]) -> Signal:
    """Takes each channel's sample idat + delay to idat; the output has the samples that all have.

    delays are (ichan, delay), for both polarizations alike, or (ichan, ipol, delay); they count from the smallest. They are one number a channel and
    polarization, looked up in a literal: no join, no shuffle.
    """
    npol = s.meta.npol
    each = [(i, p, d) for i, *at, d in delays for p in (at or range(npol))]
    base = min(d for *_, d in each)
    shift = [0] * (s.meta.nchan * npol)
    for i, p, d in each:
        shift[i * npol + p] = d - base
    n = max(0, s.meta.ndat - max(shift))
    at = F.col("idat") - F.element_at(F.array(*(F.lit(x).cast("long") for x in shift)), F.col("ichan") * npol + F.col("ipol") + 1)
    df = s.df.withColumn("idat", at).filter(F.col("idat").between(0, n - 1))
    return s.then("sample_delay", df, s.carry("delay", shift, s.meta.nchan, npol, n), ndat=n)
