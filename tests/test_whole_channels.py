"""The kurtosis detector over whole channels, against brute force."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.sk_limits import limits
from cadenza.operators import kurtosis
from cadenza.queries import QUERIES, SK_M


def brute(events):
    """ichan: bad, by exact sums over every whole block."""
    samples = len(events) // 8 // SK_M * SK_M
    sums = defaultdict(lambda: [0, 0, 0])
    for i, value in events:
        v = round(value * 100)
        if v and i // 8 < samples:
            t = sums[i // 2 % 4, i % 2]
            t[0], t[1], t[2] = t[0] + v, t[1] + v * v, t[2] + 1
    cut = limits(max(t[2] for t in sums.values()), 3.0)
    bad = defaultdict(int)
    for (chan, _), (s1, s2, n) in sums.items():
        sk = Fraction(n + 1, n - 1) * (Fraction(n * s2, s1 * s1) - 1)
        bad[chan] |= not cut.lower <= sk <= cut.upper
    return dict(bad)


def test_interference_late_in_a_channel_is_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    value = (rng.exponential(50, 8 * 640) + 0.01).round(2)
    at = np.arange(len(value))
    value[(at // 2 % 4 == 2) & (at // 8 >= 200) & (at // 8 < 230)] *= 30
    events = list(zip(at.tolist(), value.tolist()))
    spark.createDataFrame(events, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = dict(map(tuple, QUERIES["sk_freq"](spark, str(tmp_path)).collect()))
    assert got == brute(events) == {0: 0, 1: 0, 2: 1, 3: 0}


def test_channels_of_the_larger_table(spark):
    d = "/root/testdata/sf0.01"
    events = [tuple(r) for r in spark.read.parquet(f"{d}/events.parquet").select("event_id", "value").collect()]
    assert dict(map(tuple, QUERIES["sk_freq"](spark, d).collect())) == brute(events)


def test_long_channels_do_not_overflow(spark):
    n, s1, s2 = 10**8, 5 * 10**11, 5 * 10**15
    row = spark.range(1).select(*(F.lit(x).cast("long").alias(k) for k, x in (("n", n), ("s1", s1), ("s2", s2))))
    sk = row.select(kurtosis.estimate(F.col("s1"), F.col("s2"), F.col("n"))).first()[0]
    assert sk == pytest.approx((n + 1) / (n - 1) * (n * s2 / s1**2 - 1))
