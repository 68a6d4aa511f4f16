"""Concatenation and resizing of whole signals, on a table longer than the smallest."""

import pytest

from cadenza.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect()
    return [(i // 8, i // 2 % 4, i % 2, round(v * 100)) for i, v in rows]


def test_serial_concat_joins_two_whole_signals(spark, samples):
    n = len(samples) // 8
    got = sorted(map(tuple, QUERIES["serial_concat"](spark, SF).collect()))
    assert got == sorted(samples + [(t + n, c, p, v + 1) for t, c, p, v in samples])


def test_resize_cuts_the_end_of_the_whole_signal(spark, samples):
    n = len(samples) // 8
    assert sorted(map(tuple, QUERIES["resize"](spark, SF).collect())) == sorted(x for x in samples if x[0] < n - 37)
