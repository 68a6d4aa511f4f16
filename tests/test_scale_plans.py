"""Operators that look along time, against plain computations, and their plans: nothing holds a whole channel."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.meta import PPQQ, ObsMeta, Signal
from cadenza.operators import blocks, digitize, masking, rescale


def channel(spark, v, **meta):
    rows = [(i, 0, 0, x) for i, x in enumerate(v)]
    return Signal(spark.createDataFrame(rows, "idat long, ichan int, ipol int, v double"), ObsMeta(nchan=1, npol=1, ndat=len(v), rate=1000.0, state=PPQQ).but(**meta))


def column(df, name="v", by="idat"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(9).normal(size=700).tolist()


def test_running_mean_across_blocks(spark, noise):
    s = channel(spark, noise)
    got = blocks.looking_back(s.df, "idat", 6, ("ichan", "ipol"), {"v": F.avg("v")}, size=96)
    assert column(got) == pytest.approx([np.mean(noise[max(0, i - 6) : i + 1]) for i in range(700)])
    assert got.count() == 700


@pytest.mark.parametrize(("kind", "bins", "rounds"), [("noise", 16, 2), ("ties", 8, 2), ("one", 4, 1), ("noise", 4, 3)])
def test_lower_median_by_histograms(spark, noise, kind, bins, rounds):
    values = {"noise": noise, "ties": [round(x) for x in noise], "one": [4.0] * 9}[kind]
    df = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(values)], "k int, x double")
    got = {r["k"]: r["median"] for r in blocks.lower_median(df, ("k",), "x", bins, rounds).collect()}
    assert got == {k: sorted(values[k::3])[(len(values[k::3]) - 1) // 2] for k in range(3)}


def test_median_scales_of_whole_channels(spark, noise):
    v = np.array(noise)
    offset, scale = rescale.median_mad(channel(spark, noise)).select("offset", "scale").first()
    middle = np.sort(v)[349]
    assert offset == -middle and scale == pytest.approx(1 / (1.4826 * np.sort(np.abs(v - middle))[349]))


@pytest.mark.parametrize("size", [4, 50, 4096])
def test_decay_in_blocks_of_blocks(spark, noise, size):
    b, want = noise[0], []
    for x in noise:
        b += (x - b) / 20
        want.append(x - b)
    assert column(rescale.baseline_decay(channel(spark, noise), 20.0, size).df) == pytest.approx(want)


def test_intervals_are_united_by_bucket(spark, noise):
    rng = np.random.default_rng(2)
    cells = [(int(a), int(a + n)) for a, n in zip(rng.integers(-20, 720, 60), rng.integers(0, 90, 60))]
    got = masking.united(spark.createDataFrame(cells, "start long, end long"), 64, 700).collect()
    inside = {i for a, b in cells for i in range(max(a, 0), min(b, 700))}
    assert {i for r in got for i in range(r["start"], r["end"])} == inside and sum(r["end"] - r["start"] for r in got) == len(inside)
    masked = masking.mask_times(channel(spark, noise), spark.createDataFrame(cells, "start long, end long"), bucket=64)
    assert column(masked.df) == [0.0 if i in inside else x for i, x in enumerate(noise)]


def windows(df):
    """Partition columns of each window and the sort-based gathering of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [set(re.findall(r"([a-z_]+)#\d+L?", part)) for part in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)]


def test_no_window_holds_a_channel(spark, noise):
    s = channel(spark, noise)
    for df, needed in ((rescale.running_mean(s, 5).df, "__block"), (digitize.table_scale_offset(s, 8, 4), "__block"), (masking.united(spark.range(3).selectExpr("id AS start", "id + 2 AS end"), 64, 700), "b")):
        specs = windows(df)
        assert specs and all(needed in spec for spec in specs)
