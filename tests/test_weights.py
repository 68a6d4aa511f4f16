"""Weights that travel with a signal: rules against plain loops, and against weights applied to the samples first."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import weights as rules
from cadenza.meta import ANALYTIC, NYQUIST, PPQQ, ObsMeta, Signal
from cadenza.operators import delays, detection, digitize, folding, frames, integration, masking, selection


def made(spark, rng, ndat=200, nchan=3, npol=2, per=16, offset=0, voltages=False, bad=0.2):
    rows = [(t, c, p, int(rng.integers(1, 50)), int(rng.integers(1, 50))) for t in range(ndat) for c in range(nchan) for p in range(npol)]
    df = spark.createDataFrame(rows, "idat long, ichan int, ipol int, re int, im int")
    meta = ObsMeta(nchan=nchan, npol=npol, ndat=ndat, rate=1000.0, centre_frequency=1400.0, bandwidth=nchan * 1.0, state=ANALYTIC if voltages else PPQQ)
    df = df if voltages else df.select("idat", "ichan", "ipol", F.col("re").alias("v"))
    table = {(k, c, p): 0 if rng.random() < bad else int(rng.integers(1, 9)) for k in range(-(-(ndat + offset) // per)) for c in range(nchan) for p in range(npol)}
    w = spark.createDataFrame([(*k, v) for k, v in table.items()], "iw long, ichan int, ipol int, weight int")
    return Signal(df, meta).with_weights(w, per, offset=offset), table


def by_sample(s):
    return {(r.idat, r.ichan, r.ipol): r.weight for r in s.weighed().select("idat", "ichan", "ipol", "weight").collect()}


def mean(values):
    return 0 if 0 in values else sum(values) // len(values)


def one_after_the_other(w, ndat, nfft, step, per):
    """Blocks are flagged as the transforms are gone through in turn, those of one only after the next has been judged."""
    w, flag = list(w), range(0)
    if per >= nfft or ndat < nfft:
        return w
    for start in range(0, (ndat + step - nfft) // step * step, step):
        read = range(start // per, math.ceil((start + nfft) / per))
        bad = any(w[k] == 0 for k in read)
        for k in flag:
            w[k] = 0
        flag = range(start // per, math.ceil((start + step) / per)) if bad else range(0)
    for k in flag:
        w[k] = 0
    return w


@pytest.mark.parametrize(("per", "nfft", "step"), [(16, 64, 48), (16, 64, 16), (5, 64, 40), (7, 32, 32), (1, 8, 5), (64, 64, 48), (100, 64, 48), (16, 500, 16)])
def test_convolved_weights_as_in_turn(spark, per, nfft, step):
    rng = np.random.default_rng(per * nfft + step)
    for ndat in (400, 331):
        n = -(-ndat // per)
        table = {(c, p): [0 if rng.random() < 0.06 else int(rng.integers(1, 9)) for _ in range(n)] for c in range(2) for p in range(2)}
        df = spark.createDataFrame([(k, c, p, x) for (c, p), xs in table.items() for k, x in enumerate(xs)], "iw long, ichan int, ipol int, weight int")
        got = {(r.ichan, r.ipol, r.iw): r.weight for r in masking.convolve_weights(df, nfft, step, per, ndat).collect()}
        assert got == {(c, p, k): x for (c, p), xs in table.items() for k, x in enumerate(one_after_the_other(xs, ndat, nfft, step, per))}


@pytest.mark.parametrize(("n", "per", "want"), [(3, 1, ([4, 0, 7], 1)), (3, 2, ([4, 0, 7], 1)), (2, 4, ([3, 4, 5, 1, 0, 9, 7], 2)), (4, 4, ([3, 4, 5, 1, 0, 9, 7], 1)), (10, 1, ([0], 1)), (7, 1, ([0], 1)), (4, 1, ([3, 0], 1))])
def test_scrunched_weights_keep_the_tail(spark, n, per, want):
    df = spark.createDataFrame([(k, 0, 0, x) for k, x in enumerate([3, 4, 5, 1, 0, 9, 7])], "iw long, ichan int, ipol int, weight int")
    out, per_out = masking.scrunch_weights(df, n, per)
    assert ([r.weight for r in out.orderBy("iw").collect()], per_out) == want


def test_selection_and_cuts(spark):
    s, _ = made(spark, np.random.default_rng(1), offset=5)
    before = by_sample(s)
    assert by_sample(selection.chan_pol_select(s, (1, 2), (1, 1))) == {(t, c - 1, 0): w for (t, c, p), w in before.items() if c >= 1 and p == 1}
    assert by_sample(selection.poln_select(s, 0)) == {k: w for k, w in before.items() if k[2] == 0}
    assert by_sample(selection.channel_order(s, [2, 0, 1])) == {(t, [2, 0, 1][c], p): w for (t, c, p), w in before.items()}
    late = selection.delay_start(s, 43_000)
    assert by_sample(late) == {(t - 43, c, p): w for (t, c, p), w in before.items() if t >= 43}
    short = selection.chomp(late, 50)
    assert by_sample(short) == {(t - 43, c, p): w for (t, c, p), w in before.items() if 43 <= t < 93}
    assert short.weights.df.count() == short.weights.blocks(50) * 6


def test_sums(spark):
    s, _ = made(spark, np.random.default_rng(2), ndat=205, nchan=5, offset=3)
    before = by_sample(s)
    for factor in (2, 6, 16, 40):
        got = by_sample(integration.tscrunch(s, factor))
        assert got == {(t, c, p): mean([before[t * factor + k, c, p] for k in range(factor)]) for t in range(205 // factor) for c in range(5) for p in range(2)}
    got = by_sample(integration.fscrunch(s, 2))
    assert got == {(t, c, p): mean([before[t, 2 * c, p], before[t, 2 * c + 1, p]]) for t in range(205) for c in range(2) for p in range(2)}
    got = by_sample(integration.pscrunch(s))
    assert got == {(t, c, 0): mean([before[t, c, 0], before[t, c, 1]]) for t in range(205) for c in range(5)}
    other, _ = made(spark, np.random.default_rng(3), ndat=205, nchan=5, offset=3)
    theirs = by_sample(other)
    assert by_sample(integration.superpose([s, other])) == {k: mean([w, theirs[k]]) for k, w in before.items()}


def test_delays(spark):
    s, _ = made(spark, np.random.default_rng(4), offset=7)
    before = by_sample(s)
    shift = {0: 0, 1: 21, 2: 5}
    got = by_sample(delays.sample_delay(s, list(shift.items())))
    for (t, c, p), w in got.items():
        block = [before[u + shift[c], c, p] for u in range(t // 16 * 16, min(179, t // 16 * 16 + 16))]
        assert w == mean(block)
    assert len(got) == 179 * 6


def test_detection_shares_weights_among_products(spark):
    s, _ = made(spark, np.random.default_rng(5), voltages=True)
    before = by_sample(s)
    both = {(t, c): mean([before[t, c, 0], before[t, c, 1]]) for t, c, _ in before}
    assert by_sample(detection.detect(s)) == {(t, c, 0): w for (t, c), w in both.items()}
    stokes = detection.detect(s, "Stokes")
    assert by_sample(stokes) == {(t, c, p): w for (t, c), w in both.items() for p in range(4)}
    assert by_sample(selection.chan_pol_select(stokes, (1, 2), (2, 3))) == {(t, c - 1, p): w for (t, c), w in both.items() if c for p in range(2)}


def test_transforms(spark):
    s, table = made(spark, np.random.default_rng(6), voltages=True, bad=0.1)
    flagged = {(c, p): one_after_the_other([table[k, c, p] for k in range(13)], 200, 64, 40, 16) for c in range(3) for p in range(2)}
    out = frames.channelize(s, 8, freq_res=8, pos=1, neg=2)
    assert by_sample(out) == {(t, c, p): flagged[c // 8, p][t * 8 // 16] for t in range(20) for c in range(24) for p in range(2)}
    some = selection.chan_pol_select(out, (10, 17), (0, 0))
    assert by_sample(some) == {(t, c - 10, 0): flagged[c // 8, 0][t * 8 // 16] for t in range(20) for c in range(10, 18)}
    power = frames.power_filterbank(s, 8, sum_pols=True, freq_res=8, pos=1, neg=2)
    assert by_sample(power) == {(t, c, 0): mean([flagged[c // 8, p][t * 8 // 16] for p in range(2)]) for t in range(20) for c in range(24)}
    shifted = frames.convolve(s, lambda i: np.ones(64), 64, 8, 16)
    assert by_sample(shifted) == {(t, c, p): flagged[c, p][t // 16] for t in range(160) for c in range(3) for p in range(2)}


def test_real_samples_and_synthesis(spark):
    rng = np.random.default_rng(7)
    s, table = made(spark, rng, nchan=4, npol=1, ndat=256, bad=0.08)
    real = Signal(s.df, s.meta.but(state=NYQUIST), s.weights)
    flagged = {c: one_after_the_other([table[k, c, 0] for k in range(16)], 256, 64, 64, 16) for c in range(4)}
    assert by_sample(frames.channelize(real, 32)) == {(t, c, 0): mean([flagged[c // 32][t * 4 + k] for k in range(4)]) for t in range(4) for c in range(128)}
    s, table = made(spark, rng, nchan=4, npol=1, ndat=256, voltages=True, bad=0.03)
    merged = one_after_the_other([mean([table[k, c, 0] for c in range(4)]) for k in range(16)], 256, 32, 24, 16)
    out = frames.inverse_filterbank(s, 32, 4)
    assert by_sample(out) == {(t, 0, 0): merged[t // 64] for t in range(out.meta.ndat)}


def test_fold_skips_bad_samples_by_channel(spark):
    s, _ = made(spark, np.random.default_rng(8))
    got = {(r.ichan, r.ipol, r.ibin): (r.total, r.hits) for r in folding.fold_signal(s, 32_000, 8).collect()}
    zeroed = folding.fold_signal(masking.apply_weights(s).without_weights(), 32_000, 8, zeroed=True)
    assert got == {(r.ichan, r.ipol, r.ibin): (r.total, r.hits) for r in zeroed.collect() if r.hits}


def test_shared_weights(spark):
    """One weight for all channels and polarizations, spread only where they part."""
    s, _ = made(spark, np.random.default_rng(9))
    one = s.weights.df.filter("ichan = 0 AND ipol = 0")
    s = s.with_weights(one, 16, chans=3, pols=2)
    w = {r.iw: r.weight for r in one.collect()}
    want = lambda t: w[t // 16]
    assert by_sample(s) == {(t, c, p): want(t) for t in range(200) for c in range(3) for p in range(2)}
    assert by_sample(selection.chan_pol_select(s, (2, 2), (1, 1))) == {(t, 0, 0): want(t) for t in range(200)}
    assert by_sample(integration.fscrunch(selection.chan_pol_select(s, (1, 2)), 2)) == {(t, 0, p): want(t) for t in range(200) for p in range(2)}


def test_an_operator_without_a_rule_refuses(spark):
    s, _ = made(spark, np.random.default_rng(10))
    with pytest.raises(ValueError, match="no rule for weights"):
        integration.serial([s, Signal(s.df, s.meta.but(start_us=200_000))])
    assert digitize.digitize(s, 8).weights is s.weights
    with pytest.raises(ValueError, match="has no weights"):
        s.without_weights().weighed()
    with pytest.raises(ValueError):
        rules.Weights(s.df, 0)
