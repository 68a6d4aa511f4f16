import math

import numpy as np
import pytest

from cadenza.functions import response
from cadenza.functions.sk_limits import inverse_erf, limits, moments


@pytest.mark.parametrize("p", [-0.9973, -0.5, 0.0, 0.1, 0.6827, 0.9999])
def test_inverse_erf(p):
    assert math.erf(inverse_erf(p)) == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("m", [32, 128, 1024])
def test_kurtosis_limits_against_simulation(m):
    rng = np.random.default_rng(m)
    x = rng.exponential(size=(40_000, m))
    sk = (m + 1) / (m - 1) * (m * (x * x).sum(1) / x.sum(1) ** 2 - 1)
    assert sk.var() == pytest.approx(moments(m)[0], rel=0.08)
    cut = limits(m, 2.0)
    assert ((sk < cut.lower).mean(), (sk > cut.upper).mean()) == pytest.approx((0.02275, 0.02275), abs=0.004)


def test_limits_narrow_with_m_and_widen_with_tests():
    assert limits(1024, 3).upper < limits(128, 3).upper < limits(128, 3, ntest=100).upper
    assert limits(40_000, 3).upper - 1 == pytest.approx(3 * math.sqrt(4 / 40_000), rel=1e-6)


def test_tapers():
    assert response.taper("top_hat", 5).tolist() == [1] * 5
    assert np.allclose(response.taper("hanning", 9), np.hanning(9)) and np.allclose(response.taper("bartlett", 9), np.bartlett(9))
    tukey = response.taper("tukey", 16, 4, 2)
    assert tukey[0] == 0 and tukey[-1] == 0 and (tukey[4:14] == 1).all()
    with pytest.raises(ValueError):
        response.taper("none", 4)


def test_dispersion_kernel_is_a_pure_phase_and_delays_grow():
    assert np.allclose(np.abs(response.dispersion_kernel(64, 1400, 100, 30)), 1)
    assert response.dispersion_delay(10, 400) > response.dispersion_delay(10, 1400)
    assert response.best_nfft(100) > 200


def test_products_compose():
    jones, scalar = response.derotation(8, 1400, 100, 30), np.full(8, 2.0)
    back = response.derotation(8, 1400, 100, -30)
    assert np.allclose(response.product([jones, back]), np.eye(2))
    assert np.allclose(response.product([scalar, jones, back]), 2 * np.eye(2))


def test_bandpass_mask_takes_out_a_spike():
    spectrum = 100 + np.random.default_rng(1).normal(size=256)
    spectrum[77] += 50
    good = response.bandpass_mask(spectrum)
    assert good[77] == 0 and good.sum() >= 253


def test_limits_stated_in_the_sql_hold_the_published_density():
    """Tails of the Pearson density of the estimator, integrated on another grid with Simpson's rule."""
    from cadenza import oracle
    from cadenza.functions import sk_limits

    cases = [(32, 3.0, (oracle.SK_LOWER, oracle.SK_UPPER)), *((m, 0.5, pair) for m, pair in oracle.SK_NARROW.items())]
    for m, sigma, (lower, upper) in cases:
        mu2 = 4 * m * m / ((m - 1) * (m + 2) * (m + 3))  # published second moment for single powers
        assert sk_limits.moments(m)[0] == pytest.approx(mu2)
        each = math.erfc(sigma / math.sqrt(2)) / 2
        grid = np.linspace(0.0, 12.0, 400_001)
        y = sk_limits.density(m, 1.0, grid)
        weights = np.where(np.arange(len(grid)) % 2, 4.0, 2.0)
        weights[[0, -1]] = 1.0
        share = y * weights / (y * weights).sum()
        assert share[grid < lower].sum() == pytest.approx(each, rel=2e-3) and share[grid > upper].sum() == pytest.approx(each, rel=2e-3)
    assert oracle.SK_SYMMETRIC == pytest.approx(3 * math.sqrt(4 * 32 * 32 / (31 * 34 * 35)))


def test_bandpass_mask_leaves_the_neighbours_of_a_spike():
    spectrum = np.random.default_rng(1).normal(100, 1, 128)
    spectrum[77] = 1e4
    assert np.flatnonzero(response.bandpass_mask(spectrum) == 0).tolist() == [77]


def test_polynomial_predictor_reads_and_evaluates():
    from cadenza.functions import predictor

    text = """J0437-4715  1-Jan-20  0000.00   58849.50000000000        2.64 -0.1 -6.0
     123456789.250000   173.6879458121843    7   60    6  1400.0
  1.0E-01 2.0D-03 -3.0E-05
  4.0E-07 0.0E+00 0.0E+00
J0437-4715  1-Jan-20  0100.00   58849.54166666667        2.64 -0.1 -6.0
     123457414.500000   173.6879458121843    7   60    3  1400.0
  0.0E+00 0.0E+00 0.0E+00
"""
    a, b = predictor.parse_polyco(text.splitlines())
    assert (a.turns, a.fraction, a.f0, a.span_minutes, len(a.coeffs), len(b.coeffs)) == (123456789, 0.25, 173.6879458121843, 60.0, 6, 3)
    assert a.mid_us == (58849 - 40587) * 86_400_000_000 + 43_200_000_000 and b.mid_us - a.mid_us == pytest.approx(3_600_000_000, abs=1)
    dt = 3.0
    assert a.phase(a.mid_us + 180e6) == pytest.approx(123456789.25 + 60 * a.f0 * dt + 0.1 + 2e-3 * dt - 3e-5 * dt**2 + 4e-7 * dt**3)


def test_predicted_phases_match_the_segments(spark):
    from pyspark.sql import functions as F

    from cadenza.functions import predictor
    from cadenza.operators import folding

    segments = [predictor.Segment(1_000_000_000 + k * 60_000_000, 100 * k, 0.125 * k, 2.5 + k, (0.25, 1e-3, -1e-4), 1.0) for k in range(4)]
    table, start, length = predictor.table(spark, segments)
    times = spark.range(0, 300_000_000, 7_777_777).select((F.col("id") + 950_000_000).alias("us"), F.lit(1).alias("v"))
    got = folding.predicted(times, F.col("us"), table, start, length).collect()
    assert len(got) == sum(start <= u < start + 4 * length for u in range(950_000_000, 1_250_000_000, 7_777_777))
    for r in got:
        s = segments[(r["us"] - start) // length]
        assert 0 <= r["phase"] < 1 and r["turn"] + r["phase"] == pytest.approx(s.phase(r["us"]))
    with pytest.raises(ValueError):
        predictor.table(spark, [segments[0], segments[0]])


def test_responses_in_series_add_what_they_wrap_around():
    a, b = response.Response(np.arange(8) + 1j, 2, 1), response.Response(np.full(8, 2.0), 3, 0)
    c = a * b
    assert np.array_equal(c.points, 2 * a.points) and (c.pos, c.neg) == (5, 1)
    assert np.array_equal(c.fft_order(), np.roll(c.points, -4)) and np.array_equal(c.channel(1, 4).points, c.points[2:4])
    assert np.array_equal(c.decimated(4).points, (c.points[::2] + c.points[1::2]) / 2)
    with pytest.raises(ValueError):
        a * response.Response(np.ones(4))


def test_bins_of_long_periods_are_exact(spark):
    from pyspark.sql import functions as F

    from cadenza.operators import folding

    period, nbin = 3_000_000_000_001_237, 2048  # their product is above 2**53
    edges = [-(-k * period // nbin) + d for k in (0, 1, 777, 1024, 2047) for d in (-1, 0, 1)] + [5 * period - 1, 5 * period]
    df = spark.createDataFrame([(x,) for x in edges], "us long")
    got = [tuple(r) for r in df.select(folding.phase_bin(F.col("us"), period, nbin), folding.turn(F.col("us"), period)).collect()]
    assert got == [(x % period * nbin // period, x // period) for x in edges]
    with pytest.raises(ValueError):
        folding.phase_bin(F.col("us"), 1 << 60, 8)


def test_period_of_a_calibrator_and_rate_of_a_fold():
    from cadenza.meta import ObsMeta, Signal
    from cadenza.operators import folding

    cal = ObsMeta(mode="CAL", cal_frequency=11.125, rate=1e4, ndat=10**6)
    assert folding.fold_period_us(cal) == round(1e6 / 11.125) and folding.fold_period_us(cal, 5000) == 5000
    with pytest.raises(ValueError):
        folding.fold_period_us(cal.but(mode="PSR"))
    meta = folding.folded_meta(Signal(None, cal), 89_888, 64)
    assert meta.rate == pytest.approx(64 / 0.089888) and meta.ndat == 64
