from fractions import Fraction

import pytest

from cadenza.meta import ANALYTIC, NYQUIST, ObsMeta, combined_ndat

BASE = ObsMeta(nchan=4, npol=2, ndim=2, nbit=8, ndat=1000, rate=100.0, centre_frequency=1400, bandwidth=400, start_us=0)


def test_frequencies_and_swaps():
    assert [BASE.frequency(i) for i in range(4)] == [1250, 1350, 1450, 1550]
    assert [BASE.but(swap=True).unswapped(i) for i in range(4)] == [2, 3, 0, 1]
    assert [BASE.but(nsub_swap=2).unswapped(i) for i in range(4)] == [1, 0, 3, 2]
    assert BASE.but(dc_centred=True).frequency(0) == 1200
    with pytest.raises(ValueError):
        BASE.but(nsub_swap=4).unswapped(0)


def test_sizes_and_times():
    assert BASE.bits_per_sample() == 128 and BASE.nbytes(10) == 160 and BASE.nsamples(160) == 10
    assert BASE.end_us == 10_000_000 and BASE.sample_at(25_000) == 2 and BASE.sample_at(-5_000) == 0
    with pytest.raises(ValueError):
        BASE.sample_at(11_000_000)


def test_contiguity_and_merging():
    after = BASE.but(start_us=10_005_000)
    assert BASE.contiguous(after) and not BASE.contiguous(BASE.but(start_us=10_010_000))
    assert combined_ndat([BASE, after]) == 2000
    assert not BASE.combinable(BASE.but(dm=1.0)) and not BASE.combinable(BASE.but(oversampling=Fraction(8, 7)))
    with pytest.raises(ValueError):
        combined_ndat([BASE, BASE])


def test_state_change():
    real = BASE.but(state=NYQUIST, ndim=1).to_state(ANALYTIC)
    assert (real.ndat, real.rate, real.ndim) == (500, 50.0, 2)
