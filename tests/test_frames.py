"""Transforms against NumPy on whole arrays."""

import numpy as np
import pandas as pd
import pytest

from cadenza.functions.response import derotation, dispersion_kernel, impulse_samples
from cadenza.meta import ANALYTIC, NYQUIST, ObsMeta, Signal
from cadenza.operators import frames, rescale


def signal(spark, x, **meta):
    """x: (ndat, nchan, npol), complex or real."""
    at = np.indices(x.shape).reshape(3, -1)
    cols = {"idat": at[0].astype(np.int64), "ichan": at[1].astype(np.int32), "ipol": at[2].astype(np.int32)}
    cols |= {"re": x.real.ravel(), "im": x.imag.ravel()} if np.iscomplexobj(x) else {"v": x.ravel()}
    state = ANALYTIC if np.iscomplexobj(x) else NYQUIST
    base = ObsMeta(nchan=x.shape[1], npol=x.shape[2], ndat=len(x), ndim=2 if np.iscomplexobj(x) else 1, state=state, rate=1e6, centre_frequency=1400.0, bandwidth=float(x.shape[1]))
    return Signal(spark.createDataFrame(pd.DataFrame(cols)), base.but(**meta))


def array(s, values=("re", "im")):
    pdf = s.df.toPandas()
    out = np.zeros((pdf["idat"].max() + 1, pdf["ichan"].max() + 1, pdf["ipol"].max() + 1), dtype=complex)
    v = pdf["re"] + 1j * pdf["im"] if "re" in pdf else pdf["v"]
    out[pdf["idat"], pdf["ichan"], pdf["ipol"]] = v
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(7)
    return rng.normal(size=(512, 2, 2)) + 1j * rng.normal(size=(512, 2, 2))


def test_channelize_real_and_complex(spark, noise):
    got = array(frames.channelize(signal(spark, noise), 8))
    want = np.fft.fftshift(np.fft.fft(noise.reshape(64, 8, 2, 2), axis=1), axes=1).transpose(0, 2, 1, 3).reshape(64, 16, 2)
    assert np.allclose(got, want)
    real = noise.real.copy()
    got = array(frames.channelize(signal(spark, real), 8))
    want = np.fft.rfft(real.reshape(32, 16, 2, 2), axis=1)[:, :8].transpose(0, 2, 1, 3).reshape(32, 16, 2)
    assert np.allclose(got, want)


def test_synthesis_undoes_channelizing(spark, noise):
    x = noise[:, :1]
    s = frames.channelize(signal(spark, x), 8)
    back = frames.inverse_filterbank(s, 1)
    assert back.meta.rate == pytest.approx(1e6) and back.meta.ndat == 512
    assert np.allclose(array(back), x * 8)


def test_overlap_save_equals_direct_convolution(spark, noise):
    taps = np.array([1.0, -0.5, 0.25, 2.0])
    n = 64
    s = frames.convolve(signal(spark, noise), lambda i: np.fft.fft(taps, n), n, 3, 0)
    got = array(s)
    for c in range(2):
        for p in range(2):
            assert np.allclose(got[:, c, p], np.convolve(noise[:, c, p], taps)[3 : 3 + len(got)])


def test_jones_response_acts_on_both_polarizations(spark, noise):
    n, jones = 32, derotation(32, 1400, 100, 500)
    got = array(frames.convolve(signal(spark, noise), lambda i: jones, n, 0, 0))
    z = np.fft.fft(noise.reshape(16, n, 2, 2), axis=1)
    want = np.fft.ifft(np.einsum("nij,bncj->bnci", jones, z), axis=1).reshape(512, 2, 2)
    assert np.allclose(got, want)


def test_dynamic_filter_picks_the_response_by_time(spark, noise):
    got = array(frames.dynamic_filter(signal(spark, noise), {0: np.ones(32), 2: np.full(32, 3.0)}, 64, 32))
    want = noise * np.where(np.arange(512) < 128, 1, 3)[:, None, None]
    assert np.allclose(got, want)


def test_dedispersion_undoes_dispersion(spark, noise):
    x, dm = noise[:, :1, :1], 0.01
    kernel = dispersion_kernel(512, 1400.0, 1.0, dm)
    spread = np.fft.ifft(np.fft.fft(x[:, 0, 0]) / kernel)[:, None, None]
    s = frames.dedisperse(signal(spark, spread), dm, 128)
    pos, neg = impulse_samples(dm, 1400.0, 1.0, 1e6)
    got = array(s)[:, 0, 0]
    assert np.corrcoef(np.abs(got), np.abs(x[pos : pos + len(got), 0, 0]))[0, 1] > 0.98


def test_polyphase(spark, noise):
    taps = np.arange(1, 17) / 16
    got = array(frames.polyphase(signal(spark, noise), taps, 4))
    for t in (0, 5, 100):
        block = (noise[t * 4 : t * 4 + 16, 1, 0] * taps).reshape(4, 4).sum(0)
        assert np.allclose(got[t, 4:8, 0], np.fft.fftshift(np.fft.fft(block)))


def test_parseval(spark, noise):
    power = frames.power_filterbank(signal(spark, noise), 16).df.toPandas()["v"].sum()
    assert power == pytest.approx(16 * (np.abs(noise) ** 2).sum())


def test_phase_locked_filterbank_counts_transforms(spark, noise):
    out = frames.phase_locked_filterbank(signal(spark, noise[:, :1, :1], rate=1000.0), 8, 64_000, 4).toPandas()
    assert set(out["hits"]) <= {7, 8} and len(out) == 4 * 8
    assert np.isfinite(out["power"]).all()


def test_baseline_decay_matches_the_recurrence(spark, noise):
    x = noise.real[:, :1, :1] * 10 + 100
    long = np.concatenate([x] * 20)
    got = array(rescale.baseline_decay(signal(spark, long, state="Intensity"), 32.0))[:, 0, 0].real
    b, want = long[0, 0, 0], []
    for v in long[:, 0, 0]:
        b += (v - b) / 32
        want.append(v - b)
    assert np.allclose(got, want)


def test_convolving_filterbank(spark, noise):
    """Sub-bands of overlapping parts, by loops over parts."""
    nchan, res, pos, neg = 4, 8, 2, 1
    response = lambda i: np.exp(1j * np.arange(32) * (i + 1) / 7)
    s = frames.channelize(signal(spark, noise), nchan, response=response, freq_res=res, pos=pos, neg=neg)
    got, keep = array(s), res - pos - neg
    for p in (0, 3, (512 - 32) // (keep * nchan)):
        for c in (0, 1):
            part = noise[p * keep * nchan :][:32, c, 1]
            bands = (np.fft.fftshift(np.fft.fft(part)) * response(c)).reshape(nchan, res)
            for k in range(nchan):
                assert np.allclose(got[p * keep : (p + 1) * keep, c * nchan + k, 1], (np.fft.ifft(bands[k]) * res)[pos : res - neg])
    assert s.meta.ndat == len(got) and s.meta.rate == pytest.approx(1e6 / nchan)


def test_real_filterbank_with_resolution(spark, noise):
    x = noise.real[:, :1, :1].copy()
    s = frames.channelize(signal(spark, x), 4, freq_res=8)
    want = np.fft.rfft(x.reshape(8, 64), axis=1)[:, :32].reshape(8, 4, 8)
    assert np.allclose(array(s)[:8, :, 0].T, np.fft.ifft(want[0], axis=1) * 8) and s.meta.ndat == 64


def test_filterbank_dedisperses_as_well_as_before(spark, noise):
    """A dispersed impulse comes together in every sub-band."""
    dm, x = 0.02, np.zeros(4096, dtype=complex)
    x[2048] = 1
    spread = np.fft.ifft(np.fft.fft(x) / dispersion_kernel(4096, 1400.0, 1.0, dm))[:, None, None]
    s = signal(spark, spread)
    power = np.abs(array(frames.channelize(s, 8, **frames.dedispersing(s, 8, dm, 64)))[:, :, 0]) ** 2
    blurred = np.abs(array(frames.channelize(s, 8))[:, :, 0]) ** 2
    assert power.max(0).min() > 0.8 * power.sum(0).mean() and (power.max(0) > 1.3 * blurred.max(0)).all()


def test_real_convolution_gives_the_analytic_signal(spark, noise):
    n, pos = 64, 4
    x = noise.real[:, :1, :1].copy()
    s = frames.convolve(signal(spark, x), lambda i: np.exp(-2j * np.pi * np.arange(n) / n * 2), n, pos, 0)
    got, step = array(s)[:, 0, 0], n - pos
    for p in range(2):
        z = np.fft.rfft(x[p * 2 * step :][: 2 * n, 0, 0])[:n] * np.exp(-2j * np.pi * np.arange(n) / n * 2)
        assert np.allclose(got[p * step : (p + 1) * step], np.fft.ifft(z)[pos:])
    assert s.meta.rate == pytest.approx(5e5) and s.meta.state == ANALYTIC


def test_dynamic_filter_interpolates_short_responses_and_overlaps(spark, noise):
    taps = np.array([1.0, 0.5, 0.25])
    got = array(frames.dynamic_filter(signal(spark, noise), {0: np.fft.fft(taps, 8)}, 64, 32, pos=4))
    for c in range(2):
        assert np.allclose(got[:, c, 0], np.convolve(noise[:, c, 0], taps)[4 : 4 + len(got)])


def test_oversampled_synthesis_undoes_the_ripple(spark):
    """Two coarse channels of a tone, oversampled by 4/3, with a known ripple: synthesis with its inverse gives the tone."""
    from fractions import Fraction

    nfft, overlap, nchan, over = 128, 16, 4, Fraction(4, 3)
    keep = 96
    t = np.arange(1024)
    coarse = np.zeros((1024, nchan, 1), dtype=complex)
    ripple = 1 + 0.3 * np.cos(2 * np.pi * np.arange(nfft) / nfft)
    bin_ = 11  # of the channel's fftshifted spectrum, right of its middle
    coarse[:, 2, 0] = ripple[nfft // 2 + bin_] * np.exp(2j * np.pi * bin_ * t / nfft)
    whole = np.tile(1 / ripple[(nfft - keep) // 2 : (nfft + keep) // 2], nchan)
    s = frames.inverse_filterbank(signal(spark, coarse, oversampling=over), nfft, overlap, whole)
    y = array(s)[:, 0, 0]
    size = keep * nchan - 2 * (overlap * keep // nfft * nchan)
    spectrum = np.abs(np.fft.fft(y[:size]))
    assert np.allclose(np.abs(y), np.abs(y[0]), rtol=1e-6) and np.abs(y[0]) == pytest.approx(1.0, rel=1e-6)
    assert s.meta.ndat == len(y) and spectrum.max() > 0.5 * size


def test_cross_spectra(spark, noise):
    got = frames.cross_bandpass(signal(spark, noise), 8).toPandas().set_index(["ichan", "ipol", "ifreq"])["power"]
    z = np.fft.fftshift(np.fft.fft(noise.reshape(64, 8, 2, 2), axis=1), axes=1)
    cross = (z[..., 0].conj() * z[..., 1]).sum(0)
    for k in range(8):
        assert got[1, 0, k] == pytest.approx((np.abs(z[:, k, 1, 0]) ** 2).sum())
        assert complex(got[1, 2, k], got[1, 3, k]) == pytest.approx(cross[k, 1])


def test_derotation_turns_each_hand_its_own_way(spark, noise):
    out = frames.derotate(signal(spark, noise), 3.0, 64)
    got = array(out)
    for c in range(2):
        jones = derotation(64, 1399.5 + c, 1.0, 3.0)
        for p in (0, 1):
            want = np.fft.ifft(np.fft.fft(noise[:64, c, p]) * jones[:, p, p])
            assert np.allclose(got[:64, c, p], want)
    assert out.meta.rm == 3.0


def test_parts_that_lack_samples_are_left_out(spark, noise):
    s = signal(spark, noise)
    holed = Signal(s.df.filter("NOT (idat = 20 AND ichan = 1 AND ipol = 0)"), s.meta)
    left = frames.channelize(holed, 8).df.groupBy("ichan", "ipol").count().toPandas().set_index(["ichan", "ipol"])["count"]
    assert left[8, 0] == 63 and left[0, 0] == left[8, 1] == 64


def test_synthesis_of_256_channels_puts_a_tone_at_its_frequency(spark):
    """Two parts of 128 points, 16 discarded at either end: a tone in one coarse channel stays one tone, across the parts' seam as well."""
    nfft, nchan, overlap, chan, bin_ = 128, 256, 16, 37, 9
    t = np.arange(2 * nfft - 2 * overlap)
    coarse = np.zeros((len(t), nchan, 1), dtype=complex)
    coarse[:, chan, 0] = np.exp(2j * np.pi * bin_ * t / nfft)
    s = frames.inverse_filterbank(signal(spark, coarse), nfft, overlap)
    y, size = array(s)[:, 0, 0], (nfft - 2 * overlap) * nchan
    assert len(y) == s.meta.ndat == 2 * size and s.meta.nchan == 1
    frequency = (chan * nfft + nfft // 2 + bin_ - nchan * nfft // 2) / (nchan * nfft)  # cycles a sample
    want = np.exp(2j * np.pi * frequency * (np.arange(2 * size) + overlap * nchan))
    assert np.allclose(y / y[0] * want[0], want, atol=1e-9)
