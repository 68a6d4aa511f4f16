"""Tapers, frequency responses and transform lengths."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np

#: Dispersion constant, MHz^-2 pc^-1 cm^3 s^-1: a fixed value of the field's convention.
DM_DISPERSION = 2.41e-4


def taper(kind: str, n: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Window of n points: top_hat, hanning, welch, bartlett, or tukey with ``start`` and ``end`` transition points."""
    i = np.arange(n, dtype=float)
    middle = (n - 1) / 2
    if kind == "top_hat":
        return np.ones(n)
    if kind == "hanning":
        return 0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))
    if kind == "welch":
        return 1 - ((i - middle) / ((n + 1) / 2)) ** 2
    if kind == "bartlett":
        return 1 - np.abs((i - middle) / middle)
    if kind == "tukey":
        end = start if end is None else end
        ramp = lambda k, width: 0.5 - 0.5 * np.cos(np.pi * k / max(width, 1))
        out = np.ones(n)
        out[:start] = ramp(i[:start], start)
        if end:
            out[n - end :] = ramp(n - 1 - i[n - end :], end)
        return out
    raise ValueError(f"no taper {kind}")


def dispersion_delay(dm: float, mhz: float) -> float:
    """Seconds behind infinite frequency."""
    return dm / DM_DISPERSION / mhz**2


def smearing(dm: float, centre: float, width: float) -> float:
    """Seconds of delay across a band."""
    half = abs(width) / 2
    return dispersion_delay(dm, abs(centre) - half) - dispersion_delay(dm, abs(centre) + half)


def impulse_samples(dm: float, centre: float, width: float, rate: float) -> tuple[int, int]:
    """Samples of wrap-around to discard at the start and the end of a transform, complex samples at ``rate``."""
    half = abs(width) / 2
    low = dispersion_delay(dm, centre - half) - dispersion_delay(dm, centre)
    high = dispersion_delay(dm, centre) - dispersion_delay(dm, centre + half)
    return math.ceil(low * rate), math.ceil(high * rate)


def dispersion_kernel(n: int, centre: float, width: float, dm: float, fractional_delay_us: float = 0.0) -> np.ndarray:
    """Complex response, in FFT order, that removes the dispersion of a complex band of n points (MHz)."""
    offset = np.fft.fftfreq(n, 1 / width) if width else np.zeros(n)
    factor = -np.sign(width) * 2 * np.pi * 1e6 * dm / DM_DISPERSION / centre**2
    phase = factor * offset**2 / (centre + offset) - 2 * np.pi * offset * fractional_delay_us
    return np.exp(1j * phase)


def derotation(n: int, centre: float, width: float, rm: float) -> np.ndarray:
    """n Jones matrices (n, 2, 2), circular basis, that undo the Faraday rotation relative to the centre."""
    metres = lambda mhz: 299.792458 / mhz
    offset = np.fft.fftfreq(n, 1 / width)
    turn = rm * (metres(centre + offset) ** 2 - metres(centre) ** 2)
    out = np.zeros((n, 2, 2), dtype=complex)
    out[:, 0, 0], out[:, 1, 1] = np.exp(-1j * turn), np.exp(1j * turn)
    return out


@dataclass(frozen=True)
class Response:
    """A frequency response in order of frequency, and the samples that its impulse response takes before and after."""

    points: np.ndarray
    pos: int = 0
    neg: int = 0

    def __mul__(self, other: Response) -> Response:
        """Both in series: points multiply, and what each wraps around adds up."""
        if len(self.points) != len(other.points):
            raise ValueError("responses have as many points")
        return Response(product([self.points, other.points]), self.pos + other.pos, self.neg + other.neg)

    def fft_order(self) -> np.ndarray:
        """The points from zero frequency up, then those below, as convolve() takes them."""
        return np.fft.ifftshift(self.points, axes=0)

    def channel(self, k: int, nchan: int) -> Response:
        """The part of the band that channel k of nchan has."""
        n = len(self.points) // nchan
        if n * nchan != len(self.points):
            raise ValueError("the channels divide the points")
        return Response(self.points[k * n : (k + 1) * n], self.pos, self.neg)

    def decimated(self, n: int) -> Response:
        """Means of neighbouring points: n are left."""
        each = len(self.points) // n
        if each * n != len(self.points):
            raise ValueError("the new length divides the old one")
        return Response(self.points.reshape(n, each, *self.points.shape[1:]).mean(1), self.pos, self.neg)


def product(responses: list[np.ndarray]) -> np.ndarray:
    """Responses in series: scalars multiply, Jones matrices compose, a scalar scales a matrix."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.ndim == b.ndim == 3:
            return a @ b
        if a.ndim == 3:
            return a * b[:, None, None]
        return b * a[:, None, None] if b.ndim == 3 else a * b

    return reduce(pair, responses)


def deripple(taps: np.ndarray, n: int, roll: int = 0) -> np.ndarray:
    """One over the magnitude of a prototype filter's response at n points."""
    h = np.abs(np.fft.fft(taps, n))
    return np.roll(1 / np.maximum(h, 1e-12), roll)


def interpolated(response: np.ndarray, n: int) -> np.ndarray:
    """Responses (FFT order, along the last axis) at n points: their impulse responses, zero-padded between positive and negative times."""
    have = response.shape[-1]
    if have > n:
        raise ValueError("the response has more points than the transform")
    taps, half = np.fft.ifft(response), (have + 1) // 2
    return np.fft.fft(np.concatenate([taps[..., :half], np.zeros((*taps.shape[:-1], n - have)), taps[..., half:]], axis=-1))


def best_nfft(discard: int, largest: int = 1 << 24) -> int:
    """Power of two with the least cost n log2 n / (n - discard) a kept sample."""
    n, best = 2, None
    while n <= largest:
        if n > discard:
            cost = n * math.log2(n) / (n - discard)
            if best is not None and cost >= best[0]:
                break
            best = cost, n
        n *= 2
    if best is None:
        raise ValueError("no transform is long enough")
    return best[1]


def bandpass_mask(spectrum: np.ndarray, window: int = 51) -> np.ndarray:
    """1 for good channels, 0 for outliers of a bandpass: in rounds, squared residuals from a running median that exceed 16 variances are taken out, and
    the variance falls by what they held, until a round finds none.

    A step of more than 32 variances to the channel before needs no test of its own: what is left in either channel is at most 16.
    """
    half = window // 2
    smooth = np.array([np.median(spectrum[max(0, i - half) : i + half + 1]) for i in range(len(spectrum))])
    residual = (spectrum - smooth) ** 2
    good = np.ones(len(spectrum))
    while len(bad := np.flatnonzero(residual > 16 * residual.mean())):
        good[bad] = residual[bad] = 0.0
    return good
