"""Thresholds of the spectral kurtosis estimator (Nita and Gary 2010), from its moments.

The distribution is taken as Pearson type IV or VI by the criterion kappa; for large M as normal. The density is normalised and
integrated numerically on a fine grid, and quantiles are found by bisection of the tail integrals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

NORMAL_FROM = 32768


@dataclass(frozen=True)
class Limits:
    lower: float
    upper: float
    symmetric: float


def inverse_erf(p: float) -> float:
    """By bisection and Newton steps on math.erf."""
    if not -1 < p < 1:
        raise ValueError("argument is within (-1, 1)")
    low, high = -6.0, 6.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < p else (low, mid)
    x = (low + high) / 2
    for _ in range(3):
        slope = 2 / math.sqrt(math.pi) * math.exp(-x * x)
        x -= (math.erf(x) - p) / slope if slope > 1e-300 else 0
    return x


def moments(m: int, nd: float = 1.0) -> tuple[float, float, float]:
    """Second, third and fourth central moments of the estimator for m samples of nd integrated powers each; its mean is 1.

    Published formulas: Nita and Gary, MNRAS 406, L60 (2010), equation 9.
    """
    n = m * nd
    over = lambda k: 1 / math.prod(n + i for i in range(2, k + 2))  # noqa: E731  gamma(n + 2) / gamma(n + 2 + k)
    c, r = nd * (nd + 1) * m, m / (m - 1)
    mu2 = 2 * c * r * over(2)
    mu3 = 8 * c * r**2 * over(4) * (n * (nd + 4) - 5 * nd - 2)
    poly = (m**3 + 3 * m**2) * nd**4 + (m**3 + 68 * m**2 - 93 * m) * nd**3 + (125 * m**2 - 245 * m + 84) * nd**2 + (48 - 32 * m) * nd + 24
    return mu2, mu3, 12 * c * r**3 * over(6) * poly


def kappa(b1: float, b2: float) -> float:
    """Pearson's criterion from squared skewness and kurtosis; the published formula of his system of curves, as used in equation 10 of the same paper."""
    return b1 * (b2 + 3) ** 2 / (4 * (4 * b2 - 3 * b1) * (2 * b2 - 3 * b1 - 6))


def density(m: int, nd: float, x: np.ndarray) -> np.ndarray:
    """Unnormalised density of the estimator at x."""
    mu2, mu3, mu4 = moments(m, nd)
    b1, b2 = mu3**2 / mu2**3, mu4 / mu2**2
    k = kappa(b1, b2)
    if k < 0:
        raise ValueError("Pearson type I is not supported: M is too small")
    if k <= 1:  # type IV, by the published method of moments
        r = 6 * (b2 - b1 - 1) / (2 * b2 - 3 * b1 - 6)
        root = 16 * (r - 1) - b1 * (r - 2) ** 2
        width, shape = 0.25 * math.sqrt(mu2 * root), -r * (r - 2) * math.sqrt(b1) / math.sqrt(root)
        z = (x - 1 + 0.25 * (r - 2) * math.sqrt(mu2 * b1)) / width
        log = -(r + 2) / 2 * np.log1p(z * z) - shape * np.arctan(z)
    else:  # type VI, by the same: a shifted beta prime
        root = math.sqrt(16 * mu2**4 + (4 * mu2 + 1) * mu3**2)
        beta = 3 + 2 * mu2 / mu3**2 * (4 * mu2**2 + root)
        alpha = (32 * mu2**5 - 4 * mu3 * mu2**3 + 8 * mu3**2 * mu2**2 + mu3**2 * mu2 - mu3**3 + (8 * mu2**3 - mu3 * mu2 + mu3**2) * root) / mu3**3
        t = x - (beta - alpha - 1) / (beta - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(t > 0, (alpha - 1) * np.log(np.maximum(t, 1e-300)) - (alpha + beta) * np.log1p(np.maximum(t, 0)), -np.inf)
    return np.exp(log - log.max())


def limits(m: int, sigma: float = 3.0, nd: float = 1.0, ntest: int = 1) -> Limits:
    """Lower and upper thresholds whose family-wise false alarm over ntest cells is that of sigma normal deviations."""
    family = 1 - math.erf(sigma / math.sqrt(2))
    each = 1 - (1 - family) ** (1 / ntest)
    deviations = inverse_erf(1 - each) * math.sqrt(2)
    if m >= NORMAL_FROM:
        reach = math.sqrt(4 / m) * deviations
        return Limits(1 - reach, 1 + reach, reach)
    spread = math.sqrt(moments(m, nd)[0])
    x = np.linspace(1 - 60 * spread, 1 + 120 * spread, 1_800_001)
    y = density(m, nd, x)
    area = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
    area /= area[-1]
    lower = float(np.interp(each / 2, area, x))
    tail = 1 - area
    upper = float(np.interp(-each / 2, -tail, x))
    return Limits(lower, upper, spread * deviations)
