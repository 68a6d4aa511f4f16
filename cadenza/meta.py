"""Metadata of a signal, and the algebra that operators apply to it.

A signal is a DataFrame of samples with an ObsMeta beside it; metadata never travels in the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from fractions import Fraction

from pyspark.sql import DataFrame

from cadenza.weights import Weights

NYQUIST, ANALYTIC, INTENSITY, PPQQ, COHERENCE, STOKES, PP, QQ = "Nyquist", "Analytic", "Intensity", "PPQQ", "Coherence", "Stokes", "PP", "QQ"
DETECTED = (INTENSITY, PPQQ, COHERENCE, STOKES, PP, QQ)


@dataclass(frozen=True)
class ObsMeta:
    nchan: int = 1
    npol: int = 1
    ndim: int = 1
    nbit: int = 0
    ndat: int = 0
    rate: float = 1.0  # samples per second
    centre_frequency: float = 0.0  # MHz
    bandwidth: float = 0.0  # MHz, signed
    start_us: int = 0  # microseconds since the epoch, exact
    state: str = INTENSITY
    scale: float = 1.0
    basis: str = "Linear"
    source: str = ""
    telescope: str = ""
    receiver: str = ""
    machine: str = ""
    mode: str = ""
    cal_frequency: float = 0.0  # Hz, of a calibrator's signal
    dm: float = 0.0
    rm: float = 0.0
    dc_centred: bool = False
    swap: bool = False
    nsub_swap: int = 0
    oversampling: Fraction = Fraction(1)
    path: tuple[str, ...] = field(default=())  # names of the operators applied

    @property
    def detected(self) -> bool:
        return self.state in DETECTED

    @property
    def channel_width(self) -> float:
        return self.bandwidth / self.nchan

    def unswapped(self, ichan: int) -> int:
        """Position in frequency order of a stored channel."""
        if self.swap:
            ichan = (ichan + self.nchan // 2) % self.nchan
        if self.nsub_swap:
            if self.nsub_swap >= self.nchan:
                raise ValueError("fewer swapped sub-bands than channels are needed")
            each = self.nchan // self.nsub_swap
            band, rest = divmod(ichan, each)
            ichan = band * each + (rest + each // 2) % each
        return ichan

    def frequency(self, ichan: int) -> float:
        """Centre frequency of a channel, MHz."""
        edge = self.centre_frequency - self.bandwidth / 2
        first = edge if self.dc_centred else edge + self.channel_width / 2
        return first + self.unswapped(ichan) * self.channel_width

    @property
    def end_us(self) -> float:
        return self.start_us + (self.ndat / self.rate * 1e6 if self.ndat else 0)

    def bits_per_sample(self) -> int:
        return abs(self.nbit) * self.npol * self.nchan * self.ndim

    def nbytes(self, nsamples: int) -> int:
        return nsamples * self.bits_per_sample() // 8

    def nsamples(self, nbytes: int) -> int:
        return nbytes * 8 // self.bits_per_sample()

    def sample_at(self, us: float) -> int:
        """Sample that holds a time: truncated and clamped; an error beyond one sample outside."""
        offset = (us - self.start_us) * self.rate / 1e6
        if offset < -1 or offset > self.ndat + 1:
            raise ValueError(f"time is {offset / self.rate:g} s from the start, outside the data")
        return max(0, min(int(offset), self.ndat))

    def contiguous(self, following: ObsMeta) -> bool:
        """Whether another signal starts within nine tenths of a sample of this one's end."""
        return abs(following.start_us - self.end_us) < 0.9e6 / self.rate

    def merge_key(self) -> tuple:
        """What must be equal for results of two signals to be added."""
        return (self.telescope, self.receiver, self.source, self.centre_frequency, self.bandwidth, self.nchan, self.npol, self.ndim, self.nbit, self.state, self.basis, self.rate, self.scale, self.swap, self.nsub_swap, self.mode, self.machine, self.dm, self.rm, self.oversampling)

    def combinable(self, other: ObsMeta) -> bool:
        return self.merge_key() == other.merge_key()

    def to_state(self, state: str) -> ObsMeta:
        """The state changed; from real to complex voltages, two samples become one."""
        if state == ANALYTIC and self.state == NYQUIST:
            return replace(self, state=state, ndat=self.ndat // 2, rate=self.rate / 2, ndim=2)
        return replace(self, state=state)

    def describe(self) -> str:
        """Every field as a line, the operators applied last."""
        from dataclasses import fields

        lines = [f"{f.name} {getattr(self, f.name)}" for f in fields(self) if f.name != "path"]
        return "\n".join([*lines, *(f"applied {name}" for name in self.path)])

    def but(self, **changes) -> ObsMeta:
        return replace(self, **changes)


#: What the layout of weights depends on, and the mark of an operator that leaves weights as they are.
LAYOUT, SAME = ("nchan", "npol", "ndat", "rate", "start_us"), object()


@dataclass(frozen=True)
class Signal:
    """Samples (idat, ichan, ipol and v, or re and im) with their metadata, and weights where some are known."""

    df: DataFrame
    meta: ObsMeta
    weights: Weights | None = None

    def then(self, name: str, df: DataFrame, weights: Weights | None | object = SAME, **changes) -> Signal:
        """The result of an operator. One that changes the layout and has no rule for weights refuses a weighted signal."""
        if weights is SAME:
            weights = self.weights
            if weights is not None and any(changes.get(k, getattr(self.meta, k)) != getattr(self.meta, k) for k in LAYOUT):
                raise ValueError(f"{name} has no rule for weights: take them off with without_weights(), or apply them first")
        return Signal(df, replace(self.meta, path=(*self.meta.path, name), **changes), weights)

    def with_weights(self, weights: DataFrame, per: int, **layout) -> Signal:
        """weights (iw, ichan, ipol, weight) hold for blocks of ``per`` samples each; layout as in Weights."""
        return replace(self, weights=Weights(weights, per, **layout))

    def without_weights(self) -> Signal:
        return replace(self, weights=None)

    def weighed(self) -> DataFrame:
        """Samples with a column weight."""
        if self.weights is None:
            raise ValueError("the signal has no weights")
        return self.weights.attach(self.df)

    def carry(self, rule: str, *args, **kwargs) -> Weights | None:
        """The weights after one of their rules, or None where there are none."""
        return None if self.weights is None else getattr(self.weights, rule)(*args, **kwargs)

    def apply(self, operator, *args, **kwargs) -> Signal:
        return operator(self, *args, **kwargs)


def combined_ndat(parts: list[ObsMeta]) -> int:
    for a, b in zip(parts, parts[1:]):
        if not a.combinable(b) or not a.contiguous(b):
            raise ValueError("signals do not follow each other")
    return sum(p.ndat for p in parts)
