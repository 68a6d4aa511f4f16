"""A pipeline is a list of steps; rewrite() fuses and reorders them where that saves shuffles, and build() makes the plan.

Catalyst optimises within the plan; what it cannot see is that two sums over adjacent axes are one aggregate, or that a selection
before a transform saves the transform.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from cadenza.meta import INTENSITY, Signal
from cadenza.operators import delays, detection, digitize, folding, frames, integration, kurtosis, masking, rescale, responses, selection


@dataclass(frozen=True)
class Step:
    """An operator by name. of names the steps that it stands for after rewriting."""

    name: str
    args: dict = field(default_factory=dict)
    of: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        return self.of or (self.name,)


@dataclass(frozen=True)
class Hook:
    """A step that goes before the first one of a name: a dump of what reaches it, or a mask. Steps that are done together stay together, and the hook goes
    before all of them; with alone, the named step stands by itself."""

    before: str
    step: Step
    alone: bool = False


OPERATORS = {
    "chan_pol_select": selection.chan_pol_select,
    "fzoom": selection.fzoom,
    "poln_select": selection.poln_select,
    "truncate": selection.truncate,
    "chomp": selection.chomp,
    "delay_start": selection.delay_start,
    "detect": detection.detect,
    "scrunch": integration.scrunch,
    "tscrunch": integration.tscrunch,
    "fscrunch": integration.fscrunch,
    "pscrunch": integration.pscrunch,
    "rescale": rescale.rescale,
    "digitize": digitize.digitize,
    "filterbank_digitize": digitize.filterbank_digitize,
    "sample_delay": lambda s, dm=None, shift=None: delays.sample_delay(s, delays.dispersion_delays(s, dm) if shift is None else shift),
    "channelize": frames.channelize,
    "power_filterbank": frames.power_filterbank,
    "dedisperse": frames.dedisperse,
    "inverse_filterbank": frames.inverse_filterbank,
}


def _fused(steps: list[Step], apart: set[int]) -> list[Step]:
    out: list[Step] = []
    for k, step in enumerate(steps):
        if step.name in ("tscrunch", "fscrunch"):
            step = Step("scrunch", {"time" if step.name == "tscrunch" else "freq": step.args["factor"]}, step.names)
        if step.name == "scrunch" and out and out[-1].name == "scrunch" and k not in apart:
            last = out.pop()
            step = Step("scrunch", {k: last.args.get(k, 1) * step.args.get(k, 1) for k in ("time", "freq")}, last.names + step.names)
        moves = step.name in ("truncate", "chomp") or step.name == "chan_pol_select" and "pol" not in step.args
        if moves and out and out[-1].name == "detect":
            out.insert(len(out) - 1, step)
            continue
        out.append(step)
    return out


def rewrite(steps: list[Step], hooks: list[Hook] | None = None) -> list[Step]:
    """Adjacent time and frequency sums become one; a polarization or time selection moves before a detection that keeps it apart; then hooks are put in."""
    hooks = hooks or []
    first = lambda name: next((k for k, s in enumerate(steps) if s.name == name), None)
    out = _fused(steps, {first(h.before) for h in hooks if h.alone})
    for hook in hooks:
        at = next((k for k, s in enumerate(out) if hook.before in s.names and (not hook.alone or s.names[0] == hook.before)), None)
        if at is None:
            raise ValueError(f"no step {hook.before} to go before")
        out.insert(at, hook.step)
    return out


def build(source: Signal, steps: list[Step], hooks: list[Hook] | None = None) -> Signal:
    for step in rewrite(steps, hooks):
        source = OPERATORS[step.name](source, **step.args)
    return source


@dataclass(frozen=True)
class ChannelConfig:
    """``N``, ``N:D`` (dispersion removed during), ``N:B`` (before) or ``N:points`` of a filterbank option; after is the default."""

    nchan: int
    when: str = "after"
    points: int = 0


def parse_channels(text: str) -> ChannelConfig:
    m = re.fullmatch(r"(\d+)(?::(D|B|\d+))?", text)
    if not m:
        raise ValueError(f"not a filterbank option: {text}")
    if m[2] in (None, "D", "B"):
        return ChannelConfig(int(m[1]), {None: "after", "D": "during", "B": "before"}[m[2]])
    return ChannelConfig(int(m[1]), "after", int(m[2]))


def fold_path(s: Signal, period_us: int, nbin: int, dm: float = 0.0, channels: str | None = None, sk: tuple[int, float] | None = None, subint_us: int | None = None):
    """Voltages or powers to folded profiles: [dedisperse] -> [channelize] -> detect -> [kurtosis excision] -> delays -> fold."""
    if not s.meta.detected:
        config = parse_channels(channels) if channels else None
        if dm and (config is None or config.when == "before"):
            s = frames.dedisperse(s, dm)
        if config:
            settings = frames.dedispersing(s, config.nchan, dm, config.points or None) if dm and config.when == "during" else {"freq_res": config.points or 1}
            s = frames.channelize(s, config.nchan, **settings)
            if dm and config.when == "after":
                s = frames.dedisperse(s, dm)
        s = detection.detect(s, INTENSITY)
    zeroed = False
    if sk:
        from cadenza.functions.sk_limits import limits

        m, sigma = sk
        cut = limits(m, sigma)
        s, zeroed = kurtosis.excise(s, kurtosis.time_freq(kurtosis.sums(s, m), cut.lower, cut.upper), m), True
    if dm and s.meta.nchan > 1:
        s = delays.sample_delay(s, delays.dispersion_delays(s, dm))
    division = folding.by_seconds(folding.sample_us(s), subint_us, s.meta.start_us) if subint_us else None
    return folding.fold_signal(s, period_us, nbin, division=division, zeroed=zeroed)


def filterbank_path(s: Signal, nchan: int, time: int = 1, freq: int = 1, dm: float = 0.0, nbit: int = 8, rescale_interval: int | None = None) -> Signal:
    """Voltages to a quantized filterbank: channelize and detect -> [delays] -> sums -> rescale -> unsigned codes."""
    s = frames.power_filterbank(s, nchan, sum_pols=True)
    if dm:
        s = delays.sample_delay(s, delays.dispersion_delays(s, dm))
    s = build(s, [Step("fscrunch", {"factor": freq}), Step("tscrunch", {"factor": time})])
    return digitize.filterbank_digitize(rescale.rescale(s, nsample=rescale_interval), nbit)


def quantize_path(s: Signal, nbit: int, chan: tuple[int, int] | None = None, pol: tuple[int, int] | None = None, method=rescale.mean_std, interval: int | None = None) -> Signal:
    """A subset of channels and polarizations, normalised and quantized."""
    s = selection.chan_pol_select(s, chan, pol)
    return digitize.digitize(rescale.rescale(s, method, interval), nbit)


def slice_path(s: Signal, start_us: int, end_us: int, dm: float = 0.0) -> Signal:
    """A stretch of time, dedispersed (by delays where detected), as floats."""
    if dm:
        s = delays.sample_delay(s, delays.dispersion_delays(s, dm)) if s.meta.detected else frames.dedisperse(s, dm)
    return selection.truncate(selection.delay_start(s, start_us), end_us)


def fits_path(s: Signal, path: str, nchan: int, samples: int = 4096, time: int = 1, freq: int = 1, nblock: int = 1) -> Signal:
    """Voltages to a search-mode PSRFITS file: channelize and detect -> sums -> scales by row -> unsigned codes, written with their scales."""
    from cadenza.sources.fits import write_psrfits

    if not s.meta.detected:
        s = frames.power_filterbank(s, nchan)
    s = build(s, [Step("fscrunch", {"factor": freq}), Step("tscrunch", {"factor": time})])
    scales = digitize.table_scale_offset(s, samples, nblock)
    coded = digitize.table_digitize(s, scales, samples)
    write_psrfits(coded, scales, path, samples)
    return coded


def dump(s: Signal, path: str) -> Signal:
    """Writes the signal where it stands in a pipeline, as Parquet, and goes on with what was written."""
    s.df.write.mode("overwrite").parquet(path)
    return s.then("dump", s.df.sparkSession.read.schema(s.df.schema).parquet(path))


OPERATORS |= {"dump": dump, "mask_times": masking.mask_times, "apply_weights": masking.apply_weights, "derotate": frames.derotate, "convolve": frames.convolve, "respond": responses.respond}
