"""Operators on contiguous frames of samples: transforms run in NumPy on Arrow batches.

Time is dealt into parts of ``nfft`` samples every ``step``; a part's samples are gathered once, by (part, channel, polarization) or, where
channels or polarizations are needed together, by part. A part is the largest thing a task holds. All frames of a batch are transformed
together, as rows of one array; parts that lack samples are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, INTENSITY, NYQUIST, Signal
from cadenza.weights import Weights

VALUES = ("v", "re", "im")
SAMPLE = "idat long, ichan int, ipol int, re double, im double"
POWER = "idat long, ichan int, ipol int, v double"
TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
EACH = ("ichan", "ipol")  # a part is one channel's and polarization's
AT_ONCE = 1 << 20  # samples transformed in one call

Columns = dict[str, np.ndarray]


def n_parts(ndat: int, nfft: int, step: int) -> int:
    return (ndat - nfft) // step + 1 if ndat >= nfft else 0


def to_frames(s: Signal, nfft: int, step: int | None = None, keys: tuple[str, ...] = ("ichan", "ipol")) -> DataFrame:
    """(ipart, keys, re and im or v): arrays of a part's samples in order; only parts that end within the signal."""
    step = step or nfft
    values, parts = [c for c in VALUES if c in s.df.columns], n_parts(s.meta.ndat, nfft, step)
    last = F.expr(f"idat div {step}")
    if step >= nfft:  # a sample is in one part at most
        rows = s.df.withColumn("ipart", last).filter((F.col("ipart") < parts) & (F.col("idat") % step < nfft))
    else:
        low = F.greatest(F.lit(0).cast("long"), F.expr(f"(idat - {nfft} + {step}) div {step}"))
        high = F.least(F.lit(parts - 1).cast("long"), last)
        rows = s.df.filter(low <= high).withColumn("ipart", F.explode(F.sequence(low, high)))
    rest = [c for c in ("ichan", "ipol") if c not in keys]
    full = nfft * math.prod({"ichan": s.meta.nchan, "ipol": s.meta.npol}[c] for c in rest)
    return gathered(rows, ["ipart", *keys], ["idat", *rest], values, full)


def gathered(rows: DataFrame, keys: list[str], order: list[str], values: list[str], full: int) -> DataFrame:
    """The values of each key's ``full`` rows in order, as arrays of doubles: Arrow hands these to NumPy without a Python object a sample."""
    frames = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("x")).filter(F.size("x") == full)
    return frames.select(*keys, *(F.col(f"x.{c}").cast("array<double>").alias(c) for c in values))


def map_frames(frames: DataFrame, fn: Callable[[Columns, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """fn(keys, x) for frames of a batch: key columns of shape (rows, 1), other arrays and the samples of shape (rows, n), complex where there are re and im. It returns the
    schema's columns, as arrays that broadcast to one shape."""
    names, types = zip(*((n, TYPES[t]) for n, t in (c.split() for c in schema.split(", "))))

    def plane(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(name)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            rows = max(1, AT_ONCE // max(1, plane(whole.slice(0, 1), next(c for c in VALUES if c in whole.schema.names)).size))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                keys = {f.name: plane(batch, f.name) if pa.types.is_list(f.type) else batch.column(f.name).to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for f in batch.schema if f.name not in VALUES}
                x = plane(batch, "re") + 1j * plane(batch, "im") if "re" in batch.schema.names else plane(batch, "v")
                out = np.broadcast_arrays(*fn(keys, x))
                yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(t.to_pandas_dtype()), t) for a, t in zip(out, types)], list(names))

    return frames.mapInArrow(run, schema)


def over_frames(s: Signal, nfft: int, step: int, keys: tuple[str, ...], fn: Callable[[Columns, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """map_frames() over a signal's parts; of a stream, parts are put together across micro-batches."""
    if s.df.isStreaming:
        from cadenza.streaming.frames import map_stream

        return map_stream(s, nfft, step, keys, [c for c in VALUES if c in s.df.columns], fn, schema)
    return map_frames(to_frames(s, nfft, step, keys), fn, schema)


def spectra(x: np.ndarray, n: int) -> np.ndarray:
    """n points of each row's spectrum in order of frequency: all of a complex row, all but the last of a real one of 2 n samples."""
    return np.fft.fftshift(np.fft.fft(x), axes=-1) if np.iscomplexobj(x) else np.fft.rfft(x)[..., :n]


def _split(s: Signal, nchan: int, freq_res: int, pos: int, neg: int, taper, response, emit, schema: str) -> tuple[DataFrame, dict, Weights | None]:
    """Frames of nchan x freq_res points, split into sub-bands of freq_res points that are transformed back; emit makes the values of a block of
    (rows, nchan, kept) complex samples. Also the changes of metadata, and the weights."""
    real = s.meta.state == NYQUIST
    keep, points = freq_res - pos - neg, nchan * freq_res
    if keep <= 0:
        raise ValueError("the frequency resolution is not more than its wrap-around")
    n, step = points * (1 + real), keep * nchan * (1 + real)
    held: dict[int, np.ndarray] = {}

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        y = spectra(x if taper is None else x * taper, points)
        if response is not None:
            chans = k["ichan"].ravel().tolist()
            held.update((c, response(c)) for c in set(chans) - set(held))
            y = y * np.stack([held[c] for c in chans])
        y = y.reshape(len(y), nchan, freq_res)
        if freq_res > 1:
            y = np.fft.ifft(y, norm="forward")[:, :, pos : freq_res - neg]
        at = k["ipart"][:, :, None] * keep + np.arange(keep)
        return [at, (k["ichan"] * nchan + np.arange(nchan))[:, :, None], k["ipol"][:, :, None], *emit(y)]

    df = over_frames(s, n, step, EACH, one, schema)
    ndat = n_parts(s.meta.ndat, n, step) * keep
    weights = s.carry("transform", s.meta.ndat, n, step, nchan * (1 + real), ndat, nchan)
    return df, {"nchan": s.meta.nchan * nchan, "ndat": ndat, "rate": s.meta.rate / (nchan * (1 + real)), "start_us": s.meta.start_us + round(pos * nchan * (1 + real) / s.meta.rate * 1e6)}, weights


def channelize(s: Signal, nchan: int, taper: np.ndarray | None = None, response: Callable[[int], np.ndarray] | None = None, freq_res: int = 1, pos: int = 0, neg: int = 0) -> Signal:
    """Splits each channel into nchan, complex, in order of frequency, by transforms of parts of nchan x freq_res points (twice as many real samples).

    With freq_res > 1 each sub-band is transformed back (unnormalised, from its lowest frequency up), and pos samples at the start and neg at the end of
    what comes out are discarded: parts overlap by as much. response(ichan), nchan x freq_res points in order of frequency, multiplies the spectrum of
    an input channel, so that channelizing convolves.
    """
    df, changes, weights = _split(s, nchan, freq_res, pos, neg, taper, response, lambda y: [y.real, y.imag], SAMPLE)
    return s.then("channelize", df, weights, **changes, state=ANALYTIC, ndim=2)


def power_filterbank(s: Signal, nchan: int, sum_pols: bool = False, **settings) -> Signal:
    """channelize() and square-law detection in one pass; settings as there."""
    chosen = {"taper": None, "response": None, "freq_res": 1, "pos": 0, "neg": 0} | settings
    df, changes, weights = _split(s, nchan, emit=lambda y: [np.abs(y) ** 2], schema=POWER, **chosen)
    if sum_pols:
        df = df.groupBy("idat", "ichan").agg(F.sum("v").alias("v")).select("idat", "ichan", F.lit(0).alias("ipol"), "v")
        changes |= {"npol": 1, "state": INTENSITY}
        weights = weights and weights.merge(1, s.meta.npol, s.meta.nchan * nchan, s.meta.npol)
    else:
        changes |= {"state": "PPQQ" if s.meta.npol == 2 else INTENSITY}
    return s.then("power_filterbank", df, weights, ndim=1, **changes)


def dedispersing(s: Signal, nchan: int, dm: float, freq_res: int | None = None) -> dict:
    """Settings with which channelize() and power_filterbank() also dedisperse: the response of each input channel over nchan x freq_res points, and the
    wrap-around of the most smeared sub-band in output samples."""
    from cadenza.functions.response import best_nfft, dispersion_kernel, impulse_samples

    width, rate = s.meta.channel_width, s.meta.rate / (nchan * (1 + (s.meta.state == NYQUIST)))
    centres = [s.meta.frequency(i) + width * ((k + 0.5) / nchan - 0.5) for i in range(s.meta.nchan) for k in range(nchan)]
    reach = [impulse_samples(dm, c, abs(width) / nchan, rate) for c in centres]
    pos, neg = max(p for p, _ in reach), max(n for _, n in reach)
    freq_res = freq_res or best_nfft(pos + neg)
    meta = s.meta
    return {"freq_res": freq_res, "pos": pos, "neg": neg, "response": lambda i: np.fft.fftshift(dispersion_kernel(nchan * freq_res, meta.frequency(i), width, dm))}


def convolve(s: Signal, responses: Callable[[int], np.ndarray], nfft: int, pos: int, neg: int) -> Signal:
    """Overlap-save convolution with responses(ichan), nfft points; pos samples at the start and neg at the end of each part are discarded.

    Of complex samples the response is in FFT order, and of shape (nfft, 2, 2) it acts on both polarizations together. Of real samples, 2 nfft a
    part, it is in order of frequency; what comes out is complex (analytic), at half the rate, from the lowest frequency up.
    """
    real = s.meta.state == NYQUIST
    step = nfft - pos - neg
    if step <= 0:
        raise ValueError("the transform is not longer than its wrap-around")
    jones = responses(0).ndim == 3
    if jones and real:
        raise ValueError("a matrix response acts on complex samples")
    held: dict[int, np.ndarray] = {}

    def of(k: Columns) -> np.ndarray:
        chans = k["ichan"].ravel().tolist()
        held.update((c, responses(c)) for c in set(chans) - set(held))
        return np.stack([held[c] for c in chans])

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        y = np.fft.ifft((np.fft.rfft(x)[:, :nfft] if real else np.fft.fft(x)) * of(k))[:, pos : nfft - neg]
        return [k["ipart"] * step + np.arange(step), k["ichan"], k["ipol"], y.real, y.imag]

    def both(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        z = np.fft.fft(x.reshape(len(x), nfft, 2), axis=1)
        y = np.fft.ifft(np.einsum("rnij,rnj->rni", of(k), z), axis=1)[:, pos : nfft - neg]
        at = (k["ipart"] * step + np.arange(step))[:, :, None]
        return [at, k["ichan"][:, :, None], np.arange(2), y.real, y.imag]

    df = over_frames(s, nfft * (1 + real), step * (1 + real), ("ichan",) if jones else EACH, both if jones else one, SAMPLE)
    parts = n_parts(s.meta.ndat, nfft * (1 + real), step * (1 + real))
    weights = s.carry("over_pols", s.meta.nchan, 2, 2) if jones else s.weights
    weights = weights and weights.transform(s.meta.ndat, nfft * (1 + real), step * (1 + real), 1 + real, parts * step)
    return s.then("convolve", df, weights, ndat=parts * step, rate=s.meta.rate / (1 + real), start_us=s.meta.start_us + round(pos * (1 + real) / s.meta.rate * 1e6), state=ANALYTIC, ndim=2)


def dynamic_filter(s: Signal, responses: dict[int, np.ndarray], bucket: int, nfft: int, pos: int = 0, neg: int = 0) -> Signal:
    """operators.responses.respond() with a few responses for all channels: each holds from its stretch of ``bucket`` samples on."""
    from cadenza.operators.responses import respond

    rows = [(int(b) * bucket, i, np.real(h).astype(float).tolist(), np.imag(h).astype(float).tolist()) for b, h in responses.items() for i in range(s.meta.nchan)]
    return respond(s, s.df.sparkSession.createDataFrame(rows, "epoch long, ichan int, re array<double>, im array<double>"), nfft, pos, neg)


def dedisperse(s: Signal, dm: float, nfft: int | None = None) -> Signal:
    """Coherent dedispersion of complex samples, channel by channel."""
    from cadenza.functions.response import best_nfft, dispersion_kernel, impulse_samples

    meta, width = s.meta, s.meta.channel_width
    reach = [impulse_samples(dm, meta.frequency(i), abs(width), meta.rate) for i in range(meta.nchan)]
    pos, neg = max(p for p, _ in reach), max(n for _, n in reach)
    nfft = nfft or best_nfft(pos + neg)
    out = convolve(s, lambda i: dispersion_kernel(nfft, meta.frequency(i), width, dm), nfft, pos, neg)
    return replace(out, meta=out.meta.but(dm=dm))


def derotate(s: Signal, rm: float, nfft: int) -> Signal:
    """Undoes Faraday rotation of complex samples of two circular polarizations, relative to each channel's centre."""
    from cadenza.functions.response import derotation

    meta = s.meta
    out = convolve(s, lambda i: derotation(nfft, meta.frequency(i), meta.channel_width, rm), nfft, 0, 0)
    return replace(out, meta=out.meta.but(rm=rm))


def polyphase(s: Signal, taps: np.ndarray, nchan: int) -> Signal:
    """Polyphase filterbank of complex samples: ntaps blocks of nchan samples, weighted and summed, then transformed; a part every nchan samples."""
    ntap = len(taps) // nchan
    w = np.asarray(taps)[: ntap * nchan].reshape(ntap, nchan)

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        y = spectra((x.reshape(len(x), ntap, nchan) * w).sum(1), nchan)
        return [k["ipart"], k["ichan"] * nchan + np.arange(nchan), k["ipol"], y.real, y.imag]

    df = over_frames(s, ntap * nchan, nchan, EACH, one, SAMPLE)
    ndat = n_parts(s.meta.ndat, ntap * nchan, nchan)
    weights = s.carry("transform", s.meta.ndat, ntap * nchan, nchan, nchan, ndat, nchan)
    return s.then("polyphase", df, weights, nchan=s.meta.nchan * nchan, ndat=ndat, rate=s.meta.rate / nchan, state=ANALYTIC, ndim=2)


def inverse_filterbank(s: Signal, nfft: int, overlap: int = 0, response: np.ndarray | None = None) -> Signal:
    """Synthesis of one channel from all: each part of each channel is transformed, edges that oversampling repeats are cut off, the rest is put side by
    side in order of frequency, and transformed back; overlap samples at both ends of a part are discarded. The response, in order of frequency over
    what is kept of all channels, may undo the ripple of the filterbank before."""
    over = s.meta.oversampling
    keep = nfft * over.denominator // over.numerator
    if keep * over.numerator != nfft * over.denominator or (keep * overlap) % nfft:
        raise ValueError("lengths are whole multiples of the oversampling")
    edge, nchan, step = (nfft - keep) // 2, s.meta.nchan, nfft - 2 * overlap
    order = sorted(range(nchan), key=s.meta.unswapped)
    cut = overlap * keep // nfft * nchan
    out_step = keep * nchan - 2 * cut

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        z = spectra(x.reshape(len(x), nfft, nchan).transpose(0, 2, 1)[:, order], nfft)[:, :, edge : edge + keep].reshape(len(x), -1)
        z = z if response is None else z * response
        y = np.fft.ifft(np.fft.ifftshift(z, axes=-1)) * nchan * keep / nfft
        y = y[:, cut : keep * nchan - cut]
        return [k["ipart"] * out_step + np.arange(out_step), np.zeros((1, 1)), k["ipol"], y.real, y.imag]

    df = over_frames(s, nfft, step, ("ipol",), one, SAMPLE)
    changes = {"nchan": 1, "ndat": n_parts(s.meta.ndat, nfft, step) * out_step, "rate": s.meta.rate * nchan * keep / nfft, "oversampling": type(over)(1)}
    weights = s.weights and s.weights.merge(nchan, 1, nchan, s.meta.npol).convolve(s.meta.ndat, nfft, step).stretch(nchan * keep, nfft)
    return s.then("inverse_filterbank", df, weights, **changes, start_us=s.meta.start_us + round(overlap / s.meta.rate * 1e6))


def lag_filterbank(s: Signal, nlag: int, spectrum: bool = False) -> DataFrame:
    """(ipart, ichan, ipol, k, v): circular autocorrelation of zero-padded parts of nlag samples, or their power spectrum."""

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        f = np.abs(np.fft.fft(x, 2 * nlag)) ** 2
        return [k["ipart"], k["ichan"], k["ipol"], np.arange(nlag), f[:, :nlag] if spectrum else np.fft.ifft(f).real[:, :nlag]]

    return over_frames(s, nlag, nlag, EACH, one, "ipart long, ichan int, ipol int, k int, v double")


def bandpass(s: Signal, nchan: int) -> DataFrame:
    """Integrated power spectrum by channel, polarization and frequency; of a detected signal, its sum over time."""
    if s.meta.detected:
        return s.df.groupBy("ichan", "ipol").agg(F.sum("v").alias("power")).withColumn("ifreq", F.lit(0))
    powers = power_filterbank(s, nchan).df
    return powers.groupBy(F.expr(f"ichan div {nchan}").cast("int").alias("ichan"), "ipol", (F.col("ichan") % nchan).alias("ifreq")).agg(F.sum("v").alias("power"))


def cross_bandpass(s: Signal, nchan: int) -> DataFrame:
    """(ichan, ipol, ifreq, power): integrated spectra of complex samples of two polarizations: their powers, and as polarizations 2 and 3 the real and
    imaginary parts of the cross spectrum conj(p) q."""

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        z = spectra(x.reshape(len(x), nchan, 2).transpose(0, 2, 1), nchan)
        cross = z[:, 0].conj() * z[:, 1]
        y = np.stack([np.abs(z[:, 0]) ** 2, np.abs(z[:, 1]) ** 2, cross.real, cross.imag], axis=1)
        return [k["ichan"][:, :, None], np.arange(4)[:, None], np.arange(nchan), y]

    powers = map_frames(to_frames(s, nchan, keys=("ichan",)), one, "ichan int, ipol int, ifreq int, v double")
    return powers.groupBy("ichan", "ipol", "ifreq").agg(F.sum("v").alias("power"))


def phase_locked_filterbank(s: Signal, nchan: int, period_us: int, nbin: int, epoch_us: int = 0) -> DataFrame:
    """ibin, ichan, ipol, ifreq, power, hits: transforms that start at each phase bin of each turn, folded; hits counts transforms. Real samples
    make nchan channels of 2 nchan ones."""
    from cadenza.operators.folding import phase_bin, sample_us, turn

    us, n = sample_us(s), nchan * (1 + (s.meta.state == NYQUIST))
    rows = s.df.withColumns({"ibin": phase_bin(us, period_us, nbin, epoch_us), "turn": turn(us, period_us, epoch_us)})
    starts = rows.groupBy("turn", "ibin").agg(F.min("idat").alias("first"))
    covered = starts.select("turn", "ibin", F.explode(F.sequence(F.col("first"), F.col("first") + n - 1)).alias("idat"))
    values = [c for c in ("re", "im", "v") if c in s.df.columns]
    frames = gathered(s.df.join(covered, "idat"), ["turn", "ibin", "ichan", "ipol"], ["idat"], values, n)

    def one(k: Columns, x: np.ndarray) -> list[np.ndarray]:
        return [k["ibin"], k["ichan"], k["ipol"], np.arange(nchan), np.abs(spectra(x, nchan)) ** 2]

    powers = map_frames(frames, one, "ibin int, ichan int, ipol int, ifreq int, p double")
    return powers.groupBy("ibin", "ichan", "ipol", "ifreq").agg(F.sum("p").alias("power"), F.count(F.lit(1)).alias("hits"))
