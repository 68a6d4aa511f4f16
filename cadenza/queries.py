"""The signal queries by name, over the driver's tables, and their SQL.

Signals: events are dealt by number into 4 channels and 2 polarizations, v in cents, complex parts made of v; lineitem gives a longer series in
time. All inputs are integers, so sums are exact in any order; what is fractional is rounded to six places on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.response import taper
from cadenza.functions.sk_limits import limits
from cadenza.meta import ANALYTIC, COHERENCE, INTENSITY, NYQUIST, PP, PPQQ, STOKES, ObsMeta, Signal
from cadenza.operators import chebyshev, delays, detection, digitize, folding, frames, integration, kurtosis, leveling, masking, rescale, responses, selection
from cadenza.plans import pipeline
from cadenza.sources import generators

PERIOD, NBIN = 86_400_000_000 // 7, 16
META = ObsMeta(nchan=4, npol=2, rate=1000.0, centre_frequency=1400.0, bandwidth=400.0, state=PPQQ)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def powers(spark: SparkSession, d: str) -> Signal:
    e = _events(spark, d)
    n = F.col("event_id")
    df = e.select(F.expr("event_id div 8").alias("idat"), F.expr("cast((event_id div 2) % 4 as int)").alias("ichan"), (n % 2).cast("int").alias("ipol"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return Signal(df, META.but(ndat=e.count() // 8))


def voltages(spark: SparkSession, d: str) -> Signal:
    s = powers(spark, d)
    df = s.df.select("idat", "ichan", "ipol", (F.col("v") % 41 - 20).alias("re"), (F.expr("v div 7") % 37 - 18).alias("im"))
    return Signal(df, s.meta.but(state=ANALYTIC, ndim=2))


def series(spark: SparkSession, d: str) -> DataFrame:
    """us, ichan, ipol, v of events by time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _events(spark, d).select("event_id", us.alias("us"), (F.col("user_id") % 4).cast("int").alias("ichan"), F.lit(0).alias("ipol"), F.round(F.col("value") * 100).cast("long").alias("v"))


def weights(s: Signal, block: int = 16) -> DataFrame:
    cells = s.df.select(F.expr(f"idat div {block}").alias("iw"), "ichan", "ipol").distinct()
    return cells.withColumn("weight", ((F.col("iw") * 7 + F.col("ichan") * 3 + F.col("ipol")) % 6).cast("int"))


def six(*names: str):
    return [(F.round(F.col(n).cast("double"), 6) + 0.0).alias(n) for n in names]


SK_M = 32
SK = limits(SK_M, 3.0)
SAMPLES = ("idat", "ichan", "ipol", "v")
CELLS = [(3, 20), (15, 30), (100, 101), (400, 520)]


def _fold(s, d, **k):
    df = series(s, d)
    return folding.fold(df, F.col("us"), PERIOD, NBIN, **k)


def q_fold_period(s, d):
    out = folding.profile(_fold(s, d))
    return out.select("ichan", "ipol", "ibin", "total", "hits", *six("mean"))


def q_fold_lineitem(s, d):
    df = s.read.parquet(f"{d}/lineitem.parquet")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") * 1_000_003
    rows = df.select(us.alias("us"), F.col("l_linenumber").cast("int").alias("ichan"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    return folding.fold(rows, F.col("us"), PERIOD, 64, keys=("ichan",))


def q_fold_weighted(s, d):
    df = series(s, d).withColumn("iw", F.expr("event_id div 16"))
    return folding.fold(df, F.col("us"), PERIOD, NBIN, weight=(F.col("iw") * 7 + F.col("ichan")) % 5)


def q_fold_zeroed(s, d):
    df = series(s, d).withColumn("v", F.when(F.col("v") % 10 == 0, 0).otherwise(F.col("v")))
    return folding.fold(df, F.col("us"), PERIOD, NBIN, zeroed=True)


def q_subint_fold_seconds(s, d):
    return _fold(s, d, division=folding.by_seconds(F.col("us"), 3_600_000_000 * 24, 1_704_067_200_000_000))


def q_subint_fold_turns(s, d):
    return _fold(s, d, division=folding.by_turns(F.col("us"), PERIOD, 10, 1_704_067_200_000_000), epoch_us=1_704_067_200_000_000)


START, DAY = 1_704_067_200_000_000, 86_400_000_000


def predictor(s: SparkSession) -> DataFrame:
    """A predictor of 730 one-day segments, about seven turns a day with a drift and a curvature that change from day to day."""
    k = F.col("id")
    return s.range(730).select(
        k.alias("segment"), (k * DAY + START + DAY // 2).alias("mid_us"), (k * 7).cast("long").alias("turns"), ((k * 37 % 100) / 128.0).alias("fraction"),
        (F.lit(7.0) / 86400).alias("f0"), F.array(F.lit(0.0625), (k % 5) / 65536.0, (k % 3) / 16777216.0).alias("coeffs"),
    )


def _predicted(s, d) -> DataFrame:
    return folding.predicted(series(s, d), F.col("us"), predictor(s), START, DAY)


def q_fold_predictor(s, d):
    return folding.fold_predicted(_predicted(s, d), NBIN)


def q_subint_fold_predictor(s, d):
    """Sub-integrations of ten turns, phases counted from a reference phase of a quarter."""
    return folding.fold_predicted(_predicted(s, d), NBIN, turns=10, reference_phase=0.25)


def frequency_predictor(s: SparkSession) -> DataFrame:
    """Segments of a day over 1200 to 1600 MHz, about seven turns each, with terms in time and frequency that change from day to day."""
    k = F.col("id")
    rows = F.array(F.array(F.lit(3.5), (k % 7) / 64.0, F.lit(0.03125)), F.array(F.lit(3.5), (k % 5) / 128.0), F.array((k % 3) / 32.0, F.lit(-0.015625)))
    return s.range(730).select(k.alias("segment"), (k * DAY + START).alias("start_us"), F.lit(DAY).alias("length_us"), F.lit(1200.0).alias("f_low"), F.lit(1600.0).alias("f_high"), (k * 7).alias("turns"), rows.alias("coeffs"))


def q_fold_predictor_frequency(s, d):
    """Folds by a predictor that knows each channel's frequency."""
    rows = chebyshev.predicted(series(s, d), F.col("us"), F.col("ichan") * 100 + 1250.0, frequency_predictor(s), START, DAY)
    return folding.fold_predicted(rows, NBIN)


def q_fold_bookkeeping(s, d):
    """Samples offered and folded, and the time that these cover, by day, where every tenth value is zeroed."""
    df = series(s, d).withColumn("v", F.when(F.col("v") % 10 == 0, 0).otherwise(F.col("v")))
    division = folding.by_seconds(F.col("us"), DAY, START)
    folded = folding.fold(df, F.col("us"), PERIOD, NBIN, division=division, zeroed=True)
    return folding.bookkeeping(df, folded, 1000.0, ("ichan",), division).select("division", "ichan", "ndat_total", "ndat_folded", *six("integration_us"))


def q_unpack_msb(s, d):
    """Two-bit codes of bytes made of the values, the first sample in the highest bits."""
    sig = powers(s, d)
    raw = F.unhex(F.lpad(F.hex(F.col("v") % 256), 2, "0"))
    blocks = sig.df.select("ichan", "ipol", F.col("idat").alias("block"), F.lit(4).cast("long").alias("ndat"), raw.alias("raw"))
    return digitize.unpack(blocks, 2, 4, signed=False, order="msb")


def q_fold_many(s, d):
    """Three folds in one pass."""
    return folding.fold_many(series(s, d), F.col("us"), [(PERIOD, 16), (PERIOD * 2, 8), (86_400_000_000, 24)])


def q_fold_combine(s, d):
    df = series(s, d)
    half = lambda k: folding.fold(df.filter(F.col("event_id") % 2 == k), F.col("us"), PERIOD, NBIN)
    return folding.combine([half(0), half(1)])


def q_fold_drop_short(s, d):
    return folding.drop_short(q_subint_fold_seconds(s, d), 330)


def _samples(sig: Signal) -> DataFrame:
    return sig.df.select(*SAMPLES)


def q_tscrunch(s, d):
    return _samples(integration.tscrunch(powers(s, d), 6))


def q_fscrunch(s, d):
    return _samples(integration.fscrunch(powers(s, d), 2))


def q_scrunch_fused(s, d):
    return _samples(pipeline.build(powers(s, d), [pipeline.Step("tscrunch", {"factor": 2}), pipeline.Step("fscrunch", {"factor": 4}), pipeline.Step("tscrunch", {"factor": 3})]))


def q_pscrunch_intensity(s, d):
    return _samples(integration.pscrunch(powers(s, d)))


def q_pscrunch_pp(s, d):
    return _samples(integration.pscrunch(powers(s, d), PP))


def _detect(state):
    return lambda s, d: _samples(detection.detect(voltages(s, d), state))


def q_detect_nyquist(s, d):
    """Real samples, both polarizations summed."""
    sig = powers(s, d)
    return _samples(detection.detect(Signal(sig.df.withColumn("v", F.col("v") % 41 - 20), sig.meta.but(state=NYQUIST)), INTENSITY))


def q_slice_path(s, d):
    """Samples 50 to 99 of a dedispersed signal."""
    return _samples(pipeline.slice_path(powers(s, d), 50_000, 100_000, 50.0))


def q_fourth_moment(s, d):
    return integration.fourth_moment(detection.detect(voltages(s, d), STOKES))


def _reshape(n):
    return lambda s, d: _samples(selection.poln_reshape(voltages(s, d), n))


def q_poln_select(s, d):
    return _samples(selection.poln_select(powers(s, d), 1))


def q_chan_pol_select(s, d):
    return _samples(selection.chan_pol_select(powers(s, d), (1, 2), (1, 1)))


def q_fzoom(s, d):
    return _samples(selection.fzoom(powers(s, d), 1450.0, 180.0))


def q_truncate(s, d):
    return _samples(selection.truncate(powers(s, d), 100_000))


def q_chomp(s, d):
    return _samples(selection.chomp(powers(s, d), 500, 64))


def q_resize(s, d):
    return _samples(selection.resize(powers(s, d), -37))


def q_delay_start(s, d):
    return _samples(selection.delay_start(powers(s, d), 50_000))


def q_channel_order(s, d):
    return _samples(selection.channel_order(powers(s, d), [2, 3, 0, 1]))


def q_stats(s, d):
    return integration.stats(powers(s, d)).select("ichan", "ipol", "n", "total", "total_sq", *six("mean", "sigma"))


def _rescaled(method, n):
    return lambda s, d: rescale.rescale(powers(s, d), method, n).df.select("idat", "ichan", "ipol", *six("v"))


def q_rescale_constant(s, d):
    return rescale.constant_rescale(powers(s, d), nsample=100).df.select("idat", "ichan", "ipol", *six("v"))


def q_running_mean(s, d):
    return rescale.running_mean(powers(s, d), 5).df.select("idat", "ichan", "ipol", *six("v"))


def q_mask_times(s, d):
    return _samples(masking.mask_times(powers(s, d), s.createDataFrame(CELLS, "start long, end long")))


def q_rfi_filter(s, d):
    """128 channels of noise made from the events, one of them a hundred times as strong and one twice."""
    sig = powers(s, d)
    df = sig.df.select("idat", F.expr("cast((idat * 8 + ichan * 2 + ipol) % 128 as int)").alias("ichan"), F.lit(0).alias("ipol"), "v")
    df = df.withColumn("v", F.when(F.col("ichan") == 77, F.col("v") * 100).when(F.col("ichan") == 30, F.col("v") * 2).otherwise(F.col("v")))
    return _samples(masking.rfi_filter(Signal(df, sig.meta.but(nchan=128, npol=1)))[0])


def q_weights_mask(s, d):
    return masking.mask_weights(weights(powers(s, d)))


def q_weights_convolve(s, d):
    sig = powers(s, d)
    return masking.convolve_weights(weights(sig), 64, 48, 16, sig.meta.ndat)


def q_weights_scrunch(s, d):
    """Three weights in one; what is left makes one more."""
    return masking.scrunch_weights(weights(powers(s, d)), 3)[0]


def weighted(sig: Signal) -> Signal:
    return sig.with_weights(weights(sig), 16)


def _weighed(sig: Signal) -> DataFrame:
    return sig.weighed().select(*SAMPLES, "weight")


def q_weighted_select(s, d):
    return _weighed(selection.chan_pol_select(weighted(powers(s, d)), (1, 2), (1, 1)))


def q_weighted_cut(s, d):
    """What is left behind a start that cuts a block, up to an end that cuts one."""
    return _weighed(selection.truncate(selection.delay_start(weighted(powers(s, d)), 37_000), 190_000))


def q_weighted_tscrunch(s, d):
    """Sums of six samples, which blocks of 16 don't hold evenly."""
    return _weighed(integration.tscrunch(weighted(powers(s, d)), 6))


def q_weighted_pscrunch(s, d):
    return _weighed(integration.pscrunch(integration.fscrunch(weighted(powers(s, d)), 2)))


def q_weighted_delay(s, d):
    return _weighed(delays.sample_delay(weighted(powers(s, d)), [(0, 0), (1, 5), (2, 11), (3, 2)]))


def q_weighted_channelize(s, d):
    """Sub-bands of eight points of which five are kept: transforms of 64 samples every 40."""
    return frames.channelize(weighted(voltages(s, d)), 8, freq_res=8, pos=1, neg=2).weighed().select("idat", "ichan", "ipol", "weight")


def q_weighted_fold(s, d):
    """Selection, sums, delays and fold in one plan; bad samples are skipped channel by channel."""
    sig = selection.chan_pol_select(weighted(powers(s, d)), (1, 3))
    return folding.fold_signal(delays.sample_delay(integration.tscrunch(sig, 2), [(0, 0), (1, 5), (2, 3)]), 64_000, 16)


def q_apply_weights(s, d):
    sig = powers(s, d)
    return _samples(masking.apply_weights(sig, weights(sig), 16))


def q_sample_delay(s, d):
    return _samples(delays.sample_delay(powers(s, d), [(0, 0), (1, 5), (2, 11), (3, 2)]))


def q_sample_delay_pol(s, d):
    """Delays of their own for each polarization."""
    return _samples(delays.sample_delay(powers(s, d), [(c, p, 3 * c + 7 * p) for c in range(4) for p in (0, 1)]))


def q_sk_time_within(s, d):
    """Channels 1 to 3 without 2 decide."""
    return kurtosis.time(kurtosis.within(_blocks(s, d), [(1, 3)], [(2, 2)]), SK.symmetric)


def q_fscrunch_floor(s, d):
    """Three channels in one; the fourth is left over."""
    return _samples(integration.fscrunch(powers(s, d), 3))


def q_dispersion_delay(s, d):
    sig = powers(s, d)
    return _samples(delays.sample_delay(sig, delays.dispersion_delays(sig, 50.0)))


def _blocks(s, d):
    return kurtosis.sums(powers(s, d), SK_M)


def q_sk_sums(s, d):
    return _blocks(s, d)


def q_sk_coarser(s, d):
    return kurtosis.coarser(_blocks(s, d), 4)


def q_sk_overlap(s, d):
    return kurtosis.coarser(_blocks(s, d), 4, 2)


def q_sk_estimate(s, d):
    return _blocks(s, d).select("iw", "ichan", "ipol", kurtosis.estimate(F.col("s1"), F.col("s2"), F.col("n")).alias("sk")).select("iw", "ichan", "ipol", *six("sk"))


def q_sk_time_freq(s, d):
    return kurtosis.time_freq(_blocks(s, d), SK.lower, SK.upper)


def q_sk_freq(s, d):
    return kurtosis.freq(_blocks(s, d), 3.0)


def q_sk_time(s, d):
    return kurtosis.time(_blocks(s, d), SK.symmetric)


def q_sk_excise(s, d):
    return _samples(kurtosis.excise(powers(s, d), q_sk_time_freq(s, d), SK_M))


def q_sk_adaptive(s, d):
    return kurtosis.adaptive(powers(s, d), [32, 64, 128], 0.5).select("iw", "ichan", "bad")


def q_sk_configured(s, d):
    """Blocks of 128 that start every 64 samples, without channel 2, after blocks of 64 of channels 0 and 1."""
    text = '[{"M": 64, "include": [0, 1]}, {"M": 128, "overlap": 2, "exclude": [[2, 2]]}]'
    return kurtosis.adaptive(powers(s, d), kurtosis.parse_config(text), 0.5).select("iw", "ichan", "bad")


def q_zap_weight(s, d):
    return kurtosis.zap_weight(_blocks(s, d), SK.lower, SK.upper, 0.2, 2.4, 1)


def q_excision_nlow(s, d):
    return digitize.excision(powers(s, d), 3000.0, 32, 10, 20)


def q_state_histogram(s, d):
    return digitize.histogram(digitize.digitize(Signal(powers(s, d).df.withColumn("v", (F.col("v") - 5000) / 4000.0), META), 4))


def _digitize(nbit):
    def run(s, d):
        sig = powers(s, d)
        return _samples(digitize.digitize(Signal(sig.df.withColumn("v", (F.col("v") - 5000) / 4096.0), sig.meta), nbit))

    return run


def q_filterbank_digitize(s, d):
    sig = powers(s, d)
    return _samples(digitize.filterbank_digitize(Signal(sig.df.withColumn("v", (F.col("v") - 5000) / 4096.0), sig.meta), 8))


def _filterbank_digitize(nbit):
    def run(s, d):
        sig = powers(s, d)
        return _samples(digitize.filterbank_digitize(Signal(sig.df.withColumn("v", (F.col("v") - 5000) / 4096.0), sig.meta), nbit))

    return run


def q_table_digitize(s, d):
    """Eight-bit codes by the scale and offset of each block of 64 samples."""
    sig = powers(s, d)
    return _samples(digitize.table_digitize(sig, digitize.table_scale_offset(sig, 64, 1), 64))


def q_table_scale_offset(s, d):
    return digitize.table_scale_offset(powers(s, d), 64, 4).select("ib", "ichan", "ipol", *six("scale", "offset"))


def q_level_lookup(s, d):
    sig = powers(s, d)
    return digitize.lookup(Signal(sig.df.withColumn("v", F.col("v") % 4), sig.meta), digitize.level_table(2)).df.select(*SAMPLES)


LEVELS = leveling.Target(variance=1.0, variance_tolerance=0.05, mean_tolerance=0.05, watch=True)


def q_level_setting(s, d):
    """Gains and levels by integrations of 64 samples, over the whole table, all digitizers together."""
    out = leveling.set_levels(powers(s, d), 64, LEVELS)
    return out.select("iteration", "epoch", "ichan", "ipol", "n", *six("mean", "variance", "gain", "level"), "far")


def q_level_apply(s, d):
    """Samples after the gain and level that the integration before them set, each digitizer for itself."""
    sig = powers(s, d)
    return leveling.apply_levels(sig, leveling.set_levels(sig, 64, LEVELS, together=False), 64).df.select("idat", "ichan", "ipol", *six("v"))


def q_two_bit_correct(s, d):
    sig = powers(s, d)
    levels = s.range(65).select(F.col("id").alias("nlow"), (F.col("id") * 2).alias("low"), (F.col("id") * 5 + 1).alias("high"))
    return _samples(digitize.two_bit_correct(Signal(sig.df.withColumn("v", F.col("v") % 4), sig.meta), levels, 64))


def q_two_bit_optimal(s, d):
    """Levels that Gaussian noise with a block's share of low codes would have."""
    sig = powers(s, d)
    levels = s.createDataFrame(digitize.optimal_two_bit_levels(64), "nlow long, low double, high double")
    out = digitize.two_bit_correct(Signal(sig.df.withColumn("v", F.col("v") % 4), sig.meta), levels, 64)
    return out.df.select("idat", "ichan", "ipol", *six("v"))


def _round_trip(nbit):
    def run(s, d):
        sig = powers(s, d)
        low = 1 << nbit - 1
        codes = Signal(sig.df.withColumn("v", F.col("v") % (2 * low) - low), sig.meta.but(ndat=sig.meta.ndat // 64 * 64))
        return digitize.unpack(digitize.pack(Signal(codes.df.filter(F.col("idat") < codes.meta.ndat), codes.meta), nbit, 64), nbit, 64)

    return run


def q_impulse_train(s, d):
    """Pulses put into one channel and polarization of the events, of the signal's length."""
    sig = selection.chan_pol_select(powers(s, d), (0, 0), (0, 0))
    return _samples(integration.superpose([sig, generators.impulse_train(s, sig.meta.ndat, 37, 5000, 3)]))


def q_superposition(s, d):
    """The channels of the first polarization on top of each other, and two trains."""
    sig = selection.poln_select(powers(s, d), 0)
    bands = [selection.chan_pol_select(sig, (c, c)) for c in range(4)]
    return _samples(integration.superpose([*bands, generators.impulse_train(s, sig.meta.ndat, 41, 700), generators.impulse_train(s, sig.meta.ndat, 64, 1)]))


def q_multiplex(s, d):
    sig = powers(s, d)
    one = lambda c, p: sig.df.filter(f"ipol = {p} AND ichan = {c}").select("idat", "v")
    return generators.multiplex([one(c, p) for c in range(4) for p in (0, 1)], 16)


def q_dual(s, d):
    sig = powers(s, d)
    one = lambda p: sig.df.filter(f"ipol = {p}").select("idat", "ichan", "v")
    return generators.dual(one(0), one(1)).select(*SAMPLES)


def q_parallel_input(s, d):
    """Four streams of one channel each, twice as strong, as one signal."""
    sig = powers(s, d)
    one = lambda c: Signal(sig.df.filter(f"ichan = {c}").select("idat", F.lit(0).alias("ichan"), "ipol", (F.col("v") * 2).alias("v")), sig.meta.but(nchan=1, bandwidth=100.0, centre_frequency=1250.0 + 100 * c))
    return _samples(generators.parallel([one(c) for c in range(4)]))


def q_serial_concat(s, d):
    sig = powers(s, d)
    after = Signal(sig.df.withColumn("v", F.col("v") + 1), sig.meta.but(start_us=sig.meta.ndat * 1000))
    return _samples(integration.serial([sig, after]))


def q_difference_rms(s, d):
    a = powers(s, d)
    b = Signal(a.df.withColumn("v", F.col("v") + F.col("idat") % 3), a.meta)
    return integration.difference_rms(a, b).select("ichan", "ipol", *six("rms"), "differ")


def q_autocorrelation(s, d):
    return integration.autocorrelation(powers(s, d), 4)


def q_cyclic_fold(s, d):
    return folding.cyclic_fold(voltages(s, d), 32_000, 8, 4)


def q_cyclic_fold_cross(s, d):
    return folding.cyclic_fold(voltages(s, d), 32_000, 8, 4, products=4)


def q_cyclic_fold_sum(s, d):
    return folding.cyclic_fold(voltages(s, d), 32_000, 8, 4, products=1)


def q_cyclic_spectrum(s, d):
    return folding.cyclic_spectrum(q_cyclic_fold(s, d), 4).select("ichan", "ipol", "ibin", "ifreq", *six("power"))


def q_channelize_dft(s, d):
    return frames.channelize(voltages(s, d), 8).df.select("idat", "ichan", "ipol", *six("re", "im"))


def q_taper_channelize(s, d):
    return frames.channelize(voltages(s, d), 8, taper=taper("hanning", 8)).df.select("idat", "ichan", "ipol", *six("re", "im"))


def q_power_filterbank(s, d):
    return frames.power_filterbank(voltages(s, d), 8, sum_pols=True).df.select("idat", "ichan", "ipol", *six("v"))


def q_bandpass(s, d):
    return frames.bandpass(voltages(s, d), 8).select("ichan", "ipol", "ifreq", *six("power"))


def q_lag_filterbank(s, d):
    return frames.lag_filterbank(powers(s, d), 8).select("ipart", "ichan", "ipol", "k", F.round("v", 3).alias("v"))


def q_convolve_shift(s, d):
    """A response that is a pure delay of three samples, by overlap-save: the input, three samples later."""
    import numpy as np

    return frames.convolve(voltages(s, d), lambda i: np.exp(-2j * np.pi * np.fft.fftfreq(64) * 3), 64, 3, 0).df.select("idat", "ichan", "ipol", *six("re", "im"))


def q_polyphase(s, d):
    import numpy as np

    return frames.polyphase(voltages(s, d), np.arange(1, 17) / 16.0, 4).df.select("idat", "ichan", "ipol", *six("re", "im"))


def q_inverse_filterbank(s, d):
    """Synthesis of what channelize() has split gives the voltages again, scaled."""
    return frames.inverse_filterbank(frames.channelize(voltages(s, d), 4), 1).df.select("idat", "ichan", "ipol", *six("re", "im"))


def _rounded(sig: Signal, digits: int, *names: str) -> DataFrame:
    return sig.df.select("idat", "ichan", "ipol", *((F.round(F.col(n), digits) + 0.0).alias(n) for n in names))


def q_filterbank_freq_res(s, d):
    """Sub-bands of 8 points transformed back to time; the first sample and the last two of each part are discarded."""
    return _rounded(frames.channelize(voltages(s, d), 4, freq_res=8, pos=1, neg=2), 4, "re", "im")


def q_filterbank_dedisperse(s, d):
    sig = voltages(s, d)
    return _rounded(frames.channelize(sig, 4, **frames.dedispersing(sig, 4, 0.01, 8)), 3, "re", "im")


def q_filterbank_power_dedisperse(s, d):
    sig = voltages(s, d)
    return _rounded(frames.power_filterbank(sig, 4, sum_pols=True, **frames.dedispersing(sig, 4, 0.01, 8)), 2, "v")


def q_cross_bandpass(s, d):
    return frames.cross_bandpass(voltages(s, d), 8).select("ichan", "ipol", "ifreq", (F.round("power", 3) + 0.0).alias("power"))


def q_inverse_filterbank_overlap(s, d):
    """The whole table as one channel a polarization, split into 64, and put together again from overlapping parts."""
    e = _events(s, d)
    v = F.round(F.col("value") * 100).cast("long")
    df = e.select(F.expr("event_id div 2").alias("idat"), F.lit(0).alias("ichan"), (F.col("event_id") % 2).cast("int").alias("ipol"), (v % 41 - 20).alias("re"), (F.expr("cast(round(value * 100) as bigint) div 7") % 37 - 18).alias("im"))
    sig = Signal(df, META.but(nchan=1, ndat=e.count() // 2, state=ANALYTIC, ndim=2))
    return _rounded(frames.inverse_filterbank(frames.channelize(sig, 64), 8, 2), 3, "re", "im")


def q_dynamic_response(s, d):
    """Gains and delays that change with time by channel, from the samples themselves: each part takes the last response before it."""
    sig = voltages(s, d)
    at = powers(s, d).df.filter("ipol = 0 AND (idat * 7 + ichan * 13) % 61 = 0")
    point = lambda f: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.col("v") % 5 + 1) * f(k * (F.col("v") % 3) * (-2 * math.pi / 8)))
    table = at.select(F.col("idat").alias("epoch"), "ichan", point(F.cos).alias("re"), point(F.sin).alias("im"))
    return _rounded(responses.respond(sig, table, 8, bucket=64), 4, "re", "im")


def q_dedisperse(s, d):
    return frames.dedisperse(voltages(s, d), 0.001, 64).df.select("idat", "ichan", "ipol", *six("re", "im"))


def q_phase_locked_filterbank(s, d):
    return frames.phase_locked_filterbank(voltages(s, d), 8, 32_000, 4).select("ibin", "ichan", "ipol", "ifreq", *six("power"), "hits")


def q_phase_locked_real(s, d):
    """Eight channels of transforms of sixteen real samples."""
    sig = powers(s, d)
    sig = Signal(sig.df.withColumn("v", F.col("v") % 41 - 20), sig.meta.but(state=NYQUIST))
    return frames.phase_locked_filterbank(sig, 8, 32_000, 4).select("ibin", "ichan", "ipol", "ifreq", *six("power"), "hits")


def q_fold_path_voltages(s, d):
    """Voltages split into sixteen channels, dedispersed as they are split, detected, delayed and folded."""
    out = pipeline.fold_path(voltages(s, d), 64_000, 16, dm=0.01, channels="4:D")
    return out.select("ichan", "ipol", "ibin", (F.round("total", 2) + 0.0).alias("total"), "hits")


def q_baseline_decay(s, d):
    return rescale.baseline_decay(powers(s, d), 16.0).df.select("idat", "ichan", "ipol", (F.round("v", 3) + 0.0).alias("v"))


def q_quantize_path(s, d):
    return _samples(pipeline.quantize_path(powers(s, d), 8, (1, 2), (0, 0)))


def q_filterbank_path(s, d):
    return _samples(pipeline.filterbank_path(voltages(s, d), 8, time=2, freq=4))


def q_fold_path(s, d):
    return pipeline.fold_path(powers(s, d), 64_000, 16, sk=(SK_M, 3.0), subint_us=200_000)


QUERIES = {k[2:]: f for k, f in globals().items() if k.startswith("q_")} | {
    "detect_intensity": _detect(INTENSITY),
    "detect_ppqq": _detect(PPQQ),
    "detect_pp": _detect(PP),
    "detect_coherence": _detect(COHERENCE),
    "detect_stokes": _detect(STOKES),
    "poln_reshape4": _reshape(4),
    "poln_reshape2": _reshape(2),
    "poln_reshape1": _reshape(1),
    "rescale_meanstd": _rescaled(rescale.mean_std, None),
    "rescale_interval": _rescaled(rescale.mean_std, 100),
    "rescale_medianmad": _rescaled(rescale.median_mad, 200),
    "filterbank_digitize1": _filterbank_digitize(1),
    "filterbank_digitize2": _filterbank_digitize(2),
    "filterbank_digitize4": _filterbank_digitize(4),
    "filterbank_digitize16": _filterbank_digitize(16),
    "digitize1": _digitize(1),
    "digitize2": _digitize(2),
    "digitize4": _digitize(4),
    "digitize8": _digitize(8),
    "digitize16": _digitize(16),
    "pack_unpack2": _round_trip(2),
    "pack_unpack4": _round_trip(4),
    "pack_unpack8": _round_trip(8),
    "pack_unpack16": _round_trip(16),
}
