"""Quantizing to n bits, packing, unpacking, state histograms and excision by low-voltage counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.meta import Signal
from cadenza.operators.blocks import looking_back

#: Output mean and scale of the voltage digitizer by bits (floats pass through).
VOLTAGE = {1: (0.0, 1.0), 2: (-0.5, 1.03), 4: (-0.5, 3.14), 8: (-0.5, 10.1), 16: (-0.5, 1106.4), -32: (0.0, 1.0)}
#: Mean, scale and largest code of unsigned filterbank samples by bits.
UNSIGNED = {1: (0.5, 1.0, 1), 2: (1.5, 1.0, 3), 4: (7.5, 7.5 / 6, 15), 8: (127.5, 127.5 / 6, 255), 16: (32768.0, 32768.0 / 6, 65535)}


def voltage_code(v: Column, nbit: int, scale: float = 1.0, scale_factor: float = 1.0) -> Column:
    """Signed code: rounded half away from zero, clipped to the range of nbit; one bit is the sign."""
    if nbit == -32:
        return v.cast("float")
    mean, unit = VOLTAGE[nbit]
    if nbit == 1:
        return (v >= 0).cast("int")
    low, high = -(1 << nbit - 1), (1 << nbit - 1) - 1
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(v * F.lit(unit / (scale * scale_factor)) + F.lit(mean)).cast("int")))


def digitize(s: Signal, nbit: int, scale_factor: float = 1.0) -> Signal:
    return s.then("digitize", s.df.withColumn("v", voltage_code(F.col("v"), nbit, s.meta.scale, scale_factor)), nbit=nbit)


def unsigned_code(v: Column, nbit: int, rescaled: bool = True, cross: Column | None = None) -> Column:
    """Unsigned filterbank code of a normalised sample: scaled, a half added, truncated, clipped. Samples that are not rescaled
    are taken as they are, cross products with an offset."""
    if nbit == -32:
        return v.cast("float")
    mean, unit, top = UNSIGNED[nbit]
    value = v * F.lit(unit) + F.lit(mean) if rescaled else v + (F.when(cross, F.lit(mean)).otherwise(F.lit(0.0)) if cross is not None else 0)
    return F.greatest(F.lit(0), F.least(F.lit(top), (value + 0.5).cast("int")))


def filterbank_digitize(s: Signal, nbit: int, rescaled: bool = True) -> Signal:
    """Codes with channels in descending order of frequency, swaps undone, and the bandwidth negative."""
    order = sorted(range(s.meta.nchan), key=lambda i: -s.meta.frequency(i))
    new = [order.index(i) for i in range(s.meta.nchan)]
    at = F.element_at(F.array(*map(F.lit, new)), F.col("ichan") + 1)
    df = s.df.select("idat", at.alias("ichan"), "ipol", unsigned_code(F.col("v"), nbit, rescaled, F.col("ipol") > 1).alias("v"))
    return s.then("filterbank_digitize", df, s.carry("reorder", new, s.meta.npol), nbit=nbit, bandwidth=-abs(s.meta.bandwidth), swap=False, nsub_swap=0)


def table_scale_offset(s: Signal, nsamp: int, nblock: int, nbit: int = 8) -> DataFrame:
    """scale and offset by block of nsamp samples, channel and polarization, averaged over the last nblock blocks."""
    top = UNSIGNED[nbit][2]
    one = s.df.groupBy(F.expr(f"idat div {nsamp}").alias("ib"), "ichan", "ipol").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"))
    one = looking_back(one, "ib", nblock - 1, ("ichan", "ipol"), {"mean": F.avg("m"), "square": F.avg("q")})
    mean, square = F.col("mean"), F.col("square")
    sd = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    scale = F.when(sd > 0, sd * 12 / (top + 1)).otherwise(1.0)
    return one.select("ib", "ichan", "ipol", scale.alias("scale"), (mean - scale * (top + 1) / 2).alias("offset"))


def table_digitize(s: Signal, scales: DataFrame, nsamp: int, nbit: int = 8) -> Signal:
    """Unsigned codes of samples by the scale and offset of their block of nsamp samples, channel and polarization: (v - offset) / scale, rounded, clipped."""
    rows = s.df.withColumn("ib", F.expr(f"idat div {nsamp}")).join(scales, ["ib", "ichan", "ipol"])
    value = F.floor((F.col("v") - F.col("offset")) / F.col("scale") + 0.5)
    code = F.greatest(F.lit(0), F.least(F.lit(UNSIGNED[nbit][2]), value)).cast("int")
    return s.then("table_digitize", rows.select("idat", "ichan", "ipol", code.alias("v")), nbit=nbit)


def _shifts(nbit: int, order: str) -> np.ndarray:
    """Places of a byte's codes in time: from its highest bits down (msb), or from its lowest up (lsb)."""
    if order not in ("msb", "lsb"):
        raise ValueError("the bit order is msb or lsb")
    return np.arange(8 // nbit)[:: -1 if order == "msb" else 1] * nbit


def pack(s: Signal, nbit: int, samples_per_block: int = 4096, order: str = "lsb") -> DataFrame:
    """(ichan, ipol, block, raw): codes packed in bytes by bit order (lsb: the first sample in the lowest bits), one row a block of time."""
    whole = s.df.filter(F.col("idat") < s.meta.ndat // samples_per_block * samples_per_block) if s.meta.ndat >= samples_per_block else s.df

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pack_codes(pdf.sort_values("idat")["v"].to_numpy(), nbit, order)
        return pd.DataFrame({"ichan": [pdf["ichan"].iloc[0]], "ipol": [pdf["ipol"].iloc[0]], "block": [pdf["b"].iloc[0]], "ndat": [len(pdf)], "raw": [raw]})

    rows = whole.withColumn("b", F.expr(f"idat div {samples_per_block}"))
    return rows.groupBy("ichan", "ipol", "b").applyInPandas(run, "ichan int, ipol int, block long, ndat long, raw binary")


def pack_codes(v: np.ndarray, nbit: int, order: str = "lsb") -> bytes:
    """Codes as bytes; wider ones are little-endian, signed or not alike."""
    codes = np.asarray(v).astype(np.int64) & (1 << nbit) - 1
    if nbit >= 8:
        return codes.astype(f"<u{nbit // 8}").tobytes()
    codes = np.pad(codes, (0, -len(codes) % (8 // nbit))).reshape(-1, 8 // nbit)
    return (codes << _shifts(nbit, order)).sum(1).astype(np.uint8).tobytes()


def unpack(blocks: DataFrame, nbit: int, samples_per_block: int = 4096, signed: bool = True, order: str = "lsb") -> DataFrame:
    """Samples (idat, ichan, ipol, v) of packed blocks."""

    def run(batches):
        for pdf in batches:
            out = []
            for c, p, b, n, raw in zip(pdf["ichan"], pdf["ipol"], pdf["block"], pdf["ndat"], pdf["raw"]):
                v = unpack_bytes(raw, nbit, signed, order)[:n]
                out.append(pd.DataFrame({"idat": b * samples_per_block + np.arange(len(v)), "ichan": c, "ipol": p, "v": v}))
            yield pd.concat(out) if out else pd.DataFrame({"idat": [], "ichan": [], "ipol": [], "v": []})

    return blocks.mapInPandas(run, "idat long, ichan int, ipol int, v int")


def unpack_bytes(raw: bytes, nbit: int, signed: bool = True, order: str = "lsb") -> np.ndarray:
    if nbit >= 8:
        return np.frombuffer(raw, dtype=f"<{'i' if signed else 'u'}{nbit // 8}").astype(np.int32)
    v = (np.frombuffer(raw, dtype=np.uint8)[:, None] >> _shifts(nbit, order) & (1 << nbit) - 1).ravel().astype(np.int32)
    return np.where(v >= 1 << nbit - 1, v - (1 << nbit), v) if signed and nbit > 1 else v


def level_table(nbit: int, twos_complement: bool = False) -> list[float]:
    """Value of each code: unit spacing over the number of codes' half, centred on zero."""
    n = 1 << nbit
    order = [(i + n // 2) % n for i in range(n)] if twos_complement else range(n)
    return [(i - (n - 1) / 2) * 2 / n for i in order]


def lookup(s: Signal, table: list[float]) -> Signal:
    """Codes (0 up) to values through a literal table."""
    return s.then("lookup", s.df.withColumn("v", F.element_at(F.array(*map(F.lit, table)), F.col("v").cast("int") + 1)))


def histogram(s: Signal) -> DataFrame:
    """Number of samples in each digitizer state."""
    return s.df.groupBy("ichan", "ipol", F.col("v").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def low_counts(s: Signal, threshold: float, ndat_per_weight: int) -> DataFrame:
    """nlow: samples of each block whose magnitude is below a threshold."""
    return s.df.groupBy(F.expr(f"idat div {ndat_per_weight}").alias("iw"), "ichan", "ipol").agg(F.sum((F.abs(F.col("v")) < threshold).cast("long")).alias("nlow"))


def excision_limits(ndat_per_weight: int, sigma: float = 3.0, fraction: float = 0.6826895) -> tuple[int, int]:
    """Least and most low-voltage samples of undisturbed noise: sigma deviations of a binomial count."""
    spread = sigma * (ndat_per_weight * fraction * (1 - fraction)) ** 0.5
    return max(0, int(ndat_per_weight * fraction - spread)), min(ndat_per_weight, int(ndat_per_weight * fraction + spread) + 1)


def excision(s: Signal, threshold: float, ndat_per_weight: int, nlow_min: int, nlow_max: int) -> DataFrame:
    """(iw, ichan, ipol, nlow, weight): weight 0 where nlow is outside the limits."""
    return low_counts(s, threshold, ndat_per_weight).withColumn("weight", F.col("nlow").between(nlow_min, nlow_max).cast("int"))


def two_bit_correct(s: Signal, levels: DataFrame, ndat_per_weight: int, low_codes: tuple[int, int] = (1, 2)) -> Signal:
    """Two-bit codes to values chosen by the block's number of low codes: levels(nlow, low, high) has one row a count (bounded by the block size)."""
    low = F.col("v").isin(*low_codes)
    rows = s.df.withColumn("iw", F.expr(f"idat div {ndat_per_weight}"))
    counts = rows.groupBy("iw", "ichan", "ipol").agg(F.sum(low.cast("long")).alias("nlow"))
    joined = rows.join(counts, ["iw", "ichan", "ipol"]).join(F.broadcast(levels), "nlow")
    value = F.when(low, F.col("low")).otherwise(F.col("high")) * F.when(F.col("v") >= 2, 1).otherwise(-1)
    return s.then("two_bit_correct", joined.select("idat", "ichan", "ipol", value.alias("v")))


def optimal_two_bit_levels(ndat_per_weight: int) -> list[tuple[int, float, float]]:
    """(nlow, low, high): mean magnitudes below and above the threshold of Gaussian noise whose low fraction is nlow / ndat_per_weight."""
    import math

    from cadenza.functions.sk_limits import inverse_erf

    out = []
    for n in range(ndat_per_weight + 1):
        p = min(max(n, 0.5), ndat_per_weight - 0.5) / ndat_per_weight
        t = math.sqrt(2) * inverse_erf(p)
        at = math.exp(-t * t / 2) * math.sqrt(2 / math.pi)
        low2 = 1 - t * at / p  # mean square below the threshold
        high2 = 1 + t * at / (1 - p)
        out.append((n, math.sqrt(max(low2, 0.0)) / t if t else 0.0, math.sqrt(high2) / t if t else 0.0))
    return out
