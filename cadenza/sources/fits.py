"""Search-mode PSRFITS: rows of a binary table, each a block of time with weights, offsets and scales."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.meta import INTENSITY, ObsMeta, Signal
from cadenza.operators.digitize import pack_codes, unpack_bytes
from cadenza.sources.blocks import head_of, read_blocks, write_in_place
from cadenza.sources.headers import MJD_EPOCH, cards, micros, timedelta
from cadenza.sources.raw import columns, decoded

UNIT = 2880
#: Bytes of a table value by its letter.
WIDTHS = {"L": 1, "B": 1, "A": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8}
STATES = {1: INTENSITY, 2: "PPQQ", 4: "Coherence"}


def rounded_up(n: int) -> int:
    return -(-n // UNIT) * UNIT


def units(head: bytes, length: int) -> Iterator[tuple[dict[str, str], int]]:
    """(cards, start of the data) of each header unit that the head holds."""
    at = 0
    while at < min(len(head), length):
        h, size = cards(head[at:])
        at = at + rounded_up(size)
        yield h, at
        data = math.prod(int(h[f"NAXIS{i}"]) for i in range(1, int(h.get("NAXIS", 0)) + 1)) if int(h.get("NAXIS", 0)) else 0
        at += rounded_up(abs(int(h.get("BITPIX", 8))) // 8 * data + int(h.get("PCOUNT", 0)))


def layout(h: dict[str, str]) -> dict[str, tuple[int, str, int]]:
    """(offset, letter, count) of each column of a table's row."""
    out, at = {}, 0
    for i in range(1, int(h["TFIELDS"]) + 1):
        form = h[f"TFORM{i}"].strip()
        count, letter = int(form[:-1] or 1), form[-1]
        out[h[f"TTYPE{i}"].strip()] = (at, letter, count)
        at += -(-count // 8) if letter == "X" else count * WIDTHS[letter]
    return out


def values(row: bytes, column: tuple[int, str, int]) -> np.ndarray:
    at, letter, count = column
    kind = {"E": ">f4", "D": ">f8", "I": ">i2", "J": ">i4", "K": ">i8", "B": "u1"}[letter]
    return np.frombuffer(row, dtype=kind, count=count, offset=at).astype(np.float64)


def read_psrfits(spark: SparkSession, path: str, apply_weights: bool = False) -> Signal:
    """Samples (idat, ichan, ipol, v) with each row's scales and offsets applied, by channel and polarization: code * scale + offset, and with apply_weights
    also times the channel's weight. A row of the table is a block of the file."""
    head, length = head_of(path, 1 << 20)
    found = list(units(head, length))
    primary, (h, start) = found[0][0], next(u for u in found if u[0].get("EXTNAME") == "SUBINT")
    size, rows, at = int(h["NAXIS1"]), int(h["NAXIS2"]), layout(h)
    nchan, npol, nbit, per = int(h["NCHAN"]), int(h["NPOL"]), int(h["NBITS"]), int(h["NSBLK"])
    begun = micros(MJD_EPOCH + timedelta(days=int(primary.get("STT_IMJD", 40587)), seconds=int(primary.get("STT_SMJD", 0)))) + round(float(primary.get("STT_OFFS", 0)) * 1e6)
    meta = ObsMeta(
        nchan=nchan, npol=npol, nbit=nbit, ndat=rows * per, rate=1 / float(h["TBIN"]), centre_frequency=float(primary["OBSFREQ"]), bandwidth=float(primary["OBSBW"]), start_us=begun, state=STATES.get(npol, INTENSITY),
        source=primary.get("SRC_NAME", ""), telescope=primary.get("TELESCOP", ""), receiver=primary.get("FRONTEND", ""), machine=primary.get("BACKEND", ""), dm=float(primary.get("CHAN_DM", 0) or 0),
    )

    def one(file: int, k: int, row: bytes) -> pd.DataFrame:
        first, _, count = at["DATA"]
        width = WIDTHS[at["DATA"][1]]
        raw = row[first : first + count * width]
        codes = np.frombuffer(raw, ">i2") if nbit == 16 else unpack_bytes(raw, nbit, signed=False, order="msb")
        v = codes[: per * npol * nchan].reshape(per, npol, nchan).astype(np.float64)
        scale, offset = (values(row, at[c]).reshape(npol, nchan) if c in at else np.full((npol, nchan), d) for c, d in (("DAT_SCL", 1.0), ("DAT_OFFS", 0.0)))
        v = v * scale + offset
        if apply_weights and "DAT_WTS" in at:
            v = v * values(row, at["DAT_WTS"])[:nchan]
        return columns(v.transpose(0, 2, 1)[..., None], k * per)

    return decoded(read_blocks(spark, [(path, start, size, start + rows * size)]), meta, one, "double")


def card(key: str, value: object) -> bytes:
    text = f"'{value:<8}'" if isinstance(value, str) else f"{value!r:>20}" if not isinstance(value, bool) else f"{'T' if value else 'F':>20}"
    return f"{key:<8}= {text}".ljust(80)[:80].encode("latin-1")


def header(pairs: list[tuple[str, object]]) -> bytes:
    text = b"".join(card(k, v) for k, v in pairs) + b"END".ljust(80)
    return text.ljust(rounded_up(len(text)), b" ")


def write_psrfits(codes: Signal, scales: DataFrame, path: str, samples: int) -> None:
    """A search-mode file of unsigned codes (8 bits or fewer) on a mounted path; scales(ib, ichan, ipol, scale, offset) are those of each row of ``samples``
    samples, as table_scale_offset() gives them. Tasks write their rows in place; samples after the last whole row are left out."""
    m = codes.meta
    rows, cells = m.ndat // samples, m.nchan * m.npol
    data = samples * cells * m.nbit // 8
    fields = [("TSUBINT", "1D"), ("OFFS_SUB", "1D"), ("DAT_FREQ", f"{m.nchan}D"), ("DAT_WTS", f"{m.nchan}E"), ("DAT_OFFS", f"{cells}E"), ("DAT_SCL", f"{cells}E"), ("DATA", f"{data}B")]
    size = sum(int(f[:-1]) * WIDTHS[f[-1]] for _, f in fields)
    days, left = divmod(m.start_us - micros(MJD_EPOCH), 86_400_000_000)
    primary = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), ("FITSTYPE", "PSRFITS"), ("OBS_MODE", "SEARCH"), ("TELESCOP", m.telescope), ("FRONTEND", m.receiver), ("BACKEND", m.machine), ("SRC_NAME", m.source), ("OBSFREQ", m.centre_frequency), ("OBSBW", m.bandwidth), ("CHAN_DM", m.dm), ("STT_IMJD", days), ("STT_SMJD", left // 1_000_000), ("STT_OFFS", left % 1_000_000 / 1e6)]
    table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", size), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]
    for i, (name, form) in enumerate(fields, 1):
        table += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    table += [(f"TDIM{len(fields)}", f"({m.nchan},{m.npol},{samples})"), ("EXTNAME", "SUBINT"), ("NCHAN", m.nchan), ("NPOL", m.npol), ("NBITS", m.nbit), ("NSBLK", samples), ("TBIN", 1 / m.rate)]
    frequency = np.array([m.frequency(i) for i in range(m.nchan)], ">f8").tobytes()
    seconds = samples / m.rate

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["ib"].iloc[0])
        grid = pdf.sort_values(["idat", "ipol", "ichan"])
        one = grid.iloc[:cells]
        floats = lambda c: one[c].to_numpy(">f4").tobytes()
        head = np.array([seconds, (k + 0.5) * seconds], ">f8").tobytes() + frequency + np.ones(m.nchan, ">f4").tobytes()
        return pd.DataFrame({"block": [k], "raw": [head + floats("offset") + floats("scale") + pack_codes(grid["v"].to_numpy(), m.nbit, "msb")]})

    joined = codes.df.withColumn("ib", F.expr(f"idat div {samples}")).filter(F.col("ib") < rows).join(scales, ["ib", "ichan", "ipol"])
    blocks = joined.groupBy("ib").applyInPandas(pack, "block long, raw binary")
    end = rounded_up(rows * size) - rows * size
    write_in_place(blocks, path, header(primary) + header(table), size, rows * size, bytes(end))
