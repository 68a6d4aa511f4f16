"""Fold-mode PSRFITS archives: a row a sub-integration, profiles as 16-bit codes with a scale and an offset a channel and polarization.

Divisions are numbered from the first one given, so that a row knows its place without ranking; a division without profiles is a row of zeros whose weights
say so. Tasks pack and write rows; the file appears when all are there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.meta import ObsMeta
from cadenza.operators.folding import drop_short
from cadenza.sources.blocks import head_of, read_blocks, write_in_place
from cadenza.sources.fits import STATES, WIDTHS, header, layout, rounded_up, units, values
from cadenza.sources.headers import MJD_EPOCH, micros, timedelta

TOP = 32_767  # of a code; the lowest is its negative


def write_archive(profiles: DataFrame, path: str, meta: ObsMeta, nbin: int, period_us: int, length_us: int, expected: int | None = None, least: float = 0.9) -> int:
    """Writes profiles(division, ichan, ipol, ibin, total, hits) and the operators applied; returns the number of rows.

    A bin holds the mean of its hits, 0 without any; a channel's weight is its hits over its row's greatest ones. Where ``expected`` hits are given for a
    division, those with less than ``least`` of them are left out.
    """
    kept = drop_short(profiles, expected, least) if expected else profiles
    first, last = kept.agg(F.min("division"), F.max("division")).first()
    m, rows = meta, 0 if first is None else last - first + 1
    cells = m.nchan * m.npol
    fields = [("TSUBINT", "1D"), ("OFFS_SUB", "1D"), ("PERIOD", "1D"), ("DAT_FREQ", f"{m.nchan}D"), ("DAT_WTS", f"{m.nchan}E"), ("DAT_OFFS", f"{cells}E"), ("DAT_SCL", f"{cells}E"), ("DATA", f"{cells * nbin}I")]
    size = sum(int(f[:-1]) * WIDTHS[f[-1]] for _, f in fields)
    days, left = divmod(m.start_us - micros(MJD_EPOCH), 86_400_000_000)
    primary = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), ("FITSTYPE", "PSRFITS"), ("OBS_MODE", "PSR"), ("TELESCOP", m.telescope), ("FRONTEND", m.receiver), ("BACKEND", m.machine), ("SRC_NAME", m.source), ("OBSFREQ", m.centre_frequency), ("OBSBW", m.bandwidth), ("CHAN_DM", m.dm), ("STT_IMJD", days), ("STT_SMJD", left // 1_000_000), ("STT_OFFS", left % 1_000_000 / 1e6)]
    steps = "\n".join(m.path).encode("latin-1", "replace").ljust(1)
    history = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(steps)), ("NAXIS2", 1), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "PROC_CMD"), ("TFORM1", f"{len(steps)}A"), ("EXTNAME", "HISTORY")]
    table = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", size), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields))]
    for i, (name, form) in enumerate(fields, 1):
        table += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    table += [(f"TDIM{len(fields)}", f"({nbin},{m.nchan},{m.npol})"), ("EXTNAME", "SUBINT"), ("NCHAN", m.nchan), ("NPOL", m.npol), ("NBIN", nbin), ("NBITS", 1), ("NSUBOFFS", first or 0), ("TBIN", period_us / 1e6 / nbin)]
    frequency = np.array([m.frequency(i) for i in range(m.nchan)], ">f8").tobytes()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["division"].iloc[0])
        total, hits = np.zeros((m.npol, m.nchan, nbin)), np.zeros((m.npol, m.nchan, nbin))
        at = tuple(pdf[c].to_numpy() for c in ("ipol", "ichan", "ibin"))
        np.add.at(total, at, pdf["total"].to_numpy(dtype=float))
        np.add.at(hits, at, pdf["hits"].to_numpy(dtype=float))
        v = total / np.maximum(hits, 1)
        low, high = v.min(axis=2), v.max(axis=2)
        # what is stored are the rounded numbers, so codes are made by these
        offset = ((low + high) / 2).astype(">f4")
        scale = np.where(high > low, (high - low) / (2 * TOP), 1.0).astype(">f4")
        codes = np.clip(np.rint((v - offset.astype(float)[..., None]) / scale.astype(float)[..., None]), -TOP - 1, TOP).astype(">i2")
        weight = hits.sum(axis=(0, 2)) / max(1.0, hits.sum(axis=(0, 2)).max())
        spans = np.array([length_us / 1e6, ((k + 0.5) * length_us) / 1e6, period_us / 1e6], ">f8").tobytes()
        raw = spans + frequency + weight.astype(">f4").tobytes() + offset.tobytes() + scale.tobytes() + codes.tobytes()
        return pd.DataFrame({"block": [k - first], "raw": [raw]})

    blocks = kept.groupBy("division").applyInPandas(pack, "block long, raw binary")
    told = kept.select("division").distinct().count()
    head = header(primary) + header(history) + steps.ljust(rounded_up(len(steps)), b"\0") + header(table)
    write_in_place(blocks, path, head, size, rows * size, bytes(rounded_up(rows * size) - rows * size), written=told * size)
    return rows


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, ObsMeta]:
    """Profiles (division, ichan, ipol, ibin, value, weight) of a fold-mode file, and its metadata with the operators applied; divisions without any are left
    out."""
    head, length = head_of(path, 1 << 20)
    found = list(units(head, length))
    primary, (h, start) = found[0][0], next(u for u in found if u[0].get("EXTNAME") == "SUBINT")
    if primary.get("OBS_MODE", "").strip() != "PSR":
        raise ValueError(f"not a file of profiles: {path}")
    size, rows, at, first = int(h["NAXIS1"]), int(h["NAXIS2"]), layout(h), int(h.get("NSUBOFFS", 0))
    nchan, npol, nbin = int(h["NCHAN"]), int(h["NPOL"]), int(h["NBIN"])
    steps = next((head[s : s + int(u["NAXIS1"])].decode("latin-1").strip() for u, s in found if u.get("EXTNAME") == "HISTORY"), "")
    begun = micros(MJD_EPOCH + timedelta(days=int(primary.get("STT_IMJD", 40587)), seconds=int(primary.get("STT_SMJD", 0)))) + round(float(primary.get("STT_OFFS", 0)) * 1e6)
    meta = ObsMeta(
        nchan=nchan, npol=npol, ndat=nbin, rate=1 / float(h["TBIN"]), centre_frequency=float(primary["OBSFREQ"]), bandwidth=float(primary["OBSBW"]), start_us=begun, state=STATES.get(npol, STATES[1]), source=primary.get("SRC_NAME", ""),
        telescope=primary.get("TELESCOP", ""), receiver=primary.get("FRONTEND", ""), machine=primary.get("BACKEND", ""), dm=float(primary.get("CHAN_DM", 0) or 0), path=tuple(filter(None, steps.split("\n"))),
    )

    def unpack(batches):
        for pdf in batches:
            for block, row in zip(pdf["block"], pdf["raw"]):
                weight = values(row, at["DAT_WTS"])
                if not values(row, at["TSUBINT"])[0]:
                    continue
                scale, offset = (values(row, at[c]).reshape(npol, nchan, 1) for c in ("DAT_SCL", "DAT_OFFS"))
                v = values(row, at["DATA"]).reshape(npol, nchan, nbin) * scale + offset
                p, c, b = (x.ravel() for x in np.indices(v.shape))
                yield pd.DataFrame({"division": int(block) + first, "ichan": c.astype(np.int32), "ipol": p.astype(np.int32), "ibin": b.astype(np.int32), "value": v.ravel(), "weight": weight[c]})

    raw = read_blocks(spark, [(path, start, size, start + rows * size)])
    return raw.select("block", "raw").mapInPandas(unpack, "division long, ichan int, ipol int, ibin int, value double, weight double"), meta
