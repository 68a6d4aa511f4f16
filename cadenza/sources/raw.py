"""Raw sample files as signals, in splits of whole blocks, and their writers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.meta import ANALYTIC, NYQUIST, ObsMeta, Signal
from cadenza.operators.digitize import pack_codes, unpack_bytes
from cadenza.sources.blocks import head_of, read_blocks, write_in_place
from cadenza.sources.headers import ascii_header, ascii_meta, filterbank_meta, filterbank_values, guppi_header, guppi_meta, parse_ascii, read_filterbank_header, vdif_header, vdif_start_us, write_filterbank_header

BLOCK = 1 << 22  # bytes of a block, about


def columns(v: np.ndarray, first: int) -> pd.DataFrame:
    """Rows of an array (time, channel, polarization, dimension), the first sample numbered ``first``."""
    at = np.indices(v.shape[:3]).reshape(3, -1)
    out = {"idat": first + at[0].astype(np.int64), "ichan": at[1].astype(np.int32), "ipol": at[2].astype(np.int32)}
    flat = v.reshape(-1, v.shape[3])
    return pd.DataFrame(out | ({"re": flat[:, 0], "im": flat[:, 1]} if v.shape[3] == 2 else {"v": flat[:, 0]}))


def schema_of(meta: ObsMeta, kind: str = "int") -> str:
    return "idat long, ichan int, ipol int, " + (f"re {kind}, im {kind}" if meta.ndim == 2 else f"v {kind}")


def decoded(blocks: DataFrame, meta: ObsMeta, one: Callable[[int, int, bytes], pd.DataFrame], kind: str = "int") -> Signal:
    """The samples that one(file, block, raw) makes of each block."""

    def run(batches):
        for pdf in batches:
            for file, block, raw in zip(pdf["file"], pdf["block"], pdf["raw"]):
                yield one(file, block, raw)

    return Signal(blocks.mapInPandas(run, schema_of(meta, kind)), meta)


def whole_samples(meta: ObsMeta, size: int) -> tuple[int, int]:
    """(samples, bytes) of a block of about size bytes that holds whole samples and whole bytes."""
    bits = meta.bits_per_sample()
    samples = max(1, size * 8 // bits)
    while samples * bits % 8:
        samples += 1
    return samples, samples * bits // 8


def numbers(raw: bytes, meta: ObsMeta, signed: bool, order: str = "lsb") -> np.ndarray:
    return np.frombuffer(raw, dtype="<f4") if meta.nbit == -32 else unpack_bytes(raw, meta.nbit, signed, order)


def read_raw(spark: SparkSession, paths: list[str], block: int = BLOCK) -> list[Signal]:
    """A signal for each file with a text header; samples in time, channel, polarization, dimension order."""
    out = []
    for path in paths:
        head, length = head_of(path)
        h = parse_ascii(head.decode("latin-1"))
        meta, start = ascii_meta(h), int(h.get("HDR_SIZE", 4096))
        meta = meta.but(ndat=min(meta.ndat or 1 << 62, meta.nsamples(length - start)))
        samples, size = whole_samples(meta, block)

        def one(file, k, raw, meta=meta, samples=samples):
            v = numbers(raw, meta, True)
            per = meta.nchan * meta.npol * meta.ndim
            return columns(v[: len(v) // per * per].reshape(-1, meta.nchan, meta.npol, meta.ndim)[: max(0, meta.ndat - k * samples)], k * samples)

        out.append(decoded(read_blocks(spark, [(path, start, size, length)]), meta, one, "float" if meta.nbit == -32 else "int"))
    return out


def heads_of(spark: SparkSession, paths: list[str], size: int = 4096) -> list[tuple[bytes, int]]:
    """The first bytes and the length of each file, read in tasks."""

    def run(batches):
        for pdf in batches:
            found = [head_of(p, size) for p in pdf["path"]]
            yield pd.DataFrame({"i": pdf["i"], "head": [h for h, _ in found], "length": [n for _, n in found]})

    rows = spark.createDataFrame(list(enumerate(paths)), "i long, path string").repartition(max(1, min(64, len(paths))), "i").mapInPandas(run, "i long, head binary, length long")
    return [(bytes(r["head"]), r["length"]) for r in sorted(rows.collect(), key=lambda r: r["i"])]


def read_multi(spark: SparkSession, paths: list[str], block: int = BLOCK) -> Signal:
    """Files with text headers that follow each other in time, in any order of names, as one signal: one scan over the blocks of all, whatever their
    number. Each file's first sample is a number beside its name."""
    from cadenza.meta import combined_ndat

    files = []
    for path, (head, length) in zip(paths, heads_of(spark, paths)):
        h = parse_ascii(head.decode("latin-1"))
        meta, start = ascii_meta(h), int(h.get("HDR_SIZE", 4096))
        files.append((meta.but(ndat=min(meta.ndat or 1 << 62, meta.nsamples(length - start))), path, start, length))
    files.sort(key=lambda f: f[0].start_us)
    total, meta = combined_ndat([f[0] for f in files]), files[0][0]
    samples, size = whole_samples(meta, block)
    counts = [f[0].ndat for f in files]
    firsts = np.concatenate([[0], np.cumsum(counts)]).tolist()

    def one(file, k, raw):
        v, per = numbers(raw, meta, True), meta.nchan * meta.npol * meta.ndim
        return columns(v[: len(v) // per * per].reshape(-1, meta.nchan, meta.npol, meta.ndim)[: max(0, counts[file] - k * samples)], firsts[file] + k * samples)

    named = [(path, start, size, length) for _, path, start, length in files]
    out = decoded(read_blocks(spark, named), meta, one, "float" if meta.nbit == -32 else "int")
    return out.then("multi", out.df, ndat=total)


def read_filterbank(spark: SparkSession, path: str, block: int = BLOCK) -> Signal:
    """Unsigned samples; polarizations are slower than channels in these files."""
    head, length = head_of(path)
    h, start = read_filterbank_header(head)
    meta = filterbank_meta(h, length - start)
    samples, size = whole_samples(meta, block)

    def one(file, k, raw):
        v = numbers(raw, meta, False)
        v = v[: len(v) // (meta.npol * meta.nchan) * meta.npol * meta.nchan].reshape(-1, meta.npol, meta.nchan)[: max(0, meta.ndat - k * samples)]
        return columns(v.transpose(0, 2, 1)[..., None], k * samples)

    return decoded(read_blocks(spark, [(path, start, size, length)]), meta, one, "float" if meta.nbit == -32 else "int")


def read_vdif(spark: SparkSession, path: str, rate: float, frames_per_row: int = 4096) -> Signal:
    """Real or complex samples of a VDIF file, threads as polarizations; codes are offset binary, and invalid frames give no samples."""
    head, length = head_of(path, 32)
    h = vdif_header(head)
    size, skip = h["bytes"], 16 if h["legacy"] else 32
    per = (size - skip) * 8 // (h["nbit"] * h["nchan"] * (1 + h["complex"]))
    meta = ObsMeta(nchan=h["nchan"], ndim=1 + h["complex"], nbit=h["nbit"], rate=rate, state=ANALYTIC if h["complex"] else NYQUIST, start_us=vdif_start_us(h))

    def one(file, k, raw):
        parts = [pd.DataFrame(columns(np.zeros((0, 1, 1, meta.ndim), np.int32), 0))]
        for start in range(0, len(raw) - size + 1, size):
            f = vdif_header(raw[start : start + 32])
            if not f["invalid"]:
                v = unpack_bytes(raw[start + skip : start + size], h["nbit"], signed=False) - (1 << h["nbit"] - 1)
                v = v[: per * meta.nchan * meta.ndim].reshape(per, meta.nchan, 1, meta.ndim)
                first = round((f["seconds"] - h["seconds"]) * rate) + f["frame"] * per
                parts.append(columns(v.astype(np.int32), first).assign(ipol=np.int32(f["thread"])))
        return pd.concat(parts)

    return decoded(read_blocks(spark, [(path, 0, frames_per_row * size, length)]), meta, one)


def read_guppi(spark: SparkSession, path: str) -> Signal:
    """Complex samples of a file of blocks, each a header of 80-character cards and BLOCSIZE bytes in channel, time, polarization order; the last
    OVERLAP samples of a block come again in the next one and are left out."""
    head, length = head_of(path)
    h, skip = guppi_header(head)
    size, overlap = int(h["BLOCSIZE"]), int(h.get("OVERLAP", 0))
    meta = guppi_meta(h)
    per = size * 8 // meta.bits_per_sample()
    blocks = length // (skip + size)
    meta = meta.but(ndat=blocks * (per - overlap))

    def one(file, k, raw):
        v = unpack_bytes(raw[skip:], meta.nbit, True).reshape(meta.nchan, per, meta.npol, meta.ndim)
        return columns(v[:, : per - overlap].transpose(1, 0, 2, 3), k * (per - overlap))

    return decoded(read_blocks(spark, [(path, 0, skip + size, blocks * (skip + size))]), meta, one)


def raw_blocks(s: Signal, samples: int = 4096, chan_fastest: bool = False) -> DataFrame:
    """(block, raw): bytes of ``samples`` samples each, in time, channel, polarization, dimension order (or time, polarization, channel), for any sink of
    binary rows."""
    meta = s.meta
    values, order = ["re", "im"] if meta.ndim == 2 else ["v"], ["idat", "ipol", "ichan"] if chan_fastest else ["idat", "ichan", "ipol"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[values].to_numpy().ravel()
        raw = v.astype("<f4").tobytes() if meta.nbit == -32 else pack_codes(v, meta.nbit)
        return pd.DataFrame({"block": [pdf["b"].iloc[0]], "raw": [raw]})

    return s.df.withColumn("b", F.expr(f"idat div {samples}")).groupBy("b").applyInPandas(run, "block long, raw binary")


def write_raw(s: Signal, path: str, samples: int = 4096) -> None:
    """One file with a text header on a mounted path; tasks write their blocks in place."""
    size = s.meta.but(nbit=abs(s.meta.nbit)).nbytes(samples)
    write_in_place(raw_blocks(s, samples), path, ascii_header(s.meta), size, s.meta.but(nbit=abs(s.meta.nbit)).nbytes(s.meta.ndat))


def write_filterbank(s: Signal, path: str, samples: int = 4096) -> None:
    """Unsigned samples in a filterbank file, polarizations slower than channels."""
    meta = s.meta.but(nbit=abs(s.meta.nbit))
    write_in_place(raw_blocks(s, samples, chan_fastest=True), path, write_filterbank_header(filterbank_values(s.meta)), meta.nbytes(samples), meta.nbytes(meta.ndat))


def write_text(s: Signal, path: str) -> None:
    """Samples as lines of text, in files sorted by time."""
    s.df.repartitionByRange("idat").sortWithinPartitions("idat", "ichan", "ipol").write.mode("overwrite").option("sep", " ").csv(path)


def write_profiles(profiles: DataFrame, path: str, by: str = "division", meta: ObsMeta | None = None) -> None:
    """Folded profiles as Parquet, a folder a sub-integration; with its metadata and the operators applied in a text file beside them."""
    profiles.write.mode("overwrite").partitionBy(by).parquet(path)
    if meta is not None:
        described = profiles.sparkSession.createDataFrame([(meta.describe(),)], "value string")
        described.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.meta")


def division_name(start_us: int, division: int, length_us: int | None = None, turns: int | None = None, source: str = "pulsar") -> str:
    """Name of a sub-integration: by its epoch (UTC) where it is a length of time, by its number of the first turn where it is one of turns."""
    from cadenza.sources.headers import UNIX, timedelta

    if turns is not None:
        return f"{source}_pulse_{division * turns:010d}"
    return f"{source}_{(UNIX + timedelta(microseconds=start_us + division * (length_us or 0))).strftime('%Y-%m-%d-%H:%M:%S.%f')}"
