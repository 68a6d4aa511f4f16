"""Known file formats: each says whether the head of a file is its own and how to read it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cadenza.meta import Signal
from cadenza.sources import fits, raw, tracks
from cadenza.sources.blocks import head_of
from cadenza.sources.headers import cards, parse_ascii, read_filterbank_header, vdif_header


@dataclass(frozen=True)
class Format:
    name: str
    is_valid: Callable[[bytes], bool]
    read: Callable[..., Signal]


def _tried(test: Callable[[bytes], object]) -> Callable[[bytes], bool]:
    """A test that takes what it cannot parse for another format."""

    def holds(head: bytes) -> bool:
        try:
            return bool(test(head))
        except (ValueError, IndexError, KeyError, ArithmeticError, OverflowError):
            return False

    return holds


def _vdif(head: bytes) -> bool:
    """Two frames in a row that agree in size, samples and epoch."""
    a = vdif_header(head[:32])
    if not 32 < a["bytes"] <= len(head) - 32 or a["nbit"] not in (1, 2, 4, 8, 16):
        return False
    b = vdif_header(head[a["bytes"] : a["bytes"] + 32])
    return all(a[k] == b[k] for k in ("bytes", "nbit", "nchan", "epoch", "complex", "legacy")) and 0 <= b["seconds"] - a["seconds"] <= 1


FORMATS = [
    Format("psrfits", _tried(lambda h: h.startswith(b"SIMPLE  =") and any(u[0].get("EXTNAME") == "SUBINT" for u in fits.units(h, len(h)))), fits.read_psrfits),
    Format("filterbank", _tried(lambda h: read_filterbank_header(h)), raw.read_filterbank),
    Format("guppi", _tried(lambda h: "BLOCSIZE" in cards(h[: 1 << 16])[0]), raw.read_guppi),
    Format("raw", _tried(lambda h: {"HDR_VERSION", "NCHAN", "TSAMP"} <= set(parse_ascii(h[:4096].decode("latin-1")))), lambda spark, path, **k: raw.read_raw(spark, [path], **k)[0]),
    Format("vdif", _tried(_vdif), raw.read_vdif),
    Format("mark5b", _tried(tracks.is_mark5b), tracks.read_mark5b),
    Format("vlba", _tried(tracks.is_kind("vlba")), tracks.read_tracks),
    Format("mark4", _tried(tracks.is_kind("mark4")), tracks.read_tracks),
]


def format_of(path: str, formats: list[Format] = FORMATS) -> Format:
    """The first format that takes the file's head for its own."""
    head, _ = head_of(path, 1 << 20)
    for f in formats:
        if f.is_valid(head):
            return f
    raise ValueError(f"no known format: {path}")


def open_signal(spark: SparkSession, path: str, header: dict | None = None, **settings) -> Signal:
    """A file as a signal, whatever its format; header changes metadata, as an observer's corrections do, settings go to the reader."""
    s = format_of(path).read(spark, path, **settings)
    return Signal(s.df, s.meta.but(**header)) if header else s


def open_signals(spark: SparkSession, paths: list[str], header: dict | None = None, **settings) -> Signal:
    """Files that follow each other in time, as one signal."""
    from cadenza.operators.integration import serial

    return serial(sorted((open_signal(spark, p, header, **settings) for p in paths), key=lambda s: s.meta.start_us))
