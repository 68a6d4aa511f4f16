"""Text headers of raw files, and their metadata."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

from cadenza.meta import ANALYTIC, INTENSITY, NYQUIST, ObsMeta

MJD_EPOCH = datetime(1858, 11, 17, tzinfo=UTC)
UNIX = datetime(1970, 1, 1, tzinfo=UTC)


def parse_ascii(text: str) -> dict[str, str]:
    """KEYWORD value pairs, one a line; # begins a comment."""
    out = {}
    for line in text.split("\0")[0].splitlines():
        words = line.split("#")[0].split(None, 1)
        if len(words) == 2:
            out[words[0].upper()] = words[1].strip()
    return out


def micros(when: datetime) -> int:
    return (when - UNIX) // timedelta(microseconds=1)


def ascii_meta(h: dict[str, str]) -> ObsMeta:
    """Metadata of a header: NDIM defaults to 1, NBIT to 2; STATE overrides what NDIM implies."""
    ndim = int(h.get("NDIM", 1))
    state = h.get("STATE", ANALYTIC if ndim == 2 else NYQUIST)
    state = {s.lower(): s for s in (NYQUIST, ANALYTIC, INTENSITY, "PPQQ", "Coherence", "Stokes")}.get(state.lower(), state)
    start = 0
    if "UTC_START" in h:
        start = micros(datetime.strptime(h["UTC_START"], "%Y-%m-%d-%H:%M:%S").replace(tzinfo=UTC))
    elif "MJD_START" in h:
        day, _, frac = h["MJD_START"].partition(".")
        start = micros(MJD_EPOCH + timedelta(days=int(day))) + round(float("0." + (frac or "0")) * 86400e6)
    start += round(int(h.get("PICOSECONDS", 0)) / 1e6)
    tsamp = float(h["TSAMP"]) if "TSAMP" in h else 1e6
    return ObsMeta(
        nchan=int(h.get("NCHAN", 1)), npol=int(h.get("NPOL", 1)), ndim=2 if state == ANALYTIC else 1 if state == NYQUIST else ndim, nbit=int(h.get("NBIT", 2)), ndat=int(h.get("NDAT", 0)), rate=1e6 / tsamp,
        centre_frequency=float(h.get("FREQ", 0)), bandwidth=float(h.get("BW", 0)), start_us=start, state=state, source=h.get("SOURCE", ""), telescope=h.get("TELESCOPE", ""), receiver=h.get("RECEIVER", ""),
        machine=h.get("INSTRUMENT", h.get("MACHINE", "")), basis=h.get("BASIS", "Linear"), dm=float(h.get("DM", 0)), rm=float(h.get("RM", 0)),
    )


def ascii_header(meta: ObsMeta, size: int = 4096, **extra) -> bytes:
    start = UNIX + timedelta(microseconds=meta.start_us)
    pairs = {
        "HDR_VERSION": 1.0, "HDR_SIZE": size, "NCHAN": meta.nchan, "NPOL": meta.npol, "NDIM": meta.ndim, "NBIT": meta.nbit, "NDAT": meta.ndat, "TSAMP": repr(1e6 / meta.rate), "FREQ": meta.centre_frequency, "BW": meta.bandwidth,
        "STATE": meta.state, "UTC_START": start.strftime("%Y-%m-%d-%H:%M:%S"), "PICOSECONDS": meta.start_us % 1_000_000 * 1_000_000, "DM": meta.dm, "RM": meta.rm, "BASIS": meta.basis,
    } | {k: v for k, v in (("SOURCE", meta.source), ("TELESCOPE", meta.telescope), ("RECEIVER", meta.receiver), ("INSTRUMENT", meta.machine)) if v} | extra
    text = "".join(f"{k} {v}\n" for k, v in pairs.items()).encode()
    if len(text) > size:
        raise ValueError("header is longer than its size")
    return text.ljust(size, b"\0")


#: Keywords of filterbank files, by the type of what follows them.
FILTERBANK = {
    "int": ("machine_id", "telescope_id", "data_type", "nchans", "nbits", "nifs", "nsamples", "nbeams", "ibeam", "barycentric", "pulsarcentric"),
    "double": ("fch1", "foff", "tstart", "tsamp", "src_raj", "src_dej", "az_start", "za_start", "refdm", "period"),
    "string": ("rawdatafile", "source_name"),
}


def read_filterbank_header(data: bytes) -> tuple[dict, int]:
    """Values of a binary filterbank header, and its length. A keyword that is not listed stands for a whole number if a keyword
    follows four bytes on, else for a double."""
    kinds = {k: t for t, names in FILTERBANK.items() for k in names}

    def string(at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<i", data, at)
        if not 0 < n < 256:
            raise ValueError("not a filterbank header")
        return data[at + 4 : at + 4 + n].decode("latin-1"), at + 4 + n

    def keyword_at(at: int) -> bool:
        n = struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else 0
        return 0 < n < 80 and data[at + 4 : at + 4 + n].decode("latin-1").replace("_", "").isalnum()

    word, at = string(0)
    if word != "HEADER_START":
        raise ValueError("not a filterbank header")
    out: dict = {}
    while True:
        word, at = string(at)
        if word == "HEADER_END":
            return out, at
        kind = kinds.get(word) or ("int" if keyword_at(at + 4) else "double")
        if kind == "string":
            out[word], at = string(at)
        elif kind == "int":
            (out[word],), at = struct.unpack_from("<i", data, at), at + 4
        else:
            (out[word],), at = struct.unpack_from("<d", data, at), at + 8


def write_filterbank_header(values: dict) -> bytes:
    string = lambda s: struct.pack("<i", len(s)) + s.encode("latin-1")
    out = string("HEADER_START")
    for name, value in values.items():
        out += string(name)
        out += struct.pack("<i", value) if name in FILTERBANK["int"] else struct.pack("<d", value) if name in FILTERBANK["double"] else string(value)
    return out + string("HEADER_END")


def filterbank_meta(h: dict, nbytes: int | None = None) -> ObsMeta:
    """fch1 is the first channel's centre, foff the step; nifs 1, 2, 4 are Intensity, PPQQ, Coherence."""
    n, npol = h["nchans"], h.get("nifs", 1)
    meta = ObsMeta(
        nchan=n, npol=npol, nbit=h["nbits"], rate=1 / h["tsamp"], centre_frequency=h["fch1"] + 0.5 * h["foff"] * (n - 1), bandwidth=h["foff"] * n, state={1: INTENSITY, 2: "PPQQ", 4: "Coherence"}[npol],
        start_us=micros(MJD_EPOCH) + round(h.get("tstart", 0) * 86400e6), source=h.get("source_name", ""), dm=h.get("refdm", 0.0),
    )
    return meta.but(ndat=h.get("nsamples") or (meta.nsamples(nbytes) if nbytes is not None else 0))


def filterbank_values(meta: ObsMeta) -> dict:
    """Header values of a signal whose channels are stored in order."""
    out = {"nchans": meta.nchan, "nbits": meta.nbit, "nifs": meta.npol, "fch1": meta.frequency(0), "foff": meta.channel_width, "tsamp": 1 / meta.rate, "tstart": (meta.start_us - micros(MJD_EPOCH)) / 86400e6, "refdm": meta.dm}
    return out | ({"source_name": meta.source} if meta.source else {})


def presto_info(text: str) -> dict[str, str]:
    """Fields of a time-series information file: ``description = value`` lines."""
    return {k.strip(): v.strip() for k, v in (line.split("=", 1) for line in text.splitlines() if "=" in line)}


def vdif_header(data: bytes) -> dict[str, int]:
    """Fields of a VDIF frame's header words (little-endian)."""
    w = struct.unpack_from("<4I", data)
    return {"invalid": w[0] >> 31, "legacy": w[0] >> 30 & 1, "seconds": w[0] & 0x3FFFFFFF, "epoch": w[1] >> 24 & 63, "frame": w[1] & 0xFFFFFF, "nchan": 1 << (w[2] >> 24 & 31), "bytes": (w[2] & 0xFFFFFF) * 8, "complex": w[3] >> 31, "nbit": (w[3] >> 26 & 31) + 1, "thread": w[3] >> 16 & 1023, "station": w[3] & 0xFFFF}


def vdif_start_us(h: dict[str, int]) -> int:
    """Time of a frame's second: the reference epoch counts half years from 2000."""
    epoch = datetime(2000 + h["epoch"] // 2, 1 + 6 * (h["epoch"] % 2), 1, tzinfo=UTC)
    return micros(epoch) + h["seconds"] * 1_000_000


def cards(data: bytes, width: int = 80) -> tuple[dict[str, str], int]:
    """KEYWORD = value cards up to END, and the length of all of them; quotes and comments are taken off."""
    out, at = {}, 0
    while at + width <= len(data):
        card = data[at : at + width].decode("latin-1")
        at += width
        if card.split("/")[0].strip() == "END":
            return out, at
        if card[8:9] == "=":
            value = card[9:].strip()
            if value.startswith("'"):
                value = value[1:].split("'")[0].rstrip()
            else:
                value = value.split("/")[0].strip()
            out.setdefault(card[:8].strip(), value)
    raise ValueError("no END card")


def guppi_header(data: bytes) -> tuple[dict[str, str], int]:
    """Cards of a block's header, and its length (a multiple of 512 where DIRECTIO is set)."""
    h, size = cards(data)
    if "BLOCSIZE" not in h:
        raise ValueError("no BLOCSIZE card")
    return h, -(-size // 512) * 512 if int(h.get("DIRECTIO", 0)) else size


def guppi_meta(h: dict[str, str]) -> ObsMeta:
    """Complex voltages; NPOL 4 means the parts of two polarizations. TBIN is the sampling time of a channel, STT_* its start."""
    start = micros(MJD_EPOCH + timedelta(days=int(h.get("STT_IMJD", 40587)), seconds=int(h.get("STT_SMJD", 0)))) + round(float(h.get("STT_OFFS", 0)) * 1e6)
    return ObsMeta(
        nchan=int(h["OBSNCHAN"]), npol=1 if int(h.get("NPOL", 4)) == 1 else 2, ndim=2, nbit=int(h.get("NBITS", 8)), rate=1 / float(h["TBIN"]), centre_frequency=float(h["OBSFREQ"]), bandwidth=float(h["OBSBW"]), state=ANALYTIC, dc_centred=True,
        start_us=start, source=h.get("SRC_NAME", ""), telescope=h.get("TELESCOP", ""), machine=h.get("BACKEND", ""), basis={"LIN": "Linear", "CIRC": "Circular"}.get(h.get("FD_POLN", "LIN"), "Linear"),
    )
