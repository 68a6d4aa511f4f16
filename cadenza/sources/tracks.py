"""Recordings of magnetic-tape formatters, kept on disk: track-multiplexed frames (mark4, vlba) and frames of bit streams (mark5b).

A track-multiplexed file is a stream of words of one bit a track. Each frame starts with 32 words of ones, the sync, then the time in decimal digits of four
words, on all tracks alike. A channel's bits are spread over ``fanout`` tracks, consecutive samples side by side. vlba frames carry 20000 words of payload
between head and tail, with a pseudo-random sequence added to all tracks; in mark4 frames the head stands in place of payload, whose samples are zero here.

Frames are found by their sync, so bytes that were lost or inserted cost the frames they fall in and no others, and placed in time by their own time code.
Blocks overlap by a frame: the block in which a frame starts reads it, and any number of tasks may share a file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from cadenza.meta import NYQUIST, ObsMeta, Signal
from cadenza.operators.digitize import unpack_bytes
from cadenza.sources.blocks import head_of, read_blocks
from cadenza.sources.headers import MJD_EPOCH, UNIX, datetime, micros, timedelta
from cadenza.sources.raw import BLOCK, columns, decoded

#: Fixed values of the formats: words of payload, of a frame by kind, of the sync and of the head (with the time code and its check); words of the next
#: frame's auxiliary data at the end of a mark4 frame.
PAYLOAD, WORDS, SYNC, HEAD, AUXILIARY = 20000, {"vlba": 20160, "mark4": 20000}, 32, 96, 64
#: Samples of a one-bit code, and of a two-bit code (sign + 2 x magnitude).
LEVELS = {1: (1.0, -1.0), 2: (-3.3359, 1.0, -1.0, 3.3359)}
STREAM_LEVELS = {1: (-1.0, 1.0), 2: (-3.3359, 1.0, -1.0, 3.3359)}
#: Bytes of a mark5b frame and of its head, and the head's first word.
STREAM_FRAME, STREAM_HEAD, STREAM_SYNC = 10016, 16, 0xABADDEED
DEAD = 1 / 16  # part of a sync's bits that may be wrong in a frame where one is due, as a dead track makes them
DAY = 86_400_000_000


@cache
def modulation() -> np.ndarray:
    """The bit added to each word of a vlba payload: a shift register with feedback from its stages 11, 13, 14 and 16, begun with ones; every ninth bit,
    that of the parity, is passed over."""
    bits = [1] * 16
    for _ in range(PAYLOAD * 9 // 8):
        bits.append(bits[-11] ^ bits[-13] ^ bits[-14] ^ bits[-16])
    made = np.array(bits[16:], dtype=np.uint8)
    return made[np.arange(len(made)) % 9 != 8]


def first_tracks(tracks: int, nbit: int, fanout: int) -> tuple[list[int], int]:
    """Each channel's first track, and the distance between the tracks of a channel. Boards of 32 tracks hold channels on their even tracks, then on the odd
    ones; fewer tracks are one run."""
    step = 2 if tracks >= 32 else 1
    each, board = step * nbit * fanout, min(tracks, 32)
    return [b + lane + k for b in range(0, tracks, board) for lane in range(step) for k in range(0, board, each)], step


def layout(head: bytes) -> tuple[int, str, int] | None:
    """(tracks, kind, byte of the first sync) of a file's first bytes: a sync at the start or behind a word of zeros, with another one a frame later."""
    for tracks in (64, 32, 16, 8):
        word = tracks // 8
        sync, led = b"\xff" * SYNC * word, b"\0" * word + b"\xff" * SYNC * word
        at = 0 if head.startswith(sync) else head.find(led)
        while at >= 0:
            first = at if at == 0 and head.startswith(sync) else at + word
            for kind, words in WORDS.items():
                if head[first + (words - 1) * word : first + (words + SYNC) * word] == led:
                    return tracks, kind, first
            at = head.find(led, at + 1)
    return None


def digits(frame: bytes, tracks: int, count: int) -> np.ndarray | None:
    """The time code behind the sync: decimal digits as most tracks have them, or None where one is none."""
    word = tracks // 8
    raw = np.frombuffer(frame, np.uint8, count * 4 * word, SYNC * word)
    most = np.unpackbits(raw).reshape(count * 4, tracks).sum(1) * 2 > tracks
    out = most.reshape(count, 4) @ np.array([8, 4, 2, 1])
    return out if (out < 10).all() else None


def nearest(us: int, about_us: int, cycle: Callable[[int], int]) -> int:
    """Of the times cycle(k) + us that a code that starts over again may mean, the one nearest to about_us."""
    return min((cycle(k) + us for k in (-1, 0, 1)), key=lambda t: abs(t - about_us))


def julian_us(day: int, us: int, about_us: int) -> int:
    """Time of a modified Julian day's last three digits."""
    base = (about_us - micros(MJD_EPOCH)) // DAY // 1000
    return nearest(day * DAY + us, about_us, lambda k: micros(MJD_EPOCH) + (base + k) * 1000 * DAY)


def time_of(frame: bytes, tracks: int, kind: str, about_us: int) -> int | None:
    """Microseconds of a frame's time code. What it leaves out (thousands of days, or decades) is taken from about_us. vlba times have four decimals, of mark4
    times the last digit stands for the multiple of 1.25 ms that it begins."""
    d = digits(frame, tracks, 13 if kind == "mark4" else 12)
    if d is None:
        return None
    if kind == "vlba":
        return julian_us(int(d[:3] @ [100, 10, 1]), int(d[3:] @ 10 ** np.arange(8, -1, -1)) * 100, about_us)
    last = int(d[12])
    if last in (4, 9):
        return None
    day, (h, m, s) = int(d[1:4] @ [100, 10, 1]), d[4:10].reshape(3, 2) @ [10, 1]
    us = (int(h) * 3600 + int(m) * 60 + int(s)) * 1_000_000 + int(d[10]) * 100_000 + int(d[11]) * 10_000 + (last - (last > 4)) * 1250
    year = (UNIX + timedelta(microseconds=about_us)).year // 10 * 10 + int(d[0])
    return nearest((day - 1) * DAY + us, about_us, lambda k: micros(datetime(year + 10 * k, 1, 1, tzinfo=UNIX.tzinfo)))


def whole_frames(raw: bytes, size: int, at: int, end: int, good: Callable[[int], bool], search: Callable[[int, int], int | None]) -> Iterator[int]:
    """Where the whole frames begin that begin from ``at`` on and before ``end``: a frame behind the last one if a good sync is there, or where the next one is
    found. A frame into which the next one's sync has moved has lost bytes and is left out."""
    while at < end:
        if not good(at):
            found = search(at, len(raw))
            if found is None or found >= end:
                return
            at = found
        moved = None if good(at + size) else search(at + 1, at + size)
        if moved is None and at + size <= len(raw):
            yield at
        at = at + size if moved is None else moved


def syncs(raw: bytes, tracks: int, words: int, owned: int, first: bool) -> Iterator[int]:
    """Where the frames of a block begin: where the bits of a sync's length are nearly all ones, and nowhere near are more or, before it, as many. For what
    is near, a block that is not the first looks at the word before its own frames too: it gives those that begin there to the block before."""
    word = tracks // 8
    size, length = words * word, SYNC * word
    ones = np.cumsum(np.concatenate([[0], np.bitwise_count(np.frombuffer(raw, np.uint8))]), dtype=np.int32)
    score, least = ones[length:] - ones[:-length], (1 - DEAD) * length * 8

    def good(at: int) -> bool:
        if at >= len(score) or score[at] < least:
            return False
        low = max(0, at - length)
        return low + int(np.argmax(score[low : at + length])) == at

    def search(low: int, high: int) -> int | None:
        return next((at for at in (low + np.flatnonzero(score[low:high] >= least)).tolist() if good(at)), None)

    return whole_frames(raw, size, 0 if first else word, owned + word, good, search)


def demultiplexed(frame: bytes, tracks: int, kind: str, nbit: int, fanout: int) -> np.ndarray:
    """Samples (time, channel) of a frame's 20000 words."""
    word = tracks // 8
    words = np.frombuffer(frame, np.uint8, PAYLOAD * word, HEAD * word if kind == "vlba" else 0).reshape(PAYLOAD, word)
    bits = np.unpackbits(words, axis=1, bitorder="little")  # track 0 is the lowest bit
    if kind == "vlba":
        bits = bits ^ modulation()[:, None]
    bases, step = first_tracks(tracks, nbit, fanout)
    at = np.array(bases)[None, :] + step * np.arange(fanout)[:, None]  # (fan, channel)
    code = sum(bits[:, at + step * fanout * k].astype(np.int64) << k for k in range(nbit))
    v = np.array(LEVELS[nbit], dtype=np.float32)[code]
    if kind == "mark4":
        v[:HEAD] = v[PAYLOAD - AUXILIARY :] = 0
    return v.reshape(PAYLOAD * fanout, len(bases))


def channel_rate(fanout: int, words_per_second: float) -> float:
    """Samples a second of a channel: the megahertz times a power of two nearest to what the time codes, which are cut off, say."""
    return 1e6 * 2.0 ** round(np.log2(fanout * words_per_second / 1e6))


def first_seen(head: bytes, tracks: int, kind: str, fanout: int, about_us: int) -> tuple[int, int, float]:
    """Where the first frame begins, its time, counted back from the first time code, and the rate by the frames that the head holds."""
    size = WORDS[kind] * tracks // 8
    found = list(syncs(head, tracks, WORDS[kind], len(head), True))
    seen = [(at, t) for at in found if (t := time_of(head[at : at + size], tracks, kind, about_us)) is not None]
    if len(seen) < 2 or seen[-1][1] <= seen[0][1]:
        raise ValueError("no two frames with time codes at the start of the file")
    (a, t), (b, u) = seen[0], seen[-1]
    rate = channel_rate(fanout, round((b - a) / size) * PAYLOAD * 1e6 / (u - t))
    return found[0], t - round(round((a - found[0]) / size) * PAYLOAD * fanout / rate * 1e6), rate


def arranged(v: np.ndarray, npol: int) -> np.ndarray:
    """(time, channel, polarization, 1) of recorded channels, whose polarizations stand side by side."""
    return v.reshape(len(v), -1, npol, 1)


def placed(parts: list[pd.DataFrame], meta: ObsMeta) -> pd.DataFrame:
    return pd.concat(parts) if parts else columns(np.zeros((0, meta.nchan, meta.npol, 1), np.float32), 0)


def read_tracks(spark: SparkSession, path: str, fanout: int, nbit: int = 2, npol: int = 1, about_us: int | None = None, rate: float | None = None, block: int = BLOCK) -> Signal:
    """Real samples of a track-multiplexed file of 8, 16, 32 or 64 tracks. about_us is a time within four years (mark4) or 500 days (vlba) of the recording;
    rate is found from the time codes where it is not given. Frames whose sync or time code is damaged, or that are cut off, give no samples."""
    if nbit not in LEVELS or fanout not in (1, 2, 4):
        raise ValueError("codes have 1 or 2 bits, and a channel's samples are on 1, 2 or 4 tracks")
    head, length = head_of(path, 1 << 20)
    if (found := layout(head)) is None:
        raise ValueError(f"no sync in the first bytes of {path}")
    tracks, kind, _ = found
    if tracks % (nbit * fanout * npol * (2 if tracks >= 32 else 1)):
        raise ValueError(f"{tracks} tracks don't hold channels of {nbit} x {fanout} tracks in {npol} polarizations")
    about = micros(datetime.now(tz=UNIX.tzinfo)) if about_us is None else about_us
    at, start_us, estimated = first_seen(head, tracks, kind, fanout, about)
    rate, size, per = rate or estimated, WORDS[kind] * tracks // 8, PAYLOAD * fanout
    owned = max(1, block // size) * size
    meta = ObsMeta(nchan=tracks // (nbit * fanout * npol), npol=npol, nbit=nbit, ndat=(length - at) // size * per, rate=rate, state=NYQUIST, start_us=start_us, machine=kind)

    def one(file, k, raw):
        parts = []
        for s in syncs(raw, tracks, WORDS[kind], owned, k == 0):
            frame = raw[s : s + size]
            t = time_of(frame, tracks, kind, start_us)
            if t is not None:
                number = round((t - start_us) * rate / 1e6 / per)
                parts.append(columns(arranged(demultiplexed(frame, tracks, kind, nbit, fanout), npol), number * per))
        return placed(parts, meta)

    return decoded(read_blocks(spark, [(path, at, owned, length)], overlap=size + (SYNC + 1) * tracks // 8), meta, one, "float")


def stream_head(raw: bytes) -> tuple[int, int, int] | None:
    """(last three digits of the day, second, number of the frame in it) of a mark5b frame's head, or None where it is none."""
    w = np.frombuffer(raw, "<u4", 4)
    code = [int(w[2]) >> shift & 15 for shift in range(28, -1, -4)]
    if w[0] != STREAM_SYNC or max(code) > 9:
        return None
    number = int("".join(map(str, code)))
    return number // 100_000, number % 100_000, int(w[1]) & 0x7FFF


def stream_starts(raw: bytes, owned: int) -> Iterator[int]:
    """Where the mark5b frames of a block begin."""
    sync = STREAM_SYNC.to_bytes(4, "little")

    def good(at: int) -> bool:
        return at + STREAM_HEAD <= len(raw) and stream_head(raw[at : at + STREAM_HEAD]) is not None

    def search(low: int, high: int) -> int | None:
        while (low := raw.find(sync, low)) >= 0 and low < high:
            if good(low):
                return low
            low += 1
        return None

    return whole_frames(raw, STREAM_FRAME, 0, owned, good, search)


def read_mark5b(spark: SparkSession, path: str, rate: float, nchan: int, nbit: int = 2, npol: int = 1, about_us: int | None = None, block: int = BLOCK) -> Signal:
    """Real samples of a mark5b file: frames of 10000 bytes of samples, nchan x npol channels of nbit bits each side by side, the first in the lowest bits.
    about_us is a time within 500 days of the recording. Frames without their sync and a decimal time give no samples."""
    bits = nchan * npol * nbit
    if nbit not in STREAM_LEVELS or bits not in (1, 2, 4, 8, 16, 32):
        raise ValueError("1 to 32 bit streams hold codes of 1 or 2 bits")
    head, length = head_of(path, 1 << 20)
    start = next(stream_starts(head, len(head)), None)
    if start is None:
        raise ValueError(f"no frame in the first bytes of {path}")
    about = micros(datetime.now(tz=UNIX.tzinfo)) if about_us is None else about_us
    per = (STREAM_FRAME - STREAM_HEAD) * 8 // bits
    day, second, frame = stream_head(head[start : start + STREAM_HEAD])
    first_us = julian_us(day, second * 1_000_000, about)
    meta = ObsMeta(nchan=nchan, npol=npol, nbit=nbit, ndat=(length - start) // STREAM_FRAME * per, rate=rate, state=NYQUIST, start_us=first_us + round(frame * per / rate * 1e6), machine="mark5b")
    owned = max(1, block // STREAM_FRAME) * STREAM_FRAME

    def one(file, k, raw):
        parts = []
        for s in stream_starts(raw, owned):
            d, sec, number = stream_head(raw[s : s + STREAM_HEAD])
            seconds = (julian_us(d, sec * 1_000_000, first_us) - first_us) // 1_000_000
            code = unpack_bytes(raw[s + STREAM_HEAD : s + STREAM_FRAME], nbit, signed=False)
            v = np.array(STREAM_LEVELS[nbit], dtype=np.float32)[code].reshape(per, nchan * npol)
            parts.append(columns(arranged(v, npol), round(seconds * rate) + (number - frame) * per))
        return placed(parts, meta)

    return decoded(read_blocks(spark, [(path, start, owned, length)], overlap=STREAM_FRAME + STREAM_HEAD), meta, one, "float")


def is_kind(kind: str) -> Callable[[bytes], bool]:
    """A test of a file's first bytes for one of the track-multiplexed kinds."""
    return lambda head: (found := layout(head)) is not None and found[1] == kind


def is_mark5b(head: bytes) -> bool:
    """Two frames in a row."""
    start = next(stream_starts(head, len(head)), None)
    return start is not None and stream_head(head[start + STREAM_FRAME :][:STREAM_HEAD].ljust(STREAM_HEAD, b"\0")) is not None
