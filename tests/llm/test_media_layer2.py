"""Layer II checksums against a bit-by-bit computation from the standard's allocation tables."""

import numpy as np
import pytest

from cadenza.llm import mpeg


def crc_of(bits):
    value = 0xFFFF
    for bit in bits:
        top = value >> 15
        value = value << 1 & 0xFFFF
        if top ^ bit:
            value ^= 0x8005
    return value


def bits_of(data):
    return [b >> (7 - i) & 1 for b in data for i in range(8)]


#: (version bits, kbit/s index, rate index, mode, extension): widths of the subbands' allocations.
CASES = [
    ((3, 8, 0, 0, 0), [4] * 11 + [3] * 12 + [2] * 4),  # 128 kbit/s stereo, 44.1 kHz: 64 a channel
    ((3, 11, 0, 0, 0), [4] * 11 + [3] * 12 + [2] * 7),  # 224 kbit/s stereo, 44.1 kHz
    ((3, 11, 1, 0, 0), [4] * 11 + [3] * 12 + [2] * 4),  # the same at 48 kHz
    ((3, 2, 2, 3, 0), [4] * 2 + [3] * 10),  # 48 kbit/s mono, 32 kHz
    ((3, 1, 0, 3, 0), [4] * 2 + [3] * 6),  # 32 kbit/s mono, 44.1 kHz
    ((3, 10, 0, 1, 1), [4] * 11 + [3] * 12 + [2] * 7),  # 192 kbit/s joint stereo from subband 8
    ((2, 8, 0, 0, 0), [4] * 4 + [3] * 7 + [2] * 19),  # MPEG-2
]


@pytest.mark.parametrize(("head", "widths"), CASES)
def test_layer_two_checksums(head, widths):
    version, kbps, rate, mode, extension = head
    four = bytes((0xFF, 0xE0 | version << 3 | 2 << 1, kbps << 4 | rate << 2, mode << 6 | extension << 4))
    h = mpeg.header(four)
    assert h is not None and h.layer == 2 and h.protected
    rng = np.random.default_rng(kbps + rate)
    bound = 0 if mode == 3 else 4 * (extension + 1) if mode == 1 else len(widths)
    bits, selected = [], 0
    for band, width in enumerate(widths):
        for _ in range(2 if band < bound else 1):
            value = int(rng.integers(1 << width)) * int(rng.integers(2))
            bits += [value >> (width - 1 - i) & 1 for i in range(width)]
            selected += bool(value) * (1 if band < bound or mode == 3 else 2)
    bits += rng.integers(0, 2, 2 * selected).tolist()
    check = crc_of(bits_of(four[2:]) + bits)
    rest = bits + rng.integers(0, 2, -len(bits) % 8).tolist()
    body = bytes(int("".join(map(str, rest[i : i + 8])), 2) for i in range(0, len(rest), 8))
    frame = (four + check.to_bytes(2, "big") + body).ljust(h.length, b"\x5a")
    assert mpeg.checksum_ok(frame, h) is True
    spoilt = frame[:6] + bytes([frame[6] ^ 0x10]) + frame[7:]
    assert mpeg.checksum_ok(spoilt, h) is False
    audio = mpeg.parse(frame * 3)
    assert (len(audio.offsets), audio.checked, audio.bad_checksums) == (3, 3, 0)
