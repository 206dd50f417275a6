"""The validators that remember their walks against plain ones, and on a megabyte of headers made to cost much."""

import random
import struct
import time

import pytest

from scenemill.llm import media

MB = 1 << 20


def plain_wav(b, at):
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p, seen = at + 12, set()
    while p + 8 <= min(end, len(b)):
        seen.add(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    return end - at if end <= len(b) and p == end and {b"fmt ", b"data"} <= seen else None


def plain_gif(b, at):
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 * (2 << (b[at + 10] & 7)) if b[at + 10] & 0x80 else 0)
    while p < len(b) and b[p] != 0x3B:
        if b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 * (2 << (b[p + 9] & 7)) if b[p + 9] & 0x80 else 0)
        elif b[p] == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return p + 1 - at if p < len(b) else None


def crc(poly, bits, data):
    c = 0
    for x in data:
        c ^= x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def noise(rng, n):
    return bytes(rng.randrange(256) for _ in range(n))


def wav(rng):
    chunks = b""
    for _ in range(rng.randrange(6)):
        n = rng.randrange(12)
        chunks += rng.choice([b"fmt ", b"data", b"LIST", b"RIFF"]) + struct.pack("<I", n) + noise(rng, n + n % 2)
    return b"RIFF" + struct.pack("<I", max(0, 4 + len(chunks) + rng.choice([0, 0, 0, 1, -8, 8]))) + b"WAVE" + chunks


def gif(rng):
    out = b"GIF89a" + bytes(4) + rng.choice([bytes(3), b"\x80" + bytes(8)])
    for _ in range(rng.randrange(4)):
        out += rng.choice([b"!\xf9", b"," + bytes(9) + b"\x02"])
        for _ in range(rng.randrange(3)):
            n = rng.randrange(1, 9)
            out += bytes([n]) + noise(rng, n)
        out += b"\0"
    return out + rng.choice([b";", b"", b"x"])


def flac(rng, frames, total):
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + info
    for k in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([k])
        frame = head + bytes([crc(0x07, 8, head)]) + noise(rng, rng.randrange(12, 30))
        out += frame + crc(0x8005, 16, frame).to_bytes(2, "big")
    return out


def test_walks_like_plain_ones():
    rng = random.Random(9)
    for _ in range(1500):
        b = b"".join(rng.choice([wav, gif, lambda r: noise(r, r.randrange(9))])(rng) for _ in range(rng.randrange(1, 5)))
        b = b[: rng.randrange(len(b) + 1)] + rng.choice([wav, gif])(rng) + b[rng.randrange(len(b) + 1) :]
        m = media.Media(b)
        for p in m.places(b"RIFF"):
            assert media._wav(m, p) == plain_wav(b, p)
        for p in m.places(b"GIF89a"):
            assert media._gif(m, p) == plain_gif(b, p)


def test_checksum_numbers():
    """Two places have one number exactly where the checksum of the bytes between them is 0."""
    rng = random.Random(1)
    part = noise(rng, 40)
    b = noise(rng, 50_000) + part + crc(0x8005, 16, part).to_bytes(2, "big") + noise(rng, 9)
    sums = media.Media(b).sums
    assert sums[50_000] == sums[50_042]
    for _ in range(300):
        p = rng.randrange(len(b))
        q = rng.randrange(p, min(len(b), p + 60) + 1)
        assert (sums[p] == sums[q]) == (crc(0x8005, 16, b[p:q]) == 0)


@pytest.mark.parametrize("frames, total, whole", [(3, 576, 3), (3, 384, 2), (3, 9999, 2), (1, 0, 1), (0, 192, 0)])
def test_flac_ends(frames, total, whole):
    """The last sample ends it; where there are fewer samples than told, the last frame that another one follows."""
    rng = random.Random(frames * 31 + total)
    data = flac(rng, frames, total)
    ends = [len(flac(random.Random(frames * 31 + total), k, total)) for k in range(frames + 1)]
    assert media.find_media(b"x" + data + b"after") == [("audio/flac", 1, ends[whole])]


def hard():
    head = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + b"\xff\xf8\x19\x08\x00"
    head += bytes([crc(0x07, 8, head[-5:])])
    nested = b"".join(b"RIFF" + struct.pack("<I", MB - 20 * i - 20) + b"WAVELIST" + bytes(4) for i in range(MB // 20 - 2))
    yield "riff sizes beyond the end", (b"RIFF\xff\xff\xff\x7fWAVE" * (MB // 12))[:MB]
    yield "riff headers over one chain", nested + b"x" * (MB - len(nested))
    yield "text that is riff", ("RIFF\x10\x10\x10\x00WAVE" * (MB // 12)).encode()
    yield "gif headers in one endless chain", (b"GIF89a" + b"\x11" * 5 + b"\x00\x11!\xf9" + b"\x11" * 20) * (MB // 35)
    yield "gif headers with blocks of one byte", (b"GIF89a" + b"\x01" * 7) * (MB // 13)
    yield "flac frames without an end", head * 2000 + bytes(MB)


@pytest.mark.parametrize("name, data", list(hard()), ids=[n for n, _ in hard()])
def test_a_megabyte_takes_seconds(name, data):
    began = time.process_time()
    media.find_media(data)
    assert time.process_time() - began < 4
