"""Media columns: signature sniffing with Aho-Corasick and format validators."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import wave
import zlib
from bisect import bisect_right
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import id_text

# Magic bytes of each format and where they stand from its start.
SIGNATURES = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("audio/wav", b"RIFF", 0),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS", 0),
    ("video/mp4", b"ftyp", 4),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
]


class Media:
    """Bytes to look for media in; what several validators search for is located once."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def number(self, at: int, size: int, order: str = "big") -> int:
        return int.from_bytes(self.data[at : at + size], order)

    def places(self, what: bytes) -> list[int]:
        out, p = [], self.data.find(what)
        while p >= 0:
            out.append(p)
            p = self.data.find(what, p + 1)
        return out

    @cached_property
    def walks(self) -> dict[str, dict]:
        return {}

    def follow(self, name: str, p: int, step):
        """Where the walk p, step(p), step(step(p)) ... ends; ``step`` gives the next place, or a tuple with the end.

        Each sixteenth place of a walk remembers its end, so walks that join another one of the same name stop soon.
        """
        known, passed, count = self.walks.setdefault(name, {}), [], 0
        while not isinstance(p, tuple):
            if (end := known.get(p)) is not None:
                p = end
                break
            if count % 16 == 0:
                passed.append(p)
            p, count = step(p), count + 1
        known.update(dict.fromkeys(passed, p))
        return p[0]

    @cached_property
    def riff(self) -> dict[int, tuple]:
        """Chunk places that were walked over: the next one, a far one on the way (both None for the last), chunks to the last one, and how many of them are fmt and data."""
        return {}

    def chunks(self, p: int, end: int) -> tuple[int, int] | None:
        """How many fmt and data chunks lie from p to ``end``, if a walk over chunks from p comes to ``end`` exactly.

        Each chunk is walked over once; far places (skips that double along the way) find the end in few steps.
        """
        known, new = self.riff, []
        while (q := new[-1][1] if new else p) not in known:
            if q + 8 > self.n:
                known[q] = (None, None, 0, 0, 0)
                break
            size = self.number(q + 4, 4, "little")
            new.append((q, q + 8 + size + (size & 1)))
        for q, after in reversed(new):
            _, far, depth, *counts = known[after]
            further = known[far] if far is not None else None
            jump = further[1] if further and further[1] is not None and depth - further[2] == further[2] - known[further[1]][2] else after
            kind = self.data[q : q + 4]
            known[q] = (after, jump, depth + 1, counts[0] + (kind == b"fmt "), counts[1] + (kind == b"data"))
        q = p
        while q < end:
            after, far = known[q][:2]
            if after is None:
                return None
            q = far if far <= end else after
        return (known[p][3] - known[q][3], known[p][4] - known[q][4]) if q == end else None

    @cached_property
    def sums(self) -> np.ndarray:
        """A number for each place so that the FLAC checksum over the bytes between two places is 0 exactly where their numbers are equal.

        The checksum is linear: each byte adds its product with a power of x, which runs backwards through the places.
        """
        x, back = 1, []
        for _ in range(_CYCLE):
            back.append(x)
            x = (x << 1 ^ 0x8005) & 0xFFFF if x & 0x8000 else x << 1
        back = np.array(back, np.uint16)
        places = (16 - 8 * np.arange(1, _CYCLE + 1)) % _CYCLE
        b, out = np.frombuffer(self.data, np.uint8), np.zeros(self.n + 1, np.uint16)
        for k in range(8):
            powers = back[(places + k) % _CYCLE]
            out[1:] ^= np.where(b >> k & 1, np.resize(powers, self.n), 0).astype(np.uint16)
        return np.bitwise_xor.accumulate(out)

    @cached_property
    def by_sum(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of their numbers, and the numbers."""
        order = np.argsort(self.sums, kind="stable")
        return order, self.sums[order]

    @cached_property
    def frames(self) -> dict[int, list[int]]:
        """Places of FLAC frame headers by their numbers."""
        out = {}
        for m in re.finditer(rb"\xff[\xf8\xf9]", self.data):
            if _flac_frame(self.data, m.start()) is not None:
                out.setdefault(int(self.sums[m.start()]), []).append(m.start())
        return out

    def after_frame(self, p: int, last: bool) -> int | None:
        """Where the frame at p ends: where its checksum holds and, unless it is the ``last`` one, another frame starts."""
        number = self.sums[p]
        if not last:
            starts = self.frames.get(int(number), [])
            k = bisect_right(starts, p + 9)
            if k < len(starts):
                return starts[k]
            return None
        order, numbers = self.by_sum
        lo, hi = np.searchsorted(numbers, number), np.searchsorted(numbers, number, "right")
        k = lo + int(np.searchsorted(order[lo:hi], p + 9, "right"))
        return int(order[k]) if k < hi else None

    @cached_property
    def markers(self) -> np.ndarray:
        """Places of JPEG markers that end entropy-coded data."""
        b = np.frombuffer(self.data, np.uint8)
        return np.flatnonzero((b[:-1] == 0xFF) & (b[1:] != 0) & ((b[1:] < 0xD0) | (b[1:] > 0xD7)))

    @cached_property
    def pdf(self) -> tuple[list[int], list[int]]:
        """Places of PDF headers, and the ends of PDF trailers (a cross-reference place and the end mark)."""
        return self.places(b"%PDF-"), [m.end() for m in re.finditer(rb"startxref\s+\d{1,19}\s+%%EOF", self.data)]

    @cached_property
    def zips(self) -> dict[int, int]:
        """Start of each ZIP archive, as its end record tells it, to its end."""
        out = {}
        for p in self.places(b"PK\x05\x06"):
            if p + 22 <= self.n:
                size, offset, note = struct.unpack("<IIH", self.data[p + 12 : p + 22])
                if p + 22 + note <= self.n:
                    out.setdefault(p - size - offset, p + 22 + note)
        return out


def _png(m: Media, at: int):
    """A header chunk of 13 bytes, then chunks with right checksums up to IEND."""
    p, view = at + 8, memoryview(m.data)
    while p + 12 <= m.n:
        n, kind = m.number(p, 4), m.data[p + 4 : p + 8]
        if p + 12 + n > m.n or (p == at + 8) != (kind == b"IHDR" and n == 13) or zlib.crc32(view[p + 4 : p + 8 + n]) != m.number(p + 8 + n, 4):
            return None
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return None


def _gif(m: Media, at: int):
    """Screen, colour tables, blocks of sub-blocks, trailer."""
    b = m.data
    if at + 13 > m.n:
        return None
    flags = b[at + 10]

    def block(p: int):
        kind = b[p] if p < m.n else None
        if kind == 0x3B:
            return (p + 1,)
        if kind == 0x2C and p + 10 <= m.n:
            local = b[p + 9]
            p += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0) + 1
        elif kind == 0x21:
            p += 2
        else:
            return (None,)
        return m.follow("gif sub-blocks", p, lambda p: p + 1 + b[p] if p < m.n and b[p] else (p,)) + 1

    end = m.follow("gif blocks", at + 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0), block)
    return None if end is None else end - at


def _jpeg(m: Media, at: int):
    """Marker segments up to the end-of-image marker."""
    b, p = m.data, at + 2
    while p + 2 <= m.n and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            p += 2
            continue
        n = m.number(p + 2, 2)
        if kind < 0xC0 or n < 2 or p + 4 > m.n:
            return None
        p += 2 + n
        if kind == 0xDA:
            k = int(np.searchsorted(m.markers, p))
            if k == len(m.markers):
                return None
            p = int(m.markers[k])
    return None


def _wav(m: Media, at: int):
    """RIFF size within the bytes, form WAVE, chunks fmt and data that fill it."""
    if at + 12 > m.n or m.data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + m.number(at + 4, 4, "little")
    counts = m.chunks(at + 12, end) if at + 12 <= end <= m.n else None
    return end - at if counts and min(counts) else None


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for c in range(256):
        c <<= bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8 = _crc_table(0x07, 8)
#: Powers of x modulo the 16-bit checksum's polynomial come round after so many.
_CYCLE = 32767


def _flac_frame(b: bytes, p: int) -> int | None:
    """Samples of the FLAC frame whose header stands at p; None if there is no header with a right checksum."""
    if b[p : p + 2] not in (b"\xff\xf8", b"\xff\xf9") or p + 6 > len(b):
        return None
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    lead = 8 - (b[p + 4] ^ 0xFF).bit_length()  # ones that lead the coded number
    q = p + 4 + max(1, lead)
    more = {6: 1, 7: 2}.get(size, 0)
    end = q + more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or lead in (1, 8) or end >= len(b):
        return None
    crc = 0
    for c in b[p:end]:
        crc = _CRC8[crc ^ c]
    if crc != b[end]:
        return None
    if more:
        return int.from_bytes(b[q : q + more], "big") + 1
    return 192 if size == 1 else 144 << size if size <= 5 else 1 << size


def _flac(m: Media, at: int):
    """STREAMINFO of 34 bytes, metadata blocks, then frames whose checksums hold; it ends with the last sample or the last such frame."""
    b, p, first, last = m.data, at + 4, True, False
    while not last:
        if p + 4 > m.n:
            return None
        kind, n = b[p], m.number(p + 1, 3)
        if first and (kind & 0x7F or n != 34) or p + 4 + n > m.n:
            return None
        if first:
            total = m.number(p + 17, 5) & (1 << 36) - 1
        p, first, last = p + 4 + n, False, bool(kind & 0x80)
    done = 0
    while (samples := _flac_frame(b, p)) is not None and not (total and done >= total):
        end = m.after_frame(p, last=done + samples >= total)
        if end is None:
            break
        p, done = end, done + samples
    return p - at


def _ogg(m: Media, at: int):
    """Pages with version 0 one after another, the first of them opening a stream, until every stream has ended."""
    b, p, pages, streams = m.data, at, 0, set()
    while p + 27 <= m.n and b[p : p + 4] == b"OggS":
        segments = b[p + 26]
        if b[p + 4] != 0 or (pages == 0 and not b[p + 5] & 2) or p + 27 + segments > m.n:
            break
        n = sum(b[p + 27 : p + 27 + segments])
        if p + 27 + segments + n > m.n:
            break
        (streams.discard if b[p + 5] & 4 else streams.add)(b[p + 14 : p + 18])
        p, pages = p + 27 + segments + n, pages + 1
        if not streams:
            break
    return p - at if pages else None


def _mp4(m: Media, at: int):
    """Top-level boxes of known sizes, the first of them (and no other) ftyp."""
    p, boxes = at, 0
    while p + 8 <= m.n:
        n, kind = m.number(p, 4), m.data[p + 4 : p + 8]
        if n == 1 and p + 16 <= m.n:
            n = m.number(p + 8, 8)
        if n < 8 or p + n > m.n or not kind.isalnum() or (boxes == 0) != (kind == b"ftyp"):
            break
        p, boxes = p + n, boxes + 1
    return p - at if boxes >= 2 else None


def _pdf(m: Media, at: int):
    """Up to the last trailer (updates add trailers) before the next PDF header."""
    heads, ends = m.pdf
    k = bisect_right(heads, at)
    limit = heads[k] if k < len(heads) else m.n
    k = bisect_right(ends, limit) - 1
    return ends[k] - at if k >= 0 and ends[k] > at else None


def _zip(m: Media, at: int):
    """The first end record whose directory's place and size lead back here."""
    return m.zips[at] - at if at in m.zips else None


def _gzip(m: Media, at: int):
    """A deflate stream whose checksum and length hold."""
    engine, view = zlib.decompressobj(31), memoryview(m.data)
    try:
        for p in range(at, m.n, 1 << 16):
            feed = view[p : p + (1 << 16)]
            while feed and not engine.eof:
                engine.decompress(feed, 1 << 20)
                feed = engine.unconsumed_tail
            if engine.eof:
                return min(p + (1 << 16), m.n) - len(engine.unused_data) - at
    except zlib.error:
        pass
    return None


VALIDATORS = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "audio/flac": _flac, "audio/ogg": _ogg,
    "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick over all magic bytes (as Latin-1 strings)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, magic, offset in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    out.make_automaton()
    return out


def find_media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every confirmed medium, outermost first; what lies inside one is left out.

    All magic bytes come from one pass; a hit counts only if its format's validator
    confirms the structure and gives a length. Of hits that start at one place the
    longest counts.
    """
    hits: dict[int, list[str]] = {}
    for end, (kind, size, offset) in automaton().iter(data.decode("latin-1")):
        if (start := end + 1 - size - offset) >= 0:
            hits.setdefault(start, []).append(kind)
    media, found, reach = Media(data), [], 0
    for start in sorted(hits):
        if start < reach:
            continue
        sizes = [(n, kind) for kind in sorted(hits[start]) if (n := VALIDATORS[kind](media, start))]
        if sizes:
            n, kind = max(sizes)
            found.append((kind, start, n))
            reach = start + n
    return found


def sniff(df: DataFrame, content_col: str, declared_col: str) -> DataFrame:
    """Adds media_type, media_valid_bytes, media_corrected, media_embedded to a table of media bytes.

    ``media_type``: the confirmed type of what starts at byte 0, else the declared one
    (null content: null). ``media_corrected``: whether it differs from the declared type.
    ``media_embedded``: array of (type, start, length, content) carved from other places.
    Null or empty content has no type of its own and no embedded media. Existing columns
    of those four names are replaced; all others stay.
    """
    kind = "struct<media_type:string,media_valid_bytes:long,media_embedded:array<struct<type:string,start:long,length:long,content:binary>>>"

    @F.pandas_udf(kind)
    def look(content):
        import pandas as pd

        rows = []
        for data in content:
            found = find_media(data) if data else []
            first = found[0] if found and found[0][1] == 0 else (None, 0, None)
            rows.append((first[0], first[2], [(k, s, n, data[s : s + n]) for k, s, n in found if s > 0]))
        return pd.DataFrame(rows, columns=["media_type", "media_valid_bytes", "media_embedded"])

    name = "media"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    seen = df.withColumn(name, look(content_col))
    kind_col = F.coalesce(f"{name}.media_type", F.when(F.col(content_col).isNotNull(), F.col(declared_col)))
    return seen.withColumns(
        {
            "media_type": kind_col,
            "media_valid_bytes": F.col(f"{name}.media_valid_bytes"),
            "media_corrected": ~kind_col.eqNullSafe(F.col(declared_col)) & F.col(f"{name}.media_type").isNotNull(),
            "media_embedded": F.col(f"{name}.media_embedded"),
        }
    ).drop(name)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM: each payload byte is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


#: Types that stored texts are declared as, by a checksum of the text; the sniffed type corrects all but the second.
DECLARED = ("application/octet-stream", "audio/wav", "image/png", "text/plain")


def text_media(docs: DataFrame, block: int = 576, declare: tuple[str, ...] = DECLARED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a WAV medium, sniffs the stored bytes, carves the payload back and describes it.

    The payload is the UTF-8 text with bytes 255 appended up to a positive multiple of
    ``block``. Each text is declared as one of ``declare``. ``feature`` holds the declared and the corrected type, the length the
    validator confirmed, the media embedded in the payload (type@start+length) and a
    16-bin histogram of the read-back samples. Null and empty texts give one block of
    filler; equal texts give equal values; an empty table gives no rows. Works row by
    row, without a shuffle.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "n_embedded"]

    def store(batches):
        for b in batches:
            rows = {n: [] for n in names}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                size = max(1, -(-len(raw) // block)) * block
                declared = declare[zlib.crc32(raw) % len(declare)]
                media = to_wav(raw + b"\xff" * (size - len(raw)))
                kind, start, length = find_media(media)[0]
                with wave.open(io.BytesIO(media[start : start + length])) as w:
                    back = w.readframes(w.getnframes())
                inside = find_media(back)
                bins = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
                feature = f"{declared}>{kind};valid={length};embedded=" + ",".join(f"{k}@{s}+{n}" for k, s, n in inside)
                feature += ";hist=" + ",".join(map(str, bins.tolist()))
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                       hashlib.sha256(media).hexdigest(), feature, kind, kind != declared, len(inside))
                for k, v in zip(names, row):
                    rows[k].append(v)
            kinds = {**dict.fromkeys(["payload_sha256", "media_sha256", "feature", "media_type"], pa.string()), "corrected": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.int64())) for n in names], names)

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, media_type string, corrected boolean, n_embedded long"
    )
    return id_text(docs, id_col, text_col).mapInArrow(store, schema)
