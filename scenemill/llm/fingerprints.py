"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, id_text

#: The modulus and the two bases.
MODULUS = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
#: Prefixes and suffixes are recorded at this many lengths per doubling of the length.
PER_OCTAVE = 8
#: Spans end where the hash of WINDOW code points is a multiple of SPAN; the SKETCH least span hashes are recorded.
WINDOW = 16
SPAN = 32
SKETCH = 64

_POW: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POW or len(_POW[0]) <= n:
        size = max(n + 1, 1 << 17)
        _POW.clear()
        for base in BASES:
            out = np.ones(1, np.uint64)
            while len(out) < size:
                step = np.uint64(pow(base, len(out), MODULUS))
                out = np.concatenate((out, out * step % np.uint64(MODULUS)))
            _POW.append(out[:size])
    return _POW


class PrefixHash:
    """Modular prefix arrays of a text: H[i] = sum of (c+1) * B**j over the code points before i, for two bases.

    Spans of one or two texts compare in constant time after multiplying the earlier
    one by a power of the base (equality holds up to 62-bit collisions).
    """

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        value = points.astype(np.uint64) + np.uint64(1)
        self.rows = []
        for power in _powers(self.n + 1):
            row = np.zeros(self.n + 1, np.uint64)
            np.cumsum(value * power[: self.n] % np.uint64(MODULUS), out=row[1:])
            self.rows.append(row % np.uint64(MODULUS))

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Unnormalised hash of [a, b): carries the factor B**a."""
        return tuple((int(r[b]) - int(r[a])) % MODULUS for r in self.rows)

    def equal(self, a: int, other: PrefixHash, b: int, length: int) -> bool:
        """Whether self[a:a+length] == other[b:b+length]."""
        if a + length > self.n or b + length > other.n:
            return False
        power = _powers(max(self.n, other.n) + 1)
        mine, theirs = self.span(a, a + length), other.span(b, b + length)
        return all(x * int(p[b]) % MODULUS == y * int(p[a]) % MODULUS for x, y, p in zip(mine, theirs, power))

    def extension(self, a: int, other: PrefixHash, b: int) -> int:
        """Longest common extension to the right of the places a and b, by binary search."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a, other, b, mid) else (low, mid - 1)
        return low

    def extension_back(self, a: int, other: PrefixHash, b: int) -> int:
        """Longest common extension to the left of the places a and b."""
        low, high = 0, min(a, b)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(a - mid, other, b - mid, mid) else (low, mid - 1)
        return low


def grid(n: int) -> np.ndarray:
    """The lengths up to n at which prefixes and suffixes are recorded: 1, 2, ... then PER_OCTAVE a doubling; fixed for all texts."""
    out, octave = [], 1
    while octave <= n:
        step = max(1, octave // PER_OCTAVE)
        out.extend(range(octave, min(2 * octave, n + 1), step))
        octave *= 2
    return np.array(out, np.int64)


def fingerprint(h: PrefixHash) -> bytes:
    """Length and whole-text hash (8 bytes each), 16 bits of each recorded prefix and suffix, number of spans (4 bytes), least span hashes (4 bytes each)."""
    at, m, powers = grid(h.n), np.uint64(MODULUS), _powers(h.n + 1)
    whole = h.span(0, h.n)
    prefix = (h.rows[0][at] * np.uint64(1_000_003) + h.rows[1][at]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    parts = []
    for row, power in zip(h.rows, powers):  # a suffix carries the factor B**start: divided out, it compares across texts
        parts.append((row[h.n] + m - row[h.n - at]) % m * _inverse(power, h.n - at) % m)
    suffix = (parts[0] * np.uint64(1_000_003) + parts[1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    spans = _spans(h, powers)
    return struct.pack(">QII", h.n, *whole) + prefix.astype(">u2").tobytes() + suffix.astype(">u2").tobytes() + struct.pack(">I", len(spans)) + spans[:SKETCH].astype(">u4").tobytes()


def _spans(h: PrefixHash, powers: list[np.ndarray]) -> np.ndarray:
    """Distinct 32-bit hashes, sorted, of the content-defined spans of a text: the same wherever a span lies."""
    m = np.uint64(MODULUS)
    ends = np.zeros(0, np.int64)
    if h.n >= WINDOW:
        row = h.rows[0]
        value = (row[WINDOW:] + m - row[:-WINDOW]) % m * _inverse(powers[0], np.arange(h.n - WINDOW + 1)) % m
        ends = np.flatnonzero((value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SPAN) == 0) + WINDOW
    at = np.unique(np.concatenate(([0], ends, [h.n])))
    parts = [(row[at[1:]] + m - row[at[:-1]]) % m * _inverse(power, at[:-1]) % m for row, power in zip(h.rows, powers)]
    return np.unique((parts[0] * np.uint64(1_000_003) + parts[1]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))


_INV: list[np.ndarray] = []


def _inverse(power: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = 0 if power is _POW[0] else 1
    if not _INV or len(_INV[0]) < len(power):
        _INV.clear()
        for base in BASES:
            inverse, out = pow(base, -1, MODULUS), np.ones(1, np.uint64)
            while len(out) < len(power):
                out = np.concatenate((out, out * np.uint64(pow(inverse, len(out), MODULUS)) % np.uint64(MODULUS)))
            _INV.append(out[: len(power)])
    return _INV[k][at]


def likeness(a: bytes, b: bytes) -> float:
    """Likeness of two texts by their fingerprints (0 to 1; 1 only for equal fingerprints), the greater of two shares of the longer text.

    One is what lies in the common prefix and suffix: the longest recorded ones on which both agree (found by
    binary search: agreement at a length implies it at all shorter ones), without overlap, lower bounds to an
    eighth of their length. The other is the share of its content-defined spans that both texts hold at any place:
    exact up to SKETCH spans in both together, estimated from the SKETCH least hashes beyond.
    """
    if a == b:
        return 1.0
    na, nb = (struct.unpack(">Q", x[:8])[0] for x in (a, b))
    lengths = grid(min(na, nb))

    def agreed(x: bytes, y: bytes) -> int:
        low, high = 0, len(lengths)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[2 * mid - 2 : 2 * mid] == y[2 * mid - 2 : 2 * mid] else (low, mid - 1)
        return int(lengths[low - 1]) if low else 0

    grids = [2 * len(grid(n)) for n in (na, nb)]
    same = min(agreed(a[16:], b[16:]) + agreed(a[16 + grids[0] :], b[16 + grids[1] :]), min(na, nb))
    at = [16 + 2 * g for g in grids]
    ka, kb = (struct.unpack(">I", x[i : i + 4])[0] for x, i in zip((a, b), at))
    mine, theirs = (set(np.frombuffer(x[i + 4 :], ">u4").tolist()) for x, i in zip((a, b), at))
    least = sorted(mine | theirs)[:SKETCH]
    both = sum(h in mine and h in theirs for h in least) / max(len(least), 1)
    shared = min(both / (1 + both) * (ka + kb) / max(ka, kb, 1), 1.0)
    return min(max(same / max(na, nb), shared), 1 - 1 / max(na, nb, 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"


def _row(doc: int, text: str, following: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half] if half else text
    mine, other, nxt = (PrefixHash(_points(t)) for t in (text, edited, following))
    f, fe, fn = fingerprint(mine), fingerprint(other), fingerprint(nxt)
    return (
        doc, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), f, fe,
        likeness(f, fe), likeness(f, fn), mine.extension(0, other, 0), mine.extension(0, nxt, 0),
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited text: the last floor(n/2) code points give way to the first as many of the next document by
    (doc_id, text hash); the last document's next is the first. Texts are range
    partitioned and sorted once; each task reads its neighbours in order, and only the
    first and the last row of each partition (its boundary records) meet in a small second
    step. Null text counts as empty; null doc_id sorts first; of repeated rows each follows the
    other; a single document is its own next; an empty table gives no rows.
    """
    base = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th").asc()]
    empty = (None,) * 8

    def press(batches):  # texts shuffle at a third of their size
        for b in batches:
            engine = zstandard.ZstdCompressor(level=1)
            z = [engine.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), b.column(2)], ["doc_id", "z", "th"])

    def walk(batches):
        part, first, last = TaskContext.get().partitionId(), None, None
        rows: list[tuple] = []

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            names = [x.split()[0] for x in _OUT.split(", ")] + ["kind", "part", "text"]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            rows.clear()
            return out

        engine = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = engine.decompress(z).decode("utf-8", "surrogatepass")
                if last is None:
                    first = (doc, text)
                else:
                    rows.append((*_row(*last, text), "row", part, None))
                last = (doc, text)
                if len(rows) >= 512:
                    yield flush()
        if first is not None:
            rows.append((first[0], *empty, "first", part, first[1]))
            rows.append((last[0], *empty, "last", part, last[1]))
        yield flush()

    table = cut(base.mapInArrow(press, "doc_id long, z binary, th long").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, _OUT + ", kind string, part int, text string"), "fingerprints")
    # boundary records: two rows a partition; the ring of partitions is put together from their numbers alone
    parts = sorted(r["part"] for r in table.where("kind = 'first'").select("part").collect())
    ring = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    last = table.where("kind = 'last'").select("part", "doc_id", "text").join(F.broadcast(ring), "part")
    first = table.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))

    def finish(batches):
        for b in batches:
            got = [_row(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            if got:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _OUT.split(", ")])

    ends = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(finish, _OUT)
    out = table.where("kind = 'row'").select(*[x.split()[0] for x in _OUT.split(", ")]).unionByName(ends)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
