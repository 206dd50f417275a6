"""Vectorised hashing of bytes and words with numpy (runs inside Spark tasks)."""

from __future__ import annotations

import ctypes

import numpy as np

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS = {}
#: Powers that a worker keeps.
KEPT = 1 << 20
#: Bytes of text that are hashed at once (a longer text alone): arrays take up to about 60 times that.
SLICE = 1 << 19


def trim() -> None:
    """Gives freed memory of this worker back to the system: workers are kept between tasks, and the allocator keeps what arrays needed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: What empties the tables that an operator keeps in a worker from one of its tasks to the next.
_KEEPERS = []


def kept(empty) -> None:
    """Names a function that empties a table of one operator; it is called when a task of another one starts in the worker."""
    _KEEPERS.append(empty)


def forget() -> None:
    """Empties the tables that operators have kept in this worker."""
    while _KEEPERS:
        _KEEPERS.pop()()


def slices(batch, column: int):
    """The Arrow batch in slices of at most SLICE bytes in ``column`` (or one row), in order; all together the whole batch."""
    import pyarrow.compute as pc

    forget()
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(31))
    x = x * U(0x9E3779B97F4A7C15)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, KEPT), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= KEPT:  # longer ones are computed again, so that a worker does not keep them
            _POWERS[base] = have
    return have[: n + 1]


class ByteHash:
    """Prefix sums of a polynomial hash modulo 2**64 over a byte buffer.

    Each byte first goes through a fixed random 64-bit table; the hash of a span
    does not depend on where in the buffer it lies.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(n, _BASE)[:n], out=self.prefix[1:])
        self.inverse = powers(n, _INVERSE)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k-byte window, by start."""
        n = len(self.prefix) - 1
        return mix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.inverse[: n + 1 - k])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def join_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a line feed; and the start of each (plus the end)."""
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=bounds[1:])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of many texts at once.

    A word is a run of ASCII letters, digits, underscores and non-ASCII bytes.
    Returns (hash, byte start, byte end, offsets): the words of text i are
    offsets[i]:offsets[i + 1]; byte places count from the start of the lower-cased
    text joined by :func:`join_texts`.
    """
    data, bounds = join_texts([t.lower() if t else "" for t in texts])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    hashes = ByteHash(data).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    return hashes, start, end, np.searchsorted(start, bounds)


def word_prefixes(texts: list, sizes: tuple = (4, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its first 4 and 6 bytes (salted), word after word; and the offsets of each text."""
    data, bounds = join_texts([t.lower() if t else "" for t in texts])
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    spans = ByteHash(data).spans
    columns = [spans(start, end)] + [mix(spans(start, np.minimum(end, start + k)) + U(k)) for k in sizes]
    return np.stack(columns, 1).ravel(), np.searchsorted(start, bounds) * len(columns)


_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
         0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by first word (runs may cross texts; callers cut them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mix(hashes[j : j + n] + U(j)) * U(_STEP[j % 8] | 1)
    return mix(total)


def shingle_sets(texts: list, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of 1 to k-1 words has one shingle."""
    hashes, _, _, at = words(texts)
    all_runs = shingles(hashes, k)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(all_runs[a : b - k + 1]))
        elif b > a:
            out.append(shingles(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by start."""
    n, out, done = len(values), values, 1
    if n < width:
        return values[:0]
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: n - width + 1], out[width - done : width - done + n - width + 1])
