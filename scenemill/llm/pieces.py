"""SentencePiece BPE encoding and decoding that keeps the byte span of every piece."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import id_text

#: The mark that stands for a space, the replacement character, and the model file's numbers for kinds of pieces.
SPACE, BROKEN = "▁", "�"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters from which the merging uses a heap.
LONG_CHUNK = 200
#: Distinct chunks a task keeps.
TABLE_CHUNKS = 300_000


def _fields(data: bytes):
    """(number, value) of each field of a serialised message; numbers and floats as they lie there."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < n:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map of a model: a double-array trie of byte strings and the texts that replace them.

    A unit of the trie is 32 bits: the low byte is its label, bit 8 says that a value hangs below, the rest is the
    offset to its children (times 256 where bit 9 is set). The replacement texts end with a zero byte.
    """

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]
        self.first = {b for b in range(256) if self.units and self._child(self._below(self.units[0]), b) is not None}

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, base: int, label: int) -> int | None:
        at = base ^ label
        if at < len(self.units) and self.units[at] & 0x800000FF == label:
            return at
        return None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that starts at a place of ``raw`` (0: none) and the bytes that replace it."""
        if not self.units or raw[at] not in self.first:
            return 0, b""
        base, length, value = self._below(self.units[0]), 0, 0
        for i in range(at, len(raw)):
            node = self._child(base, raw[i])
            if node is None:
                break
            base = node ^ self._below(self.units[node])
            if self.units[node] & 256:
                length, value = i - at + 1, self.units[base] & 0x7FFFFFFF
        return (length, self.texts[value : self.texts.index(0, value)]) if length else (0, b"")


class Model:
    """A SentencePiece BPE model, read from its file's bytes.

    Models with user-defined or unused pieces, of another kind than BPE or without byte pieces are refused (ValueError).
    """

    def __init__(self, data: bytes):
        self.names, kinds, self.score = [], [], {}
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                kinds.append(piece.get(3, NORMAL))
                if kinds[-1] == NORMAL:
                    self.score[self.names[-1]] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte pieces and without user-defined pieces are read")
        self.map = CharMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(i, 1)) for i in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.id = {name: i for i, name in enumerate(self.names) if kinds[i] == NORMAL}
        byte_ids = [i for i, kind in enumerate(kinds) if kind == BYTE]
        self.byte_id = {int(self.names[i][3:5], 16): i for i in byte_ids}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        self.unknown = {i for i, kind in enumerate(kinds) if kind == UNKNOWN}
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        inner = {c for name in self.score if len(name) > 1 for c in name}
        # No merge joins two chunks: one ends before a space mark that follows another character (where no piece has one
        # inside) and at characters that no longer piece holds.
        if any(SPACE in name.lstrip(SPACE) for name in self.score):
            self.chunks = re.compile("(?s).+").findall
        else:
            alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inner)
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

        # What an id stands for by itself; byte pieces need their neighbours.
        self.text_of = [None if i in self.byte_of else self.unknown_text if i in self.unknown else "" if i in self.silent else name.replace(SPACE, " ") for i, name in enumerate(self.names)]

    def normalize(self, text: str, aligned: bool = False) -> tuple[str, list[int] | np.ndarray | None]:
        """The normalised text; with ``aligned``, the source byte where each of its characters starts, and the end of the last.

        At each place the longest key of the character map is replaced; where none starts, one character is kept. Spaces
        become marks, one mark is put before the text, and runs of spaces shrink only where the model says so.
        """
        if not text:
            return "", [0] if aligned else None
        space = SPACE if self.escape else " "
        raw = text.encode("utf-8", "replace")
        if not self.map.units and not self.squeeze and not self.suffix:  # no key can start anywhere: each character stands where it stood
            whole = (space if self.prefix else "") + (text.replace(" ", SPACE) if self.escape else text)
            if not aligned:
                return whole, None
            starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            return whole, np.concatenate(([0] if self.prefix else [], starts, [len(raw)])).astype(np.int64)
        out, starts, at, gap, begun = [], [], 0, self.squeeze, False
        while at < len(raw):
            used, new = self.map.longest(raw, at)
            if not used:
                head = raw[at]
                used = 1 if head < 0xC0 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
                new = raw[at : at + used]
            put = new.decode("utf-8", "replace")
            if not begun and not (self.squeeze and put == " "):  # the mark before the text stands where its first kept character does
                begun = True
                if self.prefix and not self.suffix:
                    out.append(space)
                    starts.append(at)
            if gap:
                put = put.lstrip(" ")
            if begun and put:
                out.append(put.replace(" ", SPACE) if self.escape else put)
                starts.extend([at] * len(put))
                gap = self.squeeze and put.endswith(" ")
            at += used
        whole, end = "".join(out), at
        if self.squeeze:
            kept = len(whole.rstrip(space))
            if kept < len(whole):
                end = starts[kept]
            whole, starts = whole[:kept], starts[:kept]
        if begun and self.prefix and self.suffix:
            whole += space
            starts.append(end)
        return whole, [*starts, end] if aligned else None

    def merge(self, chunk: str) -> list[str]:
        """Merges the neighbours whose joint piece scores best, leftmost first, until no joint piece is known."""
        parts, score = list(chunk), self.score.get
        if len(parts) > LONG_CHUNK:
            return self._merge_long(parts)
        never = float("-inf")
        scores = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > never:
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], never)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], never)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """:meth:`merge` with a heap of pairs: n log n for texts without spaces."""
        n, score = len(parts), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # a part of the pair has grown or gone
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := score(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def ids(self, chunk: str) -> list[int]:
        """Ids of one chunk; a character that is no piece gives its bytes."""
        out = []
        for part in self.merge(chunk):
            known = self.id.get(part)
            out.extend([self.byte_id[b] for b in part.encode("utf-8", "replace")] if known is None else [known])
        return out

    def coded(self, chunk: str) -> tuple[bytes, bytes, str]:
        """Ids of one chunk, the characters that each covers (both as packed numbers) and the ids' decimal names; of the bytes of a character that is no piece, the last one covers it."""
        ids, sizes = array("i"), array("H")
        for part in self.merge(chunk):
            known = self.id.get(part)
            some = [self.byte_id[b] for b in part.encode("utf-8", "replace")] if known is None else [known]
            ids.extend(some)
            sizes.extend([0] * (len(some) - 1) + [len(part)])
        return ids.tobytes(), sizes.tobytes(), ",".join(map(str, ids))

    def spans(self, text: str, table: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """:meth:`encode` as arrays, with the ids' decimal names joined by commas; ``table`` keeps the chunks from text to text."""
        whole, places = self.normalize(text, aligned=True)
        found, known = [], table.get
        for c in self.chunks(whole):
            if (got := known(c)) is None:
                if len(table) > TABLE_CHUNKS:
                    table.clear()
                got = table[c] = self.coded(c)
            found.append(got)
        ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
        sizes = np.frombuffer(b"".join([f[1] for f in found]), np.uint16)
        last, places = np.cumsum(sizes, dtype=np.int64), np.asarray(places, np.int64)
        return ids, places[last - sizes], places[last], ",".join([f[2] for f in found])

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a whole text with the source bytes where each piece begins and ends.

        Of the bytes of a character that is no piece, the last one spans the character, those before it are empty.
        """
        return tuple(a.tolist() for a in self.spans(text, {})[:3])

    def surface(self, ids: list[int]) -> str:
        """The pieces of the ids one after another, marks as spaces; runs of byte pieces are read as UTF-8.

        A byte that belongs to no whole character gives one replacement character.
        """
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except TypeError:  # there are byte pieces
            out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        if size == 4:
                            out.append(BROKEN)
                            at += 1
            run.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                flush()
            out.append(self.text_of[i])
        flush()
        return "".join(out)

    def trimmed(self, surface: str, ids: list[int]) -> str:
        """The decoded text of a whole document: without the mark that was put before it."""
        if self.prefix or self.squeeze:
            for i in ids:
                if i in self.silent:
                    continue
                if i in self.byte_of or i in self.unknown:
                    break
                name = self.names[i]
                if not name.startswith(SPACE):
                    break
                surface = surface[1:]
                if not self.squeeze or name != SPACE:
                    break
        return surface

    def decode(self, ids: list[int]) -> str:
        return self.trimmed(self.surface(ids), ids)


def encode_documents(docs: DataFrame, model: bytes, with_pieces: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text with a SentencePiece BPE model and decodes the ids again.

    Each task normalises its texts with the source byte of every character, cuts them where no merge can cross, merges each distinct chunk
    once, lays the chunks' pieces over the text and decodes the ids of the whole text; the model's bytes (under a megabyte, fixed by the file) go with the plan.
    No shuffle and no state across tasks; the table of chunks starts anew beyond ``TABLE_CHUNKS`` (memory only). Null and empty
    texts have no tokens and the hashes of the empty string; repeated rows repeat; an empty table gives no rows. ``with_pieces`` adds
    the arrays ``ids``, ``begins`` and ``ends``: the original bytes (of the text's UTF-8) that each piece covers; ``spans_crc32`` is theirs
    (unsigned; all begins, then all ends, as little-endian 64-bit numbers).
    """

    def run(batches):
        m = Model(model)
        table: dict[str, tuple] = {}

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                some = b.slice(lo, 200)
                n_tokens, id_sha, text_sha, spans_crc, arrays = [], [], [], [], []
                for text in some.column(1).to_pylist():
                    ids, begins, ends, names_of = m.spans(text or "", table)
                    n_tokens.append(len(ids))
                    id_sha.append(hashlib.sha256(names_of.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(m.decode(ids.tolist()).encode("utf-8", "replace")).hexdigest())
                    spans_crc.append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes())))
                    if with_pieces:
                        arrays.append((ids, begins, ends))
                columns = [some.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_pieces:
                    columns += [pa.array([a[k] for a in arrays], pa.list_(pa.int64())) for k in range(3)]
                    names += ["ids", "begins", "ends"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans_crc, pa.int64())], [*names, "spans_crc32"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema + ", ids array<long>, begins array<long>, ends array<long>" * with_pieces + ", spans_crc32 long")
