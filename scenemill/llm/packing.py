"""Packing by concatenate-and-cut with two-pass prefix sums."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import kept, trim
from .store import cut, id_text

#: Words of each of the two tables of ids that a worker process keeps: the newer one becomes the older one when it is full (speed only).
CACHE_WORDS = 150_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level tokenizer file: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


# Fixed value: the pattern that a byte-level pre-tokenizer splits by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(path: str, pattern: str) -> bool:
    """Whether a tokenizer file splits by ``pattern`` alone, at byte level, and its merges stand in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    step = spec.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and pattern == BYTE_LEVEL
    merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", []))
    ids = [spec["model"]["vocab"].get("".join(m), -1) for m in merges]
    return spec["model"].get("type") == "BPE" and not spec.get("normalizer") and plain and all(a < b for a, b in zip([-1, *ids], ids))


class WordIds:
    """Ids of whole texts through a table of space-separated pieces.

    The pattern never matches across the place before a space that a non-space follows,
    so pieces split there can be encoded apart, each distinct piece once. A text in
    which white space follows such a space is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Where merges stand in the order of the ids, a rank encoder over the same vocabulary gives the same ids; for
        # single pieces it takes half the time. Other tokenizers encode whole texts by the library.
        import public_tokenizers
        import tiktoken

        self.by_pieces = ranked(path, public_tokenizers.PATTERN)
        self.piece_ids = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_vocabulary(path), special_tokens={}).encode_ordinary

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, self.piece_ids(p)).tobytes() for p in pieces]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self._plain(texts)
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        # "^": no space before the first piece
        split = [("^" + t.replace(" ", "\0 ")).split("\0") for t in texts]
        fresh = set(chain.from_iterable(split)).difference(known)
        again = fresh & older.keys()
        known.update((p, older[p]) for p in again)
        fresh = list(fresh - again)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            # a space before more white space may belong to a longer run: such texts are encoded whole
            hard = [p == " " or p[:1] not in "^ " or p[:1] == " " and p[1:2].isspace() for p in part]
            known.update(zip(part, self._pieces([p[1:] if p[:1] == "^" else p for p in part])))
            known.update((p, None) for p, h in zip(part, hard) if h)
        get, out, whole = known.__getitem__, [], []
        for i, (t, pieces) in enumerate(zip(texts, split)):
            try:
                out.append(b"".join(map(get, pieces)) if "\0" not in t else None)
            except TypeError:
                out.append(None)
            if out[-1] is None:
                whole.append(i)
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    kept(_encoder.cache_clear)
    return WordIds(path)


def tokenize(docs: DataFrame, vocab_path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids): ids of each text and ``end_id``, little-endian in ``ids``.

    ``start`` is the sum of the tokens before it in the same partition (first pass of
    the prefix sums). The table is meant to be written at once.
    """

    def encode(batches):
        enc, part, seen = _encoder(vocab_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                ids = [x + end for x in enc.encode([t or "" for t in some.column(1).to_pylist()])]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                start = seen + np.cumsum(n) - n
                seen += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(n),
                     pa.array(np.full(len(ids), enc.dtype.itemsize, np.int32)), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "start", "n_tokens", "width", "ids"],
                )
            trim()

    return docs.mapInArrow(encode, "doc_id long, part int, start long, n_tokens long, width int, ids binary")


def pack(
    docs: DataFrame, vocab_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Cut the concatenation of all documents' ids into windows of ``length``; one row per piece.

    Pass 1 writes the ids with running sums inside each partition; the partitions' totals
    (one number each) give global offsets; pass 2 cuts each document at the window
    bounds, so a document that spans k windows has k boundary rows. All sequences
    but the last are full. Documents follow the order of the input partitions; null
    text and "" hold just ``end_id``; repeated rows are packed each; an empty table
    gives no rows. ``with_ids`` adds the ids (binary, little-endian 32-bit).
    """
    table = cut(tokenize(id_text(docs, id_col, text_col), vocab_path, end_id), "tokens")
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    offsets = docs.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    placed = table.join(F.broadcast(offsets), "part").select(
        "doc_id", "n_tokens", "width", "ids", (F.col("base") + F.col("start")).alias("at")
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pieces(batches):
        for b in batches:
            rows = {n: [] for n in names}
            ids_of, widths = b.column(3), b.column(2).to_pylist()
            for doc, n, w, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), widths, b.column(4).to_pylist(), ids_of):
                wide = np.frombuffer(raw.as_buffer(), f"<u{w}").astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                for a, e in zip(edges, edges[1:]):
                    piece = wide[a:e].tobytes()
                    row = (doc, a, e - a, zlib.crc32(piece), n, (at + a) // length, (at + a) % length, piece)
                    for k, v in zip(names, row):
                        rows[k].append(v)
            types = {"doc_id": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], types.get(n, pa.int64())) for n in names], names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return placed.mapInArrow(pieces, schema)
