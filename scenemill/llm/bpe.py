"""Byte-level BPE encoding and decoding with Spark higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import id_text

#: Slots of the literal rank map; a slot is a small map.
SLOTS = 1 << 14
#: Rank of a pair that never merges.
NEVER = (1 << 31) - 1
#: Words from which the fold uses a heap.
LONG_WORD = 400
#: Distinct words a task keeps.
TABLE_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 piece and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Ranks:
    """The vocabulary as literals of a Spark plan.

    Byte strings are held as Latin-1 strings (one character a byte). The rank map is an
    array of small maps, found by the checksum of the key, so that a look-up takes a few
    comparisons; the pieces are an array by id. Both are constant-folded once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            key = piece.decode("latin-1")
            slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
            pieces[rank] = key
        self._slots = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")
        self._pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def of(self, key: Column) -> Column:
        """Rank of a byte string, null if it is not in the vocabulary."""
        return self._slots[(F.crc32(key) % SLOTS).cast("int")][key]

    def encode(self, word: Column) -> Column:
        """Ids of one word (a Latin-1 string): a fold merges the pair of lowest rank, leftmost first, until none is left.

        The state holds the parts and the ranks of neighbouring pairs; a merge changes two ranks at most.
        """
        never = F.lit(NEVER)
        n = F.length(word)
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        ranks = F.transform(
            F.sequence(F.lit(1), n - 1), lambda i: F.coalesce(self.of(F.substring(word, i, F.lit(2))), never)
        )

        def step(state: Column, _: Column) -> Column:
            def merge(at: Column) -> Column:  # parts at and at + 1 (from 1) become one
                p, r = state["parts"], state["ranks"]
                joined = F.concat(p[at - 1], p[at])
                near = F.transform(
                    F.array(F.concat(F.get(p, at - 2), joined), F.concat(joined, F.get(p, at + 1))),
                    lambda key: F.when(key.isNotNull(), F.coalesce(self.of(key), never)),
                )
                return F.struct(
                    F.concat(F.slice(p, 1, at - 1), F.array(joined), F.slice(p, at + 2, n)).alias("parts"),
                    F.concat(
                        F.slice(r, 1, F.greatest(at - 2, F.lit(0))), F.array_compact(near), F.slice(r, at + 2, n)
                    ).alias("ranks"),
                )

            least = F.array_min(state["ranks"])
            place = F.transform(F.array(F.array_position(state["ranks"], least).cast("int")), merge)
            return F.when(F.coalesce(least, never) < never, place[0]).otherwise(state)

        folded = F.aggregate(
            F.sequence(F.lit(1), n - 1), F.struct(parts.alias("parts"), ranks.alias("ranks")), step, lambda s: s["parts"]
        )
        return F.when(n < 1, F.array().cast("array<int>")).when(n < 2, F.array(self.of(word))).otherwise(
            F.transform(folded, lambda p: self.of(p))
        )

    def decode(self, ids: Column) -> Column:
        """Bytes of an id array: the binary pieces one after another."""
        return F.encode(F.array_join(F.transform(ids, lambda i: self._pieces[i]), ""), "ISO-8859-1")


def encode_words(words: DataFrame, word_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``ids`` and ``decoded`` to a table with one binary word a row (null words: empty)."""
    r = Ranks(ranks)
    return words.withColumn(
        "ids", r.encode(F.decode(F.coalesce(F.col(word_col), F.lit(b"")), "ISO-8859-1"))
    ).withColumn("decoded", r.decode(F.col("ids")))


def fold_word(word: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The same fold in plain Python: merge the pair of lowest rank, leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > LONG_WORD:
        return _fold_long(parts, rank_of)
    get = rank_of.get
    ranks = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while ranks and (least := min(ranks)) < NEVER:
        i = ranks.index(least)
        parts[i] += parts.pop(i + 1)
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], NEVER)
    return [rank_of[p] for p in parts]


def _fold_long(parts: list[bytes], rank_of: dict[bytes, int]) -> list[int]:
    """:func:`fold_word` with a heap of pairs, for long words (n log n instead of n squared)."""
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank_of.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        alive[j], after[i] = False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank_of.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [rank_of[p] for p, here in zip(parts, alive) if here]


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Each task splits its texts by ``pattern``, folds each distinct word once by the literal rank map
    (in plain Python: see the README for why not :func:`encode_words` here) and puts the
    documents together from the words' ids and decoded pieces. No shuffle and no state
    across tasks. The table of words starts anew beyond ``TABLE_WORDS`` (memory only).
    Null and empty texts have no tokens and the hashes of the empty string; repeated rows repeat; an
    empty table gives no rows. ``with_ids`` adds the id array.
    """

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        piece_of = {rank: piece for piece, rank in ranks.items()}
        words: dict[str, tuple] = {}  # word: ids, their decimal names, decoded bytes
        pieces: dict[str, tuple | None] = {}  # the same for pieces between spaces

        def coded(text: str) -> tuple:
            out = []
            for w in find(text):
                if (known := words.get(w)) is None:
                    ids = fold_word(w.encode("utf-8", "replace"), ranks)
                    known = words[w] = (ids, " ".join(map(str, ids)), b"".join([piece_of[i] for i in ids]))
                out.append(known)
            if len(out) == 1:
                return out[0]
            return [i for o in out for i in o[0]], " ".join([o[1] for o in out]), b"".join([o[2] for o in out])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some = b.slice(lo, 500)
                n_tokens, id_sha, text_sha, arrays = [], [], [], []
                for text in some.column(1).to_pylist():
                    if len(words) > TABLE_WORDS:
                        words.clear()
                        pieces.clear()
                    # No match crosses the place before a space that a non-space follows, so pieces split there are
                    # coded apart; a text with white space after such a space is split whole.
                    split = ("^" + (text or "").replace(" ", "\0 ")).split("\0")
                    found = []
                    for p in split:
                        try:
                            found.append(pieces[p])
                        except KeyError:
                            hard = p[:1] not in "^ " or p == " " or p[:1] == " " and p[1:2].isspace()
                            pieces[p] = None if hard else coded(p[1:] if p[:1] == "^" else p)
                            found.append(pieces[p])
                    if None in found or text and "\0" in text:
                        found = [coded(text)]
                    n_tokens.append(sum([len(f[0]) for f in found]))
                    id_sha.append(hashlib.sha256(" ".join([f[1] for f in found if f[0]]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
                    if with_ids:
                        arrays.append([i for f in found for i in f[0]])
                out = [some.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(arrays, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
