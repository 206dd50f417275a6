"""Exact substring deduplication with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import SLICE, ByteHash, U, forget, mix, sliding_min, trim
from .store import cut, drop, id_text, keyed, sieve, sifted

#: Bytes of the anchor that decides which spans meet in one suffix array.
ANCHOR = 32
#: Suffixes, or bytes, that one suffix array holds at least, where there are as many.
BLOCK = 200_000
BLOCK_BYTES = 2 << 20
#: Different spans of one anchor that may meet in one task; the windows of more common anchors are dealt once more.
MANY = 4000
_PLACE = (1 << 24) - 1


def suffix_array(data: np.ndarray, begin: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Suffix array by two-stage sorting of the spans begin:end of ``data`` that lie one after another.

    A suffix ends with its span; an end sorts below every byte. Only suffixes smaller than their
    successors are sorted directly; then one scan over the buckets of first bytes, in ascending order, puts
    each larger one in front of the direct ones of its bucket, in the order of its successor. Suffixes that start after ``last`` (per
    span) are left out, except those from which a wanted one is induced.
    """
    n = len(data)
    nxt = np.empty(n, np.int16)
    nxt[:-1] = data[1:]
    nxt[end - 1] = -1
    here = data.astype(np.int16)
    # smaller than the successor: first differing byte to the right rises
    differs = np.flatnonzero(here != nxt)
    first = differs[np.searchsorted(differs, np.arange(n))]
    small = here[first] < nxt[first]
    wanted = np.zeros(n + 1, np.int32)
    stop = np.flatnonzero(small | (nxt < 0))
    reach = np.minimum(stop[np.searchsorted(stop, last)], end - 1)
    np.add.at(wanted, begin, 1)
    np.add.at(wanted, reach + 1, -1)
    wanted = np.cumsum(wanted[:n]) > 0
    direct = np.flatnonzero(small & wanted)
    span_end = np.repeat(end, end - begin)
    text = data.tobytes().decode("latin-1")
    keys = [text[a:b] for a, b in zip(direct.tolist(), span_end[direct].tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    larger = ~small & wanted
    larger_at = np.concatenate((larger, [False]))  # place -1 falls on the pad
    direct_by = np.split(direct, np.searchsorted(data[direct], np.arange(1, 256)))
    first_of = np.zeros(n, bool)
    first_of[begin] = True
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(members: np.ndarray) -> None:
        """Larger suffixes one place to the left of ``members``, queued by first byte in that order."""
        left = members[~first_of[members]] - 1
        left = left[larger_at[left]]
        if len(left):
            kinds = data[left]
            order = np.argsort(kinds, kind="stable")
            left, kinds = left[order], kinds[order]
            cuts = np.flatnonzero(np.diff(kinds)) + 1
            for part in np.split(left, cuts):
                pending[data[part[0]]].append(part)

    ends = end[larger_at[end - 1]] - 1  # the last place of a span follows the (smallest) end of its span
    for part_byte in np.unique(data[ends]) if len(ends) else []:
        pending[part_byte].append(ends[data[ends] == part_byte])
    out = []
    for byte in range(256):
        queue = pending[byte]
        while queue:  # each wave may queue more of the same bucket, behind itself
            wave = np.concatenate(queue)
            queue.clear()
            out.append(wave)
            induce(wave)
        if len(direct_by[byte]):
            out.append(direct_by[byte])
            induce(direct_by[byte])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix shares at least ``limit`` bytes with the one before it in ``order`` (the first: no).

    All suffixes must have ``limit`` bytes. Compared eight bytes at a time, with those that still agree.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(padded) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    alive = np.arange(1, len(order))
    for lo in [*range(0, limit - 7, 8)] + ([limit - 8] if limit % 8 else []):
        alive = alive[eight[order[alive] + lo] == eight[order[alive - 1] + lo]]
    out = np.zeros(len(order), bool)
    out[alive] = True
    return out


def repeated_windows(spans: list[bytes], counts: list[int], limit: int) -> list[np.ndarray]:
    """For each span the starts of its ``limit``-byte windows that occur elsewhere in ``spans``, each of which stands for counts[i] places."""
    size = np.array([len(s) for s in spans], np.int64)
    end = np.cumsum(size)
    begin = end - size
    data = np.frombuffer(b"".join(spans), np.uint8)
    order = suffix_array(data, begin, end, end - limit)
    span_of = np.repeat(np.arange(len(spans)), size)
    order = order[order <= (end - limit)[span_of[order]]]
    same = adjacent_prefixes(data, order, limit)
    run = np.cumsum(~same) - 1
    places = np.bincount(run, weights=np.asarray(counts, float)[span_of[order]])
    hits = np.sort(order[places[run] > 1.5])
    owner = span_of[hits]
    return np.split(hits - begin[owner], np.searchsorted(owner, np.arange(1, len(spans))))


def _anchors(limit: int):
    """(doc_id, th, text) to one row for each run of windows with one anchor.

    Every ``limit``-byte window picks its anchor by its content alone: the leftmost of its
    ANCHOR-byte strings with the least hash. Equal windows so have equal anchors.
    """
    width = limit - ANCHOR + 1

    def run(batches):
        forget()
        for b in batches:
            pieces, where, size = [], [], 0

            def flush():
                data = np.frombuffer(b"".join(pieces), np.uint8)
                hashes = ByteHash(data)
                anchor = hashes.windows(ANCHOR)
                value = (anchor & ~U(_PLACE)) | np.arange(len(anchor), dtype=np.uint64)
                pick = (sliding_min(value, width) & U(_PLACE)).astype(np.int64)
                ends = np.cumsum([len(p) for p in pieces])
                begins = ends - [len(p) for p in pieces]
                piece_of = np.repeat(np.arange(len(pieces)), ends - begins)[: len(pick)]
                pick[np.arange(len(pick)) + limit > ends[piece_of]] = -1
                edge = np.flatnonzero(np.diff(pick, prepend=-2))
                stop = np.append(edge[1:], len(pick))
                keep = pick[edge] >= 0
                edge, stop = edge[keep], stop[keep]
                at, owner = pick[edge], piece_of[edge]
                shape = ((at - edge) * 65536 + (stop - edge)).astype(np.uint64)
                content = hashes.spans(edge, stop + limit - 1) + shape * U(0x9E3779B97F4A7C15)
                place = edge - begins[owner] + np.array([w[2] for w in where])[owner]
                out = [
                    pa.array(anchor[at].view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array([w[0] for w in where], pa.int64()).take(pa.array(owner)),
                    pa.array([w[1] for w in where], pa.int64()).take(pa.array(owner)),
                    pa.array(place), pa.array((stop - edge).astype(np.int32)),
                ]
                pieces.clear()
                where.clear()
                return pa.RecordBatch.from_arrays(out, ["h", "sh", "doc_id", "th", "start", "windows"])

            for doc, text, th in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "replace")
                for lo in range(0, len(raw) - limit + 1, SLICE):
                    pieces.append(raw[lo : lo + SLICE + limit - 1])
                    where.append((doc, th, lo))
                    size += len(pieces[-1])
                    if size >= SLICE:
                        yield flush()
                        size = 0
            if pieces:
                yield flush()
            trim()

    return run


def narrower(span: bytes, windows: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a span in pairs: (key, content, first window, windows) of each pair.

    Windows pair up by their distance from the anchor, and the key is a hash of the limit - 1 bytes that both hold. So equal windows
    have equal keys, and pairs with one key differ by a byte at each side: at most 65,536 different ones (and 512 of one window).
    """
    hashes = ByteHash(np.frombuffer(span, np.uint8))
    anchor = hashes.windows(ANCHOR)[: limit - ANCHOR + 1]
    at = int(np.argmin(anchor & ~U(_PLACE)))
    pair = np.arange((at - windows + 1) // 2, at // 2 + 1)  # window i lies at - i before the anchor
    core = at - 2 * pair  # where the later window of the pair starts; the earlier one starts a byte before it
    first, stop = np.maximum(core - 1, 0), np.minimum(core + 1, windows)
    salt = pair.astype(np.uint64) * U(0xD6E8FEB86659FD93) + anchor[at]
    key = mix(hashes.spans(core, core + limit - 1) + salt)
    shape = ((core - first) * 4 + stop - first).astype(np.uint64)
    return key, hashes.spans(first, stop + limit - 1) + salt + shape * U(0x9E3779B97F4A7C15), first, stop - first


def _dealt_again(rows: DataFrame, by_text: DataFrame, limit: int) -> DataFrame:
    """The spans of very common anchors (a written table: the spans of each text) as pairs of windows, in the columns of spans."""
    names = ["h", "sh", "doc_id", "th", "start", "windows"]

    def run(batches):
        for b in batches:
            unpack = zstandard.ZstdDecompressor()
            for doc, th, z, some in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack.decompress(z)
                parts = [[], [], [], []]
                for s in some:
                    key, content, first, n = narrower(raw[s["start"] : s["start"] + s["windows"] + limit - 1], s["windows"], limit)
                    for x, v in zip(parts, (key.view(np.int64), content.view(np.int64), first + s["start"], n.astype(np.int32))):
                        x.append(v)
                h, sh, start, n = map(np.concatenate, parts)
                own = [pa.array([v] * len(h), pa.int64()) for v in (doc, th)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sh), *own, pa.array(start, pa.int64()), pa.array(n)], names)

    packed = _packed(sifted(rows, sieve(by_text, "doc_id", "th"), "doc_id", "th"))
    joined = packed.join(by_text, _same_row(packed, by_text)).select(packed["doc_id"], packed["th"], "z", "spans")
    return joined.mapInArrow(run, "h long, sh long, doc_id long, th long, start long, windows int")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, z, extra): texts compressed, so that they shuffle at a third of their size."""
    def run(batches):
        for b in batches:
            press = zstandard.ZstdCompressor(level=1)
            z = [press.compress((t or "").encode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(z, pa.binary()), b.column(2)], ["doc_id", "th", "z", "extra"])

    return docs.select("doc_id", "text", "extra", "th").mapInArrow(run, StructType().add("doc_id", "long").add("th", "long").add("z", "binary").add("extra", docs.schema["extra"].dataType))


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def dedup_substrings(docs: DataFrame, limit: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """Removes each byte covered by a ``limit``-byte string that also starts anywhere else in the corpus.

    1. Each window of ``limit`` bytes is dealt by its anchor (see :func:`_anchors`); neighbouring windows
       with one anchor travel as one span. Spans whose anchor occurs once cannot repeat and go no further.
    2. Spans equal in anchor and content are counted before any text is moved; one of each is fetched. An anchor with over MANY
       different spans is dealt again by the bytes around it (see :func:`narrower`), so no task meets an unbounded group.
    3. The spans of an anchor meet in one task, which sorts their suffixes in two stages, compares
       neighbours and reports the windows that occur more than once (counting step 2's numbers).
    4. Reports go back to all places of each span, and each document drops the union of its windows.

    Null and empty texts, and texts shorter than ``limit``, lose nothing; repeated rows are documents of
    their own and so lose everything from ``limit`` bytes on; null ids are kept; an empty table gives
    no rows. Removal is judged on UTF-8 bytes of the input; ``with_text`` adds ``text``, the rest with
    characters that were cut in two left out, and ``carry`` names input columns that go along.
    """
    kept_columns = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = keyed(id_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kept_columns.alias("extra")), "id", "text", "extra"))
    places = rows.select("doc_id", "text", "th").mapInArrow(_anchors(limit), "h long, sh long, doc_id long, th long, start long, windows int")
    # written, so that the join below deals plain rows and Spark can split the anchors of very common passages
    shared = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    spans = found = cut(places.join(shared.select("h"), "h", "left_semi"), "spans")
    hot = again = None

    def kinds_of(spans):
        return spans.groupBy("h", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start", "windows")).alias("at"))

    kinds = kinds_of(found)
    if not shared.where(F.col("n") > MANY).isEmpty():
        # counted from distinct spans, so that the places of one anchor never meet
        hot = cut(found.select("h", "sh").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("h"), "common-anchors")
        if not hot.isEmpty():
            by_text = cut(found.join(hot, "h", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows")).alias("spans")), "common-spans")
            again = cut(_dealt_again(rows, by_text, limit), "pairs")
            drop(by_text)
            kinds = kinds.join(hot, "h", "left_anti").unionByName(kinds_of(again))
            found = found.unionByName(again)
    wanted = kinds.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct("h", "sh", "n", "at.start", "at.windows")).alias("spans")
    )
    wanted = cut(wanted, "wanted")

    def fetch(batches):
        for b in batches:
            unpack = zstandard.ZstdDecompressor()
            out = [[], [], [], []]
            for z, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = unpack.decompress(z)
                for s in spans:
                    for k, v in enumerate((s["h"], s["sh"], s["n"], raw[s["start"] : s["start"] + s["windows"] + limit - 1])):
                        out[k].append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["h", "sh", "n", "bytes"])
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["h", "sh", "n", "bytes"])
            trim()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    packed = _packed(sifted(rows, sieve(wanted, "doc_id", "th"), "doc_id", "th"))
    texts = packed.join(wanted, _same_row(packed, wanted)).select("z", "spans").mapInArrow(fetch, "h long, sh long, n long, bytes binary")

    def sort(batches):
        h, sh, n, spans, size, held = [], [], [], [], 0, 0

        def flush():
            out = [[], [], []]
            for a, b, hits in zip(h, sh, repeated_windows(spans, n, limit)):
                if len(hits):
                    first = np.flatnonzero(np.diff(hits, prepend=-2 * limit) > limit)
                    stop = hits[np.append(first[1:], len(hits)) - 1] + limit
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(np.stack((hits[first], stop), 1).ravel())
            for x in (h, sh, n, spans):
                x.clear()
            trim()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["h", "sh", "runs"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if (size >= BLOCK or held >= BLOCK_BYTES) and row[0] != h[-1]:
                    yield flush()
                    size = held = 0
                for x, v in zip((h, sh, n, spans), row):
                    x.append(v)
                size += len(row[3]) - limit + 1
                held += len(row[3])
        if h:
            yield flush()

    repeated = texts.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "h long, sh long, runs array<long>")
    repeated = cut(repeated, "repeats")
    drop(wanted)
    hits = found.join(repeated, ["h", "sh"]).select("doc_id", "th", F.struct("start", "runs").alias("hit"))
    hits = cut(hits.groupBy("doc_id", "th").agg(F.collect_list("hit").alias("hits")), "hits")
    drop(shared, spans, hot, again, repeated)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text

    def remove(batches):
        for b in batches:
            unpack = zstandard.ZstdDecompressor()
            out = [[] for _ in names]
            for doc, z, hit in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = unpack.decompress(z)
                cover = np.zeros(len(raw) + 1, np.int32)
                for x in hit or []:
                    runs = np.array(x["runs"]) + x["start"]
                    np.add.at(cover, runs[0::2], 1)
                    np.add.at(cover, runs[1::2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                row = (doc, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
                for k in range(len(names)):
                    out[k].append(row[k])
            columns = [pa.array(x, pa.string() if k >= 4 else pa.int64()) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*columns, b.column(3)], [*names, "extra"])
            trim()

    # A text without a hit keeps all its bytes and stays where it is; only the others meet their hits.
    bits = sieve(hits, "doc_id", "th")
    packed = _packed(sifted(rows, bits, "doc_id", "th"))
    kinds = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    kinds = (kinds.add("text", "string") if with_text else kinds).add("extra", rows.schema["extra"].dataType)
    done = packed.join(hits, _same_row(packed, hits), "left").select(packed["doc_id"], "z", "hits", "extra").mapInArrow(remove, kinds)
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = sifted(rows, bits, "doc_id", "th", inside=False).select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"), text.alias("text"), "extra"
    )
    done = done.unionByName(whole.select(*done.columns))
    return done.select(*names, *[F.col("extra").getField(c).alias(c) for c in carry])
