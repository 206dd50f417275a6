"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import U, mix, shingle_sets, slices, trim
from .store import cut, drop, id_text, sieve, sifted

#: Share of the pairs at the threshold that shall be found, and mean number of tokens that such a pair shares a step.
TARGET = 0.999
SHARED = 2.0


def recall(runs: int, shared: float = SHARED) -> float:
    """Chance that a pair at the threshold stays together, however deep, in at least one run (Poisson branching)."""
    alive = 1.0
    for _ in range(100):
        alive = 1 - np.exp(-shared * alive)
    return float(1 - (1 - alive) ** runs)


#: Runs of the recursion: the fewest that reach the target.
RUNS = next(n for n in range(1, 100) if recall(n) >= TARGET)
#: Splits of a path; buckets that are still large then are compared in blocks.
DEPTH = 4
#: A bucket up to this size is compared by brute force; a larger one is split once more.
SMALL = 1024
#: Rows of a bucket in one task; larger buckets are dealt to several.
MANY = 2048
#: Paths of large buckets that may be broadcast (about 120 bytes each); beyond it they are joined.
BROADCAST = 20_000
#: Texts, and bytes of text, of one side of a tile of exact comparisons.
TILE = 2048
TILE_BYTES = 16 << 20
SKETCH = 64
#: What a sketch's estimate of likeness may be wrong by, in the bounds of :func:`_bucket`.
ERROR = 0.05
_ROOT = [(0xA24BAED4963EE407 * (run + 1)) & ((1 << 64) - 1) for run in range(RUNS)]


def _sketch(tokens: np.ndarray) -> bytes:
    """One-permutation min-hash: 64 bins of one byte, 0 for an empty one."""
    h = mix(tokens ^ U(0x51ED270B0B8F3A1D))
    bins = (h >> U(58)).astype(np.int64)
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins, h & U((1 << 58) - 1))
    small = (mix(out) % U(255)).astype(np.uint8) + np.uint8(1)
    small[out == np.iinfo(np.uint64).max] = 0
    return small.tobytes()


def _steps(tokens: np.ndarray, path: int, threshold: float) -> np.ndarray:
    """The tokens that a set samples at a path: those whose hash with the path lies under SHARED / (threshold * size).

    Two sets at the threshold share SHARED sampled tokens on average, and each takes the same ones.
    """
    limit = U(min(int(SHARED / (threshold * len(tokens)) * 2.0**64), (1 << 64) - 1))
    return tokens[mix(tokens ^ U(path)) <= limit]


def _after(path: int, token: np.ndarray) -> np.ndarray:
    """The paths that lead on from a path by each token."""
    return mix(mix(token + U(0x51ED270B0B8F3A1D)) ^ U(path))


def _similarity(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated likeness of each sketch to one."""
    return ((sketches == one) & (sketches > 0)).sum(1) / np.maximum(((sketches > 0) | (one > 0)).sum(1), 1)


def _bound(size: np.ndarray, size_one: float, threshold: float) -> np.ndarray:
    """Estimated likeness from which two sets may be a pair over the threshold: four standard errors below it (small sets fill few places)."""
    least = np.minimum(size, size_one)
    return threshold - np.where(least < 30, 0.47, np.where(least < 100, 0.38, 0.23))


def _centre(sketches: np.ndarray) -> np.ndarray:
    """The most common value of each sketch place."""
    return np.array([np.bincount(c, minlength=256).argmax() for c in sketches.T], np.uint8)


class _Forest:
    """Edges between members of a bucket, none that closes a circle: at most one for each member."""

    def __init__(self, keys: list, sketches: np.ndarray, size: np.ndarray, threshold: float):
        self.keys, self.sketches, self.size, self.threshold = keys, sketches, size, threshold
        self.root, self.edges = list(range(len(keys))), []

    def _top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, others) -> None:
        for j in others:
            a, b = self._top(i), self._top(j)
            if a != b:
                self.root[b] = a
                self.edges.append((self.keys[i], self.keys[j]))

    def compare(self, left, right: np.ndarray) -> None:
        """Joins each of ``left`` with those of ``right`` that may be alike."""
        for i in left:
            near = _similarity(self.sketches[right], self.sketches[i]) >= _bound(self.size[right], float(self.size[i]), self.threshold)
            self.join(i, right[near].tolist())


def _emit(threshold: float, shingle: int):
    """Texts to the rows of their first paths."""

    def run(batches):
        seen = set()  # a task sends each distinct text once: the hot groups of copies shrink before the shuffle
        for b in batches:
            for some in slices(b, 1):
                fresh = []
                for t in some.column(1).to_pylist():
                    key = hashlib.md5((t or "").encode("utf-8", "replace")).digest()
                    if key not in seen:
                        seen.add(key)
                        fresh.append((key, t))
                rows = [[], [], [], [], []]
                for (key, _), tokens in zip(fresh, shingle_sets([t for _, t in fresh], shingle)):
                    if not len(tokens):
                        continue
                    sketch = _sketch(tokens)
                    for root in _ROOT:
                        first = _steps(tokens, root, threshold)
                        for token, path in zip(first.view(np.int64).tolist(), _after(root, first).view(np.int64).tolist()):
                            for x, v in zip(rows, (path, key, len(tokens), sketch, [token])):
                                x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _KINDS)], _NAMES)

    return run


_NAMES = ["path", "key", "size", "sketch", "used"]
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
_ROWS = "path long, key binary, size int, sketch binary, used array<long>"


def _bucket(threshold: float):
    """Rows of buckets, sorted by path, part and key, to edges (``a`` given) and to what is still open of them.

    All that resemble a bucket's centre (the most common value of each sketch place) are connected to one of them. The
    others, the leftovers, are compared with all that they may be linked with: leftovers, and those members that are not
    very like the centre (by the triangle inequality, what is linked with a leftover is little more like the centre than the leftover
    is). Buckets of over SMALL rows with more leftovers than that leave these rows open for the next split. The centre of a
    bucket that is dealt in parts comes with its rows. At most one edge a row; ``left`` marks leftovers among the open rows.
    """

    def run(batches):
        at, given, part = None, None, [[], [], [], []]  # keys, sizes, sketches, used tokens
        edges, rest, sent = [], [[], [], [], [], [], []], set()

        def close():
            keys, size, sketch, used = part
            if given is None and len(keys) < 2:
                return
            marks, sizes = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH), np.array(size)
            forest, still, near = _Forest(keys, marks, sizes, threshold), [], None
            if given is None and len(keys) <= 4:
                for i in range(len(keys) - 1):
                    forest.compare([i], np.arange(i + 1, len(keys)))
            else:
                centre, middle, one = given or (_centre(marks), float(np.median(sizes)), None)
                same = _similarity(marks, centre)
                near = same >= _bound(sizes, middle, threshold)
                members, left = np.flatnonzero(near), np.flatnonzero(~near)
                if one is None and len(members):
                    forest.join(int(members[0]), members[1:].tolist())
                forest.edges += [(one, keys[i]) for i in members.tolist() if one not in (None, keys[i])]
                if given or len(left):
                    reach = (max(threshold - 0.23, same[left].max(initial=0)) if given else same[left].max()) + 1 - threshold + ERROR
                    open_rows = np.flatnonzero((same <= reach) | ~near)
                    if given is None and (len(keys) <= SMALL or len(left) * len(open_rows) <= SMALL * SMALL):
                        forest.compare(left.tolist(), open_rows)
                    else:
                        still = open_rows.tolist()
            for e in forest.edges:
                if e not in sent:
                    sent.add(e)
                    edges.append(e)
            if len(sent) > 100_000:
                sent.clear()
            for i in still:
                for x, v in zip(rest, (at[0], keys[i], size[i], sketch[i], used[i], not near[i])):
                    x.append(v)

        def batch():
            n, m = len(edges), len(rest[0])
            columns = [[e[0] for e in edges] + [None] * m, [e[1] for e in edges] + rest[1]] + [[None] * n + rest[k] for k in (0, 2, 3, 4, 5)]
            kinds = [pa.binary(), pa.binary(), *(_KINDS[k] for k in (0, 2, 3, 4)), pa.bool_()]
            edges.clear()
            for x in rest:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "key", "path", "size", "sketch", "used", "left"])

        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                for row in zip(*(c.to_pylist() for c in b.slice(lo, 2000).columns)):
                    if (row[0], row[5]) != at:
                        close()
                        at, part = (row[0], row[5]), [[], [], [], []]
                        given = None if row[6] is None else (np.frombuffer(row[6], np.uint8), row[7], row[8])
                    if part[0] and part[0][-1] == row[1]:
                        continue
                    for x, v in zip(part, row[1:5]):
                        x.append(v)
                if len(edges) + len(rest[0]) > 5000:
                    yield batch()
        close()
        yield batch()
        trim()

    return run


def _middle(batches):
    """Samples of large buckets to their centres: path, centre, median size and the member most alike."""
    for b in batches:
        rows = []
        for some in b.column(1).to_pylist():
            some.sort(key=lambda r: r["key"])
            marks = np.frombuffer(b"".join(r["sketch"] for r in some), np.uint8).reshape(-1, SKETCH)
            centre = _centre(marks)
            rows.append((centre.tobytes(), float(np.median([r["size"] for r in some])), some[int(_similarity(marks, centre).argmax())]["key"]))
        kinds = [pa.binary(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["path", "parts", "centre", "middle", "one"])


def _split(rows: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """One step of the recursion over written rows of buckets (which go): the written output of :func:`_bucket`, and whether a bucket was dealt in parts."""
    source, centres = rows, None
    large = hot = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > MANY), "large-buckets")
    n_large = hot.count()
    part, centre, middle, one = (F.lit(None).cast(t) for t in ("long", "binary", "double", "binary"))
    if n_large:
        few = n_large <= BROADCAST
        hot = F.broadcast(hot) if few else hot
        member = F.struct("key", "size", "sketch")
        # about 64 members by a hash of their text, and one in any case
        chosen = rows.join(hot, "path").groupBy("path").agg(
            F.collect_set(F.when(F.pmod(F.xxhash64("key"), F.expr("greatest(n div 64, 1)")) == 0, member)).alias("some"), F.min(member).alias("least"), F.max("n").alias("n")
        )
        chosen = chosen.select("path", F.array_union("some", F.array("least")).alias("some"), F.ceil(F.col("n") / MANY).cast("long").alias("parts"))
        centres = cut(chosen.mapInArrow(_middle, "path long, parts long, centre binary, middle double, one binary"), "centres")
        rows = rows.join(F.broadcast(centres) if few else centres, "path", "left")
        part, centre, middle, one = F.pmod(F.xxhash64("key"), "parts"), F.col("centre"), F.col("middle"), F.col("one")
    rows = rows.select(*_NAMES, part.alias("part"), centre.alias("centre"), middle.alias("middle"), one.alias("one"))
    dealt = rows.repartition("path", "part").sortWithinPartitions("path", "part", "key")
    out = cut(dealt.mapInArrow(_bucket(threshold), "a binary, key binary, path long, size int, sketch binary, used array<long>, left boolean"), "buckets")
    drop(source, large, centres)
    return out, n_large > 0


def _blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges of buckets of any size: each two blocks of a bucket meet in one task."""
    sizes = rows.groupBy("path").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    tiled = _tiles(rows.select("path", "key", "size", "sketch").join(sizes, "path"), "path", "size", "sketch")

    def compare(batches):
        for tile, rows in _grouped(batches, 3):
            keys, block = [r[4] for r in rows], [r[3] for r in rows]
            order = sorted(range(len(keys)), key=lambda k: block[k])
            n = block.count(tile[1])
            marks = np.frombuffer(b"".join(rows[k][6] for k in order), np.uint8).reshape(-1, SKETCH)
            forest = _Forest([keys[k] for k in order], marks, np.array([rows[k][5] for k in order]), threshold)
            forest.compare(range(n), np.arange(n) if tile[1] == tile[2] else np.arange(n, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in forest.edges], pa.binary()) for k in (0, 1)], ["a", "b"])

    return tiled.mapInArrow(compare, "a binary, b binary")


def _tiles(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows with ``key`` and ``blocks`` dealt to the tiles (i, j) of their group, i <= j, that hold their block."""
    block = rows.withColumn("block", F.pmod(F.hash("key"), "blocks"))
    both = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = both.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", *columns)
    return tiled.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "key")


def _grouped(batches, n: int):
    """(group, rows without repeats) of Arrow batches sorted by their first n columns and ``key`` (column 4)."""
    group, rows = None, []
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            for row in zip(*(c.to_pylist() for c in b.slice(lo, 2000).columns)):
                if row[:n] != group:
                    if rows:
                        yield group, rows
                    group, rows = row[:n], []
                if not rows or rows[-1][4] != row[4]:
                    rows.append(row)
    if rows:
        yield group, rows
    trim()


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of a tile: how many each set has (left with right, each pair once), and the least linked set of each.

    Shared tokens of all pairs come from products of 0/1 matrices, a slice of the shared tokens at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[token] > 1
    token, owner = token[keep], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    token = np.cumsum(np.diff(token, prepend=token[:1]) > 0) if len(token) else token
    shared = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.full(n, -1), np.full(n, -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        a, z = np.searchsorted(token, (lo, lo + 2048))
        t, o = token[a:z] - lo, owner[a:z]
        wide = int(t.max()) + 1 if len(t) else 0
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        x[row_l[o[row_l[o] >= 0]], t[row_l[o] >= 0]] = 1
        y[row_r[o[row_r[o] >= 0]], t[row_r[o] >= 0]] = 1
        shared += x @ y.T
    linked = np.zeros(shared.shape, bool)
    for lo in range(0, len(left), 256):
        part = shared[lo : lo + 256]
        total = size[left[lo : lo + 256]][:, None] + size[right][None, :]
        linked[lo : lo + 256] = part.astype(float) * (1 + threshold) >= threshold * total - 1e-6  # shared / (total - shared) >= threshold
        linked[lo : lo + 256] &= left[lo : lo + 256][:, None] != right[None, :]
    del shared
    links = np.zeros(n, np.int64)
    links[left] = linked.sum(1)
    if left is not right:
        links[right] = linked.sum(0)
    label = np.full(n, -1)
    for i in range(n):  # least place along links, to the end
        todo = [i] if label[i] < 0 else []
        while todo:
            u = todo.pop()
            label[u] = i
            near = right[linked[row_l[u]]] if row_l[u] >= 0 else left[linked[:, row_r[u]]]
            near = near[label[near] < 0]
            label[near] = i
            todo += near.tolist()
    return links, label


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document: class_id, n_links and n_copies.

    Two different texts are linked if the Jaccard likeness of their sets of ``shingle``-word runs is at least
    ``threshold``; ``n_links`` counts the different texts linked with a document's text, ``n_copies`` the other documents
    with an equal text. ``class_id`` is the least doc_id of the component of links and copies (null ids come last).

    1. Each distinct text takes its chosen paths; buckets are split (see :func:`_split`) until they are small or settled, and texts
       of one bucket that look alike by their sketch are joined to candidate groups: at most one edge for each text and
       path, never all pairs. Runs are repeated until :func:`recall` reaches TARGET. Buckets that are still large after DEPTH splits
       are compared in blocks, whatever their size.
    2. Inside a candidate group the sets are compared exactly, in tiles of about ``TILE`` texts a side, which get compressed
       texts; only counts and one label per text leave a tile. Links of one text are counted, so the work (and the copies of its text) grows
       with the square of a group of different near copies; exact copies count as one text.

    Null and empty texts, and texts without a word, are linked to nothing but their copies; texts of 1 to
    shingle-1 words have one run of all their words. An empty table gives no rows. ``with_key`` adds the MD5 of
    the text, which tells rows with one id apart.
    """
    base = id_text(docs, id_col, text_col).withColumn("key", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    ids = cut(base.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "ids")
    reps = cut(ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("bytes").alias("bytes")), "distinct-texts")

    def press(batches):
        for b in batches:
            engine = zstandard.ZstdCompressor(level=1)
            z = pa.array((engine.compress((t or "").encode("utf-8", "replace")) for some in slices(b, 1) for t in some.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), z], ["_rep", "_key", "z"])

    def sets_of(batches, column: int):
        """(slice, its token sets) of batches with compressed texts in a column."""
        engine = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 50):
                texts = [engine.decompress(z).decode() for z in b.slice(lo, 50).column(column).to_pylist()]
                at = 0
                for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), 0):
                    yield b.slice(lo + at, part.num_rows), shingle_sets(part.column(0).to_pylist(), shingle)
                    at += part.num_rows

    def texts_of(keys: DataFrame, wanted: DataFrame) -> DataFrame:
        """Adds ``z``, the text, to rows with rep and key, all of them in a written table of wanted ones: only what its sieve lets through is
        compressed and shuffled."""
        some = sifted(base, sieve(wanted, "rep", "key"), "doc_id", "key").select("doc_id", "text", "key")
        right = some.mapInArrow(press, "_rep long, _key binary, z binary")
        return keys.join(right, F.col("rep").eqNullSafe(F.col("_rep")) & (F.col("key") == F.col("_key"))).drop("_rep", "_key")

    def anew(batches):
        """Texts with their open paths to the rows of the next step."""
        for some, sets in sets_of(batches, 4):
            rows = [[], [], [], [], []]
            for key, size, sketch, paths, tokens in zip(*(some.column(k).to_pylist() for k in range(4)), sets):
                for p in paths:
                    step = np.setdiff1d(_steps(tokens, p["path"] % (1 << 64), threshold), np.array(p["used"], np.int64).view(np.uint64))
                    for token, path in zip(step.view(np.int64).tolist(), _after(p["path"] % (1 << 64), step).view(np.int64).tolist()):
                        for x, v in zip(rows, (path, key, size, sketch, [*p["used"], token])):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _KINDS)], _NAMES)

    rows = cut(base.mapInArrow(_emit(threshold, shingle), _ROWS), "paths")
    found, large, steps = [], [], []
    for depth in range(1, DEPTH + 1):
        step, dealt = _split(rows, threshold)
        steps.append(step)
        found.append(step.where("a is not null").select("a", F.col("key").alias("b")))
        n_left, n_spent = step.where("a is null").agg(F.count_if("left"), F.count_if(F.size("used") >= F.col("size"))).first()
        if not n_left:
            break
        still = step.where("a is null").select(*_NAMES)
        if dealt:  # a bucket without leftovers is settled: all its texts are joined to its centre, whatever its parts kept open
            still = still.join(step.where("a is null and left").select("path").distinct(), "path", "left_semi")
        if depth == DEPTH:
            large.append(still)
            break
        if n_spent:  # no token is left to split these buckets by
            spent = still.where(F.size("used") >= F.col("size")).select("path").distinct()
            large.append(still.join(spent, "path", "left_semi"))
        wanted = still.groupBy("key").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.collect_list(F.struct("path", "used")).alias("paths"))
        wanted = cut(wanted.join(reps.select("key", "rep"), "key"), "wanted")
        rows = cut(texts_of(wanted, wanted).select("key", "size", "sketch", "paths", "z").mapInArrow(anew, _ROWS), "paths")
        drop(wanted)
    found += [_blocks(x, threshold) for x in large]
    groups = components(reduce(DataFrame.union, found))
    drop(*steps)

    known = cut(groups.join(reps, groups["node"] == reps["key"]).select("rep", "key", "label", "bytes"), "candidates")
    drop(groups)
    sizes = known.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int").alias("blocks"))
    texts = texts_of(known.join(sizes, "label").select("rep", "key", "label", "blocks"), known)

    def verify(batches):
        tiles, held = [], 0

        def flush():
            z = pa.RecordBatch.from_arrays([pa.array([r[5] for _, rows in tiles for r in rows], pa.binary())], ["z"])
            sets, out = [x.copy() for _, some in sets_of([z], 0) for x in some], [[], [], []]
            lo = 0
            for (_, i, j), rows in tiles:
                at, keys = np.array([r[3] for r in rows]), [r[4] for r in rows]
                left = np.flatnonzero(at == i)
                right = left if i == j else np.flatnonzero(at == j)
                links, label = _links(sets[lo : lo + len(rows)], left, right, threshold)
                lo += len(rows)
                for x, v in zip(out, (keys, links.tolist(), [keys[k] for k in label])):
                    x += v
            tiles.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.binary()))], ["key", "links", "peer"])

        for tile in _grouped(batches, 3):
            tiles.append(tile)
            held += len(tile[1])
            if held >= 50:  # texts of many small tiles are hashed together
                yield flush()
                held = 0
        if tiles:
            yield flush()

    verified = cut(_tiles(texts, "label", "z").mapInArrow(verify, "key binary, links long, peer binary"), "links")
    drop(known)
    classes = components(verified.where("key <> peer").select("key", "peer"), "key", "peer")
    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    texts = reps.join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    texts = cut(texts.withColumn("label", F.coalesce("label", "key")), "texts")
    drop(verified, classes)
    least = texts.groupBy("label").agg(F.min("rep").alias("class_id"))
    texts = texts.join(least, "label").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return ids.join(texts, "key").select("doc_id", "class_id", "n_links", "n_copies", *["key"] * with_key)


def one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each class the document with the least id stays, whole.

    Exact repeats of its id and text go. Null and empty texts are one class of copies; null ids come last, so a class without any
    other keeps a row with a null id. Columns may have any name. An empty table gives no rows.
    """
    near = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col, with_key=True)
    # In doubt are the documents that go and those that stand more than once; all others stay without a shuffle.
    kept = F.bool_or(F.col("doc_id").eqNullSafe(F.col("class_id")))
    doubt = near.groupBy("doc_id", "key").agg(F.count("*").alias("rows"), kept.alias("kept")).where("rows > 1 or not kept")
    doubt = cut(doubt.select(F.col("doc_id").alias("doubt_id"), F.col("key").alias("doubt_key"), "kept"), "doubt")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"))
    bits = sieve(doubt, "doubt_id", "doubt_key")
    sure = sifted(rows, bits, "id", "key", inside=False).select("row")
    # one hash deals both sides, and the window after the join needs no other exchange
    some = sifted(rows, bits, "id", "key").withColumn("deal", F.xxhash64("id", "key"))
    doubt = doubt.withColumn("doubt_deal", F.xxhash64("doubt_id", "doubt_key"))
    some = some.join(doubt, (F.col("deal") == F.col("doubt_deal")) & F.col("id").eqNullSafe(F.col("doubt_id")) & (F.col("key") == F.col("doubt_key")), "left").where("coalesce(kept, true)")
    first = F.row_number().over(Window.partitionBy("deal", "id", "key").orderBy(F.monotonically_increasing_id()))
    return sure.union(some.withColumn("place", first).where("place = 1").select("row")).select("row.*")
