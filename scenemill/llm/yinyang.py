"""K-means over integer vectors, exact, with the group bounds of the Yinyang method."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, ship

#: Components beyond this (after scaling) are taken as this, so that every distance and sum fits 64 bits.
LIMIT = 1 << 26
#: Components up to this have squared distances that doubles hold exactly.
_EXACT = 1 << 21
#: Share by which bounds are widened, far above what rounding can add.
_SLACK = 1e-12
#: Bound of a group without another centroid (finite, so that it can sink).
_FAR = 1e150
_STATE = "vec_id long, v array<int>, cluster int, before int, lower array<double>, distance long, scanned int"


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``: the vectors of exactly ``dim`` components, none null or non-finite, each x as floor(scale * x)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where((F.size(v) == dim) & whole).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), ints.alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``c``, exact integers (as doubles where those hold them)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def group_centroids(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """Numbers of the centroids in each group: a few plain k-means rounds over the centroids, started at far-apart ones."""
    seeds = [0]
    while len(seeds) < min(groups, len(centroids)):
        away = squared(centroids, centroids[seeds]).min(1)
        seeds.append(int(away.argmax()))
    middle = centroids[seeds].astype(np.float64)
    for _ in range(5):
        of = ((centroids[:, None, :] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.stack([centroids[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(of == g) for g in range(len(middle)) if (of == g).any()]


class Pass:
    """One assignment: old clusters and bounds in, new ones out (``drift``: how far each group's centroids moved at most)."""

    def __init__(self, centroids: np.ndarray, groups: list[np.ndarray], drift: np.ndarray | None):
        self.centroids, self.groups, self.drift = centroids, groups, drift
        self.group_of = np.zeros(len(centroids), np.int64)
        for g, members in enumerate(groups):
            self.group_of[members] = g

    def __call__(self, x: np.ndarray, cluster: np.ndarray, lower: np.ndarray):
        """New cluster, squared distance, lower bounds by group and number of computed distances of every row."""
        n, first = len(x), self.drift is None
        rows = np.arange(n)
        scanned = np.zeros(n, np.int64)
        if first:
            best, near = np.full(n, len(self.centroids)), np.full(n, np.iinfo(np.int64).max, np.int64)
            lower, open_ = np.zeros((n, len(self.groups))), np.ones(n, bool)
        else:
            own = self.centroids[cluster]
            best, near = cluster.copy(), ((x - own) ** 2).sum(1)
            scanned += 1
            lower = lower - self.drift - _SLACK * (lower + self.drift)
            upper = np.sqrt(near.astype(np.float64)) * (1 + _SLACK)
            open_ = lower.min(1) <= upper  # the global filter
        was, at = best.copy(), near.copy()
        firsts, seen = [], []
        for g, members in enumerate(self.groups):
            some = rows if first else rows[open_ & (lower[:, g] <= upper)]  # the group filter
            seen.append(some)
            d = squared(x[some], self.centroids[members])
            scanned[some] += len(members)
            order = np.sort(d, 1)[:, :2].astype(np.float64)
            firsts.append(order if order.shape[1] > 1 else np.column_stack((order, np.full(len(some), _FAR**2))))
            if len(some):
                k = d.argmin(1)  # the smallest number among equals: members ascend
                d, k = d[np.arange(len(some)), k].astype(np.int64), members[k]
                better = (d < near[some]) | ((d == near[some]) & (k < best[some]))
                near[some[better]], best[some[better]] = d[better], k[better]
        for g, (some, pair) in enumerate(zip(seen, firsts)):
            mine = self.group_of[best[some]] == g if len(some) else np.zeros(0, bool)
            lower[some, g] = np.sqrt(np.where(mine, pair[:, 1], pair[:, 0])) * (1 - _SLACK)
        if not first:
            moved = rows[best != was]  # the left centroid counts in its group, seen or not
            g = self.group_of[was[moved]]
            lower[moved, g] = np.minimum(lower[moved, g], np.sqrt(at[moved].astype(np.float64)) * (1 - _SLACK))
        return best, near, lower, scanned

    def over(self, batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            if self.drift is None:
                cluster = np.full(b.num_rows, -1)
                best, near, lower, scanned = self(x, cluster, None)
            else:
                cluster = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                lower = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                best, near, lower, scanned = self(x, cluster, lower)
                scanned = scanned + b.column(6).to_numpy(zero_copy_only=False)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * lower.shape[1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(cluster, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(lower.ravel())),
                 pa.array(near, pa.int64()), pa.array(scanned, pa.int32())],
                ["vec_id", "v", "cluster", "before", "lower", "distance", "scanned"],
            )


def _moves(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows that changed their cluster add to and take from the clusters' counts and sums (k * dim numbers)."""

    def partial(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            for column, sign in ((1, 1), (2, -1)):
                of = b.column(column).to_numpy(zero_copy_only=False)
                known = of >= 0
                np.add.at(counts, of[known], sign)
                np.add.at(sums, of[known], sign * x[known])
        used = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        yield pa.RecordBatch.from_pylist(
            [{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in used],
            pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]),
        )

    parts = state.where("cluster <> before").select("v", "cluster", "before").mapInArrow(partial, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for r in added.collect():
        counts[r["cluster"]], sums[r["cluster"]] = r["n"], [r[f"s{i}"] for i in range(dim)]
    return counts, sums


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, groups: int = 4, salt: str = "1:",
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Exact Lloyd rounds over integer vectors (see :func:`integer_vectors`); which centroids are looked at is cut by Yinyang bounds.

    The ``k`` vectors with the least sha256 of ``salt`` and id start (null ids last, then the smaller vector; fewer vectors: fewer
    centroids). Centroids are put into groups once. Each vector keeps its cluster and one lower bound a group: groups' bounds sink by the
    largest move of their centroids, and a vector whose own distance is below all of them is done (global filter); else only
    groups whose bound it reaches are scanned. Ties go to the smaller number: bounds exclude only what is strictly farther.

    Sums change by the vectors that moved, in exact integers. No vector is shuffled; each round writes the state once (earlier tables are removed when the next
    stands) and the driver sees ``k * dim`` numbers. Returns vec_id, cluster, distance (squared), cluster_inertia, inertia (null beyond
    64 bits), centroid (array) and scanned (distances computed for the vector in all rounds). Repeated rows and ids are vectors of their own;
    vectors with nulls, NaN, infinities or another length are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    ints = integer_vectors(vectors, dim, scale, id_col, vec_col)
    lot = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = ints.orderBy(lot.asc_nulls_last(), "v").limit(k).collect()
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, scanned int"
    if not starts:
        return spark.createDataFrame([], names)
    centroids = np.array([r["v"] for r in starts], np.int64)
    parts, drift = group_centroids(centroids, groups), None
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    state = old = None
    for turn in range(rounds + 1):
        one = Pass(centroids, parts, drift)
        source = ints if state is None else state
        old, state = state, cut(source.mapInArrow(one.over, _STATE), f"vectors-{turn}")
        drop(old)
        if turn == rounds:
            break
        n, s = _moves(state, len(centroids), dim)
        counts, sums = counts + n, sums + s
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        drift, centroids = np.array([moved[members].max() for members in parts]), new
    by = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(by.values()))
    rows = [(c, fits(d), total, centroids[c].tolist()) for c, d in by.items()]
    small = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "scanned")
