"""Document quality by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, join_texts, mix, shingles, slices, trim, words
from .linear import fit, labelled_sample, predict
from .store import cut, drop, numbered_columns, ship

#: Labelled documents used for fitting, at most.
TRAIN_ROWS = 4000
ROUNDS = 3
#: Pseudo-labels that a view gives in a round, at most: the surest of all documents outside the labelled sample.
TAUGHT = 400
#: How sure a view must be of a pseudo-label.
SURE = 0.95
#: Slots for hashed languages and sources, for hashed words, and for hashed character runs.
SLOTS = 64

_KIND = np.zeros(256, np.int8)  # 1 upper case, 2 lower case, 3 digit, 4 other ASCII sign, 5 non-ASCII
_KIND[33:127] = 4
_KIND[48:58] = 3
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 5
N_TEXT = 17 + 2 * SLOTS
N_META = 2 * SLOTS + 8


def text_features(texts: list) -> np.ndarray:
    """Content of each whole text: hashed words and runs of three bytes, and its shape (case, signs, digits, word lengths, repeated words and five-word runs)."""
    n = len(texts)
    data, bounds = join_texts(texts)
    kind = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(owner * 6 + kind, minlength=n * 6).reshape(n, 6).astype(float)
    signs = np.zeros((n, 4))
    for i, t in enumerate(texts):
        t = t or ""
        signs[i] = (sum(map(t.count, "*#$%&@~^=+_")), sum(map(t.count, "!?")), sum(map(t.count, "|<>{}[]\\/")), sum(map(t.count, ".,;:")))
    h, start, end, at = words(texts)
    size = np.diff(at).astype(float)
    of = np.repeat(np.arange(n), np.diff(at))
    inner = of[1:] == of[:-1]
    twice = np.bincount(of[1:][inner & (h[1:] == h[:-1])], minlength=n)
    runs = shingles(h, 5)
    ok = of[: len(runs)] == of[4:] if len(runs) else np.zeros(0, bool)
    of_run = of[: len(runs)][ok]
    distinct = np.unique(runs[ok] ^ mix(of_run.astype(np.uint64) + U(1)), return_index=True)[1]
    n_runs = np.maximum(np.bincount(of_run, minlength=n), 1)
    repeated = 1 - np.minimum(np.bincount(of_run[distinct], minlength=n) / n_runs, 1)
    repeated[np.bincount(of_run, minlength=n) == 0] = 0
    kinds = np.unique(h ^ mix(of.astype(np.uint64) + U(1)), return_index=True)[1]
    variety = np.bincount(of[kinds], minlength=n)
    w = np.maximum(size, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    upper, sign = counts[:, 1] / letters, signs / w[:, None]
    length = np.bincount(of, weights=end - start, minlength=n) / w
    root = np.sqrt(np.minimum(sign, 2))
    slot = (mix(h + U(0x2545F4914F6CDD1D)) % U(SLOTS)).astype(np.int64)
    bag = np.bincount(of * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS)
    wide = data.astype(np.uint32)
    three = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(26)
    inside = owner[:-2] == owner[2:]
    trio = np.bincount(owner[:-2][inside] * SLOTS + three[inside], minlength=n * SLOTS).reshape(n, SLOTS)
    content = [np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)) for c in (bag, trio)]
    return np.column_stack((
        upper, upper > 0.5, root, sign[:, 0] > 0.2, sign[:, 1] > 0.2, sign[:, 2] > 0.2, twice / w, twice / w > 0.2, repeated, repeated > 0.4,
        np.minimum(counts[:, 3] / w, 2), np.log1p(size) / 5, np.minimum(length, 20) / 10, variety / w, *content,
    ))


def metadata_features(langs: list, sources: list, n_chars: list) -> np.ndarray:
    """Language, source and recorded length, as sparse indicators; nulls have a slot of their own."""
    import zlib

    n = len(langs)
    out = np.zeros((n, N_META))
    for k, column in enumerate((langs, sources)):
        slot = [0 if v is None else 1 + zlib.crc32(str(v).encode("utf-8", "replace")) % (SLOTS - 1) for v in column]
        out[np.arange(n), np.array(slot, int) + k * SLOTS] = 1
    size = np.array([-1 if c is None else max(int(c), 0) for c in n_chars], float)
    out[np.arange(n), 2 * SLOTS + np.clip(np.log10(np.maximum(size, 0) + 1), 0, 6).astype(int)] = size >= 0
    out[:, -1] = size < 0
    return out


class CoTraining:
    """Two views that teach each other, then calibrated and combined.

    Three fifths of the labelled rows train the views. In each round each view labels the documents it is surest of (at SURE or
    more, in the classes' proportion) for the other view's next fit. Each view's score is calibrated by a
    logistic fit on the fourth fifth, and on the last fifth another one weighs the two calibrated logits.
    """

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        part = np.arange(len(y)) % 5
        self.views, self.y, self.part = views, y, part
        self.x, self.target = [v[part < 3] for v in views], [y[part < 3]] * 2
        self.share = float(y[part < 3].mean()) if (part < 3).any() else 0.5
        self.models = [fit(a, b) for a, b in zip(self.x, self.target)]
        self.rounds: list[int] = []

    def learn(self, taught: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """One round: for each view the rows and pseudo-labels that the other one gave it."""
        for k, (x, y) in enumerate(taught):
            self.x[k], self.target[k] = np.concatenate((self.x[k], x)), np.concatenate((self.target[k], y))
        self.models = [fit(a, b) for a, b in zip(self.x, self.target)]
        self.rounds.append(sum(len(y) for _, y in taught))
        return self.rounds[-1]

    def finish(self) -> CoTraining:
        """Calibrates and combines the views on rows that trained neither; drops the training rows."""
        fourth, last = self.part == 3, self.part == 4
        self.calibration = [fit(self._logit(m, v[fourth])[:, None], self.y[fourth], l2=0.1) for m, v in zip(self.models, self.views)]
        self.weights = fit(self._calibrated([v[last] for v in self.views]), self.y[last], l2=0.1)
        del self.views, self.y, self.part, self.x, self.target
        return self

    @staticmethod
    def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ w[:-1] + w[-1], -8, 8)

    def _calibrated(self, views: list[np.ndarray]) -> np.ndarray:
        cols = [self._logit(m, v) * c[0] + c[1] for m, v, c in zip(self.models, views, self.calibration)]
        return np.clip(np.column_stack(cols), -8, 8)

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, combined."""
        logits = self._calibrated(views)
        return np.column_stack((1 / (1 + np.exp(-logits)), predict(self.weights, logits)))


def _columns(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def _views(batches):
    """Arrow batches in, (slice, text view, metadata view) out."""
    for b in batches:
        for some in slices(b, 1):
            text, lang, source, n = (some.column(k).to_pylist() for k in range(1, 5))
            yield some, text_features(text), metadata_features(lang, source, n)


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(float)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, taught: int = TAUGHT) -> CoTraining:
    """Fits on at most ``rows`` labelled documents (the least by a hash of the id) and pseudo-labels of all others.

    The features of all documents are written once; in every round both views score all of them, and the surest ones (at
    most ``taught`` a view) come back. Only feature rows of labelled and taught documents (about 1 KB each) reach the driver.
    """
    base = _columns(docs)
    names, kinds = ["doc_id", "rid", "a", "b"], "doc_id long, rid long, a binary, b binary"

    def features(batches):
        for some, a, b in _views(batches):
            packed = [pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary()) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(5), *packed], names)

    table = cut(base.withColumn("rid", F.xxhash64(*base.columns)).mapInArrow(features, kinds), "features")
    got = labelled_sample(table, labels, "quality", rows).toArrow().sort_by([("rid", "ascending")])
    y = np.array(got.column("y").to_pylist(), float)
    mixed = np.argsort(mix(np.array(got.column("doc_id").to_pylist(), np.int64).view(np.uint64)), kind="stable")
    views = [_matrix(got.column(c), w)[mixed] for c, w in (("a", N_TEXT), ("b", N_META))]
    model = CoTraining(views, y[mixed])
    known = np.array(got.column("rid").to_pylist(), np.int64)
    used = [known, known]  # rows that need no label from a view any more
    for _ in range(ROUNDS if len(y) else 0):
        weights, done = list(model.models), [np.sort(u) for u in used]
        most = [int(taught * (1 - model.share)) + 1, int(taught * model.share) + 1]

        def surest(batches):
            """The surest rows of a task: view, class, how sure, and the row."""
            best = {}
            for b in batches:
                rid = b.column(1).to_numpy(zero_copy_only=False)
                for k, width in enumerate((N_TEXT, N_META)):
                    p = predict(weights[k], _matrix(b.column(2 + k), width))
                    free = ~np.isin(rid, done[k])
                    for kind, sure in ((0, 1 - p), (1, p)):
                        at = np.flatnonzero(free & (sure >= SURE))
                        new = [(float(sure[i]), int(rid[i]), b.column(2)[int(i)].as_py(), b.column(3)[int(i)].as_py()) for i in at[np.lexsort((rid[at], -sure[at]))][: most[kind]]]
                        best[k, kind] = sorted(best.get((k, kind), []) + new, key=lambda r: (-r[0], r[1]))[: most[kind]]
            rows = [(k, kind, *r) for (k, kind), some in best.items() for r in some]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["view", "kind", "sure", "rid", "a", "b"])
            trim()

        found = cut(table.mapInArrow(surest, "view int, kind int, sure double, rid long, a binary, b binary"), "surest")
        news = []
        for k in (0, 1):  # view k teaches the other one
            both = [found.where(f"view = {k} and kind = {kind}").orderBy(F.desc("sure"), "rid").limit(most[kind]).toArrow() for kind in (0, 1)]
            x = np.concatenate([_matrix(t.column("ab"[1 - k]), (N_TEXT, N_META)[1 - k]) for t in both])
            news.append((x, np.repeat([0.0, 1.0], [t.num_rows for t in both])))
            used[k] = np.concatenate([used[k], *(np.array(t.column("rid").to_pylist(), np.int64) for t in both)])
        drop(found)
        if not model.learn(news[::-1]):
            break
    drop(table)
    return model.finish()


def score_quality(docs: DataFrame, model: CoTraining, threshold: float = 0.5) -> DataFrame:
    """p_text, p_meta, p_quality and ``keep`` for every document.

    Null columns have feature values of their own; null and empty texts count as texts
    without words; repeated rows repeat; an empty table gives no rows. One pass, no shuffle.
    """

    def run(batches):
        for some, a, b in _views(batches):
            p = model.score([a, b])
            yield pa.RecordBatch.from_arrays(
                [some.column(0), *[pa.array(p[:, k]) for k in range(3)], pa.array(p[:, 2] >= threshold)],
                ["doc_id", "p_text", "p_meta", "p_quality", "keep"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Trains on the labelled documents and scores all; without labels every document has probability 1/2 and is kept."""
    return score_quality(docs, train(docs, labels), threshold)


def keep_good(docs: DataFrame, model: CoTraining, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns.

    Nulls have feature values of their own and empty texts count as texts without words, as in :func:`score_quality`; repeated
    rows repeat; an empty table gives none. Columns may have any name.
    """
    at = {c: docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")}

    def run(batches):
        for b in batches:
            for some in slices(b, at["text"]):
                text, lang, source, n = (some.column(k).to_pylist() for k in at.values())
                p = model.score([text_features(text), metadata_features(lang, source, n)])
                yield some.filter(pa.array(p[:, 2] >= threshold))

    plain = numbered_columns(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
