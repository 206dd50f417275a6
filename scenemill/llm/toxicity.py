"""Toxicity by a classifier chain with out-of-fold probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices, word_prefixes
from .linear import fit, folds, labelled_sample, predict
from .store import cut, drop, id_text, numbered_columns, ship

#: Labelled documents used for fitting, at most.
TRAIN_ROWS = 4000
#: Words and word beginnings kept as features, at most.
TERMS = 256
#: Groups (languages) that have a category of their own, at most.
GROUPS = 4
FOLDS = 5
#: Bias of a model without labels: nothing is toxic.
NOTHING = -30.0


def _select(some: DataFrame) -> list[np.ndarray]:
    """For each fold the terms chosen without its rows, and last the terms chosen with all rows.

    A term is the hash of a word or word beginning; those whose presence sets the two classes apart most count (likelihood
    ratio of documents with and without it). Documents are counted in Spark, over whole texts.
    """

    def distinct(batches):
        for b in batches:
            for part in slices(b, 1):
                h, at = word_prefixes(part.column(1).to_pylist())
                sets = [np.unique(h[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                size = [len(x) for x in sets]
                toxic, fold = (np.repeat(part.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False), size) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(toxic), pa.array(fold)], ["h", "y", "fold"])

    totals = {r["fold"]: (r["n"], r["n1"]) for r in some.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).collect()}
    counts = [F.sum("y").alias("pos"), F.count("*").alias("tot")]
    for k in range(FOLDS):
        counts += [F.sum(F.when(F.col("fold") == k, F.col("y")).otherwise(0)).alias(f"pos{k}"), F.sum((F.col("fold") == k).cast("int")).alias(f"tot{k}")]
    terms = some.select("doc_id", "text", "y", "fold").mapInArrow(distinct, "h long, y long, fold long").groupBy("h").agg(*counts).where("pos >= 4")
    terms = cut(terms, "terms")
    out = []
    for k in [*range(FOLDS), None]:
        n, n1 = (sum(v[i] for f, v in totals.items() if f != k) for i in (0, 1))
        pos, tot = (F.col(c) - (F.col(f"{c}{k}") if k is not None else 0) for c in ("pos", "tot"))
        expected = tot * (n1 / max(n, 1))
        neg, expected_neg = tot - pos, tot - expected
        score = 2 * (pos * F.log(pos / expected) + F.when(neg > 0, neg * F.log(neg / expected_neg)).otherwise(0.0))
        best = terms.where((pos >= 4) & (pos > expected)).select("h", score.alias("score")).where("score > 8").orderBy(F.desc("score"), "h").limit(TERMS)
        out.append(np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64)))
    return out


def _counts(hashes: np.ndarray, at: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Hits of each text on each term."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    place = np.searchsorted(terms, hashes)
    ok = place < len(terms)
    ok[ok] = terms[place[ok]] == hashes[ok]
    return np.bincount(owner[ok] * max(len(terms), 1) + place[ok], minlength=n * max(len(terms), 1)).reshape(n, max(len(terms), 1))[:, : len(terms)]


class _Inputs:
    """Inputs of the linear models: which terms a text has, and how many and how dense the hits on strong ones are."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray, toxic: np.ndarray):
        self.columns = columns
        present = counts[:, columns] > 0
        self.strong = columns[(present * toxic[:, None]).sum(0) > 0.5 * present.sum(0)] if len(toxic) else columns[:0]

    def __call__(self, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
        hits = counts[:, self.strong].sum(1).astype(float)
        return np.column_stack((counts[:, self.columns] > 0, np.log1p(hits), np.minimum(hits / np.maximum(size, 1) * 20, 2)))


class Chain:
    """Linear models in chain order; each sees the inputs and the probabilities of the categories before it.

    Later models are trained with probabilities that came from models of the other folds (out of fold). Terms, strong
    terms and weights of such a model are all chosen without the fold's rows, so later models meet probabilities of the
    quality they get when scoring. The last category is ``toxic``, the given label; its probability is the verdict.
    """

    def __init__(self, chosen: list[np.ndarray], terms: np.ndarray, counts: np.ndarray, size: np.ndarray, fold: np.ndarray, targets: dict[str, np.ndarray]):
        self.categories = list(targets)
        toxic = targets[self.categories[-1]]
        columns = [np.searchsorted(terms, c) for c in chosen]
        inputs = [_Inputs(c, counts[fold != k], toxic[fold != k]) for k, c in enumerate(columns[:-1])]
        whole = _Inputs(columns[-1], counts, toxic)
        base, of_fold = whole(counts, size), [make(counts, size) for make in inputs]
        self.models, seen = [], np.zeros((len(toxic), 0))
        for target in targets.values():
            self.models.append(fit(np.column_stack((base, seen)), target, unknown=NOTHING))
            out = np.zeros(len(target))
            for k, x in enumerate(of_fold):
                x = np.column_stack((x, seen))
                out[fold == k] = predict(fit(x[fold != k], target[fold != k], unknown=NOTHING), x[fold == k])
            seen = np.column_stack((seen, out))
        self.out_of_fold = seen
        # the scorer looks for the terms of the final models only
        self.terms = terms[whole.columns]
        self.inputs = whole
        whole.strong = np.searchsorted(whole.columns, whole.strong)
        whole.columns = np.arange(len(whole.columns))

    def score(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of all categories in chain order; the last one decides."""
        base = self.inputs(_counts(hashes, at, self.terms), np.diff(at).astype(float))
        seen = np.zeros((len(base), 0))
        for w in self.models:
            seen = np.column_stack((seen, predict(w, np.column_stack((base, seen)))))
        return seen


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, group_col: str | None = "lang") -> Chain:
    """Fits the chain on at most ``rows`` labelled documents, whole; only their lengths and hits on the chosen terms reach the driver.

    The labels have one toxicity column, so the earlier categories are toxicity in each of the (at most GROUPS) commonest values of
    ``group_col``, a column that the models do not see; without that column there is one category. No labels: nothing is toxic.
    """
    ship(docs.sparkSession)
    group = F.col(group_col).cast("string") if group_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), group.alias("kind"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    some = cut(labelled_sample(base, labels, "toxic", rows).select("doc_id", "text", "y", fold.alias("fold"), "kind"), "labelled")
    chosen = _select(some)
    terms = np.unique(np.concatenate(chosen))

    def hits(batches):
        for b in batches:
            for part in slices(b, 1):
                h, at = word_prefixes(part.column(1).to_pylist())
                counts = [c.tobytes() for c in _counts(h, at, terms).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.binary()), pa.array(np.diff(at)), *part.columns[2:]], ["doc_id", "counts", "size", "y", "fold", "kind"])

    got = some.mapInArrow(hits, "doc_id long, counts binary, size long, y int, fold int, kind string").toArrow().sort_by([("doc_id", "ascending"), ("size", "ascending")])
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.int32).reshape(got.num_rows, len(terms))
    size, toxic, fold = (np.array(got.column(c).to_pylist(), float) for c in ("size", "y", "fold"))
    kinds = np.array([k or "" for k in got.column("kind").to_pylist()], object)
    drop(some)
    names, often = np.unique(kinds[(toxic > 0) & (kinds != "")].astype(str), return_counts=True)
    common = names[np.lexsort((names, -often))][:GROUPS].tolist()
    targets = {f"toxic_{g}": toxic * (kinds == g) for g in common} | {"toxic": toxic}
    return Chain(chosen, terms, counts, size, fold, targets)


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every whole text ``p_groups`` (probabilities of the earlier categories, in the order of ``chain.categories``), ``p_toxic``
    (of the chain's end) and ``is_toxic`` (``p_toxic`` at or over ``threshold``).

    Null and empty texts have no words and get the chain's base rate; repeated rows repeat; an
    empty table gives no rows. One pass, no shuffle.
    """

    def run(batches):
        for b in batches:
            for some in slices(b, 1):
                p = chain.score(*word_prefixes(some.column(1).to_pylist()))
                groups = pa.array(list(p[:, :-1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([some.column(0), groups, pa.array(p[:, -1]), pa.array(p[:, -1] >= threshold)], ["doc_id", "p_groups", "p_toxic", "is_toxic"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, p_groups array<double>, p_toxic double, is_toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Trains on the labelled documents and scores all; without labels every document gets probability 0 (to 1e-12) and none is toxic."""
    return score_toxicity(docs, train(docs, labels), threshold)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, with all their columns.

    Null and empty texts are judged by the base rate, as in :func:`score_toxicity`; an empty table gives none; repeated rows repeat. Columns may
    have any name.
    """
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for some in slices(b, text):
                yield some.filter(pa.array(chain.score(*word_prefixes(some.column(text).to_pylist()))[:, -1] < threshold))

    plain = numbered_columns(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
