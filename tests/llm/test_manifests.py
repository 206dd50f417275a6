"""Yinyang clustering, Merkle manifests and SentencePiece against brute-force versions and the library."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scenemill.llm import merkle, pieces, yinyang
from scenemill.llm.queries import QUERIES

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
#: Strings that the texts are made of: word parts, white space, marks, other scripts, ligatures, joiners.
PARTS = ["a", "b", "e", "th", "ing", " ", "  ", "▁", "\n", "\t", "\0", "é", "ß", "日本", "語", "🎬", "👩‍👧", "ﬁ", "Ａ", "①", "é", "　", "\xa0", "<s>", "<0x41>", "'"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g int, node string, `a.b` int, at int"


def made_up(rng, most):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


def rows():
    rng = random.Random(5)
    out = [(i, rng.choice(["a", "a", "a", "b", "é", "Z", "", None]), "en", i, made_up(rng, 20) + "\n" * (i % 3)) for i in range(200)]
    out += [(7, "a", None, None, None), (7, "a", None, None, None), (None, "b", "x", 1, "t\n"), (500, "alone", "en", 4, "a\nb"), (501, None, None, 0, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows()], SCHEMA).repartition(5)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        start = i - i % 3
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 3])
        i //= 3


def manifest(table):
    groups = {}
    for r in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf(r) for r in groups[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*way(trees[k], i), *way(top, k)]
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            folded = leaf(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                folded = sha(left, folded, right)
            yield r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*[a + b for a, b in path]), folded, folded == top[-1][0]


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(docs, levels, monkeypatch):
    """Blocks of 3, 9 and 729 nodes give the same trees, over nulls, ties, repeated rows, groups of one and clashing names."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    want = sorted(manifest(rows()), key=str)
    got = [tuple(r) for r in merkle.manifest(docs, changed={"text": tampered()}).collect()]
    assert sorted(got, key=str) == want
    assert {r[-1] for r in got} == {True, False}


def test_manifest_edges(docs, spark):
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 500")
    (r,) = merkle.manifest(one, with_path=True).collect()
    assert r.leaf == r.subroot == r.root and r.path == [] and r.verified and r.proof_sha256 == sha("")
    assert all(r.verified for r in merkle.manifest(docs).collect())
    (r,) = merkle.manifest(one, fields=("a.b", "doc_id"), group_col="a.b").collect()
    assert r.leaf == leaf((2, 500))


def test_manifest_path(docs):
    """The given path folds each leaf to the root."""
    for r in merkle.manifest(docs, with_path=True).collect():
        node = r.leaf
        for s in r.path:
            node = sha(s.left, node, s.right)
        assert node == r.root and r.proof_sha256 == sha(*[s.left + s.right for s in r.path])


def plain(vectors, k, rounds):
    """Clusters by plain Lloyd rounds, all distances computed."""
    order = sorted(vectors, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in vectors]
        for i in range(len(centroids)):
            if mine := [v for (_, v), c in zip(vectors, of) if c == i]:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, nearest(v)) for i, v in vectors]
    inertia = sum(d for _, (d, _) in found)
    return [(i, c, d, sum(e for _, (e, b) in found if b == c), inertia, tuple(centroids[c])) for i, (d, c) in found]


def clumps(rng, n, dim, spread):
    middles = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("dim, k, groups, spread", [(3, 12, 4, 0.05), (64, 16, 4, 0.2), (2, 7, 1, 1.0), (4, 16, 16, 0.0), (3, 40, 4, 0.05)])
def test_clusters(spark, dim, k, groups, spread):
    """Any number of groups gives what all distances give, ties, repeated vectors and ids and other lengths included."""
    rng = random.Random(dim * k)
    table = clumps(rng, 300, dim, spread)
    table += [(i, table[0][1]) for i in range(300, 330)] + [(5, table[9][1]), (5, table[9][1]), (None, table[3][1])]
    odd = [(900, None), (901, [0.0] * (dim - 1)), (902, [None] + [0.0] * (dim - 1)), (903, [math.nan] * dim), (904, [math.inf] + [0.0] * (dim - 1)), (905, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in table + odd], "vec_id long, embedding array<double>, cluster int, `v.x` int").repartition(4)
    want = plain([(i, [math.floor(64 * x) for x in v]) for i, v in table], k, 3)
    got = yinyang.cluster_vectors(frame, k=k, groups=groups, dim=dim).collect()
    assert sorted([(r[0], r[1], r[2], r[3], r[4], tuple(r[5])) for r in got], key=str) == sorted(want, key=str)
    assert max(r.scanned for r in got) <= 4 * k + 3
    if spread == 0.05:  # separate clumps: most distances are never computed
        assert sum(r.scanned for r in got) < 0.6 * 4 * k * len(got)


def test_clusters_edges(spark):
    frame = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.5])], "vec_id long, embedding array<float>")
    assert yinyang.cluster_vectors(frame.limit(0), dim=2).collect() == []
    got = {r.vec_id: r for r in yinyang.cluster_vectors(frame, k=1, dim=2).collect()}
    assert set(got) == {1, 2} and got[1].inertia == got[1].distance + got[2].distance
    big = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 3]])
    assert yinyang.squared(big, big)[0, 1] == 1 + ((1 << 26) + 3) ** 2


def _field(number, data):
    size, out = len(data), b""
    while size > 127:
        size, out = size >> 7, out + bytes([size & 127 | 128])
    return bytes([number << 3 | 2]) + out + bytes([size]) + data


def with_rules(rule, flags):
    """The model with the character map of one of the library's rules instead of its own."""
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = dict(pieces._fields(dict(pieces._fields(own))[3]))
    kept = b"".join(_field(n, v) for n, v in pieces._fields(MODEL) if n in (1, 2))
    return kept + _field(3, _field(2, spec.get(2, b"")) + flags)


@pytest.mark.parametrize("rule", [None, "identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_pieces_like_the_library(rule):
    """Ids, decoded texts and the source span of every piece, under the library's own character maps and flags."""
    rng = random.Random(2)
    for flags in [b""] if rule is None else [b"", b"\x18\x01\x20\x01", b"\x18\x00\x20\x01", b"\x18\x01\x20\x00"]:
        data = MODEL if rule is None else with_rules(rule, flags)
        ours, theirs = pieces.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        texts = ["", " ", "\n", "thing" * 400, " " * 300 + "x", "x" * 2000 + " y"] + [made_up(rng, 30) for _ in range(300)]
        for text in texts:
            ids, begins, ends = ours.encode(text)
            assert ids == theirs.encode(text) == [i for c in ours.chunks(ours.normalize(text)[0]) for i in ours.ids(c)]
            assert ours.decode(ids) == theirs.decode(ids)
            raw = text.encode()
            assert [raw[a:b].decode() for a, b in zip(begins, ends)] == [p.surface for p in theirs.encode(text, return_type="proto").pieces]


def test_decoding_any_ids():
    """Byte pieces that are no characters, control pieces and the unknown piece."""
    rng, ours, theirs = random.Random(4), pieces.Model(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for _ in range(2000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert ours.decode(ids) == theirs.decode(ids)


def test_sentencepiece_documents(spark):
    rng = random.Random(8)
    table = [(i, made_up(rng, 60)) for i in range(50)] + [(None, "x"), (3, None), (3, ""), (4, "tie"), (4, "tie"), (60, "word " * 30_000 + "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in table], "doc_id long, text string, ids int, n_tokens int")
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = []
    for i, t in table:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), sha(sp.decode(ids)), ids))
    got = pieces.encode_documents(docs, MODEL, with_pieces=True).collect()
    assert sorted([(*r[:4], list(r[4])) for r in got], key=str) == sorted(want, key=str)
    assert pieces.encode_documents(docs.limit(0), MODEL).collect() == []
    with pytest.raises(ValueError):
        pieces.Model(MODEL[:2000])


def test_sentencepiece_query_has_the_spans(spark):
    """The query's rows come with the source bytes of every piece, as the library gives them."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        at = [(p.begin, p.end) for p in sp.encode(r.text or "", return_type="proto").pieces]
        spans = [a for a, _ in at] + [b for _, b in at]
        want[r.doc_id] = zlib.crc32(np.array(spans, "<i8").tobytes())
    assert {r.doc_id: r.spans_crc32 for r in QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()} == want


@pytest.mark.parametrize("name", ["op11_yinyang_clustering", "op12_merkle_manifest", "op13_sentencepiece"])
def test_queries_keep_rows(spark, name):
    table = "embeddings" if name.startswith("op11") else "documents"
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
