"""Each operator against a brute-force version on a small table with nulls, empty, long, tied and repeated rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from scenemill.llm import bpe, chaining, components, fingerprints, hashing, jaccard, media, packing, quality, sharding, suffixes, toxicity
from scenemill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path long, th string, key int, h int"


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré", "sh", "ing"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    a, b, passage = prose(120), prose(300), prose(80)
    near = a.split()
    near[60] = "changed"
    texts = [a, a, " ".join(near), b, prose(50) + " " + passage + " " + prose(40), passage + ".\n\n " + prose(60), None, "", "one", "two words", " \n\t ",
             "  double  spaces \n here\t \n", "x" * 3000, prose(5000), "ab " * 200, "\0nul \0 bytes", "日本語のテキスト 🎬 emoji", b]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, b), (None, prose(30)), (None, None), (20, "tie"), (20, "tie other")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, "x", 2, 3) for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(60):
        spans = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 5))]
        size = np.array([len(s) for s in spans])
        end = np.cumsum(size)
        data, begin = np.frombuffer(b"".join(spans), np.uint8), end - size
        order = suffixes.suffix_array(data, begin, end, end - 1)
        stop = np.repeat(end, size)
        got = [data[i : stop[i]].tobytes() for i in order]
        assert got == sorted(got) and len(got) == len(data)


@pytest.mark.parametrize("limit, many", [(40, 4000), (200, 4000), (40, 1), (200, 1)])
def test_dedup_substrings(docs, limit, many, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    seen = Counter()
    for _, t in corpus():
        r = raw(t)
        seen.update(r[p : p + limit] for p in range(len(r) - limit + 1))
    want = []
    for i, t in corpus():
        r = raw(t)
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - limit + 1):
            if seen[r[p : p + limit]] > 1:
                gone[p : p + limit] = True
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        want.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.dedup_substrings(docs, limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates(docs, monkeypatch):
    for tile, small, many, error in ((2048, 1024, 2048, 0.05), (2, 0, 2048, 2.0), (2, 0, 1, 0.05)):
        monkeypatch.setattr(jaccard, "TILE", tile)
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "MANY", many)
        monkeypatch.setattr(jaccard, "ERROR", error)
        texts = sorted({t or "" for _, t in corpus()})
        sets = dict(zip(texts, (set(s.tolist()) for s in hashing.shingle_sets(texts))))
        links = defaultdict(set)
        for x in texts:
            for y in texts:
                both = len(sets[x] & sets[y])
                if x != y and both and 5 * both >= 4 * len(sets[x] | sets[y]):
                    links[x].add(y)

        def group(t):
            out, todo = set(), [t]
            while todo:
                if (x := todo.pop()) not in out:
                    out.add(x)
                    todo += links[x]
            return out

        want = []
        for i, t in corpus():
            ids = [k for k, u in corpus() if (u or "") in group(t or "") and k is not None]
            want.append((i, min(ids, default=None), len(links[t or ""]), sum((u or "") == (t or "") for _, u in corpus()) - 1))
        got = [tuple(r) for r in jaccard.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.recall(jaccard.RUNS) >= 0.999 > jaccard.recall(jaccard.RUNS - 1)


def test_near_duplicates_recall(spark):
    """All pairs of a table of the benchmark against the join: at least 0.99 of the links, and no other ones."""
    rng = random.Random(11)
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = set(t or "" for t in own)
    for t in own[:400]:  # copies of a likeness about the threshold, some of them in groups
        words = (t or "").split()[:3000]
        for _ in range(rng.choice([1, 1, 1, 6]) if len(words) > 40 else 0):
            copy = list(words)
            for k in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.uniform(0.002, 0.02)))):
                copy[k] = f"own{rng.randrange(10**6)}"
            texts.add(" ".join(copy))
    texts = sorted(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets, holders, both, links = hashing.shingle_sets(texts), defaultdict(list), Counter(), Counter()
    for i, s in enumerate(sets):
        for token in s.tolist():
            both.update((j, i) for j in holders[token])
            holders[token].append(i)
    for (i, j), n in both.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links.update((i, j))
    want = {hashlib.md5(t.encode()).digest(): links[i] for i, t in enumerate(texts)}
    got = {bytes(r.key): r.n_links for r in jaccard.near_duplicates(docs, with_key=True).collect()}
    assert got.keys() == want.keys() and all(n <= want[k] for k, n in got.items())
    assert sum(want.values()) > 1000 and sum(got.values()) >= 0.99 * sum(want.values())


def test_one_of_each(docs):
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len(set(rows)) and {0, 3, 4, 5} <= {r[0] for r in rows} and not {1, 2, 17} & {r[0] for r in rows}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 4), (8, 7), *[(i, i + 1) for i in range(20, 40)]]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 7: 7, 8: 7, 9: 7, **{i: 20 for i in range(20, 41)}}


def test_byte_bpe(spark, docs):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in corpus():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw(t)).hexdigest()))
    got = [tuple(r) for r in bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    words = [b" thinking", b"a", b"", "é日".encode(), bytes(range(256))]
    rows = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "w binary"), "w", ranks).collect()
    one = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        assert bytes(r.decoded) == bytes(r.w) and r.ids == bpe.fold_word(bytes(r.w), ranks)
        if bytes(r.w)[:1] != b"\0":
            assert r.ids == one.encode_ordinary(bytes(r.w).decode())
    assert base64.b64encode(b"x")


def test_sharding(docs):
    for n in (1, 2, 3, 17, 1000):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permute(p, n, inverse=True).tolist() == list(range(n))
    rows = sharding.shard(docs, 4).collect()
    again = sharding.shard(docs.repartition(5), 4).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in corpus())
    one = rows[0]
    assert sharding.row_at(one.shard, one.slot, len(rows), 4) == one.row_number


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    assert packing.ranked(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, with_ids=True).collect()
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert sorted(fill) == list(range(len(fill)))
    for s, pieces in fill.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or s == len(fill) - 1
    docs_of = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        docs_of[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    whole = Counter()
    for (i, _), pieces in docs_of.items():
        run = []
        for start, ids in pieces:
            if start == 0 and run:
                whole[(i, tuple(run))] += 1
                run = []
            run += ids
        whole[(i, tuple(run))] += 1
    assert whole == Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in corpus())


def test_fingerprints(docs):
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(order)
    by_text = {}
    single = [k for k, n in Counter(i for i, _ in order).items() if n == 1]
    ids = [i for i, _ in order]
    for r in rows:
        if r.doc_id in single and ids[(ids.index(r.doc_id) + 1) % len(ids)] in single:
            t, nxt = (order[(ids.index(r.doc_id) + k) % len(ids)][1] or "" for k in (0, 1))
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half] if half else t
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            assert r.common_prefix_edited == next((k for k, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
            assert (r.near_edited == 1.0) == (t == edited) and 0 <= r.near_next <= 1
    h = fingerprints.PrefixHash(fingerprints._points("abcabcabd"))
    assert h.extension(0, h, 3) == 5 and h.extension_back(9, h, 6) == 0 and h.equal(0, h, 3, 5) and not h.equal(0, h, 3, 6)


def test_likeness_counts_the_interior():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    mark = lambda x: fingerprints.fingerprint(fingerprints.PrefixHash(fingerprints._points(x)))
    text = prose(10_000)
    assert fingerprints.likeness(mark(text), mark("#" + text[1:-1] + "#")) > 0.9
    assert 0.9 < fingerprints.likeness(mark(text), mark("new header " + text + " new footer")) < 1
    assert fingerprints.likeness(mark(text), mark(prose(10_000))) < 0.1


def test_media(docs):
    for r in media.text_media(docs).collect():
        assert r.payload_bytes % 576 == 0 and r.media_type == "audio/wav" and r.media_bytes == r.payload_bytes + 44
        assert r.corrected == (not r.feature.startswith("audio/wav>"))
    want = sorted((str(i), len(raw(t)), hashlib.sha256(raw(t) + b"\xff" * (max(1, math.ceil(len(raw(t)) / 576)) * 576 - len(raw(t)))).hexdigest()) for i, t in corpus())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in media.text_media(docs).collect()) == want


def _made() -> dict[str, bytes]:
    """A small medium of every type."""
    import gzip
    import io
    import zipfile

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    def crc(data, poly, bits):
        out = 0
        for c in data:
            out ^= c << bits - 8
            for _ in range(8):
                out = (out << 1 ^ poly if out >> bits - 1 else out << 1) & (1 << bits) - 1
        return out.to_bytes(bits // 8, "big")

    def frame(k, body):  # 192 samples, numbered
        head = b"\xff\xf8\x19\x08" + bytes([k])
        data = head + crc(head, 0x07, 8) + body
        return data + crc(data, 0x8005, 16)

    info = b"\x00\xc0" * 2 + b"\0" * 6 + (44100 << 44 | 15 << 36 | 3 * 192).to_bytes(8, "big") + b"\0" * 16
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a.txt", "hello " * 50)
    page = lambda flag, body: b"OggS\0" + bytes([flag]) + b"\0" * 20 + bytes([1, len(body)]) + body
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    return {
        "image/png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b""),
        "image/gif": b"GIF89a\x01\0\x01\0\0\0\0;",
        "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03x" + b"data\xff\0more\xff\xd0end" + b"\xff\xd9",
        "audio/wav": media.to_wav(b"sound"[:4]),
        "audio/flac": b"fLaC\x80\0\0\x22" + info + frame(0, b"one audio frame") + frame(1, b"another") + frame(2, b"and the last"),
        "audio/ogg": page(2, b"head") + page(0, b"body") + page(4, b"tail"),
        "video/mp4": box(b"ftyp", b"isom") + box(b"mdat", b"1234") + box(b"moov", b""),
        "application/pdf": b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\nupdate\nstartxref\n40\n%%EOF",
        "application/zip": archive.getvalue(),
        "application/gzip": gzip.compress(b"hello" * 30),
    }


def test_media_lengths():
    made = _made()
    gif = made["image/gif"]
    for kind, one in made.items():
        for before, after in ((b"", b""), (b"junk ", b" junk"), (gif, gif + gif), (b"--", one + b"..")):
            got = media.find_media(before + one + after)
            assert (kind, len(before), len(one)) in got and len(got) == 1 + (before == gif) + (after == gif + gif) * 2 + (before == b"--"), (kind, got)
        for cut in range(len(one) // 2, len(one) - 1):  # one that is not whole is none (a FLAC stream or Ogg or MP4 ends with its last whole part)
            if kind not in ("audio/flac", "audio/ogg", "video/mp4", "application/pdf"):
                assert all(k != kind for k, _, _ in media.find_media(one[:cut])), (kind, cut)
    assert [k for k, _, _ in media.find_media(made["audio/flac"] + gif + gif)] == ["audio/flac", "image/gif", "image/gif"]
    assert [k for k, _, _ in media.find_media(made["application/pdf"] + gif + made["application/pdf"])] == ["application/pdf", "image/gif", "application/pdf"]


@pytest.mark.parametrize("mark", [b"PK\x03\x04", b"%PDF-", b"PK\x05\x06", b"fLaC", b"GIF89a", b"OggS", b"RIFF", b"\0\0\0\x08ftyp"])
def test_media_search_is_linear(mark):
    import time

    began = time.time()
    media.find_media(mark * ((1 << 20) // len(mark)))
    assert time.time() - began < 15


def test_sniffing(spark):
    made = _made()
    png, gif, zipped = made["image/png"], made["image/gif"], made["application/gzip"]
    blob = b"junk" + png + b"--" + gif + b"GIF89a not one" + zipped
    assert media.find_media(blob) == [("image/png", 4, len(png)), ("image/gif", 6 + len(png), len(gif)), ("application/gzip", len(blob) - len(zipped), len(zipped))]
    rows = [(1, png, "image/gif"), (2, blob, "text/plain"), (3, b"", "x"), (4, None, "y"), (5, media.to_wav(gif), "audio/wav")]
    df = spark.createDataFrame([(*r, "mine", "too") for r in rows], "id int, content binary, kind string, _media string, Media string")
    out = media.sniff(df, "content", "kind")
    assert out.columns == [*df.columns, "media_type", "media_valid_bytes", "media_corrected", "media_embedded"]
    got = {r.id: r for r in out.collect()}
    assert (got[1].media_type, got[1].media_corrected) == ("image/png", True)
    assert [bytes(e.content) for e in got[2].media_embedded] == [png, gif, zipped] and got[2].media_type == "text/plain"
    assert got[3].media_embedded == [] and got[4].media_type is None and got[5].media_valid_bytes == 44 + len(gif) and not got[5].media_corrected
    assert {(r["_media"], r["Media"]) for r in got.values()} == {("mine", "too")}


def test_chains():
    x = np.array([0, 10, 20, 30, 5, 200])
    y = np.array([100, 110, 121, 131, 3, 300])
    best = max(chaining.chains(x, y), key=len)
    assert best.tolist() == [0, 1, 2, 3]
    a = np.arange(80, dtype=np.uint64)
    b = np.concatenate((np.arange(900, 903), np.delete(np.arange(80), 40), [7])).astype(np.uint64)
    assert chaining.align(a, b, 10, 13) == (0, 80, 3, 82, 79)
    assert chaining.align(a, b, 60, 62) == (0, 80, 3, 82, 79)


@pytest.mark.parametrize("spans", [2000, 1])
def test_fuzzy_passages(docs, spans, monkeypatch):
    monkeypatch.setattr(chaining, "SPANS", spans)
    rows = chaining.fuzzy_passages(docs, 50).collect()
    pairs = {(r.doc_id, r.partner_id) for r in rows}
    assert {(1, 0), (2, 0), (17, 3), (5, 4)} <= pairs
    assert all(r.n_words >= 50 and r.likeness >= 0.8 for r in rows)
    assert not {6, 7, 8, 9, 13, 16} & {i for p in pairs for i in p}


def labelled(spark, n=400):
    """Toxic by words that stand for it, a language at a time; junk by its vocabulary, which no count of signs or cases shows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    vile = {"en": ["vile", "rotten", "scum"], "de": ["mies", "faul"]}
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(60)]
        bad, junk, lang = i % 5 == 0, i % 7 == 0, "en" if i % 2 else "de"
        if bad:
            for _ in range(rng.randint(2, 4)):
                t[rng.randrange(60)] = rng.choice(vile[lang])
        if junk:
            for _ in range(12):
                t[rng.randrange(60)] = rng.choice(["buy", "now", "cheap", "click"])
        rows.append((i, " ".join(t), lang, f"src{i % 3}", 200))
        labels.append((i, int(not junk) if i % 11 else None, int(bad) if i % 13 else None))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def _found(spark, texts):
    rows = chaining.fuzzy_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 50, 0.8).collect()
    return {(r.doc_id, r.partner_id) for r in rows}, rows


def test_fuzzy_passage_of_common_lines(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    lines = [own(20) for _ in range(3)]
    passage = " ".join(lines)
    texts = [*(own(30) + " " + x + " " + own(30) for x in lines), *(own(40) + " " + passage + " " + own(40) for _ in range(2))]
    assert (4, 3) in _found(spark, texts)[0]


@pytest.mark.parametrize("sizes", [(1_000_000, 4, 2_000_000), (40, 1, 3)])
def test_fuzzy_passage_of_common_seeds(spark, monkeypatch, sizes):
    """Each seed of the passage, long ones too, stands in four documents without it, two of them between its two documents; copies are tied once."""
    for name, value in zip(("BLOCK", "BLOCKS", "PAIRS"), sizes):
        monkeypatch.setattr(chaining, name, value)
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(60)
    pieces = lambda: [" ".join(own(30) + passage[k : k + 38] + own(30)) for k in (0, 11, 22) for _ in range(2)]
    whole = lambda: " ".join(own(40) + passage + own(40))
    texts = [*pieces(), whole(), *pieces(), whole(), *pieces(), whole()]
    assert _found(spark, [*texts, texts[13], texts[13]])[0] == {(13, 6), (20, 6), (20, 13), (21, 13), (22, 13)}


def _ties_kept(every, some):
    """Each passage of the whole list ties two stretches of one class; how many do not."""
    stretch = {}
    for r in some:
        stretch.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words, r.class_id))
        stretch.setdefault(r.partner_id, []).append((r.partner_start, r.partner_start + r.partner_words, r.class_id))
    of = lambda i, a, n: {c for lo, hi, c in stretch.get(i, []) if lo < a + n and a < hi}
    return sum(not of(r.doc_id, r.start_word, r.n_words) & of(r.partner_id, r.partner_start, r.partner_words) for r in every)


@pytest.mark.parametrize("sizes", [(1_000_000, 4, 2_000_000, 100), (200, 1, 300, 2)])
def test_classes_of_passages(spark, monkeypatch, sizes):
    """A class of m passages has about m rows, not m squared; no link of the whole list is lost, with common lines and with passages of common seeds."""
    for name, value in zip(("BLOCK", "BLOCKS", "PAIRS", "COMMON"), sizes):
        monkeypatch.setattr(chaining, name, value)
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, exact, near, lines = own(9), own(68), own(160), [own(20) for _ in range(3)]
    texts = [own(30) + line + own(30) for _ in range(20)]
    texts += [own(rng.randrange(90)) + exact + own(20) + line for _ in range(20)]
    for _ in range(20):
        copy = list(near)
        for k in rng.sample(range(160), 8):
            copy[k] = own(1)[0]
        texts.append(copy)
    texts += [own(30) + x + own(30) for x in lines]
    texts += [own(40) + sum(lines, []) + own(40) for _ in range(2)]
    texts += [texts[25], own(10) + near[:100] + own(70) + exact + line]
    texts += [own(80) + line + own(8) + lines[0] + own(3) + line + lines[1][:18] + own(20) for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    every, some = chaining.fuzzy_passages(docs, 50, 0.8).collect(), chaining.passage_classes(docs, 50, 0.8).collect()
    assert _ties_kept(every, some) == 0 and len(every) > 350 and len(some) < 100
    whole = {(r.doc_id, r.partner_id) for r in every}
    assert {(r.doc_id, r.partner_id) for r in some} <= whole and (64, 63) in whole
    of = {}
    for r in some:
        of.setdefault(r.class_id, set()).update((r.doc_id, r.partner_id))
    classes = sorted(map(len, of.values()))
    assert classes[-2:] == [21, 22]


def test_fuzzy_passages_edited_to_the_bound(spark):
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, planted = [], set()
    for n, edits, even in [(60, 6, True), (60, 9, True), (60, 9, False), (100, 15, True), (100, 19, False), (200, 30, True)] * 5:
        passage = own(n)
        copy = list(passage)
        for k in [round((e + 0.5) * n / edits) for e in range(edits)] if even else rng.sample(range(n), edits):
            copy[k] = own(1)[0]
        planted.add((len(texts) + 1, len(texts)))
        texts += [" ".join(own(30) + passage + own(30)), " ".join(own(20) + copy + own(40))]
    pairs, rows = _found(spark, texts)
    assert pairs <= planted and len(pairs) >= 28
    assert all(r.likeness >= 0.8 and r.n_words >= 50 for r in rows)


def test_fuzzy_passages_between_own_words(spark):
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = [own(60) for _ in range(4)]
    texts = [" ".join(x + " " + own(35) for x in shared) for _ in range(2)]
    rows = _found(spark, texts)[1]
    assert sorted((r.start_word, r.n_words, r.equal_words) for r in rows) == [(95 * k, 60, 60) for k in range(4)]


def test_scattered_seeds_are_not_chained():
    """Pairs of documents whose common seeds lie far apart go before any is chained; those with a chain stay."""
    rng = np.random.default_rng(7)
    pair, x, y, chained = [], [], [], set()
    for k in range(300):
        n = int(rng.integers(2, 9))
        some = np.sort(rng.integers(0, 3000 if k % 3 else 150, n)), rng.integers(0, 3000 if k % 3 else 150, n)
        spots = chaining._thin(some[0], np.sort(some[1]) if k % 2 else some[1])
        found = [spots[c] for c in chaining.chains(spots[:, 0], spots[:, 1])]
        if any(len(c) > 1 and min(c[-1] - c[0]) + chaining.SEED >= 20 for c in found):
            chained.add(k)
        pair, x, y = pair + [k] * len(spots), x + spots[:, 0].tolist(), y + spots[:, 1].tolist()
    near = set(chaining._near(np.array(pair), np.array(x), np.array(y), 20).tolist())
    assert chained and chained <= near and len(near) < 150


def test_places_of_a_seed_in_two_documents():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 30, 40)
    at, flat = np.concatenate(([0], np.cumsum(size))), np.arange(size.sum())
    later, earlier = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    want = []
    for k, (e, f) in enumerate(zip(later, earlier)):
        i, j = flat[at[e] : at[e + 1]].tolist(), flat[at[f] : at[f + 1]].tolist()
        near = len(j) if len(i) * len(j) <= chaining.CROSS else max(1, chaining.CROSS // len(i))
        for n, a in enumerate(i):
            lo = 0 if near == len(j) else max(0, min(n * len(j) // len(i) - near // 2, len(j) - near))
            want += [(k, a, b) for b in j[lo : lo + near]]
    assert list(zip(*(v.tolist() for v in chaining._matches(later, earlier, at, flat)))) == want


def test_parts_of_many_runs():
    """The best stretches, whatever number of runs is looked at together; an alignment of 120 runs takes under 6 ms of CPU."""
    import time

    rng = np.random.default_rng(9)
    cases = []
    for _ in range(60):
        n, gaps = rng.integers(1, 9, 120), rng.integers(0, 3, (120, 2))
        ends = np.cumsum(n[:, None] + gaps, 0)
        cases.append(np.column_stack((ends - n[:, None], n)))
    began = time.process_time()
    got = [chaining.parts(c, 50, 0.8) for c in cases]
    took = time.process_time() - began
    for c, found in zip(cases, got):
        total = np.concatenate(([0], np.cumsum(c[:, 2])))
        score = {}
        for r in range(len(c)):
            for s in range(r, len(c)):
                sides, equal = c[s, :2] + c[s, 2] - c[r, :2], total[s + 1] - total[r]
                if min(sides) >= 50 and equal >= 0.8 * max(sides):
                    score[r, s] = 2 * equal - max(sides)
        r, s = min(score, key=lambda k: (-score[k], k))
        assert found[0] == (c[r, 0], c[s, 0] + c[s, 2], c[r, 1], c[s, 1] + c[s, 2], total[s + 1] - total[r])
    assert took < 60 * 0.006


def test_toxicity_held_out(spark, docs):
    d, labels, rows = labelled(spark)
    chain = toxicity.train(d, labels.where("doc_id < 300"))
    assert sorted(chain.categories[:2]) == ["toxic_de", "toxic_en"] and chain.categories[2] == "toxic" and len(chain.models[-1]) == len(chain.models[0]) + 2
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, chain).collect()}
    assert sum(got[i].is_toxic == (i % 5 == 0) for i in range(300, 400)) >= 98
    assert all(0 <= p <= 1 for r in got.values() for p in (r.p_toxic, *r.p_groups))
    own = [chain.categories.index("toxic_en" if i % 2 else "toxic_de") for i in range(400)]
    assert np.mean([(got[i].p_groups[own[i]] > 0.5) == (i % 5 == 0) for i in range(300, 400)]) >= 0.95
    odd = toxicity.score_toxicity(docs, chain).collect()
    assert len(odd) == len(corpus()) and not any(r.is_toxic for r in odd)
    kept = toxicity.drop_toxic(d, chain)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if not r.is_toxic)


def test_held_out_labels(spark):
    """Fitted on half of the labelled documents of a table of the benchmark, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("pmod(hash(doc_id), 2) = 0")
    judged = labels.where("pmod(hash(doc_id), 2) = 1").join(docs, "doc_id")
    bad = {r.doc_id: (r.toxic, r.quality) for r in judged.collect()}
    for rows, column, want in (
        (toxicity.score_toxicity(judged, toxicity.train(docs, half)), "is_toxic", 0), (quality.score_quality(judged, quality.train(docs, half)), "keep", 1),
    ):
        rows = [(bool(r[column]), bad[r.doc_id][want] == 1) for r in rows.collect() if bad[r.doc_id][want] is not None]
        assert len(rows) > 100 and np.mean([a == b for a, b in rows]) >= 0.9
        # of what is to be caught (toxic ones; for quality the bad ones): right among the called, called among the right
        caught = [(a, b) if want == 0 else (not a, not b) for a, b in rows]
        both = sum(a and b for a, b in caught)
        assert both / max(1, sum(a for a, _ in caught)) >= 0.9 and both / max(1, sum(b for _, b in caught)) >= 0.75, (column, both)


def test_toxicity_of_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(9000)] + [f"vile{rng.randrange(10**9)}"] * (i % 2))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.is_toxic for r in toxicity.toxicity(d, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(60))


def test_views_teach_each_other(spark):
    """Labelled texts hold a tenth of the words only, and the source tells: unlabelled documents teach the text view the others."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    good, junk = [word() for _ in range(100)], [word() for _ in range(100)]
    rows, labels = [], []
    for i in range(2200):
        bad = i % 2 == 1
        own = junk if bad else good
        if i < 600:
            own = own[:10]
        rows.append((i, " ".join(rng.choice(own) for _ in range(8)), "en", ("spam" if bad else "news") if i < 2000 else f"new{i}", 60))
        if i < 600:
            labels.append((i, int(not bad), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    late = d.where("doc_id >= 2000")

    def right(pool):
        got = quality.score_quality(late, quality.train(pool, known)).collect()
        return np.mean([(r.p_text > 0.5) == (r.doc_id % 2 == 0) for r in got])

    alone, together = right(d.where("doc_id < 600")), right(d.where("doc_id < 2000"))
    assert together >= alone + 0.05, (alone, together)


def test_quality_held_out(spark, docs):
    d, labels, rows = labelled(spark)
    model = quality.train(d, labels.where("doc_id < 300"))
    assert model.rounds and model.rounds[0] > 0
    got = {r.doc_id: r for r in quality.score_quality(d, model).collect()}
    assert sum(got[i].keep == (i % 7 != 0) for i in range(300, 400)) >= 97
    assert quality.score_quality(docs, model).count() == len(corpus())
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.keep)


def test_no_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none).where("is_toxic").count() == 0
    assert toxicity.drop_toxic(docs, toxicity.train(docs, none)).count() == len(corpus())
    assert quality.quality(docs, none).where("keep").count() == len(corpus())
    assert toxicity.toxicity(empty, none).count() == 0 and quality.quality(empty, none).count() == 0


def test_empty_tables(empty):
    ranks = {bytes([i]): i for i in range(256)}
    for df in (
        suffixes.dedup_substrings(empty), jaccard.near_duplicates(empty), bpe.encode_documents(empty, ranks, r"\S+"), chaining.fuzzy_passages(empty), sharding.shard(empty),
        packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")), fingerprints.fingerprint_documents(empty), media.text_media(empty),
    ):
        assert df.count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert out.columns[:3] == ["doc_id", "start", "length"] and rows
    last = max(r.sequence_id for r in rows)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert all(n == 2048 for s, n in fill.items() if s != last)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, part int, place string"


def test_columns_of_any_name(spark):
    """Dotted and clashing names go through every stage before the packing, and through the numbering of rows."""
    import corpus_pipeline

    rows = [(i, t, "en", None, None if t is None else len(t), i, 2, "x") for i, t in corpus() if i is not None]
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    folder = f"{__import__('tempfile').mkdtemp(prefix='spark-')}/sf"
    labels.write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        known = {(r[0], r[5]) for r in rows}
        assert {(r[0], r[5]) for r in out.collect()} <= known
    numbered = sharding.number_rows(docs, ["doc_id", "a.b"]).collect()
    assert sorted(r.row_number for r in numbered) == list(range(len(rows))) and {r.part for r in numbered} == {2}


def test_one_of_each_keeps_whole_rows(spark):
    """Against the classes of the join: the least id of each, one row of exact repeats, other columns as they were."""
    rows = [(i, t, k) for k, (i, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` int").repartition(4)
    near = jaccard.near_duplicates(docs, with_key=True).collect()
    want = {(r.doc_id, bytes(r.key)) for r in near if r.doc_id == r.class_id}
    got = jaccard.one_of_each(docs).collect()
    assert all((r[0], r[1]) == rows[r[2]][:2] for r in got)
    assert sorted((str(r[0]), hashlib.md5(raw(r[1])).digest()) for r in got) == sorted((str(i), k) for i, k in want)


@pytest.mark.parametrize("words", [1 << 19, 1])
def test_dedup_gives_text_and_columns(spark, docs, words, monkeypatch):
    """The kept text and the carried columns against brute force; a full sieve changes nothing."""
    from scenemill.llm import store

    monkeypatch.setattr(store, "WORDS", words)
    seen = Counter()
    for _, t in corpus():
        seen.update(raw(t)[p : p + 40] for p in range(len(raw(t)) - 39))
    want = []
    for i, t in corpus():
        r, gone = raw(t), set()
        for p in range(len(r) - 39):
            if seen[r[p : p + 40]] > 1:
                gone |= set(range(p, p + 40))
        want.append((i, bytes(c for p, c in enumerate(r) if p not in gone).decode("utf-8", "ignore"), "en", "x"))
    got = suffixes.dedup_substrings(docs, 40, with_text=True, carry=("lang", "th")).collect()
    assert sorted([(r.doc_id, r.text, r.lang, r.th) for r in got], key=str) == sorted(want, key=str)
