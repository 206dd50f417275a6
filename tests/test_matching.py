"""Matching of script lines with cues and spoken words against worked cases."""

import random

from scenemill.operators import matching


def slow_distance(a, b):
    table = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return table[len(a), len(b)]


def test_likeness():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abC") for _ in range(rng.randint(0, 9))) for _ in "xx")
        assert abs(matching.likeness(a, b) - (1 - slow_distance(a.lower(), b.lower()) / max(len(a), len(b), 1))) < 1e-12


def test_correct_cues(spark):
    lines = spark.createDataFrame([(1, 1, "hello there"), (1, 2, "good morning all"), (1, 3, "zzz"), (1, 4, "late"), (2, 1, None), (3, 1, " a ")], "job int, line_no int, line string")
    cues = spark.createDataFrame(
        [(1, 1, 0.0, 1.0, "hello there "), (1, 2, 1.0, 2.0, "good"), (1, 3, 2.0, 3.0, "mornin all"), (1, 4, 3.0, 4.0, "qq"), (3, 1, 0.0, 1.0, "a"), (4, 1, 0.0, 1.0, "x")],
        "job int, cue_no int, start double, end double, text string",
    )
    got = sorted(tuple(r) for r in matching.correct_cues(lines, cues).collect())
    assert got == [
        (1, 1, 0.0, 1.0, "hello there", "same"), (1, 2, 1.0, 3.0, "good morning all", "merged"), (1, 3, 3.0, 4.0, "zzz", "mismatch"), (1, 4, 0.0, 0.0, "late", "extra"),
        (2, 1, 0.0, 0.0, "", "extra"), (3, 1, 0.0, 1.0, "a", "same"),
    ]


def test_match_words(spark):
    lines = spark.createDataFrame([(1, 1, "run, far"), (1, 2, "日本"), (2, 1, "no"), (3, 1, "!!"), (4, 1, None), (5, 1, "it's")], "job int, line_no int, line string")
    said = [(1, "run"), (1, " far"), (1, "."), (1, "日"), (1, "本"), (1, "more"), (2, "not"), (3, "!!"), (5, "its"), (6, "w")]
    words = spark.createDataFrame([(j, n, float(n), n + 1.0, w) for n, (j, w) in enumerate(said)], "job int, word_no int, start double, end double, word string")
    cues, rest = matching.match_words(lines, words)
    assert sorted(tuple(r) for r in cues.collect()) == [(1, 1, 0.0, 2.0, "run far"), (1, 2, 2.0, 5.0, "日本"), (5, 1, 8.0, 9.0, "its")]
    assert sorted(r.job for r in rest.collect()) == [2, 3, 4]


def test_phrase_cues(spark):
    items = spark.createDataFrame([(1, 1, 0.0, 4.0, 0), (1, 2, 4.0, 6.0, 1), (1, 3, 6.0, 10.0, 0)], "job int, item_no int, start double, end double, OST int")
    said = [(1, 1, 0.0, 1.0, "one"), (1, 2, 1.0, 2.0, "two"), (2, 3, 0.0, 1.0, "a very long part of it"), (2, 4, 1.0, 2.0, None), (2, 5, 2.0, 4.0, "end"), (9, 6, 0.0, 1.0, "beyond")]
    words = spark.createDataFrame([(1, *r) for r in said], "job int, part int, word_no int, start double, end double, word string")
    sentences = spark.createDataFrame([(1, 1, "one"), (1, 2, "nowhere")], "job int, sentence_no int, sentence string")
    got = [tuple(r) for r in matching.phrase_cues(items, words, sentences).collect()]
    assert got == [(1, 1, 0.0, 2.0, "one"), (1, 2, 2.0, 4.0, "two"), (1, 3, 6.0, 7.0, "a very long part of it"), (1, 4, 7.0, 10.0, "end")]
    assert matching.phrase_cues(items, words.where("false"), sentences).count() == 0


def test_distance_of_all_kinds():
    """Against the whole table, and long texts in a bit a character."""
    import random
    import time

    rng = random.Random(1)
    for _ in range(500):
        x, y = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for k, d in enumerate(y, 1):
                row.append(min(last[k] + 1, row[-1] + 1, last[k - 1] + (c != d)))
        assert matching._distance(x, y) == row[-1]
    began = time.process_time()
    for _ in range(40):
        matching.likeness("".join(rng.choices("abcdef ", k=2000)), "".join(rng.choices("abcdef ", k=1900)))
    assert time.process_time() - began < 0.5


def test_phrase_cues_meet_once(spark):
    """Words of all files meet in one exchange by file and are folded as they come, over batches of any size; parts without item, words of no file and files without words have no rows."""
    job = "if(id % 7 = 6, null, id % 7)"
    words = spark.range(4000).selectExpr(f"{job} as job", "cast(id div 400 as int) as part", "id as word_no", "id * 1.0D as start", "id * 1.0D + 1 as end", "concat('w', id) as word")
    items = spark.range(64).selectExpr("id % 8 as job", "id div 8 as item_no", "id * 1.0D as start", "id * 1.0D + 2 as end", "if(id div 8 = 3, 1, 0) as OST")
    sentences = spark.createDataFrame([(k, n, t) for k in range(8) for n, t in enumerate((None, f"w{400 + k}w", "no"))], "job long, sentence_no int, sentence string")
    got = matching.phrase_cues(items, words, sentences)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(job") == 2 and "CoGroup" not in plan  # the other one numbers the items
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        rows = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = []
    for k in range(6):
        placed = [(i * 8 + k) * 1.0 for i in range(8) if i != 3]
        mine = [(n // 400, n) for n in range(4000) if n % 7 == k and 1 <= n // 400 <= 7]
        last = dict(mine)
        ratio = {p: 2.0 / (n + 1.0) for p, n in last.items()}
        said = [(p, placed[p - 1] + n * ratio[p], placed[p - 1] + (n + 1.0) * ratio[p], f"w{n}") for p, n in mine]
        want += [(k, n, *cue) for n, cue in enumerate(matching.phrase_words(said, ["", f"w{400 + k}w", "no"]), 1)]
    assert rows == sorted(want)
