"""Scenes, frames, subtitles, files, rules and places against plain Python versions and in odd cases."""

import ast
import bisect
import glob
import json
import os
import random
import re
import tempfile
from html import escape

import pytest
from pyspark.sql import functions as F

from scenemill.functions import scoring, serialize, text
from scenemill.operators import positions, records, reports, rules, sampling, segmentation, timeline
from scenemill.plans import highlights
from scenemill.sources import files


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


# --- SRT by lines ------------------------------------------------------------------------------------------------


def by_lines(srt):
    """The line state machine in plain Python."""
    out, times, said = [], None, ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", re.sub("\r\n?", "\n", srt)):
        if re.findall("([0-9]*:[0-9]*:[0-9]*,[0-9]*)", line):
            times = line
        elif line.strip() == "" and times:
            out.append((len(out) + 1, times.strip(), said.strip()))
            times, said = None, ""
        elif times:
            said += line
    return out


def test_strict_srt(spark):
    rng = random.Random(3)
    parts = ["1", "00:00:01,000 --> 00:00:02,000", "::,", "text", "", " ", "　", "\x1c", "two words ", "\t"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "\n\n", "\r\n\r\n"]) for _ in range(300)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    got = {}
    for r in files.strict_srt(df).orderBy("file_id", "index").collect():
        got.setdefault(r.file_id, []).append((r["index"], r.times, r.text))
    assert got == {i: c for i, t in enumerate(texts) if (c := by_lines(t or ""))}


def test_strict_srt_files(spark):
    at = folder()
    with open(f"{at}/a.srt", "w") as f:
        f.write("1\n00:00:01,000 --> 00:00:02,000\nA\nB\n\n2\n00:00:03,000 --> 00:00:04,000\nlost\n")
    assert [(r["index"], r.text) for r in files.read_strict_srt(spark, f"{at}/a.srt").collect()] == [(1, "A\nB")]
    assert files.read_strict_srt(spark, f"{at}/none.srt").collect() == []


# --- files -------------------------------------------------------------------------------------------------------


def test_frame_analysis_files(spark):
    at, whole = folder(), {"overall_activity_summaries": [{"batch_index": 1, "time_range": "r", "summary": "s"}, {"batch_index": None, "summary": ""}], "frame_observations": [
        {"batch_index": 1, "timestamp": "t1", "observation": "o1"}, {"timestamp": "t0"}, {"batch_index": 7, "timestamp": "x"}, {"batch_index": 1, "timestamp": "t2", "observation": "o2"}]}
    for name, data in (("a", json.dumps(whole, indent=1)), ("b", "{}"), ("c", "no json")):
        with open(f"{at}/{name}.json", "w") as f:
            f.write(data)
    analyses = files.read_frame_analyses(spark, at)
    summaries, frames = files.analysis_rows(analyses)
    assert summaries.count() == 2 and frames.count() == 4
    (r,) = reports.frame_report_of_files(analyses).collect()
    assert r.markdown == "## 片段 1\n- 时间范围：r\n- 片段描述：s\n- 详细描述：\n  - t1: o1\n  - t2: o2\n\n## 片段 2\n- 时间范围：\n- 片段描述：\n- 详细描述：\n  - t0: \n\n"
    plan = reports.frame_report_of_files(analyses)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") <= 1 or plan.count("FileScan text") == 1
    assert "Join" not in plan


def test_voices(spark):
    at = f"{folder()}/voices.txt"
    with open(at, "w") as f:
        f.write("Name: zh-CN-B\nGender: Male\n\nName: af-ZA-A\nGender: Female\n\nName: none\n\nName: zh-CN-A\nGender: Female\n")
    assert [tuple(r) for r in files.read_voices(spark, at, ["zh-cn"]).collect()] == [("zh-CN-A", "Female"), ("zh-CN-B", "Male")]
    assert files.read_voices(spark, at).count() == 3


def test_sorted_files(spark):
    df = spark.sql("select 'b/a10' as path, 2L as size, timestamp'2024-01-02' as modified union all select 'a/b2', 3L, timestamp'2024-01-01'")
    for by, descending, want in (("size", True, "a/b2"), ("name", False, "b/a10"), ("modified", True, "b/a10"), ("ctime", False, "a/b2")):
        assert files.sorted_files(df, by, descending).first().path == want
    assert files.sorted_files(df, "other").count() == 2


def test_written_batches(spark):
    """One file a batch, its lines in order, whatever partitions the rows come from."""
    at = folder() + "/out"
    rows = [(b, i, f"{b}:{i}") for b in range(5) for i in range(200)]
    random.Random(1).shuffle(rows)
    files.write_batches(spark.createDataFrame(rows, "batch int, ord int, text string").repartition(7), at, "batch", ["ord"])
    for b in range(5):
        (path,) = glob.glob(f"{at}/batch={b}/*.txt")
        assert open(path).read().split("\n")[:-1] == [f"{b}:{i}" for i in range(200)]


def test_written_scripts(spark):
    at = folder() + "/out"
    items = [(s, i, i + 1, f"00:00:0{i},000-00:00:0{i + 1},000", 'p "q"', None, i % 3) for s in ("a", "b") for i in range(3)]
    files.write_scripts(spark.createDataFrame(items, "script_id string, ord int, _id int, timestamp string, picture string, narration string, OST int"), at)
    (path,) = glob.glob(f"{at}/script_id=a/*.txt")
    assert [x["_id"] for x in json.load(open(path))] == [1, 2, 3]
    back = files.read_script(spark, path).orderBy("ord").collect()
    assert [(r._id, r.picture, r.OST) for r in back] == [(1, 'p "q"', 0), (2, 'p "q"', 1), (3, 'p "q"', 2)]


# --- scenes and frames -------------------------------------------------------------------------------------------


def scan(raw, low, high):
    """Scene numbers by a loop over the raw scenes."""
    out = []
    for i, (a, b) in enumerate(raw):
        if b - a < low:
            continue
        if b - a > high:
            number, at = i + len(out) + 1, a
            pieces = []
            while at < b:
                end = min(at + high, b)
                if end - at >= low:
                    pieces.append((number + len(pieces), at, end))
                at = end
            out += pieces
        else:
            out.append((i + 1 + len(out), a, b))
    return out


def test_scene_numbers(spark):
    rng, want, rows = random.Random(4), [], []
    for v in range(20):
        points = [0.0]
        for _ in range(rng.randint(1, 12)):
            points.append(points[-1] + rng.choice([0.5, 1.0, 2.0, 4.5, 8.0, 8.5, 16.0, 17.5, 18.0, 33.0]))
        raw = list(zip(points, points[1:]))
        rows += [(v, i, a, b) for i, (a, b) in enumerate(raw)]
        want += [(v, *s) for s in scan(raw, 2.0, 8.0)]
    got = segmentation.numbered_scenes(spark.createDataFrame(rows, "video_id int, i long, start_time double, end_time double"), 2.0, 8.0).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)


def test_segment_ids(spark):
    r = segmentation.as_segments(spark.sql("select 2 as episode_index, 3L as scene_index, 0.25D as start_time")).first()
    assert r.segment_id == f"ep2_scn3_{0.25:.1f}s"


def test_frames_at(spark):
    """The as-of join against a bisection, over ranges without frames, ties and points before the first frame; without a range join."""
    rng = random.Random(6)
    frames = [(v, rng.randint(0, 999), i) for v in range(4) for i in range(rng.choice([0, 1, 40]))] + [(9, None, 1)]
    points = [(v, rng.randint(-5, 1200), k) for k, v in enumerate(rng.choices(range(6), k=200))]
    f = spark.createDataFrame(frames, "video_id int, frame_no long, x int")
    out = sampling.frames_at(spark.createDataFrame(points, "video_id int, frame_no long, k int"), f, width=64)
    want = set()
    for v, p, k in points:
        known = sorted((n, x) for w, n, x in frames if w == v and n is not None)
        at = bisect.bisect_right([n for n, _ in known], p)
        want.add((v, p, k, *(known[at - 1] if at else (None, None))))
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sampling.frames_at(spark.createDataFrame(points, "video_id int, frame_no long, k int"), f.limit(0)).where("x is not null").count() == 0


def test_grids(spark):
    v = spark.sql("select 1 as video_id, 30.0D as fps, 100000 as total_frames, 0.0D as duration union all select 2, null, 0, 12.5D union all select 3, 0.5D, 3, null")
    got = sampling.frame_grid(v, 2.0).collect()
    assert sorted(r.frame_no for r in got if r.video_id == 1) == list(range(0, 100000, 15))
    assert [r.frame_no for r in got if r.video_id == 3] == [0, 1, 2] and not [r for r in got if r.video_id == 2]
    assert [(r.seconds, r.file_name) for r in sampling.keyframes(v.where("video_id = 2").fillna(24.0, ["fps"]), 5.0).orderBy("seconds").collect()] == [
        (0.0, "keyframe_000000_000000000.jpg"), (5.0, "keyframe_000120_000005000.jpg"), (10.0, "keyframe_000240_000010000.jpg")]


# --- subtitles ---------------------------------------------------------------------------------------------------


def test_assembled_subtitles(spark):
    """A file, a text, nothing, and both formulas, by hand."""
    kind = "job int, rank int, segment_id int, duration double, subtitle_text string"
    segments = spark.createDataFrame([(1, 1, 10, 4.0, None), (1, 2, 11, 3.0, "unused"), (1, 3, 12, 2.0, "a\nb"), (2, 1, 13, 1.0, "")], kind)
    cues = spark.createDataFrame([(11, 0, 0.5, 1.5, "x"), (11, 1, 1.5, 2.0, "y")], "segment_id int, cue_idx int, start double, end double, text string")
    rows = lambda faithful: [tuple(r) for r in timeline.assemble_subtitles(segments, cues, faithful=faithful).orderBy("job", "cue_no").collect()]
    assert rows(False) == [(1, 1, 11, 4.5, 5.5, "x"), (1, 2, 11, 5.5, 6.0, "y"), (1, 3, 12, 7.0, 8.0, "a"), (1, 4, 12, 8.0, 9.0, "b")]
    assert rows(True) == [(1, 1, 11, 0.5, 1.0, "x"), (1, 2, 11, 1.5, 0.5, "y"), (1, 3, 12, 7.5, 1.5, "a"), (1, 4, 12, 8.5, 1.5, "b")]
    assert timeline.assemble_subtitles(segments.limit(0), cues).count() == 0


def test_transcript_is_bounded(spark):
    rows = [(1, e, float(i), "x" * 30) for e in range(1, 4) for i in range(200)] + [(2, 1, 0.5, "y" * 9000), (3, 1, 1.0, "")]
    got = {r.job: r.transcript for r in timeline.transcript(spark.createDataFrame(rows, "job int, episode int, start double, text string"), 500).collect()}
    want = "\n".join(f"[E{e} {i}s]: " + "x" * 30 for e in range(1, 4) for i in range(200))[:500]
    assert got == {1: want, 2: ("[E1 0s]: " + "y" * 9000)[:500]}


def test_context(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 60), (1, 2, ""), (1, 3, "b"), (1, 4, None), (1, 5, "c")], "g int, o int, text string")
    assert [r.context for r in timeline.context_tail(rows, "g", "o").orderBy("o").collect()] == [None, "a" * 50, "a" * 50, "b", "b"]


# --- places ------------------------------------------------------------------------------------------------------


def test_zip(spark):
    rng = random.Random(2)
    left = [(g, rng.randint(-100, 5000)) for g in (None, 1, 2) for _ in range(rng.randint(5, 60))]
    right = [(g, rng.randint(0, 5000), k) for k, g in enumerate(rng.choices([None, 1, 3], k=70))]
    a, b = spark.createDataFrame(left, "g int, o int"), spark.createDataFrame(right, "g int, o int, k int")
    got = [(r.g, r.place, r.o) for r in positions.zip_rows(a, b, "g", "o", width=37).collect()]
    want = []
    for g in (None, 1, 2, 3):
        x, y = sorted(o for h, o in left if h == g), sorted(o for h, o, _ in right if h == g)
        want += [(g, i, o) for i, (o, _) in enumerate(zip(x, y))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_seeded_orders(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 3).alias("g"))
    order = [r.id for r in positions.shuffled(df, "id", 1).collect()]
    assert order == [r.id for r in positions.shuffled(df.repartition(7), "id", 1).collect()] and sorted(order) == list(range(50))
    assert order != [r.id for r in positions.shuffled(df, "id", 2).collect()]
    assert positions.pick_one(df, "id", 1).first().id == order[0]
    assert positions.pick_one(df, "id", 1, wanted=F.lit(7)).first().id == 7
    assert positions.pick_one(df.limit(0), "id").collect() == []
    assert [r.id for r in positions.page(df, [F.col("id").desc()], 2, 20).collect()] == list(range(29, 9, -1))


# --- rules, answers, JSON ----------------------------------------------------------------------------------------


def test_rules_are_rows(spark):
    """A new kind of check needs rows only; the first broken rule by item, then order."""
    more = spark.createDataFrame([("json", 1, None, "a", "present", None, "no_a"), ("json", 2, None, "a", "type", "BIGINT", "a_no_number"), ("json", 3, "xs", "n", "positive", None, "bad_n"), ("json", 4, "ys", "t", "matches", "^k", "bad_t")], rules.RULES)
    given = ['{"a": 1, "xs": [{"n": 1}, {"n": 0}], "ys": [{"t": "k"}]}', '{"a": "1"}', "{}", '{"a": 1, "xs": [5]}', '{"a": 1, "xs": 3, "ys": [{"t": "k"}, {"t": "q"}, {}]}', "[]", None, '{"a": true}']
    answers = spark.createDataFrame([(i, "x", "json", g) for i, g in enumerate(given)], "answer_id int, name string, output_format string, output string")
    got = {r.answer_id: (r.error, r.item) for r in rules.validate(answers, more).collect()}
    assert got == {0: ("bad_n", 2), 1: ("a_no_number", None), 2: ("no_a", None), 3: ("no_object", 1), 4: ("bad_t", 2), 5: ("no_json", None), 6: ("no_json", None), 7: ("a_no_number", None)}
    assert rules.validate(answers.limit(0), more).collect() == []


def test_masked_json(spark):
    row = spark.sql("""select named_struct('b', cast('x' as binary), 'l', array(named_struct('m', map(1, cast('y' as binary), 2, null), 'd', date'2024-01-01'), null), 's', cast(null as struct<z:binary>), 'n', 1.5D, 't', true, 'plain', map('k', array(1))) as v""")
    got = json.loads(row.select(serialize.to_json(F.col("v"), row.schema["v"].dataType).alias("j")).first().j)
    assert got == {"b": serialize.MASK, "l": [{"m": {"1": serialize.MASK, "2": None}, "d": None}, None], "s": None, "n": 1.5, "t": True, "plain": {"k": [1]}}
    for sql in ("cast(null as binary)", "'a\"b'", "3", "array(cast('x' as binary))"):
        row = spark.sql(f"select {sql} as v")
        assert json.loads(row.select(serialize.to_json(F.col("v"), row.schema["v"].dataType).alias("j")).first().j) == {"cast(null as binary)": None, "'a\"b'": 'a"b', "3": 3}.get(sql, [serialize.MASK])


@pytest.mark.parametrize("raw", ["(1, 2)", "{1: 'a'}", "['a', \"b\"]", "1_000", "(1,)", "()", "{'a': {'b': (None, -1.5)}}", "'it\\'s'", "\"say 'x'\"", "['x\"y']", "{True: 1}", "(5)", "[.5, 5., +1]", "-7", "{'a': [1, 2,],}", "[ ]"])
def test_type_recovery_as_written(spark, raw):
    value = ast.literal_eval(raw)
    want = json.loads(json.dumps(value))
    assert json.loads(one(spark, raw, lambda c: F.to_json(text.recover_type(c)))) == want


def test_render_filters(spark):
    values = {"a": F.lit("x$1\\y"), "n": F.lit("${a|upper}")}
    r = lambda t: one(spark, t, lambda c: text.render(c, values))
    assert r("${a|upper}-${ a | title }") == "X$1\\Y-X$1\\Y" and r("${n}") == "X$1\\Y"
    assert r("${n|lower}") == "${a|upper}" and r("${b|upper}${a|b}") == "${b|upper}${a|b}" and r("") == "" and r("$a|") == "x$1\\y|"
    assert one(spark, "${a} ${ b |x} $c ${a|y}", text.variables) == ["a", "b"]
    assert one(spark, "${a}${z}", lambda c: text.missing_values(c, values)) == ["z"]


def test_entities_and_blanks(spark):
    from xml.sax.saxutils import unescape

    for raw in ("&lt;&quot;&nbsp;&amp;lt;&gt;", escape("<a & 'b'>"), ""):
        assert one(spark, raw, text.unescape_xml) == unescape(raw)
    for raw in ("```json\nx\n```", "`son`", "json", "", "a json"):
        assert one(spark, raw, text.strip_signs) == raw.strip("```json").strip("```").strip()


# --- scores ------------------------------------------------------------------------------------------------------


def test_fallbacks_of_scores(spark):
    kind = "segment_id int, start_time double, end_time double, duration double, audio_path string, subtitle_text string, video_path string"
    segments = spark.createDataFrame([(1, 0.0, 4.0, 4.0, None, None, None), (2, 1.0, 5.0, 4.0, "a", "t", "v"), (3, None, None, 4.0, "", "", "")], kind)
    got = {r.segment_id: r for r in highlights.score_segments(segments).collect()}
    assert (got[1].audio_score, got[1].emotion_score, got[1].visual_score) == (0.45, 0.1, 0.2)
    assert (got[2].audio_score, got[2].emotion_score, got[2].visual_score) == (0.3, 0.2, 0.3)
    assert got[3].rhythm_score == one(spark, 4.0, scoring.rhythm_default, "double") and not got[3].has_face
    assert one(spark, None, scoring.rhythm_default, "double") == 0.2
    row = spark.sql("select 1 as drama_id, 2 as rank, 3 as episode_index, 0.12345D as total_score, 1.25D as start_time, 2.0D as duration, true as closeup, false as has_face, 0.7D as audio_score, 0.1D as emotion_score, 0.1D as visual_score, cast(null as string) as subtitle_text")
    assert tuple(highlights.shown(row).first()) == (1, 2, 3, 0.123, 1.2, 2.0, "特写, 音频爆点")


# --- small rules -------------------------------------------------------------------------------------------------


def test_script_choices(spark):
    found = spark.sql("select 'a.json' as path, timestamp'2024-01-01' as modified union all select 'b.json', timestamp'2024-01-02'")
    rows = lambda current: [(r.path, r.selected) for r in records.script_choices(found, current).collect()]
    assert rows("a.json") == [("", False), ("upload_script", False), ("b.json", False), ("a.json", True)]
    assert rows("gone")[0] == ("", True) and rows("")[0] == ("", True)


def test_edit_order(spark):
    items = spark.createDataFrame([(1, "00:00:09-00:00:10"), (2, None), (3, "00:00:01,500-00:00:02"), (4, "bad")], "_id int, editedTimeRange string")
    assert [r._id for r in records.by_edit_start(items).collect()] == [2, 4, 3, 1]


def test_latest_progress(spark):
    """The streaming state of tasks after two batches of files."""
    from scenemill.streaming import latest_progress

    at, kind = folder(), "task_id string, seq long, state string, progress double"
    spark.createDataFrame([("a", 1, "run", 0.1), ("b", 1, "run", 0.2)], kind).write.parquet(f"{at}/in/1")
    spark.createDataFrame([("a", 2, "done", 1.0)], kind).write.parquet(f"{at}/in/2")
    stream = spark.readStream.schema(kind).parquet(f"{at}/in/*")
    q = latest_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", f"{at}/c").start()
    try:
        q.processAllAvailable()
        got = {r.task_id: r.asDict() for r in spark.sql("select * from progress").collect()}
    finally:
        q.stop()
    assert set(got) == {"a", "b"} and "done" in str(got["a"]) and os.path.isdir(at)


def test_one_line_cues(spark):
    df = spark.createDataFrame([(0, " a\nb "), (1, "\n"), (2, None)], "n int, text string")
    assert [(r.n, r.text) for r in files.one_line_cues(df).collect()] == [(0, "a b")]


def test_catalogue(spark):
    at = folder()
    for name in ("b.TTF", "sub/a.otf", "c.mp3", "x.mp4", "y.mkv", "z.txt"):
        os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
        with open(f"{at}/{name}", "w") as f:
            f.write("x")
    names = lambda kind: [r.name for r in files.catalogue(spark, at, kind).collect()]
    assert names("fonts") == ["a.otf", "b.TTF"] and names("songs") == ["c.mp3"] and names("videos") == ["y.mkv", "x.mp4"]


def test_stock_answers(spark):
    from scenemill.sources import stock

    rows = spark.createDataFrame([("t", '{"videos": [{"duration": 9, "video_files": [{"width": 1, "height": 2, "link": "u"}]}]}'), ("s", '{"videos": [{"duration": 8, "video_files": [{"width": 1, "height": 2, "link": "u"}, {"width": 1, "height": 2, "link": "w"}]}]}'), ("x", "no"), ("y", None)], "term string, body string")
    found = stock.exact_renditions(rows, 1, 2, 5)
    assert sorted(tuple(r) for r in found.collect()) == [("s", 0, "u", 8.0), ("t", 0, "u", 9.0)]
    assert [tuple(r) for r in stock.new_materials(found).collect()] == [("u", "s", 0, 8.0)]
