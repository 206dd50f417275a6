"""Answers, scripts, joins and times in the forms that go wrong easily."""

import pytest
from pyspark.sql import functions as F

from scenemill.functions import scoring, text, timecode
from scenemill.operators import catalog, rules, sampling, timeline
from scenemill.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw", ['{"k": 1}', '{{"k": 1}}', '{"k": 1, # note\n}', "{k: 1}", "{'k': 1}", 'so: ```json\n{"k": 1}\n``` ok', 'a {"k": 1} b', '{"k": 1,}'])
def test_parse_json(spark, raw):
    assert one(spark, raw, lambda c: text.parse_json(c, "struct<k:int>")["k"]) == 1


def test_answers(spark):
    assert one(spark, "no", lambda c: text.parse_json(c, "struct<k:int>")) is None
    assert one(spark, "x" * 120, text.placeholder_item).narration == "x" * 100 + "..."
    item = "struct<t:int>"
    for raw, want in (('```json\n{"clips": [{"t": 1}]}\n```', [1]), ('[{"t": 2}]', [2]), ('{"a": 1, "b": [{"t": 3}]}', [3]), ('{"a": 1}', None), ("5", None)):
        got = one(spark, raw, lambda c: text.clip_list(c, item))
        assert (got and [r.t for r in got]) == want
    for raw, want in (('["a", "b"]', ["a", "b"]), ('terms: ["c"] ok', ["c"]), ("[1, 2]", None), ("none", None)):
        assert one(spark, raw, text.string_list) == want
    log = 'noise\n{\n"input_i": "-20.1"\n}\nmore'
    assert one(spark, log, lambda c: F.try_variant_get(text.loudness_report(c), "$.input_i", "string")) == "-20.1"
    assert one(spark, "&lt;a&gt; &amp;lt;", text.unescape_xml) == "<a> &lt;"
    segments = spark.createDataFrame([("", ["a", "b"], "raw"), ("w", ["a"], "raw"), (None, [], "raw")], "w string, s array<string>, r string")
    got = segments.select(text.full_text(F.col("w"), F.transform("s", lambda t: F.struct(t.alias("text"))), F.col("r")).alias("t")).collect()
    assert [r.t for r in got] == ["a b", "w", "raw"]
    plot = spark.sql("select named_struct('summary', repeat('x', 600), 'key_moments', array('a'), 'characters', cast(null as array<string>), 'main_conflict', cast(null as string), 'tags', array('t'), 'tone', 'dark', 'target_audience', cast(null as string)) as p")
    r = plot.select(text.plot_result(F.col("p")).alias("r")).first().r
    assert len(r.summary) == 500 and r.characters == [] and r.main_conflict == "" and r.tone == "dark"


@pytest.mark.parametrize("raw, want", [("they're bill's", "They'Re Bill'S"), ("ÉCOLE 2b中x", "École 2B中X"), ("", "")])
def test_title_filter(spark, raw, want):
    assert raw.title() == want
    assert one(spark, raw, text.FILTERS["title"]) == want


def test_other_filters(spark):
    assert one(spark, " \u3000a b\n ", text.FILTERS["strip"]) == "a b"
    assert one(spark, "x" * 100, text.FILTERS["truncate"]) == "x" * 100
    assert one(spark, "x" * 101, text.FILTERS["truncate"]) == "x" * 100 + "..."
    assert one(spark, 'é"\n', text.FILTERS["json"]) == '"é\\"\\n"'
    assert one(spark, None, text.FILTERS["json"]) == "null"


@pytest.mark.parametrize("raw, want", [
    ("12", "12"), ("007", "7"), ("-1.5", "-1.5"), ("True", "true"), ("None", "null"), ("true", '"true"'), ("[true]", '"[true]"'), ("'a'", '"a"'),
    ("[1, 'a', False]", '[1,"a",false]'), ('{"a": "None, true"}', '{"a":"None, true"}'), ("it's", '"it\'s"'), ("", '""'), (None, None),
])
def test_type_recovery(spark, raw, want):
    assert one(spark, raw, lambda c: F.to_json(text.recover_type(c))) == want


def test_prompt_export_and_plot_script(spark):
    kind = "category string, name string, version string, description string"
    rows = spark.createDataFrame([("c", "n", "2", "b"), ("c", "n", "1", "a"), ("c", "n", "1", "A"), ("c", "m", "1", None), ("c", None, "1", "x")], kind)
    assert catalog.export(rows).first().prompts == {"m": {"1": None}, "n": {"1": "a", "2": "b"}}
    assert catalog.export(rows.limit(0)).count() == 0
    plots = spark.sql("select 1 as script_id, array(named_struct('timestamp', 't', 'picture', 'p'), named_struct('timestamp', 'u', 'picture', null)) as plot_points union all select 2, null")
    got = timeline.plot_script(plots).collect()
    assert [(r.script_id, r._id, r.timestamp, r.picture, r.OST) for r in got] == [(1, 1, "t", "p", 1), (1, 2, "u", None, 1)]
    assert got[0].narration != got[1].narration


def test_script_text(spark):
    good = '{"_id": 1, "timestamp": "00:00:01,000-00:00:02,000", "picture": "p", "narration": "n", "OST": 1}'
    cases = {
        "{": (None, "no_json"), "{}": (None, "no_list"), "[]": (None, "empty_list"), "[1]": (1, "no_object"), f"[{good}]": (None, None),
        f'[{good}, {{"_id": 1}}]': (2, "no_timestamp"), "[" + good.replace('"_id": 1', '"_id": 0') + "]": (1, "bad__id"), "[" + good.replace('"_id": 1', '"_id": "1"') + "]": (1, "bad__id"),
        "[" + good.replace("01,000", "01") + "]": (1, "bad_timestamp"), "[" + good.replace('"p"', '" "') + "]": (1, "bad_picture"), "[" + good.replace('"n"', "null") + "]": (1, "bad_narration"),
        "[" + good.replace('"OST": 1', '"OST": 1.5') + "]": (1, "bad_OST"),
    }
    for raw, want in cases.items():
        assert tuple(one(spark, raw, catalog.check_script_text)) == want, raw


def test_times(spark):
    assert [one(spark, t, timecode.range_duration) for t in ("01:00-02:00", "00:00:01,5-00:00:03", "a-b", "00:00:01")] == [0.0, 1.5, 0.0, 0.0]
    names = ("vid-00-00-00-00-00-20.mp4", "vid_00-00-00-000@00-00-20-250.mp4", "clip.mp4")
    assert [one(spark, n, timecode.file_range) for n in names] == ["00:00:00-00:00:20", "00:00:00,000-00:00:20,250", None]
    assert one(spark, "1:02:03.4567", timecode.ticks) == 37234560000 - 37234560000 % 10000 and one(spark, "x", timecode.ticks) is None
    assert [one(spark, t, timecode.relaxed) for t in ("00:01:02,500", "01:02", "7", "x")] == [62.5, 62.0, 7.0, 0.0]


def test_media_joins(spark):
    items = spark.createDataFrame([(1, "a"), (0, "b"), (3, "c")], "_id int, timestamp string")
    media = spark.createDataFrame([(1, "x", "z.mp4", 1), (1, "x", "a.mp4", 2), (0, "q", "zero.mp4", 3), (None, "b", "by_time.mp4", 4)], "_id int, timestamp string, path string, ord int")
    assert {r._id: r.path for r in timeline.attach_media(items, media).collect()} == {1: "a.mp4", 0: "by_time.mp4", 3: None}
    episodes = spark.createDataFrame([(0, "e0"), (1, "e1")], "ordinal int, path string")
    script = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, -1)], "_id int, episode int")
    assert {r._id: (r.path, r.rejected) for r in timeline.attach_episodes(script, episodes).collect()} == {1: ("e0", False), 2: ("e1", False), 3: (None, True), 4: (None, True)}
    videos = spark.createDataFrame([("j", 0, 2.0, False), ("j", 1, 3.0, True), ("j", 2, 1.0, True)], "job string, index int, duration double, keep_audio boolean")
    audio = spark.createDataFrame([("j", 1, "one", 1), ("j", 1, "two", 0)], "job string, index int, path string, ord int")
    assert [(r["index"], r.start, r.file) for r in timeline.audio_starts(videos, audio).collect()] == [(1, 2.0, "two")]
    stamps = spark.createDataFrame([("s", 1, "00:00:01,000-00:00:02,500", ""), ("s", 2, "01:00-01:05", "n")], "script_id string, ord int, timestamp string, narration string")
    assert [r.new_timestamp for r in timeline.new_timestamps(stamps).orderBy("ord").collect()] == ["00:00:00,000-00:00:01,500", "00:00:01,500-00:00:06,500"]
    tagged = timeline.new_timestamps(stamps, minutes=True).orderBy("ord").collect()
    assert tagged[0].narration.startswith("原声播放_") and tagged[1].narration == "n" and tagged[1].new_timestamp == "00:01-00:06"
    words = spark.createDataFrame([("c", 1, 0, 5_000_000), ("c", 2, 6_000_000, 4_000_000)], "clip string, ord int, start long, end long")
    assert [r.duration for r in timeline.word_events(words).orderBy("ord").collect()] == [5_000_000, 0] and timeline.speech_length(words).first().seconds == 0.4


@pytest.mark.parametrize("name", files.ENCODINGS)
def test_encodings(spark, name):
    cue = "1\n00:00:01,000 --> 00:00:02,000\n你好\n"
    got = files.decode_subtitles(spark.createDataFrame([(bytearray(cue.encode(name)),)], "content binary")).first().text
    assert "00:00:01,000 --> 00:00:02,000" in got and "你好" in got


def test_score_defaults(spark):
    rows = spark.createDataFrame([(None, None), ("t", None), ("t", 0.7)], "t string, s double")
    got = rows.select(scoring.emotion_or_default(F.col("s"), F.col("t")).alias("e"), scoring.visual_or_default(F.col("s"), F.col("t")).alias("v"), scoring.audio_or_default(F.col("s"), F.col("t"), F.lit(0.4)).alias("a")).collect()
    assert [tuple(r) for r in got] == [(0.1, 0.2, 0.4), (0.2, 0.3, 0.3), (0.7, 0.7, 0.7)]
    assert [one(spark, "x" * 10, lambda c, k=k: scoring.cue_milliseconds(c, k)) for k in ("floor_800", "plain", "floor_1000")] == [1800, 2000, 2000]


def test_points_are_dealt(spark):
    """The points of one small file of videos are made in many tasks, in keyframes and in frame grids."""
    videos = spark.range(0, 40, 1, 1).selectExpr("id as video_id", "25.0 as fps", "20000.5D as duration", "500000 as total_frames")
    for made in (sampling.keyframes(videos, 2.5), sampling.frame_grid(videos)):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_digits(spark):
    rows = spark.createDataFrame([(0,), (7,), (99,), (100,), (12345,), (-3,), (None,)], "n long")
    got = rows.select(timecode.digits(F.col("n"), 2).alias("a"), F.format_string("%02d", "n").alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_new_timestamps_cut_codes_once(spark):
    """However often a length is used, each code is cut and cast once; what a formatter prints stays."""
    items = spark.createDataFrame([(1, 1, "00:01-00:02,250"), (1, 2, "99:59:58-100:00:00"), (1, 3, "00:00-99:59:59")], "script_id int, ord int, timestamp string")
    made = timeline.new_timestamps(items)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
    assert [r.new_timestamp for r in made.orderBy("ord").collect()] == ["00:00:00,000-00:00:01,250", "00:00:01,250-00:00:03,250", "00:00:03,250-100:00:02,250"]
    codes = spark.createDataFrame([(0.0,), (59.999,), (359999.999,), (360000.0,), (6000.0,), (-1.5,), (None,)], "s double")
    shown = codes.select(timecode.to_srt(F.col("s")).alias("a"), timecode.to_minutes(F.col("s")).alias("b")).collect()
    assert [r.a for r in shown[:4]] == ["00:00:00,000", "00:00:59,999", "99:59:59,999", "100:00:00,000"] and [r.b for r in shown[1:5]] == ["00:59", "5999:59", "6000:00", "100:00"]


def test_answers_are_not_dealt_by_kind(spark):
    """Answers of one kind stay in many tasks: rules are broadcast, and only keys are dealt."""
    answers = spark.range(0, 20, 1, 2).selectExpr("id as answer_id", "'narration' as name", "'json' as output_format", "'{\"items\": []}' as output")
    made = rules.validate(answers, rules.default_rules(spark))
    assert "SortMergeJoin [kind" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.error, r.item) for r in made.collect()} == {("empty_items", None)}
