"""Worked cases of column functions that the oracles do not reach."""

from pyspark.sql import functions as F

from scenemill.functions import checks, media
from scenemill.operators import emotion, features, reports


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_largest_face(spark):
    faces = F.from_json(F.lit('[{"x":0,"y":0,"w":10,"h":10},{"x":40,"y":20,"w":40,"h":40}]'), "array<struct<x:int,y:int,w:int,h:int>>")
    r = one(spark, f=media.largest_face(faces, F.lit(100), F.lit(100)), none=media.largest_face(F.slice(faces, 1, 0), F.lit(100), F.lit(100)))
    assert (r.f.size_ratio, r.f.center_x, r.f.center_y, r.f.is_closeup) == (0.16, 0.6, 0.4, True)
    assert r.none is None


def test_media(spark):
    r = one(
        spark, rate=media.frame_rate(F.lit("30000/1001")), bad=media.frame_rate(F.lit("1/0")), plain=media.frame_rate(F.lit("25")), none=media.loops(F.lit(3.0), F.lit(0.0)),
        top=media.subtitle_y_fixed(F.lit("top"), F.lit(1000), F.lit(30)), share=media.subtitle_y_fixed(F.lit("0.5"), F.lit(1000), F.lit(30)), low=media.subtitle_y_fixed(F.lit("?"), F.lit(1000), F.lit(30)),
        pitch=media.signed_change(F.lit(0.875), "Hz"), same=media.signed_change(F.lit(1.0)),
    )
    assert abs(r.rate - 29.97002997) < 1e-6 and r.bad is None and r.plain == 25 and r.none is None
    assert (r.top, r.share, r.low, r.pitch, r.same) == (50, 500, 920, "-12Hz", "+0%")


def test_checks(spark):
    r = one(
        spark, blank=checks.analysis(F.lit(" ")), short=checks.analysis(F.lit("剧情")), odd=checks.analysis(F.repeat(F.lit("a"), 60)), good=checks.analysis(F.repeat(F.lit("角色"), 30)),
        key=checks.api_key(F.lit("abc")), url=checks.base_url(F.lit("ftp://x")), no_url=checks.base_url(F.lit("")), voice=checks.is_voice_name(F.lit("zh-CN-YunzeNeural")), not_voice=checks.is_voice_name(F.lit(None).cast("string")),
        kept=checks.chosen_option(F.lit(0.4), F.lit(0.3), F.lit(0.9)), advised=checks.chosen_option(F.lit(0.3), F.lit(0.3), F.lit(0.9)),
        back=checks.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))),
        force=checks.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9")), True),
        nothing=checks.missing_fields(F.lit("no json"), ["a"]),
    )
    assert (r.blank, r.short, r.odd, r.good) == ("empty_analysis", "analysis_too_short", "warning_no_keyword", None)
    assert (r.key, r.url, r.no_url, r.voice, r.not_voice, r.kept, r.advised) == ("too_short", "no_scheme", None, True, False, 0.4, 0.9)
    assert r.back == {"a": "9", "b": "2"} and r.force == {"a": "1", "b": "2"} and r.nothing is None


def test_emotion_words(spark):
    rows = [("恨 你竟然", ["恨", "你竟然"]), ("", []), (None, None)]
    df = spark.createDataFrame(rows, "text string, words array<string>")
    a, b, c = emotion.emotion_scores(df, words_col="words").collect()
    assert a.matched == ["你竟然(conflict)", "竟然(conflict)", "恨(conflict)", "恨(emotion)"] and a.density_score == 1.0
    assert b.emotion_score == c.emotion_score == 0.0 and c.matched == []
    plain = emotion.emotion_scores(df).first()
    assert plain.matched == ["你竟然(conflict)", "竟然(conflict)"] and plain.density_score == plain.keyword_score


def test_video_without_frames(spark):
    frames = spark.createDataFrame([], "video_id long, frame_idx int, face_count int, is_closeup boolean, center_x double, center_y double, edge_density double, sharpness double")
    r = features.visual_scores(frames, spark.range(1).toDF("video_id")).first()
    assert abs(r.visual_score - 0.17) < 1e-9 and not r.has_face


def test_pick_prompts(spark):
    prompts = spark.createDataFrame([("a", "x", "v1", 1), ("a", "x", "v2", 2)], "category string, name string, version string, id int")
    wanted = spark.createDataFrame([("a", "x", None), ("a", "x", "v1"), ("a", "y", None)], "category string, name string, version string")
    assert sorted((r.name, r.version or "", r.id or 0) for r in reports.pick_prompts(wanted, prompts).collect()) == [("x", "v1", 1), ("x", "v2", 2), ("y", "", 0)]


def test_similarity_of_whole_texts(spark, tmp_path):
    from scenemill.queries import QUERIES

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    texts = ["a" * 50 + "été", "a" * 50 + "âtà und mehr", "A" * 45 + "日本語", "short"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.a: r.likeness for r in QUERIES["levenshtein_similarity_whole"](spark, str(tmp_path)).collect()}
    for i, (x, y) in enumerate(zip(texts, texts[1:])):
        assert abs(got[i] - (1 - distance(x.lower(), y.lower()) / max(len(x), len(y)))) < 1e-4
