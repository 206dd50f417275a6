"""Registered queries of the highlight operators and their SQL oracles, on carrier views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import checks, lexicon, media, scoring, text, timecode
from .operators import catalog, emotion, features, matching, reports, segmentation, selection, timeline
from .plans import highlights
from .sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- carrier views -----------------------------------------------------------------------------------------------


def segments(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    ts = F.col("ts")
    seconds = F.datediff(F.to_date(ts), F.lit("1970-01-01")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return e.select(
        (F.col("user_id") % 10).alias("drama_id"), (F.col("user_id") % 7 + 1).cast("int").alias("episode_index"), F.col("event_id").alias("ord"),
        seconds.cast("double").alias("start_time"), (F.lit(1.0) + (F.col("event_id") % 29) / 4.0).alias("duration"),
        (((F.col("event_id") * 37) % 1001) / 1000.0).alias("total_score_raw"),
    ).withColumn("total_score", F.round("total_score_raw", 4))


SEG = """seg AS (SELECT user_id % 10 AS drama_id, CAST(user_id % 7 + 1 AS INTEGER) AS episode_index, event_id AS ord,
  CAST(floor(epoch(ts)) AS DOUBLE) AS start_time, 1.0::DOUBLE + (event_id % 29) / 4.0::DOUBLE AS duration,
  ((event_id * 37) % 1001) / 1000.0::DOUBLE AS total_score_raw FROM events)"""


def _chosen(ratio: float, min_d: float, m: int, target: str) -> str:
    return f"""{SEG}, a AS (SELECT *, row_number() OVER (PARTITION BY drama_id ORDER BY total_score_raw DESC, ord) <=
  greatest(1, CAST(floor(count(*) OVER (PARTITION BY drama_id) * {ratio}::DOUBLE) AS BIGINT)) AS top,
  row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY total_score_raw DESC, ord) AS er FROM seg WHERE duration >= {min_d}),
b AS (SELECT *, sum(CAST(top AS INTEGER)) OVER (PARTITION BY drama_id, episode_index) AS c FROM a),
cov AS (SELECT *, CASE WHEN top THEN 0 WHEN c = 0 AND er = 1 THEN 1 ELSE 2 END AS ph FROM b WHERE er <= greatest(c, 1, {m})),
cu AS (SELECT *, sum(duration) OVER (PARTITION BY drama_id ORDER BY total_score_raw DESC, ph, episode_index, er ROWS UNBOUNDED PRECEDING) AS cum FROM cov),
fit AS (SELECT * FROM cu WHERE {target}),
fin AS (SELECT *, row_number() OVER (PARTITION BY drama_id ORDER BY episode_index, start_time, ord) AS rnk FROM fit)"""


_ALL = "TRUE"
_T30 = "cum - duration < 0.95 * 30 AND NOT (cum - duration >= 0.70 * 30 AND cum > 1.30 * 30)"
_T30M = _chosen(0.3, 2, 2, _T30)
_PLAIN = _chosen(0.3, 2, 1, _ALL)


def _selected(spark: SparkSession, sf: str, m: int = 1, target: float | None = None) -> DataFrame:
    return selection.select_highlights(segments(spark, sf), 0.3, 2.0, m, target)


# --- selection and order -----------------------------------------------------------------------------------------


@query(f"WITH {_T30M} SELECT drama_id, episode_index, ord, start_time, duration, total_score_raw, CAST(rnk AS INTEGER) AS rank FROM fin")
def highlight_select(spark, sf):
    return _selected(spark, sf, 2, 30.0).select("drama_id", "episode_index", "ord", "start_time", "duration", "total_score_raw", "rank")


@query(f"WITH {_PLAIN} SELECT drama_id, episode_index, ord FROM a WHERE top")
def highlight_top_ratio(spark, sf):
    return selection.rank_top(selection.long_enough(segments(spark, sf))).where("top").select("drama_id", "episode_index", "ord")


@query(f"WITH {_chosen(0.05, 2, 3, _ALL)} SELECT drama_id, episode_index, ord, CAST(er AS INTEGER) AS ep_rank, ph AS phase FROM cov")
def episode_coverage(spark, sf):
    ranked = selection.rank_top(selection.long_enough(segments(spark, sf)), 0.05)
    return selection.cover_episodes(ranked, 3).select("drama_id", "episode_index", "ord", "ep_rank", "phase")


@query(f"WITH {_T30M} SELECT drama_id, count(*) AS n, sum(duration) AS total FROM fit GROUP BY drama_id")
def fit_duration(spark, sf):
    return _selected(spark, sf, 2, 30.0).groupBy("drama_id").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


@query(f"WITH {SEG} SELECT ord, duration FROM seg WHERE duration >= 2")
def min_duration_filter(spark, sf):
    return selection.long_enough(segments(spark, sf)).select("ord", "duration")


_RAMP = f"""{_T30M}, r0 AS (SELECT drama_id, episode_index, ord, start_time, duration, round(total_score_raw, 4) AS ts, total_score_raw FROM fin),
r1 AS (SELECT *, count(*) OVER (PARTITION BY drama_id) AS n, count(*) OVER (PARTITION BY drama_id, episode_index) AS ne,
 first_value(start_time) OVER w AS lo, last_value(start_time) OVER w AS hi,
 row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY ts, start_time, ord) AS ps,
 row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY start_time, ord) AS pt FROM r0
 WINDOW w AS (PARTITION BY drama_id, episode_index ORDER BY ts, start_time, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ramp AS (SELECT *, row_number() OVER (PARTITION BY drama_id ORDER BY episode_index,
 CASE WHEN n > 2 AND ne > 2 AND abs(lo - hi) <= 30 THEN ps ELSE pt END) AS rnk FROM r1)"""


@query(f"WITH {_RAMP} SELECT drama_id, episode_index, ord, CAST(rnk AS INTEGER) AS rank FROM ramp")
def emotion_ramp_sort(spark, sf):
    return selection.emotion_ramp(_selected(spark, sf, 2, 30.0)).select("drama_id", "episode_index", "ord", "rank")


@query(f"""WITH {_RAMP}, l AS (SELECT *, lag(episode_index) OVER w AS e, lag(start_time) OVER w AS s, lag(ts) OVER w AS v FROM ramp
 WINDOW w AS (PARTITION BY drama_id ORDER BY rnk)), g AS (SELECT drama_id, count(*) AS c, count_if(e > episode_index) AS inv, count_if(e = episode_index) AS chk,
 count_if(e = episode_index AND s > start_time) AS err, count_if(ts > v) AS inc, count_if(ts < v) AS dec_, avg(duration) AS mu, stddev_pop(duration) AS sd, sum(duration) AS tot, avg(ts) AS mean FROM l GROUP BY drama_id)
SELECT drama_id, CASE WHEN c < 2 THEN 'too_few_segments' ELSE 'ok' END AS status, c AS segment_count, round(1.0::DOUBLE - inv::DOUBLE / greatest(1, c - 1), 3) AS episode_continuity,
 round(1.0::DOUBLE - err::DOUBLE / greatest(1, chk), 3) AS temporal_order, CASE WHEN inc >= dec_ THEN 'rising' WHEN dec_ > inc * 1.5 THEN 'falling' ELSE 'stable' END AS emotion_trend,
 round(inc::DOUBLE / greatest(1, c - 1), 3) AS trend_ratio, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - sd / mu), 3) AS rhythm_balance, round(mu, 2) AS avg_duration, round(sd, 2) AS duration_std,
 round(tot, 1) AS total_duration, round(mean, 3) AS avg_score FROM g""")
def sorting_quality(spark, sf):
    return selection.ordering_quality(selection.emotion_ramp(_selected(spark, sf, 2, 30.0))).drop("score_range")


@query(f"""WITH {_PLAIN}, n AS (SELECT drama_id, count(*) AS total_segments FROM seg GROUP BY 1), s AS (SELECT drama_id, count(*) AS k, count(DISTINCT episode_index) AS e, sum(duration) AS d,
 round(avg(total_score_raw), 4) AS a, max(total_score_raw) AS hi, min(total_score_raw) AS lo FROM fin GROUP BY 1)
SELECT n.drama_id, total_segments, coalesce(k, 0) AS selected_segments, coalesce(e, 0) AS episodes, coalesce(d, 0) AS total_duration, coalesce(a, 0) AS avg_score, coalesce(hi, 0) AS max_score,
 coalesce(lo, 0) AS min_score, round(coalesce(k, 0)::DOUBLE / total_segments, 4) AS selected_ratio FROM n LEFT JOIN s USING (drama_id)""")
def selection_stats(spark, sf):
    return selection.selection_stats(segments(spark, sf), _selected(spark, sf))


@query(f"WITH {_PLAIN} SELECT drama_id, count(*) AS segment_count, round(sum(duration), 1) AS total_duration, count(DISTINCT episode_index) AS episode_count, round(avg(total_score_raw), 3) AS avg_score FROM fin GROUP BY 1")
def result_summary(spark, sf):
    return selection.result_summary(_selected(spark, sf))


@query(f"WITH {SEG} SELECT drama_id, arg_min(ord, (-total_score_raw, ord)) AS ord FROM seg GROUP BY 1")
def cover_segment(spark, sf):
    return selection.best_segment(segments(spark, sf)).select("drama_id", "ord")


# --- scores ------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_discount * 8 * 0.4 + l_tax * 10 * 0.3 + l_quantity / 50.0::DOUBLE * 0.2 + l_discount * 0.1)), 4) AS total_score FROM lineitem""")
def weighted_total(spark, sf):
    li = _read(spark, sf, "lineitem").withColumns({"audio_score": F.col("l_discount") * 8, "emotion_score": F.col("l_tax") * 10, "visual_score": F.col("l_quantity") / 50.0, "rhythm_score": F.col("l_discount")})
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.weighted_total(), 4).alias("total_score"))


_FIT = "CASE WHEN d < 0.5 THEN 0.05::DOUBLE WHEN d < 2 THEN 0.3 + 0.5 * d / 2.0::DOUBLE WHEN d <= 6 THEN greatest(0.7::DOUBLE, 1.0 - 0.3 * abs(d - 4) / 2.0::DOUBLE) ELSE greatest(0.3::DOUBLE, 0.8 - (d - 6) / 15.0::DOUBLE) END"


@query(f"""WITH {SEG}, x AS (SELECT ord, duration AS d, (ord % 100) * 1.25::DOUBLE AS s, 130.0::DOUBLE AS e FROM seg), y AS (SELECT *, s / e AS r FROM x)
SELECT ord, round(0.4 * ({_FIT}) + 0.3 * (CASE WHEN r < 0.10 THEN 0.75::DOUBLE WHEN r < 0.25 THEN 0.55 + 0.2 * (r / 0.25::DOUBLE) WHEN r < 0.50 THEN 0.70 + 0.15 * ((r - 0.25) / 0.25::DOUBLE)
 WHEN r < 0.75 THEN 0.85 + 0.12 * ((r - 0.50) / 0.25::DOUBLE) WHEN r < 0.90 THEN 0.90 + 0.05 * ((r - 0.75) / 0.15::DOUBLE) ELSE 0.80 END)
 + 0.2 * (0.8 * CASE WHEN d < 2 THEN 0.9::DOUBLE WHEN d < 4 THEN 0.7 WHEN d < 6 THEN 0.5 ELSE 0.3 END + 0.2 * (0.85 + CASE WHEN s % 1 < 0.3 OR s % 1 > 0.7 THEN 0.15 ELSE 0.0 END))
 + 0.1 * CASE WHEN s >= 0.5 AND e - (s + d) >= 0.5 THEN 1.0::DOUBLE WHEN s >= 0.5 OR e - (s + d) >= 0.5 THEN 0.6 ELSE 0.3 END, 6) AS rhythm_score FROM y""")
def rhythm_score(spark, sf):
    s = segments(spark, sf).select("ord", "duration", ((F.col("ord") % 100) * 1.25).alias("s"))
    return s.select("ord", scoring.rhythm_total(F.col("duration"), F.col("s"), F.lit(130.0), 6).alias("rhythm_score"))


@query(f"WITH {SEG} SELECT ord, CASE WHEN duration BETWEEN 2 AND 5 THEN 0.45::DOUBLE WHEN duration BETWEEN 1 AND 8 THEN 0.30 ELSE 0.15 END AS audio_score FROM seg")
def audio_default_score(spark, sf):
    return segments(spark, sf).select("ord", scoring.audio_default(F.col("duration")).alias("audio_score"))


def _audio_frames(spark, sf):
    e = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("segment_id"), F.posexplode("embedding").alias("frame_idx", "x"))
    x = F.col("x").cast("double")
    return e.select("segment_id", "frame_idx", F.abs(x).alias("rms"), (x * 20.0 - 10.0).alias("rms_db"), (F.abs(x) / 10.0).alias("zcr"), (F.abs(x) * 4000.0).alias("centroid"))


@query("""WITH f AS (SELECT vec_id AS segment_id, i - 1 AS k, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), w AS (SELECT *, abs(abs(x) - lag(abs(x)) OVER (PARTITION BY segment_id ORDER BY k)) AS d FROM f),
g AS (SELECT segment_id, count(*) AS n, avg(CASE WHEN x * 20.0::DOUBLE - 10.0::DOUBLE > -10 THEN 1.0::DOUBLE ELSE 0 END) AS loud, max(x * 20.0::DOUBLE - 10.0::DOUBLE) AS mx, avg(d) AS dm, max(d) AS dx, stddev_pop(d) AS ds, max(abs(x)) AS hi, min(abs(x)) AS lo,
 avg(abs(x) / 10.0::DOUBLE) AS zm, stddev_pop(abs(x) / 10.0::DOUBLE) AS zs, avg(abs(x) * 4000.0::DOUBLE) AS cm, stddev_pop(abs(x) * 4000.0::DOUBLE) AS cs FROM w GROUP BY 1)
SELECT segment_id, n, round(greatest(0, least(1.0::DOUBLE, 0.30 * (0.6 * least(1.0::DOUBLE, (mx + 80) / 80.0::DOUBLE) + 0.4 * least(1.0::DOUBLE, 5 * loud)) + 0.25 * (CASE WHEN n < 2 THEN 0 ELSE 0.5 * CASE WHEN ds > 0 THEN least(1.0::DOUBLE, 2 * dm / ds) ELSE 0 END + 0.5 * least(1.0::DOUBLE, 5 * dx) END)
 + 0.20 * CASE WHEN hi > 0 THEN least(1.0::DOUBLE, 2 * (hi - lo) / hi) ELSE 0 END + 0.15 * (0.7 * least(1.0::DOUBLE, zm / 0.15::DOUBLE) + 0.3 * least(1.0::DOUBLE, zs / 0.05::DOUBLE)) + 0.10 * (0.6 * least(1.0::DOUBLE, cm / 5512.5::DOUBLE) + 0.4 * least(1.0::DOUBLE, cs / 1000.0::DOUBLE)))), 4) AS audio_score FROM g""")
def audio_score_agg(spark, sf):
    return features.audio_scores(_audio_frames(spark, sf)).select("segment_id", "n", F.round("audio_score", 4).alias("audio_score"))


@query("""SELECT user_id AS video_id, count(*) AS frames_analyzed, round(avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END), 4) AS face_ratio, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 4) AS closeup_ratio,
 round(avg(CASE WHEN value * 2 < 100 THEN 1.0::DOUBLE ELSE 0 END), 4) AS blurry_ratio, round(avg(value * 2), 2) AS avg_sharpness, avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) > 0.3 AS has_face FROM events GROUP BY 1""")
def visual_aggregate(spark, sf):
    f = _read(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.col("event_type") == "click").cast("int").alias("face_count"), (F.col("value") > 50).alias("is_closeup"),
        F.lit(0.5).alias("center_x"), F.lit(0.5).alias("center_y"), (F.col("value") / 100).alias("edge_density"), (F.col("value") * 2).alias("sharpness"),
    )
    v = features.visual_scores(f)
    return v.select("video_id", "frames_analyzed", *[F.round(c, 4).alias(c) for c in ("face_ratio", "closeup_ratio", "blurry_ratio")], F.round("avg_sharpness", 2).alias("avg_sharpness"), "has_face")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN t = '' THEN '高光片段' ELSE t END AS reason FROM (SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN l_linenumber = 1 THEN '特写' END, CASE WHEN l_returnflag = 'R' THEN '有人物' END, CASE WHEN l_linestatus = 'O' THEN '动作' END,
 CASE WHEN l_discount * 10 > 0.6 THEN '音频爆点' END, CASE WHEN l_tax * 10 > 0.6 THEN '情绪' END, CASE WHEN l_quantity > 30 THEN '画面佳' END) AS t FROM lineitem)""")
def highlight_flags_reason(spark, sf):
    r = scoring.reason(F.col("l_linenumber") == 1, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") * 10, F.col("l_tax") * 10, F.when(F.col("l_quantity") > 30, 1.0).otherwise(0.0), F.lit(""))
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r.alias("reason"))


@query(f"""WITH {SEG} SELECT ord, CASE WHEN total_score_raw >= 0.7 THEN '精品' WHEN total_score_raw >= 0.5 THEN '优质' WHEN total_score_raw >= 0.3 THEN '普通' ELSE '一般' END AS label,
 CASE WHEN duration < 1 THEN '过短' WHEN duration < 2 THEN '偏短' WHEN duration <= 6 THEN '理想' WHEN duration <= 10 THEN '偏长' ELSE '过长' END AS rating FROM seg""")
def score_label(spark, sf):
    return segments(spark, sf).select("ord", scoring.score_label(F.col("total_score_raw")).alias("label"), scoring.duration_rating(F.col("duration")).alias("rating"))


_CONFLICT, _CLIMAX, _INTENSE = ["idiot", "scum", "moron"], ["the", "and"], ["tion", "ing"]


@query("""SELECT doc_id, round(least(1.0::DOUBLE, ((CAST(contains(text, 'idiot') AS INTEGER) + CAST(contains(text, 'scum') AS INTEGER) + CAST(contains(text, 'moron') AS INTEGER)) * 1.0::DOUBLE + (CAST(contains(text, 'the') AS INTEGER) + CAST(contains(text, 'and') AS INTEGER)) * 0.8::DOUBLE
 + (CAST(contains(text, 'tion') AS INTEGER) + CAST(contains(text, 'ing') AS INTEGER)) * 0.6::DOUBLE) / 3.0::DOUBLE), 4) AS keyword_score FROM documents""")
def emotion_keyword(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.round(text.keyword_score(F.col("text"), _CONFLICT, _CLIMAX, _INTENSE), 4).alias("keyword_score"))


@query(r"""SELECT doc_id, round(least(1.0::DOUBLE, (len(regexp_extract_all(lower(text), 'th[a-z]+!')) + len(regexp_extract_all(lower(text), '[a-z]+ing\b'))) * 2.0::DOUBLE / greatest(1.0::DOUBLE, length(text) / 10.0::DOUBLE)), 4) AS pattern_score FROM documents""")
def emotion_pattern(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.round(text.pattern_score(F.lower("text"), ["th[a-z]+!", r"(?-u)[a-z]+ing\b"]), 4).alias("pattern_score"))


@query()
def emotion_intensity(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", text.intensity_score(F.col("text")).alias("intensity_score"))


@query("SELECT c_custkey, round(coalesce(greatest(0.1::DOUBLE, least(2.0::DOUBLE, pow(10.0::DOUBLE, (-20.0 + c_acctbal / 500.0::DOUBLE) / 20.0::DOUBLE))), 0.7), 6) AS gain FROM customer")
def loudness_gain(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", F.round(scoring.loudness_gain(-F.col("c_acctbal") / 500.0), 6).alias("gain"))


@query("""WITH b AS (SELECT p_partkey, CAST(640 + p_size * 20 AS INTEGER) AS vw, CAST(360 + p_size * 10 AS INTEGER) AS vh, CAST(p_size * 15 AS INTEGER) AS fx FROM part), s AS (SELECT *, least(1080.0::DOUBLE / vw, 1920.0::DOUBLE / vh) AS k FROM b),
w AS (SELECT *, least(vw, CAST(trunc(1080 / k) AS INTEGER)) AS w, least(vh, CAST(trunc(1920 / k) AS INTEGER)) AS h FROM s)
SELECT p_partkey, w, h, CAST(greatest(0, least(fx - w // 2, vw - w)) AS INTEGER) AS x, CAST((vh - h) // 2 AS INTEGER) AS y FROM w""")
def crop_geometry(spark, sf):
    p = _read(spark, sf, "part").select("p_partkey", (640 + F.col("p_size") * 20).cast("int").alias("vw"), (360 + F.col("p_size") * 10).cast("int").alias("vh"), (F.col("p_size") * 15).cast("int").alias("fx"))
    return p.select("p_partkey", scoring.crop_window(F.col("vw"), F.col("vh"), 1080, 1920, F.col("fx")).alias("c")).select("p_partkey", "c.*")


@query(f"WITH {SEG} SELECT ord, greatest(10, least(500, CAST(trunc(duration / 0.4::DOUBLE) AS INTEGER))) AS words FROM seg")
def word_budget(spark, sf):
    return segments(spark, sf).select("ord", scoring.word_budget(F.col("duration")).alias("words"))


# --- time codes --------------------------------------------------------------------------------------------------

_SRT = "printf('%02d:%02d:%02d,%03d', CAST(floor({0} / 3600) AS INTEGER), CAST(floor(({0} % 3600) / 60) AS INTEGER), CAST(floor({0} % 60) AS INTEGER), CAST(floor(({0} % 1) * 1000) AS INTEGER))"


@query(f"WITH x AS (SELECT event_id, (event_id % 20000) / 4.0::DOUBLE AS t FROM events) SELECT event_id, {_SRT.format('t')} AS code, t AS back FROM x")
def timecode_roundtrip(spark, sf):
    x = _read(spark, sf, "events").select("event_id", ((F.col("event_id") % 20000) / 4.0).alias("t"))
    code = timecode.to_srt(F.col("t"))
    return x.select("event_id", code.alias("code"), timecode.from_srt(code).alias("back"))


@query("SELECT event_id, round((event_id % 40) / 4.0::DOUBLE, 2) AS length FROM events")
def range_duration(spark, sf):
    t = (F.col("event_id") % 20000) / 4.0
    rng = F.concat(timecode.to_srt(t), F.lit("-"), timecode.to_srt(t + (F.col("event_id") % 40) / 4.0))
    return _read(spark, sf, "events").select("event_id", timecode.range_duration(rng).alias("length"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ',000-00:01:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ',250' END AS rng,
 (event_id % 24) * 3600 + (event_id % 60) * 60 + 0.5::DOUBLE AS digits FROM events""")
def filename_timerange(spark, sf):
    ss = F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("vid_00-00-"), ss, F.lit("-000@00-01-"), ss, F.lit("-250.mp4"))).otherwise("plain.mp4")
    digits = F.concat(F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), ss, F.lit("005"))
    return _read(spark, sf, "events").select("event_id", timecode.file_range(name).alias("rng"), timecode.from_digits(digits).alias("digits"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 61.25 WHEN 2 THEN 60.0 ELSE 0.0 END::DOUBLE AS length,
 CASE event_id % 4 WHEN 2 THEN '00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':00-00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':20' END AS rng FROM events""")
def time_range_forms(spark, sf):
    """Range lengths of minute codes, full codes and broken ones; file names of the older form."""
    k, mm = F.col("event_id") % 4, F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    rng = F.when(k == 0, "01:00-02:00").when(k == 1, "00:00:01,250-00:01:02,500").when(k == 2, "00:00:00-00:01:00").otherwise("00:00:01-00:00:02-00:00:03")
    name = F.when(k == 2, F.concat(F.lit("vid-00-"), mm, F.lit("-00-00-"), mm, F.lit("-20.mp4"))).otherwise("vid_1.mp4")
    return _read(spark, sf, "events").select("event_id", timecode.range_duration(rng).alias("length"), timecode.file_range(name).alias("rng"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def json_repair_forms(spark, sf):
    """Double braces, comments, bare and single-quoted keys, text around; the last form is no JSON."""
    n, k = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    raw = (
        F.when(n == 0, F.concat(F.lit('{{"k": '), k, F.lit("}}"))).when(n == 1, F.concat(F.lit('{"k": '), k, F.lit(" # the key\n}")))
        .when(n == 2, F.concat(F.lit("{k: "), k, F.lit("}"))).when(n == 3, F.concat(F.lit("Sure: {'k': "), k, F.lit(",} // done"))).when(n == 4, F.concat(F.lit("x {\"k\":"), k, F.lit("} y"))).otherwise("no json")
    )
    return _read(spark, sf, "events").select("event_id", text.parse_json(raw, "struct<k:int>")["k"].alias("k"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no_narration' WHEN 1 THEN 'bad__id' WHEN 2 THEN 'bad_OST' WHEN 3 THEN 'empty_list' END AS error,
 CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS item FROM orders""")
def script_text_check(spark, sf):
    k = F.col("o_orderkey") % 5
    good = '{"_id": 1, "timestamp": "00:00:01,000-00:00:02,000", "picture": "p", "narration": "n", "OST": 1}'
    script = (
        F.when(k == 0, "[" + good + ', {"_id": 2, "timestamp": "x", "picture": "p", "OST": 0}]').when(k == 1, "[" + good.replace('"_id": 1', '"_id": "1"') + "]")
        .when(k == 2, "[" + good.replace('"OST": 1', '"OST": "1"') + "]").when(k == 3, "[]").otherwise("[" + good + "]")
    )
    got = catalog.check_script_text(script)
    return _read(spark, sf, "orders").select("o_orderkey", got["error"].alias("error"), got["item"].alias("item"))


@query("""WITH u AS (SELECT l_orderkey AS script_id, l_linenumber AS ord, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CAST(floor(q) AS BIGINT) % 60 AS len, sum(CAST(floor(q) AS BIGINT) % 60) OVER (PARTITION BY script_id ORDER BY ord) AS e FROM u)
SELECT script_id, ord, lpad(CAST((e - len) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((e - len) % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(e // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') AS new_timestamp FROM r""")
def new_timestamps(spark, sf):
    lines = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("script_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("q"))
    items = lines.repartition("script_id").groupBy("script_id", "ord").agg(F.min("q").alias("q"))  # dealt once, for the window too
    stamp = F.concat(F.lit("00:00-00:"), F.lpad((F.floor("q") % 60).cast("string"), 2, "0"))
    return timeline.new_timestamps(items.withColumns({"timestamp": stamp, "narration": F.lit("n")}), minutes=True).select("script_id", "ord", "new_timestamp")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 40 < 25 THEN n_name END AS path, o_orderkey % 40 >= 25 AS rejected FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 40""")
def script_episode_join(spark, sf):
    items = _read(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderkey") % 40, F.lit(0)).alias("episode"))
    return timeline.attach_episodes(items, _read(spark, sf, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("path"))).select("o_orderkey", "path", "rejected")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.1 WHEN event_id % 3 = 1 THEN 0.2 ELSE value END::DOUBLE AS emotion, CASE WHEN event_id % 3 = 0 THEN 0.2 WHEN event_id % 3 = 1 THEN 0.3 ELSE value END::DOUBLE AS visual,
 greatest(800, 180 * length(event_type)) AS cue_ms FROM events""")
def score_fallbacks(spark, sf):
    k = F.col("event_id") % 3
    name, score = F.when(k > 0, F.col("event_type")), F.when(k == 2, F.col("value").cast("double"))
    return _read(spark, sf, "events").select(
        "event_id", scoring.emotion_or_default(score, name).alias("emotion"), scoring.visual_or_default(score, name).alias("visual"), scoring.cue_milliseconds(F.col("event_type")).cast("long").alias("cue_ms"),
    )


# --- timelines and joins -----------------------------------------------------------------------------------------


def _items(spark, sf):
    return _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("script_id"), F.col("l_linenumber").alias("ord"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"),
        F.expr("cast(l_linenumber % 3 as int)").alias("OST"), (F.floor("l_quantity") / 4.0).alias("duration"), F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("timestamp"),
    )


_ITEMS = "items AS (SELECT l_orderkey AS script_id, l_linenumber AS ord, l_orderkey * 10 + l_linenumber AS _id, CAST(l_linenumber % 3 AS INTEGER) AS ost, floor(l_quantity) / 4.0::DOUBLE AS duration, l_suppkey || '-' || l_partkey AS ts FROM lineitem)"
_LINES = f"""{_ITEMS}, ed AS (SELECT *, sum(duration) OVER (PARTITION BY script_id ORDER BY ord, _id, ts, duration ROWS UNBOUNDED PRECEDING) AS e FROM items)"""


def _unique_items(spark, sf):
    return catalog.keep_first(_items(spark, sf), "_id", ["timestamp", "duration"])


def _script_items(spark, sf):
    """The same, dealt once by script: what runs over a script's items needs no other exchange."""
    return catalog.keep_first(_items(spark, sf).repartition("script_id"), ["script_id", "_id"], ["timestamp", "duration"])


_UNIQ = f"""{_ITEMS}, u AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY _id ORDER BY ts, duration) = 1), ed AS (SELECT *, sum(duration) OVER (PARTITION BY script_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e FROM u)"""
_CLOCK = "printf('%02d:%02d:%02d', CAST(floor(({0}) / 3600) AS INTEGER), CAST(floor((({0}) % 3600) / 60) AS INTEGER), CAST(floor(({0}) % 60) AS INTEGER))"


@query(f"WITH {_UNIQ} SELECT script_id, ord, e - duration AS edited_start, e AS edited_end, CASE WHEN duration > 0 THEN {_CLOCK.format('e - duration')} || '-' || {_CLOCK.format('e')} END AS edited FROM ed")
def edit_timeline(spark, sf):
    return timeline.edit_timeline(_script_items(spark, sf)).select("script_id", "ord", "edited_start", "edited_end", F.col("editedTimeRange").alias("edited"))


def _speech(spark, sf):
    return _read(spark, sf, "orders").where("o_orderkey % 4 != 0").select((F.col("o_orderkey") * 10 + 1).alias("_id"), ((F.col("o_orderkey") % 80) / 4.0).alias("speech_duration"))


_SPEECH = "sp AS (SELECT o_orderkey * 10 + 1 AS _id, (o_orderkey % 80) / 4.0::DOUBLE AS sd FROM orders WHERE o_orderkey % 4 != 0)"


@query(f"WITH {_UNIQ}, {_SPEECH} SELECT u._id, ost AS \"OST\", sd AS speech_duration FROM u LEFT JOIN sp USING (_id) WHERE NOT (ost IN (0, 2) AND sd IS NULL)")
def script_tts_join(spark, sf):
    return timeline.join_speech(_unique_items(spark, sf), _speech(spark, sf)).where("not rejected").select("_id", "OST", "speech_duration")


@query(f"WITH {_UNIQ}, {_SPEECH} SELECT u._id, ost AS \"OST\" FROM u LEFT JOIN sp USING (_id) WHERE ost IN (0, 2) AND sd IS NULL")
def script_tts_rejects(spark, sf):
    return timeline.join_speech(_unique_items(spark, sf), _speech(spark, sf)).where("rejected").select("_id", "OST")


@query(f"""WITH {_UNIQ}, {_SPEECH}, j AS (SELECT u._id, ost, ord * 5.0::DOUBLE AS start, CASE WHEN ost = 1 THEN duration ELSE coalesce(sd, duration) END AS len FROM u LEFT JOIN sp USING (_id))
SELECT _id, start AS cut_start, start + len AS cut_end, ost = 0 AS mute FROM j""")
def ost_cut_list(spark, sf):
    joined = _unique_items(spark, sf).join(_speech(spark, sf), "_id", "left").withColumns({"start": F.col("ord") * 5.0, "scripted": F.col("duration")})
    return timeline.cut_list(joined).select("_id", "cut_start", "cut_end", "mute")


@query(f"""WITH {_UNIQ}, m AS (SELECT CASE WHEN ps_i % 2 = 0 THEN id END AS id, ts, path, o FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey || '-' || l_partkey AS ts, 'p' || l_orderkey || '_' || l_linenumber AS path, l_orderkey + l_linenumber AS ps_i, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_orderkey % 3 != 0)),
a AS (SELECT id, arg_min(path, o) AS p FROM m WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT ts, arg_min(path, o) AS p FROM m GROUP BY 1)
SELECT u._id, coalesce(a.p, b.p) AS path FROM u LEFT JOIN a ON u._id = a.id LEFT JOIN b ON u.ts = b.ts""")
def script_media_fallback_join(spark, sf):
    li = _read(spark, sf, "lineitem").where("l_orderkey % 3 != 0")
    media = li.select(
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("timestamp"),
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("path"),
        (-(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("ord"),
    )
    return timeline.attach_media(_unique_items(spark, sf), media).select("_id", "path")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def missing_media_anti(spark, sf):
    have = _read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return catalog.without(_read(spark, sf, "part").select("p_partkey"), have, ["p_partkey"])


_CUES = "cues AS (SELECT conv_id, turn, 4.0::DOUBLE * turn AS s, 4.0::DOUBLE * turn + 2.5::DOUBLE AS e, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1)"


def _cues(spark, sf):
    c = _read(spark, sf, "conversations").withColumn("key", F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    return catalog.keep_first(c, "key", ["text"]).select("conv_id", "turn", (F.lit(4.0) * F.col("turn")).alias("s"), (F.lit(4.0) * F.col("turn") + 2.5).alias("e"), "text")


@query(f"""WITH {_CUES}, it AS (SELECT DISTINCT conv_id, conv_id % 7 AS script_id, (conv_id % 50) * 2.5::DOUBLE AS off FROM cues), j AS (SELECT script_id, conv_id, turn, s + off AS st, e + off AS en FROM cues JOIN it USING (conv_id))
SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY st, conv_id, turn) AS INTEGER) AS cue_no, st AS start, en AS "end" FROM j""")
def subtitle_merge(spark, sf):
    cues = _cues(spark, sf)
    items = cues.select(F.col("conv_id").alias("_id"), (F.col("conv_id") % 7).alias("script_id"), ((F.col("conv_id") % 50) * 2.5).alias("edited_start")).distinct()
    return timeline.merge_subtitles(items, cues.select(F.col("conv_id").alias("_id"), F.col("turn").alias("cue_idx"), F.col("s").alias("cue_start"), F.col("e").alias("cue_end"), "text")).select("script_id", "cue_no", "start", "end")


@query(f"""WITH {_CUES}, l AS (SELECT conv_id % 5 AS job, conv_id AS file_no, max_by(e, turn) AS le FROM cues GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(le) OVER (PARTITION BY job ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY file_no, turn) AS INTEGER) AS cue_no, off + s AS start, off + e AS "end" FROM cues JOIN o ON conv_id = file_no""")
def srt_concat(spark, sf):
    c = _cues(spark, sf).select((F.col("conv_id") % 5).alias("job"), F.col("conv_id").alias("file_no"), F.col("turn").alias("cue_idx"), F.col("s").alias("start"), F.col("e").alias("end"), "text")
    return timeline.concat_srt(c).select("job", "cue_no", "start", "end")


@query("""WITH x AS (SELECT doc_id, string_split(trim(text), chr(10))[1:5] AS l FROM documents), y AS (SELECT doc_id, l, len(l) AS n, unnest(range(len(l))) AS i FROM x)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, l[i + 1] AS line, round(10.0::DOUBLE / n * i, 6) AS cue_start FROM y""")
def simple_srt(spark, sf):
    t = _read(spark, sf, "documents").select("doc_id", "text", F.lit(0.0).alias("start"), F.lit(10.0).alias("duration"))
    return timeline.split_evenly(t).select("doc_id", "line_no", "line", F.round("cue_start", 6).alias("cue_start"))


@query(r"SELECT doc_id, greatest(2.0::DOUBLE, least(10.0::DOUBLE, length(regexp_replace(text, '[ \n]', '', 'g')) / 2.5::DOUBLE)) AS duration FROM documents")
def narration_srt(spark, sf):
    return timeline.narration_lengths(_read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "duration")


@query(f"""WITH {_CUES} SELECT conv_id % 11 AS job, left(string_agg('[E' || conv_id || ' ' || CAST(s AS BIGINT) || 's]: ' || text, chr(10) ORDER BY conv_id, s, text), 8000) AS transcript FROM cues WHERE text != '' GROUP BY 1""")
def transcript_concat(spark, sf):
    return timeline.transcript(_cues(spark, sf).select((F.col("conv_id") % 11).alias("job"), F.col("conv_id").alias("episode"), F.col("s").alias("start"), "text"))


@query(f"""WITH {_CUES}, sc AS (SELECT DISTINCT conv_id, k AS scene_id, k * 7.0::DOUBLE AS a, k * 7.0::DOUBLE + 7.0::DOUBLE AS b FROM cues, range(0, 6) t(k))
SELECT sc.conv_id AS episode_id, scene_id, count(*) AS n_cues FROM sc JOIN cues ON sc.conv_id = cues.conv_id AND a < e AND b > s GROUP BY 1, 2""")
def subtitle_scene_overlap(spark, sf):
    cues = _cues(spark, sf).select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("cue_idx"), F.col("s").alias("cue_start"), F.col("e").alias("cue_end"), "text")
    scenes = cues.select("episode_id").distinct().withColumn("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    scenes = scenes.withColumns({"start_time": F.col("scene_id") * 7.0, "end_time": F.col("scene_id") * 7.0 + 7.0})
    return timeline.overlay_cues(scenes, cues).select("episode_id", "scene_id", "n_cues")


# --- segmentation ------------------------------------------------------------------------------------------------


@query(f"""WITH {SEG}, r AS (SELECT ord AS video_id, duration * 3 AS d FROM seg), k AS (SELECT video_id, d, unnest(range(0, greatest(CAST(ceil(d / 8.0::DOUBLE) AS BIGINT), 1))) AS p FROM r WHERE d >= 2)
SELECT video_id, CAST(p AS INTEGER) AS piece, p * 8.0::DOUBLE AS start_time, least(d, p * 8.0::DOUBLE + 8) AS end_time FROM k WHERE least(d, p * 8.0::DOUBLE + 8) - p * 8.0::DOUBLE >= 2""")
def scene_split(spark, sf):
    raw = segments(spark, sf).select(F.col("ord").alias("video_id"), F.lit(0.0).alias("start_time"), (F.col("duration") * 3).alias("end_time"))
    out = segmentation.split_long(raw.where("end_time - start_time >= 2"), 2.0, 8.0)
    return out.select("video_id", "piece", "start_time", "end_time")


@query("""WITH RECURSIVE p AS (SELECT user_id, CAST(event_id % 1000 AS DOUBLE) AS ts FROM events WHERE value > 25 GROUP BY 1, 2), rec(user_id, ts) AS (SELECT DISTINCT user_id, 0.0::DOUBLE FROM p UNION ALL
 SELECT r.user_id, (SELECT min(p.ts) FROM p WHERE p.user_id = r.user_id AND p.ts - r.ts >= 40) AS ts FROM rec r WHERE r.ts IS NOT NULL), g AS (SELECT user_id, max(ts) AS last_point, count(ts) AS n FROM rec GROUP BY 1)
SELECT user_id AS video_id, CASE WHEN 1000 - last_point > 1 THEN n + 1 ELSE n END AS n_points, CASE WHEN 1000 - last_point > 1 THEN 1000.0::DOUBLE ELSE last_point END AS last_point FROM g""")
def scene_change_points(spark, sf):
    d = _read(spark, sf, "events").where("value > 25").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 1000).cast("double").alias("ts"), F.col("value").alias("diff"), F.lit(1000.0).alias("duration"))
    p = segmentation.change_points(d, 10.0, 40.0)
    return p.select("video_id", F.size("points").cast("long").alias("n_points"), F.element_at("points", -1).alias("last_point"))


@query("""SELECT c_custkey AS video_id, coalesce(s, 0.0::DOUBLE) AS start_time, coalesce(e, 100.0::DOUBLE) AS end_time FROM customer LEFT JOIN (SELECT o_custkey, 1.0::DOUBLE AS s, min(o_orderkey)::DOUBLE + 1 AS e FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def fallback_scene(spark, sf):
    found = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.lit(1.0).alias("start_time"), (F.min("o_orderkey").cast("double") + 1).alias("end_time"))
    return segmentation.with_fallback(_read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.lit(100.0).alias("duration")), found)


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), p AS (SELECT *, regexp_matches(t, '[.,]') AS p FROM w), q AS (SELECT *, p AND length(t) = 1 AND coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY i), TRUE) AS sw FROM p),
b AS (SELECT *, p AND NOT sw AS b FROM q), c AS (SELECT *, coalesce(sum(CAST(b AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cue FROM b),
g AS (SELECT doc_id, cue, string_agg(CASE WHEN sw THEN '' ELSE t END, '' ORDER BY i) AS t, bool_or(b) AS closed, min(i) AS a, max(i) AS z FROM c GROUP BY 1, 2)
SELECT doc_id AS _id, CAST(cue AS BIGINT) AS cue, CASE WHEN closed THEN left(t, length(t) - 1) ELSE t END AS text, a AS start, z AS "end" FROM g WHERE CASE WHEN closed THEN left(t, length(t) - 1) ELSE t END != ''""")
def word_cue_islands(spark, sf):
    w = _read(spark, sf, "documents").select(F.col("doc_id").alias("_id"), F.posexplode(F.split("text", " ")).alias("word_idx", "text")).withColumn("start", (F.col("word_idx") + 1).cast("long"))
    return segmentation.word_cues(w.withColumn("end", F.col("start")), ".,")


@query("""WITH b AS (SELECT o_custkey AS group_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderkey AS t FROM orders), g AS (SELECT group_id, ord // 4 AS batch, count(*) AS n, min_by(t, ord) AS f, max_by(t, ord) AS l FROM b GROUP BY 1, 2)
SELECT group_id, batch, n, CASE WHEN n = 1 THEN coalesce(lag(l) OVER (PARTITION BY group_id ORDER BY batch), f) ELSE f END AS start_t, l AS end_t FROM g""")
def batch_timerange(spark, sf):
    from pyspark.sql import Window

    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("ord"), F.col("o_orderkey").alias("t"))
    return segmentation.batch_ranges(o, 4)


# --- text, catalogues, validation --------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([0-9])\.([0-9])', '\1@@\2', 'g'), '[.?,、;:!…？，。；：！\n]')) AS x FROM conversations) SELECT conv_id, turn, replace(trim(x), '@@', '.') AS part FROM p WHERE trim(x) != ''""")
def split_punctuation(spark, sf):
    c = _read(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.split_marks(F.col("text"))).alias("part"))
    return c


@query("""SELECT a.item_id AS a, b.item_id AS b, round(1 - levenshtein(lower(a.t), lower(b.t)) / greatest(length(a.t), length(b.t))::DOUBLE, 4) AS likeness
 FROM (SELECT item_id, regexp_replace(left(text, 40), '[^ -~]', '?', 'g') AS t FROM benchmark) a JOIN (SELECT item_id, regexp_replace(left(text, 40), '[^ -~]', '?', 'g') AS t FROM benchmark) b ON b.item_id = a.item_id + 1""")
def levenshtein_similarity(spark, sf):
    # the oracle's edit distance counts bytes: other than ASCII becomes one sign for the comparison
    b = _read(spark, sf, "benchmark").withColumn("t", F.regexp_replace(F.left("text", F.lit(40)), "[^ -~]", "?"))
    left, right = b.select(F.col("item_id").alias("a"), F.col("t").alias("x")), b.select(F.col("item_id").alias("b"), F.col("t").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.similarity(F.col("x"), F.col("y")), 4).alias("likeness"))


@query()
def levenshtein_similarity_whole(spark, sf):
    # whole texts, all letters: no SQL, since the oracle's edit distance counts bytes
    b = _read(spark, sf, "benchmark")
    left, right = b.select(F.col("item_id").alias("a"), F.col("text").alias("x")), b.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.similarity(F.col("x"), F.col("y")), 4).alias("likeness"))


@query(r"""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 7 = 0 THEN '00:00:01-00:00:02' ELSE '00:00:01,000-00:00:02,000' END AS t, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS n, o_orderkey % 4 AS ost FROM orders)
SELECT o_orderkey, CASE WHEN id <= 0 THEN 'bad_id' WHEN NOT regexp_matches(t, '^\d{2}:\d{2}:\d{2},\d{3}-\d{2}:\d{2}:\d{2},\d{3}$') THEN 'bad_timestamp' WHEN trim(n) = '' THEN 'blank_narration' WHEN ost NOT IN (0, 1, 2) THEN 'bad_ost' END AS error FROM i""")
def script_validate(spark, sf):
    k = F.col("o_orderkey")
    items = _read(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 10 == 0, F.lit(0)).otherwise(k).alias("_id"), F.when(k % 7 == 0, "00:00:01-00:00:02").otherwise("00:00:01,000-00:00:02,000").alias("timestamp"),
        F.lit("p").alias("picture"), F.when(k % 11 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("narration"), (k % 4).cast("int").alias("OST"),
    )
    return catalog.check_script(items).select("o_orderkey", "error")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_repair(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.col("props"))
    return _read(spark, sf, "events").select("event_id", text.parse_json(raw, "struct<k:int>")["k"].alias("k"))


@query("SELECT s_suppkey, 'Dear ' || s_name || ' of ' || s_nationkey || ', ' || s_name AS letter FROM supplier")
def template_render(spark, sf):
    t = F.lit("Dear ${name} of ${nation}, $name")
    return _read(spark, sf, "supplier").select("s_suppkey", text.render(t, {"name": F.col("s_name"), "nation": F.col("s_nationkey").cast("string")}).alias("letter"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, array_to_string(list_transform(regexp_extract_all(p_name || chr(39) || 'S x1Y', '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS title,
 p_name AS stripped, CASE WHEN length(p_name) <= 10 THEN p_name ELSE p_name[1:10] || '...' END AS short, '"' || p_name || ' \\"x\\""' AS js, CAST(p_size AS VARCHAR) AS js_number FROM part""")
def template_filters(spark, sf):
    name, f = F.col("p_name"), text.FILTERS
    return _read(spark, sf, "part").select(
        "p_partkey", f["upper"](name).alias("up"), f["lower"](F.col("p_brand")).alias("low"), f["title"](F.concat(name, F.lit("'S x1Y"))).alias("title"),
        f["strip"](F.concat(F.lit(" \n\t"), name, F.lit(" \n"))).alias("stripped"), f["truncate"](name, 10).alias("short"), f["json"](F.concat(name, F.lit(' "x"'))).alias("js"), f["json"](F.col("p_size")).alias("js_number"),
    )


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '7' WHEN 1 THEN '["a","b"]' WHEN 2 THEN 'true' WHEN 3 THEN '"true"' WHEN 4 THEN '"plain text"' WHEN 5 THEN CAST(event_id AS VARCHAR) ELSE '{"k":null,"n":"None"}' END AS value FROM events""")
def type_recovery(spark, sf):
    e = F.col("event_id") % 7
    raw = F.when(e == 0, "007").when(e == 1, "['a', 'b']").when(e == 2, "True").when(e == 3, "true").when(e == 4, "plain text").when(e == 5, F.col("event_id").cast("string")).otherwise("{'k': None, 'n': 'None'}")
    return _read(spark, sf, "events").select("event_id", F.to_json(text.recover_type(raw)).alias("value"))


@query("""WITH v AS (SELECT p_brand AS c, p_type AS n, CAST(p_size AS VARCHAR) AS v, max(p_name) AS d FROM part GROUP BY ALL),
n AS (SELECT c, n, '{' || string_agg('"' || v || '":"' || d || '"', ',' ORDER BY v) || '}' AS vs FROM v GROUP BY ALL)
SELECT c AS category, '{' || string_agg('"' || n || '":' || vs, ',' ORDER BY n) || '}' AS prompts FROM n GROUP BY 1""")
def prompt_export(spark, sf):
    return catalog.export(_prompts(spark, sf)).select("category", F.to_json("prompts").alias("prompts"))


@query("""WITH p AS (SELECT s_suppkey AS script_id, unnest(range(1, s_suppkey % 4 + 1)) AS i, s_name FROM supplier)
SELECT script_id, CAST(i AS INTEGER) AS _id, '00:00:0' || i || ',000-00:00:09,000' AS timestamp, s_name || i AS picture, '播放原生_' || md5(script_id || '/' || i)[1:8] AS narration, 1 AS OST FROM p""")
def plot_script(spark, sf):
    point = lambda i: F.struct(F.concat(F.lit("00:00:0"), i.cast("string"), F.lit(",000-00:00:09,000")).alias("timestamp"), F.concat("s_name", i.cast("string")).alias("picture"))
    numbers = F.slice(F.array(*(F.lit(i) for i in (1, 2, 3))), F.lit(1), (F.col("s_suppkey") % 4).cast("int"))
    return timeline.plot_script(_read(spark, sf, "supplier").select(F.col("s_suppkey").alias("script_id"), F.transform(numbers, point).alias("plot_points")))


def _prompts(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_name").alias("description"))


@query("SELECT p_brand AS category, p_type AS name, p_name AS description FROM part WHERE contains(lower(p_type), 'economy') OR contains(lower(p_name), 'economy')")
def prompt_search(spark, sf):
    return catalog.search(_prompts(spark, sf), "Economy").select("category", "name", "description")


@query("SELECT count(DISTINCT p_brand) AS n_categories, count(DISTINCT (p_brand, p_type)) AS n_prompts, count(DISTINCT (p_brand, p_type, p_size)) AS n_versions FROM part")
def registry_stats(spark, sf):
    return catalog.registry_stats(_prompts(spark, sf))


@query("SELECT p_brand AS category, p_type AS name, max(CAST(p_size AS VARCHAR)) AS default_version FROM part GROUP BY 1, 2")
def default_version(spark, sf):
    return catalog.default_versions(_prompts(spark, sf))


@query("SELECT c_name, regexp_replace(lower(c_name), '[0-9]+', '') AS stem, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS num FROM customer")
def natural_sort(spark, sf):
    k = text.natural_key(F.col("c_name"))
    return files.in_natural_order(_read(spark, sf, "customer"), "c_name").select("c_name", k[0].alias("stem"), k[1].cast("long").alias("num"))


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1")
def dedup_keep_first(spark, sf):
    return catalog.keep_first(_read(spark, sf, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def first_rendition(spark, sf):
    return catalog.keep_first(_read(spark, sf, "lineitem").where("l_quantity >= 20"), "l_orderkey", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey")


@query(f"WITH {_UNIQ}, c AS (SELECT script_id, ord, coalesce(sum(least(duration, 5.0::DOUBLE)) OVER (PARTITION BY script_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM u) SELECT * FROM c WHERE used_before <= 12")
def budgeted_take(spark, sf):
    return catalog.take_budget(_script_items(spark, sf), "script_id", "ord", F.lit(12.0), 5.0).select("script_id", "ord", "used_before")


@query("SELECT c_custkey, coalesce(n, 0) AS n_items, coalesce(m, -1) AS first_item FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def group_by_episode_left(spark, sf):
    g = catalog.group_with_empty(_read(spark, sf, "customer").select("c_custkey"), _read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")
    return g.select("c_custkey", F.size("items").cast("long").alias("n_items"), F.coalesce(F.get("items", F.lit(0)), F.lit(-1)).alias("first_item"))


@query("SELECT user_id AS task_id, max_by(event_type, event_id) AS state, max_by(value, event_id) AS progress FROM events GROUP BY 1")
def task_state_latest(spark, sf):
    return catalog.latest_state(_read(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.col("value").alias("progress")))


@query("SELECT user_id AS task_id, max_by(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE WHEN event_id % 3 = 0 THEN event_id END) AS state, max_by(value, event_id) AS progress FROM events GROUP BY 1")
def task_state_merged(spark, sf):
    e = _read(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("state"), F.col("value").alias("progress"))
    return catalog.latest_state(e, merge=True)


@query("SELECT page_id, md5(string_split(url, '?')[1]) AS key FROM pages")
def md5_cache_key(spark, sf):
    return _read(spark, sf, "pages").select("page_id", text.cache_key(F.col("url")).alias("key"))


@query("""SELECT event_id, 'cue' AS text, (event_id % 400) / 4.0::DOUBLE AS start, (event_id % 400) / 4.0::DOUBLE + 2 AS "end" FROM events""")
def srt_parse(spark, sf):
    s = (F.col("event_id") % 400) / 4.0
    raw = F.concat(F.lit("1\n"), timecode.to_srt(s), F.lit(" --> "), timecode.to_srt(s + 2), F.lit("\ncue\n\nbroken\n"))
    return files.parse_srt(_read(spark, sf, "events").select("event_id", raw.alias("text"))).select("event_id", "text", "start", "end")


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '[\[\](){}<>""''“”‘’\n]', ' ', 'g')) AS spoken, length(text) AS n FROM conversations")
def speech_cleanup(spark, sf):
    return _read(spark, sf, "conversations").select("conv_id", "turn", text.speakable(F.col("text")).alias("spoken"), F.length("text").cast("long").alias("n"))


@query()
def highlights_scored(spark, sf):
    s = segments(spark, sf).withColumns({"audio_score": F.col("total_score_raw"), "emotion_score": F.col("total_score_raw"), "visual_score": F.col("total_score_raw"), "rhythm_score": F.col("total_score_raw")})
    return highlights.highlights(s.drop("total_score", "total_score_raw"), target=30.0)


# --- script lines over cues and words ----------------------------------------------------------------------------


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("line"))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the turns."""
    return _words(_turns(spark, sf))


def _words(turns: DataFrame, *more: str) -> DataFrame:
    """Words of turns, half a second each; every fifth conversation has one misheard word a turn."""
    w = turns.select("job", "line_no", *more, F.posexplode(F.split("line", " ", -1)).alias("pos", "word"))
    no = F.col("line_no") * 100000 + F.col("pos")
    word = F.when((F.col("job") % 5 == 0) & (F.col("pos") == 3), "x").otherwise(F.col("word"))
    return w.select("job", "line_no", *more, no.alias("word_no"), (no * 0.5).alias("start"), (no * 0.5 + 0.5).alias("end"), word.alias("word"))


@query(
    r"""WITH l AS (SELECT conv_id AS job, CAST(turn AS BIGINT) AS line_no, coalesce(text, '') AS line FROM conversations),
n AS (SELECT *, length(regexp_replace(line, '[^\p{L}\p{N}_]', '', 'g')) AS n FROM l),
lc AS (SELECT *, row_number() OVER o AS k, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM n WINDOW o AS (PARTITION BY job ORDER BY line_no)),
s AS (SELECT job, line_no, string_split(line, ' ') AS ws FROM l),
w0 AS (SELECT job, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM s),
w1 AS (SELECT job, line_no * 100000 + pos AS no, CASE WHEN job % 5 = 0 AND pos = 3 THEN 'x' ELSE word END AS word FROM w0),
w AS (SELECT *, length(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')) AS n FROM w1),
wc AS (SELECT *, sum(n) OVER (PARTITION BY job ORDER BY no ROWS UNBOUNDED PRECEDING) AS upto FROM w),
b AS (SELECT lc.job, lc.k, lc.line, lc.n, wc.no AS last FROM lc LEFT JOIN wc ON wc.job = lc.job AND wc.upto = lc.upto AND wc.n > 0),
r AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY job ORDER BY k), -1) AS before FROM b),
t AS (SELECT r.job, r.k, r.line, r.n, r.last, min(w.no) AS first, string_agg(w.word, '' ORDER BY w.no) AS raw
  FROM r LEFT JOIN w ON w.job = r.job AND w.no > r.before AND w.no <= r.last GROUP BY ALL),
ok AS (SELECT *, min(CAST(coalesce(n > 0 AND regexp_replace(raw, '[^\p{L}\p{N}_]', '', 'g') = regexp_replace(line, '[^\p{L}\p{N}_]', '', 'g'), false) AS INTEGER))
  OVER (PARTITION BY job) AS whole FROM t)
SELECT job, k AS cue_no, CAST(first * 0.5 AS DOUBLE) AS start, CAST(last * 0.5 + 0.5 AS DOUBLE) AS "end",
  regexp_replace(CASE WHEN raw != line AND regexp_replace(raw, '[^\p{L}\p{N}_\s]', '', 'g') = regexp_replace(line, '[^\p{L}\p{N}_\s]', '', 'g')
    THEN regexp_replace(line, '[^\p{L}\p{N}_\s]', '', 'g') ELSE line END, '^\s+|\s+$', '', 'g') AS text
FROM ok WHERE whole = 1"""
)
def word_stream_match(spark: SparkSession, sf: str) -> DataFrame:
    """J11 over conversations."""
    return matching.match_words(_turns(spark, sf), _spoken(spark, sf).drop("line_no"))[0]


@query()
def fuzzy_cue_match(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as script lines, their halves as cues."""
    lines = _turns(spark, sf)
    half = F.ceil(F.length("line") / 2).cast("int")
    parts = F.array(F.left("line", half), F.substr("line", half + 1))
    cues = lines.select("job", "line_no", F.posexplode(parts).alias("pos", "text")).withColumn("cue_no", F.col("line_no") * 2 + F.col("pos"))
    return matching.correct_cues(lines, cues.select("job", "cue_no", F.col("cue_no").cast("double").alias("start"), (F.col("cue_no") + 1.0).alias("end"), "text"))


@query()
def spoken_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn is a part of its own, spoken over a ten-second item."""
    turns, by_job = _turns(spark, sf), Window.partitionBy("job").orderBy("line_no")
    items = turns.select("job", F.col("line_no").alias("item_no"), (F.col("line_no") * 10.0).alias("start"), (F.col("line_no") * 10.0 + 10).alias("end"), F.lit(0).alias("OST"))
    words = _words(turns.withColumn("part", F.row_number().over(by_job)), "part").drop("line_no")
    first = F.min("start").over(Window.partitionBy("job", "part"))
    words = words.withColumns({"start": F.col("start") - first, "end": F.col("end") - first})
    return matching.phrase_cues(items, words, turns.select("job", F.col("line_no").alias("sentence_no"), F.regexp_replace("line", " ", "").alias("sentence")))


# --- emotion, pictures, sound -------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line of one or two list words and some marks for each event."""
    words = F.array(*map(F.lit, lexicon.CONFLICT + lexicon.CLIMAX + lexicon.INTENSE))
    n, e = len(lexicon.CONFLICT + lexicon.CLIMAX + lexicon.INTENSE), F.col("event_id")
    a, b = F.element_at(words, (e % n + 1).cast("int")), F.element_at(words, (e * 7 % n + 1).cast("int"))
    line = F.concat(a, F.lit("他说"), F.when(e % 3 == 0, b).otherwise(""), F.repeat(F.lit("！"), (e % 4).cast("int")), F.when(e % 5 == 0, "？").otherwise(""))
    return _read(spark, sf, "events").select("event_id", line.alias("text"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_hits(words: list[str]) -> str:
    return f"len(list_filter({_sql_list([w for w in words if len(w) > 1])}, lambda k: contains(text, k)))"


_ALL_WORDS = lexicon.CONFLICT + lexicon.CLIMAX + lexicon.INTENSE
_LINE_SQL = f"""ks AS (SELECT {_sql_list(_ALL_WORDS)} AS k), t AS (SELECT event_id, k[event_id % {len(_ALL_WORDS)} + 1] || '他说' || CASE WHEN event_id % 3 = 0 THEN k[event_id * 7 % {len(_ALL_WORDS)} + 1] ELSE '' END
 || repeat('！', event_id % 4) || CASE WHEN event_id % 5 = 0 THEN '？' ELSE '' END AS text FROM events, ks)"""
_KEYWORD_SQL = f"least(1.0::DOUBLE, ({_sql_hits(lexicon.CONFLICT)} * 1.0::DOUBLE + {_sql_hits(lexicon.CLIMAX)} * 0.8::DOUBLE + {_sql_hits(lexicon.INTENSE)} * 0.6::DOUBLE) / 3.0::DOUBLE)"
_HITS_SQL = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in lexicon.PATTERNS)


@query(f"""WITH {_LINE_SQL}, p AS (SELECT event_id, {_KEYWORD_SQL} AS kw, least(1.0::DOUBLE, ({_HITS_SQL}) * 2.0::DOUBLE / greatest(1.0::DOUBLE, length(text) / 10.0::DOUBLE)) AS pt,
 CASE WHEN length(text) BETWEEN 1 AND 4 THEN 0.5::DOUBLE ELSE 0 END + least(1.0::DOUBLE, len(regexp_extract_all(text, '！{{3,}}|？{{3,}}')) / 3.0::DOUBLE) * 0.3 AS it FROM t)
SELECT event_id, round(kw, 4) AS keyword_score, round(pt, 4) AS pattern_score, round(it, 4) AS intensity_score, round(kw * 0.40 + pt * 0.25 + kw * 0.20 + it * 0.15, 4) AS emotion_score FROM p""")
def emotion_scores(spark, sf):
    out = emotion.emotion_scores(_lines(spark, sf))
    return out.select("event_id", *[F.round(c, 4).alias(c) for c in ("keyword_score", "pattern_score", "intensity_score", "emotion_score")])


@query(f"""WITH {_LINE_SQL}, w AS (SELECT event_id, string_split(text, '他说') AS ws FROM t) SELECT event_id, round(least(1.0::DOUBLE, len(list_filter(ws, lambda x: list_contains({_sql_list(_ALL_WORDS)}, x))) / len(ws)::DOUBLE * 15), 4) AS density_score FROM w""")
def emotion_density(spark, sf):
    lines = _lines(spark, sf).withColumn("words", F.split("text", "他说"))
    return emotion.emotion_scores(lines, words_col="words").select("event_id", F.round("density_score", 4).alias("density_score"))


@query("""WITH g AS (SELECT user_id AS video_id, avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0 END) AS fr, avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END) AS cr,
 avg(CASE WHEN value * 2 < 100 THEN 1.0::DOUBLE ELSE 0 END) AS br, avg(value * 2) AS sh, avg(value / 100) AS ed, 1 - least(1.0::DOUBLE, avg(abs(event_id % 8 / 8.0::DOUBLE - 0.5) / 2)) AS cs FROM events GROUP BY 1)
SELECT video_id, round(greatest(0, least(1.0::DOUBLE, (fr * 0.6 + least(1.0::DOUBLE, fr / 3) * 0.3 + cs * 0.1) * 0.30 + cr * 0.25
 + (least(1.0::DOUBLE, ed * 3) * 0.5 + least(1.0::DOUBLE, sh / 500) * 0.3 + (1 - br) * 0.2) * 0.25 + ((1 - br) * 0.6 + least(1.0::DOUBLE, ed * 2) * 0.4) * 0.20)), 4) AS visual_score FROM g""")
def visual_total(spark, sf):
    f = _read(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.col("event_type") == "click").cast("int").alias("face_count"), (F.col("value") > 50).alias("is_closeup"),
        (F.col("event_id") % 8 / 8.0).alias("center_x"), F.lit(0.5).alias("center_y"), (F.col("value") / 100).alias("edge_density"), (F.col("value") * 2).alias("sharpness"),
    )
    return features.visual_scores(f).select("video_id", F.round("visual_score", 4).alias("visual_score"))


@query("""WITH b AS (SELECT p_partkey, CAST(640 + p_size * 20 AS INTEGER) AS vw, CAST(360 + p_size * 13 AS INTEGER) AS vh, p_size FROM part), c AS (SELECT *, vw::DOUBLE / vh AS r FROM b),
d AS (SELECT *, CASE WHEN r > 1080 / 1920::DOUBLE THEN 1080.0::DOUBLE / vw ELSE 1920.0::DOUBLE / vh END AS k FROM c), e AS (SELECT *, CAST(trunc(vw * k) AS INTEGER) AS w, CAST(trunc(vh * k) AS INTEGER) AS h FROM d)
SELECT p_partkey, w, h, CAST(floor((1080 - w) / 2) AS INTEGER) AS x, CAST(floor((1920 - h) / 2) AS INTEGER) AS y,
 round(0.3 * least(1.0::DOUBLE, vw * vh / (1920.0::DOUBLE * 1080)) + 0.2 * least(1.0::DOUBLE, p_size / 5.0::DOUBLE) + 0.1, 6) AS visual_score, CAST(trunc(p_size * 1.5::DOUBLE) + 3 AS INTEGER) AS cover_frame,
 CASE p_size % 4 WHEN 0 THEN vh * 0.95::DOUBLE - 40 WHEN 1 THEN vh * 0.05::DOUBLE WHEN 2 THEN greatest(10.0::DOUBLE, least((vh - 40) * (p_size / 50.0::DOUBLE), vh - 50.0::DOUBLE)) ELSE (vh - 40) / 2.0::DOUBLE END AS subtitle_y FROM e""")
def picture_geometry(spark, sf):
    size = F.col("p_size")
    p = _read(spark, sf, "part").select("p_partkey", "p_size", (640 + size * 20).cast("int").alias("vw"), (360 + size * 13).cast("int").alias("vh"))
    place = F.when(size % 4 == 0, "bottom").when(size % 4 == 1, "top").when(size % 4 == 2, "custom").otherwise("center")
    return p.select(
        "p_partkey", media.padded_size(F.col("vw"), F.col("vh"), 1080, 1920).alias("g"), F.round(media.visual_from_size(F.col("vw"), F.col("vh"), size), 6).alias("visual_score"),
        media.cover_frame(size.cast("double"), F.lit(1.5)).alias("cover_frame"), media.subtitle_y(place, F.col("vh"), F.lit(40), size * 2.0).alias("subtitle_y"),
    ).select("p_partkey", "g.*", "visual_score", "cover_frame", "subtitle_y")


@query("""WITH b AS (SELECT c_custkey, c_acctbal AS v, (c_custkey % 41) / 8.0::DOUBLE AS s FROM customer) SELECT c_custkey, round(least(1.0::DOUBLE, (v / 100 + 20) / 20) * 0.6, 6) AS audio_score,
 greatest(0.0::DOUBLE, least(2.0::DOUBLE, v / 1000)) AS volume, round(greatest(0.1::DOUBLE, least(1.5::DOUBLE, v / 1000 * 0.5::DOUBLE)), 6) AS speech_volume,
 CASE WHEN (s - 1) * 100 > 0 OR s = 1 THEN '+' ELSE '' END || CAST(CAST(round_even((s - 1) * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS rate,
 CASE WHEN greatest(0.5, least(2, s)) < 0.95 THEN 'slow' WHEN greatest(0.5, least(2, s)) > 1.05 THEN 'fast' ELSE 'normal' END AS speed,
 CAST(floor(60 / (s + 0.5)) AS INTEGER) + 1 AS loops, c_custkey / 1048576.0::DOUBLE AS mb FROM b""")
def sound_measures(spark, sf):
    v, s = F.col("c_acctbal"), (F.col("c_custkey") % 41) / 8.0
    return _read(spark, sf, "customer").select(
        "c_custkey", F.round(media.audio_from_peak(v / 100), 6).alias("audio_score"), media.volume(v / 1000).alias("volume"), F.round(media.smart_volume(v / 1000, F.lit(0.5), 1.5), 6).alias("speech_volume"),
        media.signed_change(s).alias("rate"), media.speed_tag(s).alias("speed"), media.loops(F.lit(60.0), s + 0.5).alias("loops"), media.size_in(F.col("c_custkey")).alias("mb"),
    )


@query("""SELECT doc_id, CAST(trunc(length(text) * 0.21531::DOUBLE) AS INTEGER) AS seconds, greatest(1.0::DOUBLE, length(text) / 3.0::DOUBLE) AS fallback FROM documents""")
def speech_estimates(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", media.speech_seconds(F.col("text")).alias("seconds"), media.speech_seconds_default(F.col("text")).alias("fallback"))


@query("""WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'educational' ELSE 'other' END AS kind, CASE event_id % 4 WHEN 0 THEN '16:9' WHEN 1 THEN '1:1' WHEN 2 THEN '3:4' ELSE 'x' END AS shape FROM events)
SELECT event_id, CASE kind WHEN 'news' THEN 1.0::DOUBLE WHEN 'educational' THEN 0.9 ELSE 0.5 END AS tts_volume, CASE kind WHEN 'news' THEN 0.6::DOUBLE WHEN 'educational' THEN 0.8 ELSE 0.25 END AS original_volume,
 CASE shape WHEN '16:9' THEN 1920 ELSE 1080 END AS width, CASE shape WHEN '16:9' THEN 1080 WHEN '1:1' THEN 1080 WHEN '3:4' THEN 1440 ELSE 1920 END AS height FROM b""")
def profile_lookup(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "news").when(e % 3 == 1, "educational").otherwise("other")
    shape = F.when(e % 4 == 0, "16:9").when(e % 4 == 1, "1:1").when(e % 4 == 2, "3:4").otherwise("x")
    out = _read(spark, sf, "events").select("event_id", media.volumes_for(kind, (0.5, 0.25, 0.125)).alias("v"), media.size_for(shape).alias("s"))
    return out.select("event_id", "v.tts_volume", "v.original_volume", "s.width", "s.height")


# --- checks and reports -------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_id AS e, CASE WHEN event_id % 5 = 0 THEN '00:00:01,000-00:00:02' ELSE '00:00:01,000-00:00:02,000' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END END AS ts,
 CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'p' END AS pic, event_id % 11 AS id, event_id % 4 AS ost FROM events)
SELECT e AS event_id, CASE WHEN e % 5 = 0 THEN 'timestamp_format' WHEN pic = ' ' THEN 'empty_picture' WHEN id = 0 THEN 'invalid_id' END AS loose,
 CASE WHEN id = 0 THEN 'invalid_id' WHEN e % 5 = 0 OR e % 7 = 0 THEN 'timestamp_format' WHEN pic = ' ' THEN 'empty_picture' WHEN ost = 3 THEN 'invalid_ost' END AS strict,
 CASE WHEN pic = ' ' THEN 'empty_title' WHEN e % 5 = 0 OR e % 7 = 0 THEN 'timestamp_format' END AS plot FROM b""")
def script_item_checks(spark, sf):
    e, good = F.col("event_id"), F.lit("00:00:01,000-00:00:02,000")
    ts = F.when(e % 5 == 0, "00:00:01,000-00:00:02").otherwise(F.concat(good, F.when(e % 7 == 0, "x").otherwise("")))
    pic = F.when(e % 3 == 0, " ").otherwise("p")
    return _read(spark, sf, "events").select(
        "event_id", checks.narration_item(ts, pic, F.lit("n"), e % 11).alias("loose"), checks.strict_narration_item(ts, pic, F.lit("n"), e % 11, e % 4).alias("strict"), checks.plot_point(ts, pic, F.lit("p")).alias("plot"),
    )


@query("""WITH m AS (SELECT event_id AS e, CASE event_id % 5 WHEN 0 THEN 'Reinitializing Filters' WHEN 1 THEN 'no NVENC here' WHEN 2 THEN 'bad preset' WHEN 3 THEN 'No such file' ELSE 'boom' END AS msg,
 CASE event_id % 4 WHEN 0 THEN 'OpenAI/m-' || event_id WHEN 1 THEN '/m' WHEN 2 THEN 'a b/m' ELSE 'mx' END AS model FROM events)
SELECT e AS event_id, CASE e % 5 WHEN 0 THEN 'filter_chain_error' WHEN 1 THEN 'hardware_error' WHEN 2 THEN 'encoder_error' WHEN 3 THEN 'file_error' ELSE 'unknown_error' END AS tool,
 CASE e % 4 WHEN 1 THEN 'bad_form' WHEN 2 THEN 'bad_provider' WHEN 3 THEN 'too_short' END AS model, CASE WHEN e % 4 = 0 THEN 'm-' || e ELSE model END AS plain,
 CASE e % 3 WHEN 0 THEN 'authentication' WHEN 1 THEN 'rate_limit' ELSE 'server' END AS http FROM m""")
def error_classes(spark, sf):
    e = F.col("event_id")
    msg = F.when(e % 5 == 0, "Reinitializing Filters").when(e % 5 == 1, "no NVENC here").when(e % 5 == 2, "bad preset").when(e % 5 == 3, "No such file").otherwise("boom")
    model = F.when(e % 4 == 0, F.concat(F.lit("OpenAI/m-"), e.cast("string"))).when(e % 4 == 1, "/m").when(e % 4 == 2, "a b/m").otherwise("mx")
    status = F.when(e % 3 == 0, 401).when(e % 3 == 1, 429).otherwise(503)
    return _read(spark, sf, "events").select(
        "event_id", checks.tool_error(msg).alias("tool"), checks.model_name(model).alias("model"), checks.plain_model_name(model).alias("plain"), checks.http_error(status).alias("http"),
    )


@query("""SELECT event_id, list_filter(['summary', 'plot_points'], lambda f: (f = 'summary' AND event_id % 2 = 0) OR (f = 'plot_points' AND event_id % 3 = 0)) AS missing FROM events""")
def json_missing_fields(spark, sf):
    e = F.col("event_id")
    js = F.concat(F.lit('{"a": 1'), F.when(e % 2 != 0, ', "summary": "s"').otherwise(""), F.when(e % 3 != 0, ', "plot_points": []').otherwise(""), F.lit("}"))
    return _read(spark, sf, "events").select("event_id", checks.missing_fields(js, ["summary", "plot_points"]).alias("missing"))


@query(f"""WITH {_T30M}, p AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY drama_id ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM fin)
SELECT drama_id, '[' || string_agg('{{"index":' || rnk || ',"episode":' || episode_index || ',"start_in_video":' || round(pos, 1) || ',"duration":' || round(duration, 1) || ',"original_time":"E' || episode_index || ' '
 || CAST(round_even(start_time, 0) AS BIGINT) || 's-' || CAST(round_even(start_time + duration, 0) AS BIGINT) || 's","subtitle_preview":"","score":' || round(total_score_raw, 4) || '}}', ',' ORDER BY rnk) || ']' AS timeline FROM p GROUP BY 1""")
def prompt_timeline(spark, sf):
    return reports.prompt_timeline(_selected(spark, sf, 2, 30.0).withColumn("subtitle_text", F.lit(None).cast("string")))


@query(f"""WITH {_UNIQ} SELECT _id, e - duration AS position FROM ed WHERE ost != 1""")
def audio_timeline(spark, sf):
    items = _script_items(spark, sf).withColumn("audio", F.when(F.col("OST") != 1, "a.mp3"))
    return reports.audio_timeline(items).select("_id", "position")


_TURN_SQL = "c AS (SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1), t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM c)"


@query(f"""WITH {_TURN_SQL} SELECT conv_id AS group_id, CAST(batch AS BIGINT) AS batch_index, string_agg('=== [E1] ' || turn || ' ===' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM t GROUP BY 1, 2""")
def analysis_texts(spark, sf):
    rows = reports.in_batches(_cues(spark, sf), 3, ["conv_id"], ["turn"])
    return reports.analysis_texts(rows.select(F.col("conv_id").alias("group_id"), "batch_index", F.col("turn").alias("frame_no"), F.lit(1).alias("episode"), F.col("turn").cast("string").alias("timestamp"), "text"))


@query(f"""WITH {_TURN_SQL}, f AS (SELECT conv_id, batch, string_agg('  - ' || turn || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn) AS fs, min(turn) AS t0 FROM t GROUP BY 1, 2)
SELECT conv_id AS group_id, string_agg('## 片段 ' || (batch + 1) || chr(10) || '- 时间范围：' || t0 || chr(10) || '- 片段描述：s' || chr(10) || '- 详细描述：' || chr(10) || CASE WHEN batch = 1 THEN '' ELSE fs END || chr(10), '' ORDER BY batch) AS markdown FROM f GROUP BY 1""")
def frame_report(spark, sf):
    rows = reports.in_batches(_cues(spark, sf), 3, ["conv_id"], ["turn"]).withColumnRenamed("conv_id", "group_id")
    heads = rows.groupBy("group_id", "batch_index").agg(F.min("turn").cast("string").alias("time_range")).withColumns({"ord": F.col("batch_index"), "summary": F.lit("s")})
    frames = rows.where("batch_index != 1").select("group_id", "batch_index", F.col("turn").alias("frame_no"), F.col("turn").cast("string").alias("timestamp"), F.col("text").alias("observation"))
    return reports.frame_report(heads, frames)


@query("""SELECT user_id, count(*) AS n, count_if(value > 50) AS n_ok, round(count_if(value > 50) * 100.0::DOUBLE / count(*), 1) AS success_rate,
 CASE WHEN count_if(value > 50) = 0 THEN 'failed' WHEN (count(*) - count_if(value > 50)) * 2 > count(*) THEN 'warn' ELSE 'ok' END AS level FROM events GROUP BY 1""")
def failure_levels(spark, sf):
    return reports.failure_levels(_read(spark, sf, "events").select("user_id", (F.col("value") > 50).alias("ok")), "user_id")


@query("""SELECT 'k' || (c_nationkey % 3) AS kind, count(*) AS total, count_if(c_custkey % 4 != 0) AS valid, coalesce(list('no key ' || c_custkey ORDER BY c_custkey) FILTER (c_custkey % 4 = 0), []) AS errors FROM customer GROUP BY 1""")
def config_summary(spark, sf):
    k = F.col("c_custkey")
    errors = F.when(k % 4 == 0, F.array(F.concat(F.lit("no key "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = _read(spark, sf, "customer").select(F.concat(F.lit("k"), (F.col("c_nationkey") % 3).cast("string")).alias("kind"), k.alias("provider"), errors.alias("errors"))
    return reports.config_summary(rows)
