"""Registered queries of scene numbering, frame sampling, subtitle assembly, readers, rules and repaired forms, with oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import checks, media, scoring, serialize, text, timecode, voices
from .operators import catalog, emotion, features, positions, records, reports, rules, sampling, segmentation, timeline
from .plans import highlights
from .queries import _FIT, _ITEMS, _items, _read, query
from .sources import files, stock

# --- subtitles ---------------------------------------------------------------------------------------------------

_T1, _T2 = "00:00:01,000 --> 00:00:02,000", "00:00:03,000 --> 00:00:04,000"


@query(f"""WITH f AS (SELECT o_orderkey AS file_id, o_orderkey % 5 AS k, 'A' || o_orderkey AS a FROM orders)
SELECT file_id, CAST(1 AS INTEGER) AS "index", CASE k WHEN 2 THEN '{_T2}' ELSE '{_T1}' END AS times, CASE k WHEN 2 THEN a || chr(10) || '2' || chr(10) || 'B' ELSE a END AS text FROM f WHERE k < 4
UNION ALL SELECT file_id, CAST(2 AS INTEGER), '{_T2}', 'B' || chr(10) || 'C' FROM f WHERE k = 0""")
def strict_srt_read(spark, sf):
    """Files with a lost last cue, without a blank line between cues, with lines of several kinds of white space, and empty ones."""
    n, k = F.concat(F.lit("A"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 5
    two = F.concat(F.lit(f"1\n{_T1}\n"), n, F.lit(f"\n\n2\n{_T2}\nB\nC\n"))
    srt = (
        F.when(k == 0, F.concat(two, F.lit("\n"))).when(k == 1, two).when(k == 2, F.concat(F.lit(f"1\n{_T1}\n"), n, F.lit(f"\n2\n{_T2}\nB\n\n")))
        .when(k == 3, F.concat(F.lit(f"x\r\n\r\n {_T1} \r\n  "), n, F.lit(" \r\n　\r\n"))).otherwise("")
    )
    return files.strict_srt(_read(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), srt.alias("text")))


_CHOSEN = """s AS (SELECT o_custkey AS job, o_orderkey AS id, 1.0::DOUBLE + (o_orderkey % 20) / 4.0::DOUBLE AS d, o_orderkey % 3 AS k FROM orders),
p AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY job ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM s)"""


def _chosen(spark, sf):
    o = _read(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    segments = o.select(
        F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("segment_id"), (F.lit(1.0) + (F.col("o_orderkey") % 20) / 4.0).alias("duration"),
        F.when(k == 1, F.concat(F.lit("L0 "), F.col("o_orderkey").cast("string"), F.lit("\n L1"))).otherwise("").alias("subtitle_text"),
    )
    cue = F.array(F.struct(F.lit(0).alias("cue_idx"), F.lit(0.25).alias("start"), F.lit(1.0).alias("end"), F.lit("c").alias("text")), F.struct(F.lit(1).alias("cue_idx"), F.lit(1.0).alias("start"), F.lit(1.5).alias("end"), F.lit("d").alias("text")))
    return segments, o.where(k == 0).select(F.col("o_orderkey").alias("segment_id"), F.inline(cue))


@query(f"""WITH {_CHOSEN}, c AS (SELECT job, id, 0 AS i, beg + 0.25 AS s, beg + 1.0 AS e, 'c' AS t FROM p WHERE k = 0 UNION ALL SELECT job, id, 1, beg + 1.0, beg + 1.5, 'd' FROM p WHERE k = 0
UNION ALL SELECT job, id, i, beg + d / 2 * i, beg + d / 2 * (i + 1), CASE i WHEN 0 THEN 'L0 ' || id ELSE 'L1' END FROM p, range(2) r(i) WHERE k = 1)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY id, i) AS INTEGER) AS cue_no, id AS segment_id, s AS "start", e AS "end", t AS text FROM c""")
def subtitle_assembly(spark, sf):
    return timeline.assemble_subtitles(*_chosen(spark, sf))


@query(f"""WITH {_CHOSEN}, c AS (SELECT job, id, 0 AS i, 0.25::DOUBLE AS s, 1.0::DOUBLE AS e, 'c' AS t FROM p WHERE k = 0 UNION ALL SELECT job, id, 1, 1.0, 1.5, 'd' FROM p WHERE k = 0
UNION ALL SELECT job, id, i, beg + d / 2 * i, beg + d / 2 * (i + 1), CASE i WHEN 0 THEN 'L0 ' || id ELSE 'L1' END FROM p, range(2) r(i) WHERE k = 1),
l AS (SELECT job, id, max_by(e - s, i) AS step FROM c GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY job ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT c.job, CAST(row_number() OVER (PARTITION BY c.job ORDER BY c.id, i) AS INTEGER) AS cue_no, c.id AS segment_id, round(off + s, 6) AS "start", round(off + e - s, 6) AS "end", t AS text FROM c JOIN o ON c.job = o.job AND c.id = o.id""")
def subtitle_assembly_shifts(spark, sf):
    """The sums of the formula to match: shifts by shown lengths, made-up lines shifted twice."""
    out = timeline.assemble_subtitles(*_chosen(spark, sf), faithful=True)
    return out.withColumns({c: F.round(c, 6) for c in ("start", "end")})


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN '' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, last_value(right(nullif(t, ''), 50) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context FROM x""")
def prompt_context(spark, sf):
    rows = _read(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 2, "").otherwise(F.col("text")))
    return timeline.context_tail(rows, "conv_id", "turn").select("conv_id", "turn", "context")


# --- scenes and frames -------------------------------------------------------------------------------------------

#: Pieces of a raw scene of length d, and the scene numbers of a relation r(v, i, s, e) of raw scenes.
_PIECES = "CASE WHEN e - s < 2 THEN 0 WHEN e - s > 8 THEN CAST(floor((e - s) / 8) AS BIGINT) + CASE WHEN (e - s) - floor((e - s) / 8) * 8 >= 2 THEN 1 ELSE 0 END ELSE 1 END"
_NUMBERED = f"""n AS (SELECT *, {_PIECES} AS k FROM r), b AS (SELECT *, i + 1 + coalesce(sum(k) OVER (PARTITION BY v ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n),
q AS (SELECT v, CAST(base + p AS BIGINT) AS scene_index, s + CASE WHEN e - s > 8 THEN p * 8.0::DOUBLE ELSE 0.0 END AS start_time, CASE WHEN e - s > 8 THEN least(e, s + p * 8.0::DOUBLE + 8) ELSE e END AS end_time FROM b, LATERAL (SELECT unnest(range(k)) AS p))"""


@query(f"""WITH l AS (SELECT user_id AS v, event_id, (event_id * 7 % 200) / 8.0::DOUBLE AS d FROM events), r AS (SELECT v, row_number() OVER w - 1 AS i, coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS s,
 sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS e FROM l WINDOW w AS (PARTITION BY v ORDER BY event_id)), {_NUMBERED} SELECT v AS video_id, scene_index, start_time, end_time, end_time - start_time AS duration FROM q""")
def scene_index(spark, sf):
    w = Window.partitionBy("video_id").orderBy("event_id")
    e = _read(spark, sf, "events").select(F.col("user_id").alias("video_id"), "event_id", ((F.col("event_id") * 7 % 200) / 8.0).alias("d"))
    end = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    raw = e.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (end - F.col("d")).alias("start_time"), end.alias("end_time"))
    return segmentation.numbered_scenes(raw, 2.0, 8.0)


@query(f"""WITH RECURSIVE ep AS (SELECT c_nationkey AS drama_id, c_custkey AS v, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS episode_index, CASE WHEN c_custkey % 7 > 0 THEN 60.0::DOUBLE + c_custkey % 50 END AS d FROM customer),
p AS (SELECT DISTINCT v, CAST(o_orderkey % 100 AS DOUBLE) AS ts FROM orders JOIN ep ON v = o_custkey WHERE d IS NOT NULL),
rec(v, ts) AS (SELECT DISTINCT v, 0.0::DOUBLE FROM p UNION ALL SELECT x.v, (SELECT min(p.ts) FROM p WHERE p.v = x.v AND p.ts - x.ts >= 2) FROM rec x WHERE x.ts IS NOT NULL),
g AS (SELECT v, ts FROM rec WHERE ts IS NOT NULL UNION ALL SELECT v, max(d) FROM (SELECT rec.v, rec.ts, d FROM rec JOIN ep USING (v) WHERE ts IS NOT NULL) GROUP BY v HAVING max(d) - max(ts) > 1),
r AS (SELECT * FROM (SELECT v, row_number() OVER w - 1 AS i, ts AS s, lead(ts) OVER w AS e FROM g WINDOW w AS (PARTITION BY v ORDER BY ts)) WHERE e IS NOT NULL), {_NUMBERED},
a AS (SELECT * FROM q UNION ALL SELECT v, 1, 0.0, coalesce(d, 60.0) FROM ep WHERE v NOT IN (SELECT v FROM p))
SELECT drama_id, episode_index, v AS video_id, scene_index, start_time, end_time, end_time - start_time AS duration, 'ep' || episode_index || '_scn' || scene_index || '_' || printf('%.1f', start_time) || 's' AS segment_id FROM a JOIN ep USING (v)""")
def episode_scenes(spark, sf):
    """All episodes of all dramas in one job: change points, numbered scenes, whole episodes where nothing could be scanned."""
    c = _read(spark, sf, "customer")
    episodes = c.select(F.col("c_nationkey").alias("drama_id"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("video_id"), F.when(F.col("c_custkey") % 7 > 0, 60.0 + F.col("c_custkey") % 50).alias("duration"))
    diffs = _read(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 100).cast("double").alias("ts"), F.lit(80.0).alias("diff"))
    return segmentation.as_segments(segmentation.episode_scenes(episodes, diffs, 30.0, 2.0, 8.0))


_VIDEOS = """v AS (SELECT c_custkey AS video_id, CASE c_custkey % 4 WHEN 1 THEN 0.0 WHEN 2 THEN 30.0 WHEN 3 THEN 23.5 END::DOUBLE AS fps, c_custkey * 13 % 900 AS total FROM customer),
iv AS (SELECT video_id, total, greatest(1, CAST(floor((CASE WHEN coalesce(fps, 0) = 0 THEN 25.0 ELSE fps END) / 2.0) AS BIGINT)) AS step FROM v),
grid AS (SELECT video_id, CAST(i AS BIGINT) AS sample, i * step AS frame_no FROM iv, LATERAL (SELECT unnest(range(CAST(ceil(total / step::DOUBLE) AS BIGINT))) AS i) WHERE total > 0)"""


def _videos(spark, sf):
    k = F.col("c_custkey") % 4
    fps = F.when(k == 1, 0.0).when(k == 2, 30.0).when(k == 3, 23.5)
    return _read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), fps.alias("fps"), (F.col("c_custkey") * 13 % 900).alias("total_frames"))


@query(f"""WITH {_VIDEOS}, f AS (SELECT o_custkey AS video_id, o_orderkey * 37 % 900 AS found_no, max(o_totalprice) AS sharpness FROM orders GROUP BY 1, 2)
SELECT grid.video_id, sample, frame_no, found_no, sharpness FROM grid ASOF LEFT JOIN f ON grid.video_id = f.video_id AND grid.frame_no >= f.found_no""")
def sampled_frames(spark, sf):
    stored = _read(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") * 37 % 900).alias("frame_no"), F.col("o_totalprice").alias("sharpness"))
    return sampling.sampled_frames(_videos(spark, sf), stored, 2.0).select("video_id", "sample", "frame_no", "found_no", "sharpness")


@query("""WITH v AS (SELECT c_custkey AS video_id, 24.0::DOUBLE + c_custkey % 7 AS fps, CASE WHEN c_custkey % 50 = 0 THEN 8000.5::DOUBLE ELSE (c_custkey * 17 % 600) / 2.0::DOUBLE END AS d FROM customer), t AS (SELECT *, unnest(range(CAST(ceil(d / 2.5) AS BIGINT))) * 2.5::DOUBLE AS s FROM v)
SELECT video_id, s AS seconds, CAST(floor(s * fps) AS BIGINT) AS frame_no, printf('keyframe_%06d_%02d%02d%02d%03d.jpg', CAST(floor(s * fps) AS BIGINT), CAST(floor(s / 3600) AS BIGINT), CAST(floor(s % 3600 / 60) AS BIGINT), CAST(floor(s % 60) AS BIGINT), CAST(floor(s % 1 * 1000) AS BIGINT)) AS file_name FROM t""")
def keyframe_names(spark, sf):
    v = _read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), (24.0 + F.col("c_custkey") % 7).alias("fps"), F.when(F.col("c_custkey") % 50 == 0, 8000.5).otherwise(F.col("c_custkey") * 17 % 600 / 2.0).alias("duration"))
    return sampling.keyframes(v, 2.5)


@query("""WITH t AS (SELECT conv_id, turn, text, turn // 3 AS b FROM conversations), f AS (SELECT conv_id, b, string_agg('  - ' || turn || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn) AS fs FROM t WHERE turn != 1 GROUP BY 1, 2),
s AS (SELECT conv_id, b, row_number() OVER (PARTITION BY conv_id ORDER BY b) AS n FROM (SELECT DISTINCT conv_id, b FROM t))
SELECT s.conv_id AS group_id, string_agg('## 片段 ' || n || chr(10) || '- 时间范围：' || 'r' || s.b || chr(10) || '- 片段描述：' || CASE WHEN s.b = 1 THEN '' ELSE 's' || s.b END || chr(10) || '- 详细描述：' || chr(10) || coalesce(fs, '') || chr(10), '' ORDER BY n) AS markdown
FROM s LEFT JOIN f ON f.conv_id = s.conv_id AND f.b = s.b GROUP BY 1""")
def frame_report_files(spark, sf):
    """The report from nested JSON texts, one scan."""
    t = _read(spark, sf, "conversations").withColumn("b", F.floor(F.col("turn") / 3))
    frames = F.array_sort(F.collect_list(F.when(F.col("turn") != 1, F.struct("turn", F.struct(F.col("b").alias("batch_index"), F.col("turn").alias("frame_number"), F.col("turn").cast("string").alias("timestamp"), F.col("text").alias("observation")).alias("f")))))
    batches = F.array_sort(F.collect_set("b"))
    summary = lambda b: F.struct(b.alias("batch_index"), F.concat(F.lit("r"), b.cast("string")).alias("time_range"), F.when(b != 1, F.concat(F.lit("s"), b.cast("string"))).alias("summary"))
    whole = F.to_json(F.struct(F.transform(batches, summary).alias("overall_activity_summaries"), F.transform(frames, lambda r: r["f"]).alias("frame_observations")))
    texts = t.groupBy(F.col("conv_id").alias("group_id")).agg(whole.alias("text"))
    return reports.frame_report_of_files(files.frame_analyses(texts))


# --- places and orders -------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE value > 40), r AS (SELECT user_id, event_id AS other, event_id % 3 AS ost, event_type = 'click' AS has_audio,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE value <= 40) SELECT user_id, place, event_id, other, ost > 0 AND has_audio AS keep_audio FROM l JOIN r USING (user_id, place)""")
def positional_zip(spark, sf):
    e = _read(spark, sf, "events")
    left = e.where("value > 40").select("user_id", "event_id")
    right = e.where("value <= 40").select("user_id", "event_id", F.col("event_id").alias("other"), positions.keeps_audio(F.col("event_id") % 3, F.col("event_type") == "click").alias("keep_audio"))
    return positions.zip_rows(left, right, "user_id", "event_id", width=512).select("user_id", "place", "event_id", "other", "keep_audio")


@query("""WITH l AS (SELECT c_custkey, c_nationkey, sha256('7:' || c_custkey) AS lot FROM customer) SELECT c_nationkey, arg_min(c_custkey, (lot, c_custkey)) AS picked, coalesce(max(CASE WHEN c_custkey % 100 = 3 THEN c_custkey END), arg_min(c_custkey, (lot, c_custkey))) AS wanted,
 list(c_custkey ORDER BY lot, c_custkey)[1:5] AS first_five FROM l GROUP BY 1""")
def seeded_order(spark, sf):
    """A seeded shuffle's first rows, a pick of one, and a pick of a named one where there is one."""
    c = _read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("lot", "c_custkey"))), lambda r: r["c_custkey"]), 1, 5)
    five = positions.shuffled(c, "c_custkey", 7, "lot").groupBy("c_nationkey").agg(top.alias("first_five"))
    one = positions.pick_one(c, "c_custkey", 7, ["c_nationkey"]).withColumnRenamed("c_custkey", "picked")
    last = c.groupBy(F.col("c_nationkey").alias("_n")).agg(F.max(F.when(F.col("c_custkey") % 100 == 3, F.col("c_custkey"))).alias("_w"))
    named = positions.pick_one(c.join(last, F.col("c_nationkey") == F.col("_n")).drop("_n"), "c_custkey", 7, ["c_nationkey"], F.col("_w")).select("c_nationkey", F.col("c_custkey").alias("wanted"))
    return one.join(named, "c_nationkey").join(five, "c_nationkey")


# --- answers, rules and texts ------------------------------------------------------------------------------------

_MASK = '{"id":%d,"parts":[{"raw":"*** binary data ***","n":%d},{"raw":null,"n":0}],"by":{"%s":{"1":"*** binary data ***"}},"day":null,"none":null}'


@query(f"""SELECT o_orderkey, printf('{_MASK.replace("%d", "%s")}', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus) AS json FROM orders""")
def json_masked(spark, sf):
    raw = F.encode("o_orderstatus", "UTF-8")
    part = F.array(F.struct(raw.alias("raw"), F.col("o_custkey").alias("n")), F.struct(F.lit(None).cast("binary").alias("raw"), F.lit(0).cast("long").alias("n")))
    by = F.create_map(F.col("o_orderstatus"), F.create_map(F.lit(1), raw))
    whole = _read(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), part.alias("parts"), by.alias("by"), F.col("o_orderdate").alias("day"), F.lit(None).cast("string").alias("none")).alias("v"))
    return whole.select("o_orderkey", serialize.to_json(F.col("v"), whole.schema["v"].dataType).alias("json"))


_GOOD = '{"_id": 1, "timestamp": "00:00:01,000-00:00:02,000", "picture": "p", "narration": "n"}'
_POINT = '{"timestamp": "00:00:01-00:00:02", "title": "t", "picture": "p"}'
#: Answers by number: name of the prompt, its format, the output, the expected error and item.
_ANSWERS = [
    ("short_narration", "json", '```json\n{"items": [%s]}\n```' % _GOOD, None, None), ("script_a", "json", 'so: {"items": []} ok', "empty_items", None),
    ("script_a", "json", '{"clips": []}', "missing_items", None), ("narration", "json", '{"items": {}}', "items_no_list", None),
    ("narration", "json", '{"items": [%s, {"_id": 2}]}' % _GOOD, "missing_timestamp", 2), ("narration", "json", '{"items": [%s]}' % _GOOD.replace('"_id": 1', '"_id": "1"'), "bad__id", 1),
    ("narration", "json", '{"items": [%s]}' % _GOOD.replace('"n"', '"　\\n"'), "empty_narration", 1), ("narration", "json", '{"items": [%s]}' % _GOOD.replace("}", ', "OST": 3}'), "bad_OST", 1),
    ("plot_points", "json", '{"summary": "s", "plot_points": [%s]}' % _POINT, None, None), ("analysis", "json", '{"summary": "s", "plot_points": [%s, %s]}' % (_POINT, _POINT.replace("02", "2")), "timestamp_format", 2),
    ("other", "json", "[1, 2]", None, None), ("other", "structured", "no json", "no_json", None), ("other", "text", "anything", None, None), ("other", "yaml", "x", "bad_format", None),
]


def _cases(column: int, sql: bool):
    n = len(_ANSWERS)
    if sql:
        lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
        return f"CASE o_orderkey % {n} " + " ".join(f"WHEN {i} THEN {lit(a[column])}" for i, a in enumerate(_ANSWERS)) + " END"
    out = F
    for i, a in enumerate(_ANSWERS):
        out = out.when(F.col("o_orderkey") % n == i, F.lit(a[column]))
    return out


@query(f"SELECT o_orderkey, {_cases(3, True)} AS error, CAST({_cases(4, True)} AS INTEGER) AS item FROM orders")
def answer_rules(spark, sf):
    """Answers of fourteen kinds against rules that are rows."""
    answers = _read(spark, sf, "orders").select("o_orderkey", _cases(0, False).alias("name"), _cases(1, False).alias("output_format"), _cases(2, False).alias("output"))
    return rules.validate(answers, rules.default_rules(spark), "o_orderkey")


@query("""SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER w THEN '[' ELSE '' END || '{"role":"' || role || '","n":' || length(text) || '}' || CASE WHEN turn = max(turn) OVER w THEN ']' ELSE ',' END AS text
FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def script_file_lines(spark, sf):
    """The lines of a JSON file for each conversation."""
    c = _read(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return files.json_lines_of_lists(c, "conv_id", "turn")


@query("""SELECT o_orderkey, 'frame_' || printf('%02d:%02d:%02d,250', 0, CAST(o_orderkey % 60 AS INTEGER), 5) || '_' || printf('%02d:%02d:%02d,000', CAST(o_orderkey % 9000 // 3600 AS INTEGER), CAST(o_orderkey % 9000 % 3600 // 60 AS INTEGER), CAST(o_orderkey % 60 AS INTEGER)) || '.txt' AS file_name,
 'r ' || o_orderkey AS text FROM orders WHERE o_orderkey % 3 > 0""")
def analysis_file_names(spark, sf):
    n = F.col("o_orderkey")
    first = F.format_string("/f/keyframe_000001_00:%02d:05,250.jpg", n % 60)
    last = F.format_string("/f/keyframe_000009_%09d.jpg", n % 9000)
    paths = F.when(n % 3 > 0, F.array(first, F.lit("x.jpg"), last)).otherwise(F.array().cast("array<string>"))
    results = _read(spark, sf, "orders").select("o_orderkey", paths.alias("image_paths"), F.concat(F.lit("\n r "), n.cast("string"), F.lit(" \n　")).alias("response"))
    return files.analysis_file_names(results).select("o_orderkey", "file_name", "text")


@query("""SELECT p_partkey, upper(p_name) || ' ${x|upper} ${p|none} ' || lower(p_brand) || ', ' || p_brand || '/' || p_brand || ' ' || CASE WHEN length(p_name) <= 100 THEN p_name ELSE left(p_name, 100) || '...' END AS t,
 ['x'] AS missing FROM part""")
def template_with_filters(spark, sf):
    """Filters within a template, an unknown variable and an unknown filter."""
    t = F.lit("${p|upper} ${x|upper} ${p|none} ${ b | lower }, $b/${b} ${p|truncate}")
    values = {"p": F.col("p_name"), "b": F.col("p_brand")}
    return _read(spark, sf, "part").select("p_partkey", text.render(t, values).alias("t"), text.missing_values(t, values).alias("missing"))


@query(r"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{"1":"a"}' WHEN 2 THEN '["a","b"]' WHEN 3 THEN '1000' WHEN 4 THEN '"{1, 2}"' WHEN 5 THEN '["it''s","say \"x\""]' WHEN 6 THEN '[0.5,5,[true,null]]' ELSE '[]' END AS value FROM events""")
def type_recovery_forms(spark, sf):
    """Tuples, number keys, both kinds of quotation marks, grouped digits, a set, escapes, numbers in short form, an empty tuple."""
    k, out = F.col("event_id") % 8, F
    for i, raw in enumerate(["(1, 2)", "{1: 'a'}", "['a', \"b\"]", "1_000", "{1, 2}", "[\"it's\", 'say \"x\"']", "(.5, +5, (True, None,),)", "()"]):
        out = out.when(k == i, raw)
    return _read(spark, sf, "events").select("event_id", F.to_json(text.recover_type(out)).alias("value"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 3 END AS first_clip FROM orders""")
def clip_lists(spark, sf):
    """The first list in the text, not by name; a list itself; ``clips``; none."""
    k, out = F.col("o_orderkey") % 4, F
    for i, raw in enumerate(['{"z": [{"n": 1}], "a": [{"n": 2}]}', '```json\n[{"n": 7}]\n```', '{"a": [{"n": 4}], "clips": [{"n": 3}]}', '{"a": 1}']):
        out = out.when(k == i, raw)
    return _read(spark, sf, "orders").select("o_orderkey", F.get(text.clip_list(out, "struct<n:int>"), F.lit(0))["n"].alias("first_clip"))


@query("""SELECT page_id, replace(replace(replace(html, '&gt;', '>'), '&lt;', '<'), '&amp;', '&') AS plain FROM pages""")
def xml_entities(spark, sf):
    return _read(spark, sf, "pages").select("page_id", text.unescape_xml(F.col("html")).alias("plain"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'blank_picture' WHEN 1 THEN 'blank_narration' WHEN 2 THEN NULL ELSE 'bad_narration' END AS error FROM orders""")
def script_blanks(spark, sf):
    """Texts of an ideographic space or of line feeds are blank, in typed items and in JSON."""
    k = F.col("o_orderkey") % 4
    items = _read(spark, sf, "orders").select(
        "o_orderkey", F.lit(1).alias("_id"), F.lit("00:00:01,000-00:00:02,000").alias("timestamp"), F.when(k == 0, "　").otherwise("p").alias("picture"), F.when(k == 1, "\n ").otherwise("n").alias("narration"), F.lit(1).alias("OST")
    )
    script = F.lit('[{"_id": 1, "timestamp": "00:00:01,000-00:00:02,000", "picture": "p", "narration": "\\u2003\\n", "OST": 1}]')
    return catalog.check_script(items).select("o_orderkey", F.when(k == 3, catalog.check_script_text(script)["error"]).otherwise(F.col("error")).alias("error"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'T' ELSE 'AI解说文案' END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'a None 5' WHEN 1 THEN 'whole' WHEN 2 THEN 'one two' ELSE 'no json ' || o_orderkey END AS full_text,
 CASE o_orderkey % 4 WHEN 0 THEN '0.0/a/true;2.5/None/false;1.0/5/false' WHEN 1 THEN '' WHEN 2 THEN '0.0/one/false;0.0/two/false' ELSE '' END AS segments FROM orders""")
def narration_answers(spark, sf):
    """Segments as records with values of other types, as strings, and answers that do not parse."""
    k, out = F.col("o_orderkey") % 4, F
    raws = ['{"title": "T", "segments": [{"text": "a", "emphasis": "yes"}, {"timestamp": "2.5", "text": null, "emphasis": 0}, {"timestamp": true, "text": 5}, 7]}', 'x ```json\n{"full_text": "whole"}\n```', 'a {"segments": ["one", "two"]} b']
    for i, raw in enumerate(raws):
        out = out.when(k == i, raw)
    s = text.narration_script(out.otherwise(F.concat(F.lit("no json "), F.col("o_orderkey").cast("string"))))
    shown = F.array_join(F.transform(s["segments"], lambda x: F.concat_ws("/", x["timestamp"].cast("string"), x["text"], x["emphasis"].cast("string"))), ";")
    return _read(spark, sf, "orders").select("o_orderkey", s["title"].alias("title"), s["full_text"].alias("full_text"), shown.alias("segments"))


# --- times -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ITEMS}, u AS (SELECT script_id, ord, min(duration) AS q FROM items GROUP BY 1, 2), r AS (SELECT *, CASE WHEN ord = 3 THEN 0 ELSE 3540 + CAST(floor(q) AS BIGINT) % 60 END AS len FROM u), e AS (SELECT *, sum(len) OVER (PARTITION BY script_id ORDER BY ord) AS e FROM r)
SELECT script_id, ord, CASE WHEN ord != 3 THEN printf('%02d:%02d-%02d:%02d', CAST((e - len) // 60 AS BIGINT), CAST((e - len) % 60 AS BIGINT), CAST(e // 60 AS BIGINT), CAST(e % 60 AS BIGINT)) END AS new_timestamp, CASE WHEN ord = 2 THEN '原声播放_' || left(md5(script_id || '/' || ord), 8) ELSE 'n' END AS narration FROM e""")
def new_timestamps_long(spark, sf):
    """Edits of over 100 minutes, ranges without a dash, blank narrations."""
    items = _items(spark, sf).select("script_id", "ord", "duration").repartition("script_id").groupBy("script_id", "ord").agg(F.min("duration").alias("q"))
    stamp = F.when(F.col("ord") == 3, "05:00").otherwise(F.concat(F.lit("00:00-59:"), timecode.digits(F.floor("q") % 60, 2)))
    items = items.withColumns({"timestamp": stamp, "narration": F.when(F.col("ord") == 2, "").otherwise("n")})
    return timeline.new_timestamps(items, minutes=True).select("script_id", "ord", "new_timestamp", "narration")


_HMS = "printf('%02d:%02d:%02d,%03d', CAST({0} // 3600000 AS BIGINT), CAST({0} // 60000 % 60 AS BIGINT), CAST({0} // 1000 % 60 AS BIGINT), CAST({0} % 1000 AS BIGINT))"


@query(f"""WITH {_ITEMS}, u AS (SELECT script_id, ord, min(duration) AS q FROM items GROUP BY 1, 2), r AS (SELECT *, CAST(60000 * ord + 250 * (CAST(floor(q) AS BIGINT) % 4) AS BIGINT) AS len FROM u), e AS (SELECT *, CAST(sum(len) OVER (PARTITION BY script_id ORDER BY ord) AS BIGINT) AS e FROM r)
SELECT script_id, ord, {_HMS.format('(e - len)')} || '-' || {_HMS.format('e')} AS new_timestamp FROM e""")
def new_timestamps_full(spark, sf):
    """Places in the edit with milliseconds, from codes of minutes and of hours."""
    items = _items(spark, sf).select("script_id", "ord", "duration").repartition("script_id").groupBy("script_id", "ord").agg(F.min("duration").alias("q"))
    ms = timecode.digits(F.floor("q") % 4 * 250, 3)
    stamp = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("00:00-"), timecode.digits(F.col("ord"), 2), F.lit(":00,"), ms)).otherwise(F.concat(F.lit("00:01:00-00:"), timecode.digits(F.col("ord") + 1, 2), F.lit(":00,"), ms))
    return timeline.new_timestamps(items.withColumn("timestamp", stamp)).select("script_id", "ord", "new_timestamp")


@query("""WITH x AS (SELECT event_id AS n, event_id % 6 AS k, event_id % 90 AS s FROM events) SELECT n AS event_id, CASE k WHEN 0 THEN CASE WHEN s < 10 THEN '00:00:00,000' ELSE printf('00:%02d:%02d,000', CAST(s // 60 AS INTEGER), CAST(s % 60 AS INTEGER)) END WHEN 1 THEN printf('%02d:%02d:00,007', CAST(s // 60 AS INTEGER), CAST(s % 60 AS INTEGER)) WHEN 2 THEN printf('01:%02d:%02d,250', CAST(s // 60 AS INTEGER), CAST(s % 60 AS INTEGER))
 WHEN 3 THEN printf('00:%02d:%02d,000', CAST((1000 + s) // 60 AS INTEGER), CAST((1000 + s) % 60 AS INTEGER)) ELSE '00:00:00,000' END AS code FROM x""")
def script_time_forms(spark, sf):
    """Codes whose seconds and minutes carry over, short ones and broken ones."""
    n, k, s = F.col("event_id"), F.col("event_id") % 6, F.col("event_id") % 90
    raw = (
        F.when(k == 0, F.format_string("0:%d", s)).when(k == 1, F.format_string("%d:00,7", s)).when(k == 2, F.format_string("1:0:%d,250", s)).when(k == 3, (s + 1000).cast("string"))
        .when(k == 4, "1:2").otherwise("ab:cd")
    )
    return _read(spark, sf, "events").select(n, records.script_time(raw).alias("code"))


@query("""WITH x AS (SELECT event_id, (event_id % 20000) / 8.0::DOUBLE AS t FROM events) SELECT event_id, printf('%02d:%02d:%02d,%03d', CAST(floor(t / 3600) AS INTEGER), CAST(floor(t % 3600 / 60) AS INTEGER), CAST(floor(t % 60) AS INTEGER), CAST(floor(t * 1000) AS BIGINT) % 1000) AS modulo,
 printf('%02d:%02d:%06.3f', CAST(floor(t / 3600) AS INTEGER), CAST(floor(t % 3600 / 60) AS INTEGER), t % 60) AS dotted, floor(t) AS strict, CAST(floor(t * 25) AS BIGINT) AS frame, printf('00:%02d:05', CAST(event_id % 60 AS INTEGER)) || '-00:10:00' AS audio, ['00:01:02', '00:03:04'] AS minutes, event_id % 2 = 0 AS has_code,
 CASE event_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 60.0 ELSE 5.0 END::DOUBLE AS sane, printf('00-%02d-05-250', CAST(event_id % 60 AS INTEGER)) AS safe, (event_id * 10000)::DOUBLE / 10000000.0::DOUBLE AS tick_seconds, CAST(ceil((event_id % 10) / 2.5::DOUBLE) AS INTEGER) AS grid_points,
 CASE WHEN event_id % 2 = 0 THEN (event_id % 10 * 1000 + 250) * 10000 END AS ticks, printf('00:%02d:%02d,%03d', CAST((event_id % 60 + 2) // 60 AS INTEGER), CAST((event_id % 60 + 2) % 60 AS INTEGER), 750) AS added FROM x""")
def timecode_forms(spark, sf):
    """T2, T3, T6, T10, T13, T16 to T21 and R3 side by side."""
    n = F.col("event_id")
    t, m = (n % 20000) / 8.0, F.format_string("%02d", n % 60)
    return _read(spark, sf, "events").select(
        "event_id", timecode.to_srt_modulo(t).alias("modulo"), timecode.to_dotted(t).alias("dotted"), timecode.from_strict(timecode.to_clock(t)).alias("strict"), timecode.frame_number(t, F.lit(25.0)).alias("frame"),
        timecode.audio_range(F.concat(F.lit("audio_00_"), m, F.lit("_05-00_10_00.mp3"))).alias("audio"), timecode.minute_range(F.lit("01:02 - 03:04")).alias("minutes"),
        timecode.has_timecode(F.when(n % 2 == 0, "x 00:00:01.000-->00:00:02,000").otherwise("00:00:01 --> 00:00:02")).alias("has_code"),
        timecode.sane_duration(F.when(n % 3 == 0, 4.0).otherwise(400.0), F.when(n % 3 == 1, "00:00:00-00:01:00").otherwise("x")).alias("sane"), timecode.path_safe(F.concat(F.lit("00:"), m, F.lit(":05,250"))).alias("safe"),
        timecode.ticks_to_seconds(n * 10000).alias("tick_seconds"), F.size(timecode.grid((n % 10).cast("double"), 2.5)).alias("grid_points"),
        timecode.ticks(F.when(n % 2 == 0, F.concat(F.lit("0:0:"), (n % 10).cast("string"), F.lit(".25"))).otherwise("x")).alias("ticks"),
        timecode.add_seconds(F.concat(F.lit("00:00:"), m, F.lit(",500")), F.lit(2.0), F.lit(0.25)).alias("added"),
    )


# --- the flagship, from features to what is shown ----------------------------------------------------------------

_DIRECT = f"""seg0 AS (SELECT user_id % 10 AS drama_id, CAST(user_id % 7 + 1 AS INTEGER) AS episode_index, event_id AS ord, (event_id % 997) * 1.25::DOUBLE AS start_time, 1.0::DOUBLE + (event_id % 29) / 4.0::DOUBLE AS d, value,
 (event_id % 997) * 1.25::DOUBLE AS s, 2000.0::DOUBLE AS e, (event_id % 997) * 1.25::DOUBLE / 2000.0::DOUBLE AS r, event_type FROM events),
sc AS (SELECT *, CASE WHEN ord % 4 = 0 THEN CASE WHEN d BETWEEN 2 AND 5 THEN 0.45::DOUBLE WHEN d BETWEEN 1 AND 8 THEN 0.30 ELSE 0.15 END WHEN ord % 4 = 1 THEN 0.3 ELSE (ord * 37 % 1001) / 1000.0::DOUBLE END AS a,
 CASE WHEN event_type = 'click' THEN 0.1::DOUBLE WHEN ord % 5 = 0 THEN 0.2 ELSE (ord * 13 % 1001) / 1000.0::DOUBLE END AS m, CASE WHEN ord % 3 = 0 THEN 0.2::DOUBLE WHEN ord % 3 = 1 THEN 0.3 ELSE (ord * 7 % 1001) / 1000.0::DOUBLE END AS v,
 round(0.4 * ({_FIT}) + 0.3 * (CASE WHEN r < 0.10 THEN 0.75::DOUBLE WHEN r < 0.25 THEN 0.55 + 0.2 * (r / 0.25::DOUBLE) WHEN r < 0.50 THEN 0.70 + 0.15 * ((r - 0.25) / 0.25::DOUBLE)
 WHEN r < 0.75 THEN 0.85 + 0.12 * ((r - 0.50) / 0.25::DOUBLE) WHEN r < 0.90 THEN 0.90 + 0.05 * ((r - 0.75) / 0.15::DOUBLE) ELSE 0.80 END)
 + 0.2 * (0.8 * CASE WHEN d < 2 THEN 0.9::DOUBLE WHEN d < 4 THEN 0.7 WHEN d < 6 THEN 0.5 ELSE 0.3 END + 0.2 * (0.85 + CASE WHEN s % 1 < 0.3 OR s % 1 > 0.7 THEN 0.15 ELSE 0.0 END))
 + 0.1 * CASE WHEN s >= 0.5 AND e - (s + d) >= 0.5 THEN 1.0::DOUBLE WHEN s >= 0.5 OR e - (s + d) >= 0.5 THEN 0.6 ELSE 0.3 END, 3) AS h FROM seg0),
tot AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, a * 0.4 + m * 0.3 + v * 0.2 + h * 0.1)) AS total FROM sc)"""


def _direct_parts(spark, sf):
    n, start = F.col("ord"), (F.col("ord") % 997) * 1.25
    e = _read(spark, sf, "events").withColumn("ord", F.col("event_id"))
    segments = e.select(
        (F.col("user_id") % 10).alias("drama_id"), (F.col("user_id") % 7 + 1).cast("int").alias("episode_index"), "ord", n.alias("segment_id"), start.alias("start_time"), (F.lit(1.0) + (n % 29) / 4.0).alias("duration"),
        (start + 1.0).alias("end_time"), F.lit(2000.0).alias("episode_duration"), F.when(n % 4 > 0, "a.wav").alias("audio_path"), F.when(F.col("event_type") != "click", F.concat(F.lit("line\n"), F.col("event_type"))).alias("subtitle_text"),
        F.when(n % 3 > 0, "v.mp4").alias("video_path"),
    )
    audio = e.where(n % 4 > 1).select(n.alias("segment_id"), (n * 37 % 1001 / 1000.0).alias("audio_score"))
    emotion = e.where(n % 5 > 0).select(n.alias("segment_id"), (n * 13 % 1001 / 1000.0).alias("emotion_score"))
    visual = e.where(n % 3 == 2).select(n.alias("segment_id"), (n * 7 % 1001 / 1000.0).alias("visual_score"), (n % 2 == 0).alias("has_face"), (n % 7 == 0).alias("closeup"))
    return segments, audio, emotion, visual


@query(f"WITH {_DIRECT} SELECT ord, a AS audio_score, m AS emotion_score, v AS visual_score, h AS rhythm_score, round(total, 6) AS total FROM tot")
def segment_scores(spark, sf):
    """Four different scores of every segment, with the fallbacks of missing and unscorable sounds, texts and videos."""
    out = highlights.score_segments(*_direct_parts(spark, sf)).withColumn("total", F.round(scoring.weighted_total(), 6))
    return out.select("ord", "audio_score", "emotion_score", "visual_score", "rhythm_score", "total")


@query(f"""WITH {_DIRECT}, seg AS (SELECT drama_id, episode_index, ord, start_time, d AS duration, total AS total_score_raw, a, m, v, event_type FROM tot),
x AS (SELECT *, row_number() OVER (PARTITION BY drama_id ORDER BY total_score_raw DESC, ord) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY drama_id) * 0.3::DOUBLE) AS BIGINT)) AS top,
  row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY total_score_raw DESC, ord) AS er FROM seg WHERE duration >= 2),
b AS (SELECT *, sum(CAST(top AS INTEGER)) OVER (PARTITION BY drama_id, episode_index) AS c FROM x), cov AS (SELECT *, CASE WHEN top THEN 0 WHEN c = 0 AND er = 1 THEN 1 ELSE 2 END AS ph FROM b WHERE er <= greatest(c, 1, 1)),
cu AS (SELECT *, sum(duration) OVER (PARTITION BY drama_id ORDER BY total_score_raw DESC, ph, episode_index, er ROWS UNBOUNDED PRECEDING) AS cum FROM cov),
fit AS (SELECT * FROM cu WHERE cum - duration < 0.95 * 120 AND NOT (cum - duration >= 0.70 * 120 AND cum > 1.30 * 120)),
fin AS (SELECT *, round(total_score_raw, 4) AS ts FROM fit), r1 AS (SELECT *, count(*) OVER (PARTITION BY drama_id) AS n, count(*) OVER (PARTITION BY drama_id, episode_index) AS ne, first_value(start_time) OVER w AS lo, last_value(start_time) OVER w AS hi,
 row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY ts, start_time, ord) AS ps, row_number() OVER (PARTITION BY drama_id, episode_index ORDER BY start_time, ord) AS pt FROM fin
 WINDOW w AS (PARTITION BY drama_id, episode_index ORDER BY ts, start_time, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ramp AS (SELECT *, row_number() OVER (PARTITION BY drama_id ORDER BY episode_index, CASE WHEN n > 2 AND ne > 2 AND abs(lo - hi) <= 30 THEN ps ELSE pt END) AS rnk FROM r1),
y AS (SELECT *, concat_ws(', ', CASE WHEN ord % 3 = 2 AND ord % 7 = 0 THEN '特写' END, CASE WHEN ord % 3 = 2 AND ord % 2 = 0 THEN '有人物' END, CASE WHEN a > 0.6 THEN '音频爆点' END, CASE WHEN m > 0.6 THEN '情绪' END, CASE WHEN v > 0.6 THEN '画面佳' END,
 CASE WHEN event_type != 'click' THEN '"line ' || event_type || '"' END) AS why FROM ramp)
SELECT drama_id, CAST(rnk AS INTEGER) AS rank, episode_index AS episode, round_even(ts, 3) AS score, round_even(start_time, 1) AS start_time, round_even(duration, 1) AS duration, CASE WHEN why = '' THEN '高光片段' ELSE why END AS reason FROM y""")
def direct_cut_highlights(spark, sf):
    """The flagship from features to what is shown."""
    return highlights.shown(highlights.direct_cut(*_direct_parts(spark, sf), target=120.0))


# --- small rules -------------------------------------------------------------------------------------------------


@query(f"""WITH {_ITEMS}, u AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY _id ORDER BY ts, duration) = 1), ed AS (SELECT *, sum(duration) OVER (PARTITION BY script_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e FROM u)
SELECT _id, CAST(trunc((e - duration) * 1000) AS BIGINT) AS delay_ms, count(*) OVER (PARTITION BY script_id) + 1 AS volume FROM ed WHERE ost != 1""")
def audio_mix(spark, sf):
    items = catalog.keep_first(_items(spark, sf), "_id", ["timestamp", "duration"]).withColumn("audio", F.when(F.col("OST") != 1, "a.mp3"))
    return reports.mix_table(items).select("_id", "delay_ms", "volume")


@query("""WITH s AS (SELECT drama_id, rnk, ord, ep, st, lead(ord) OVER w AS next_ord, lead(ep) OVER w AS nep, lead(st) OVER w AS nst FROM (SELECT user_id % 10 AS drama_id, event_id AS rnk, event_id AS ord, user_id % 3 AS ep, (event_id * 7 % 100)::DOUBLE AS st FROM events) WINDOW w AS (PARTITION BY drama_id ORDER BY rnk))
SELECT drama_id, rnk AS rank, ord, next_ord, ep = nep AND abs(st - nst) <= 30 AS safe FROM s WHERE next_ord IS NOT NULL""")
def safe_swaps(spark, sf):
    n = F.col("event_id")
    s = _read(spark, sf, "events").select((F.col("user_id") % 10).alias("drama_id"), n.alias("rank"), n.alias("ord"), (F.col("user_id") % 3).alias("episode_index"), (n * 7 % 100).cast("double").alias("start_time"))
    return records.swap_candidates(s)


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'k1' WHEN 1 THEN 'k2' ELSE 'k0' END AS api_key, list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'no p_api_key' END, CASE WHEN c_custkey % 6 = 0 THEN 'no p_model_name' END], lambda x: x IS NOT NULL) AS errors,
 c_custkey % 4 > 0 AND c_custkey % 6 > 0 AS is_valid, CASE WHEN c_custkey % 2 = 0 THEN '[{"role":"system","content":"s"},' ELSE '[' END || '{"role":"user","content":"' || c_name || '"}]' AS messages,
 '{"status":200' || CASE WHEN c_custkey % 2 = 0 THEN ',"data":[1]' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ',"message":"m"' ELSE '' END || '}' AS envelope, '/o/' || c_custkey || '.x_normalized.mp3' AS normalized,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE -20.0::DOUBLE - (-c_custkey / 8.0::DOUBLE) END AS gain, CASE WHEN c_custkey % 2 = 0 THEN '00:00:07' END AS clock, 'text {} by' AS stripped,
 CASE c_custkey % 3 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'too_short' END AS upload FROM customer""")
def small_records(spark, sf):
    """X14, X33, X35, R7, R8, R9, R12, R24, R26 and R33 side by side."""
    c, n = _read(spark, sf, "customer").withColumn("_one", F.lit(1)), F.col("c_custkey")
    is_, no = F.lit("x"), F.lit(None).cast("string")
    check = records.provider_check(F.when(n % 4 > 0, is_).otherwise(""), F.when(n % 6 > 0, is_).otherwise(no), no, F.lit("p"))
    level = records.measured_loudness(F.when(n % 5 > 0, F.concat(F.lit('x\n{\n"input_i" : "'), (-n / 8.0).cast("string"), F.lit('"\n}\ny'))).otherwise("none"))
    return records.in_turn(c, ["k0", "k1", "k2"], "c_custkey", "_one").select(
        "c_custkey", "api_key", check["errors"].alias("errors"), check["is_valid"].alias("is_valid"), F.to_json(records.chat_messages(F.col("c_name"), F.when(n % 2 == 0, "s").otherwise(""))).alias("messages"),
        serialize.envelope(F.lit(200), F.when(n % 2 == 0, "[1]").otherwise("[]"), F.when(n % 3 == 0, "m")).alias("envelope"), records.normalized_name(F.concat(F.lit("/a.b/"), n.cast("string"), F.lit(".x.wav")), F.lit("/o/")).alias("normalized"),
        records.simple_gain(level).alias("gain"), text.clock_in_name(F.when(n % 2 == 0, "f_00:00:07.jpg").otherwise("f_000007.jpg")).alias("clock"), text.strip_signs(F.lit("```json\ntext {} by\njson```")).alias("stripped"),
        records.upload_check(F.when(n % 3 == 0, "").when(n % 3 == 1, " short 　").otherwise("long enough to be one")).alias("upload"),
    )


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, bool_or(turn % 3 = 1) AS original_sound, sum(length(role) + length(text) + 4) + 3 AS n_tokens FROM conversations WHERE NOT (turn = 2) GROUP BY 1""")
def conversation_records(spark, sf):
    """P9, A16, A21 and R16 over conversations."""
    c = _read(spark, sf, "conversations").withColumn("error", F.when(F.col("turn") == 2, "failed")).withColumn("OST", (F.col("turn") % 3).cast("int"))
    good = records.without_errors(c)
    tokens = records.message_tokens(good, F.length("role") + F.length("text"), "conv_id")
    return reports.joined_texts(good, "conv_id", "turn").join(reports.any_original_sound(good, "conv_id"), "conv_id").join(tokens, "conv_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 25 < 20 THEN 'http://' || (o_orderkey % 25) ELSE '' END AS base_url, o_orderkey % 25 < 20 AS required, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 3) END AS path
FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 5 = 0)""")
def lookup_records(spark, sf):
    """Noise dropped, gateways by name without case, clips by time stamp."""
    n = F.col("o_orderkey")
    o = _read(spark, sf, "orders").select(
        n, F.concat(F.lit("NATION_"), (n % 25).cast("string")).alias("provider"), F.when(n % 4 == 0, "DEBUG").otherwise("INFO").alias("level"), F.when(n % 5 == 0, "x 已注册提示词").otherwise("y").alias("message"), (n % 3).cast("string").alias("timestamp"),
    )
    urls = _read(spark, sf, "nation").where("n_nationkey < 20").select(F.lower("n_name").alias("provider"), F.concat(F.lit("http://"), F.col("n_nationkey").cast("string")).alias("url"))
    clips = _read(spark, sf, "region").where("r_regionkey = 0").select(F.col("r_regionkey").cast("string").alias("timestamp"), F.lit("p0").alias("path"))
    out = records.attach_clips(records.base_urls(records.shown_messages(o), urls), clips)
    return out.select("o_orderkey", "base_url", "required", "path")


@query("""SELECT event_id AS n, CASE event_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS profile_speech, CASE event_id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.2 WHEN 2 THEN 0.0 ELSE 0.3 END::DOUBLE AS content_music,
 CASE event_id % 6 WHEN 1 THEN 1280 WHEN 3 THEN 720 WHEN 0 THEN 1920 ELSE 1080 END AS width, CASE event_id % 6 WHEN 1 THEN 720 WHEN 3 THEN 1280 WHEN 0 THEN 1080 WHEN 4 THEN 1080 ELSE 1920 END AS height,
 CAST(greatest(0, (vw - least(vw, CAST(trunc(1080 / k) AS INTEGER))) // 2) AS INTEGER) AS x FROM (SELECT event_id, vw, least(1080.0::DOUBLE / vw, 1920.0::DOUBLE / 720) AS k FROM (SELECT event_id, CAST(640 + event_id % 50 * 30 AS INTEGER) AS vw FROM events))""")
def profile_tables(spark, sf):
    """P22 and P23 by their further tables, F26 without a face."""
    n = F.col("event_id")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    profile = media.volumes_for(pick([*media.PROFILES, "other"]), (0.5, 0.5, 0.5), media.PROFILES)
    content, size = media.volumes_for_content(pick(["mixed", "voice_only", "music_video", "other"])), media.size_for(pick(["16:9", "4:3", "9:16", "3:4", "1:1", "x"]), media.SECOND_SIZES)
    crop = scoring.crop_window((640 + n % 50 * 30).cast("int"), F.lit(720), 1080, 1920)
    return _read(spark, sf, "events").select(n.alias("n"), profile["tts_volume"].alias("profile_speech"), content["bgm_volume"].alias("content_music"), size["width"].alias("width"), size["height"].alias("height"), crop["x"].alias("x"))


#: Voices, engines, and what follows: the plain name, the second form, whether the service speaks, the engine, the bare name.
_VOICES = [
    ("zh-CN-XiaoyiNeural-Female", "azure_speech", "zh-CN-XiaoyiNeural", "", False, "edge", "zh-CN-XiaoyiNeural-Female"), ("zh-CN-YunxiNeural", "azure_speech", "zh-CN-YunxiNeural", "", True, "azure_v2", "zh-CN-YunxiNeural"),
    ("zh-CN-XNeural-V2", "azure_speech", "zh-CN-XNeural-V2", "zh-CN-XNeural", True, "azure_v2", "zh-CN-XNeural-V2"), ("zh-CN-XNeural-V2-Male", "edge_tts", "zh-CN-XNeural-V2", "zh-CN-XNeural", False, "edge", "zh-CN-XNeural-V2-Male"),
    ("speech:a:b", "azure_speech", "speech:a:b", "", False, "edge", "speech:a:b"), ("cosyvoice: c ", "cosyvoice", "cosyvoice: c", "", False, "cosyvoice", "c"), ("tencent:101", "tencent_tts", "tencent:101", "", False, "tencent", "tencent:101"), ("x", "none", "x", "", False, "edge", "x"),
]


def _voice_cases(k: int) -> str:
    lit = lambda v: str(v).upper() if isinstance(v, bool) else "'" + v + "'"
    return f"CASE event_id % {len(_VOICES)} " + " ".join(f"WHEN {i} THEN {lit(v[k])}" for i, v in enumerate(_VOICES)) + " END"


@query(f"SELECT event_id, {_voice_cases(2)} AS plain, {_voice_cases(3)} AS second, {_voice_cases(4)} AS service, {_voice_cases(5)} AS engine, {_voice_cases(6)} AS bare FROM events")
def voice_names(spark, sf):
    pick = lambda k: F.get(F.array(*[F.lit(v[k]) for v in _VOICES]), (F.col("event_id") % len(_VOICES)).cast("int"))
    name = pick(0)
    return _read(spark, sf, "events").select(
        "event_id", voices.plain_name(name).alias("plain"), voices.second_form(name).alias("second"), voices.wants_service(name).alias("service"), voices.engine_for(pick(1), name).alias("engine"), voices.without_prefix(name, "cosyvoice").alias("bare")
    )


@query("""WITH v AS (SELECT o_custkey AS term, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT term, CAST(place AS INTEGER) AS place, 'u' || k % 500 || CASE WHEN k % 3 = 1 THEN 'b' ELSE 'c' END AS url, (k % 20)::DOUBLE AS duration, 'exact' AS kind FROM v WHERE k % 20 >= 5 AND k % 3 > 0
UNION ALL SELECT term, CAST(place AS INTEGER), 'w' || k % 500 || CASE WHEN k % 4 = 0 THEN 'm' ELSE 'l' END, (k % 20)::DOUBLE, 'wide' FROM v WHERE k % 20 >= 5 AND k % 4 < 3""")
def stock_videos(spark, sf):
    """Searches of both kinds: files of exactly the wanted size, and the first size that is wide enough."""
    k = F.col("o_orderkey")
    url = lambda mark, kind: F.concat(F.lit(mark), (k % 500).cast("string"), F.lit(kind))
    file = lambda w, h, kind: F.struct(w.alias("width"), F.lit(h).alias("height"), url("u", kind).alias("link"))
    files_ = F.array(file(F.lit(720), 1280, "a"), file(F.when(k % 3 == 1, 1080).otherwise(360), 1920, "b"), file(F.when(k % 3 > 0, 1080).otherwise(1081), 1920, "c"))
    size = lambda w, kind: F.struct(w.alias("width"), F.lit(1).alias("height"), url("w", kind).alias("url"))
    sizes = F.create_map(F.lit("small"), size(F.lit(10), "s"), F.lit("medium"), size(F.when(k % 4 == 0, 1200).otherwise(100), "m"), F.lit("large"), size(F.when(k % 4 < 3, 1080).otherwise(1079), "l"))
    v = F.struct("o_orderkey", F.struct((k % 20).alias("duration"), files_.alias("video_files"), sizes.alias("videos")).alias("v"))
    g = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("term")).agg(F.transform(F.array_sort(F.collect_list(v), lambda a, b: (a["o_orderkey"] - b["o_orderkey"]).cast("int")), lambda r: r["v"]).alias("vs"))
    exact = stock.exact_renditions(g.select("term", F.to_json(F.struct(F.col("vs").alias("videos"))).alias("body")), 1080, 1920, 5)
    wide = stock.wide_renditions(g.select("term", F.to_json(F.struct(F.col("vs").alias("hits"))).alias("body")), 1080, 5)
    return exact.withColumn("kind", F.lit("exact")).unionByName(wide.withColumn("kind", F.lit("wide")))


@query("""SELECT p_partkey, p_type AS name, p_size AS version, left(repeat(p_name || ' ', p_size), 500) || CASE WHEN (length(p_name) + 1) * p_size > 500 THEN '...' ELSE '' END AS template_preview, p_size % 3 AS examples_count, p_size % 2 = 0 AS has_parameters,
 lpad(p_size::VARCHAR, 3, '0') = coalesce(max(CASE WHEN p_size = 7 THEN '007' END) OVER (PARTITION BY p_brand, p_type), max(lpad(p_size::VARCHAR, 3, '0')) OVER (PARTITION BY p_brand, p_type)) AS is_default FROM part""")
def prompt_registry(spark, sf):
    """Previews and default versions, some of them set."""
    size = F.col("p_size")
    ones = lambda n: F.filter(F.array_repeat(F.lit("x"), 3), lambda _, i: i < n)
    p = _read(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("category"), F.col("p_type").alias("name"), F.lpad(size.cast("string"), 3, "0").alias("version"), F.expr("repeat(concat(p_name, ' '), p_size)").alias("template"),
        ones(size % 3).alias("examples"), ones(1 - size % 2).alias("parameters"),
    )
    chosen = p.where("version = '007'").select("category", "name", "version").union(p.select("category", "name", F.lit("999")))
    out = catalog.with_defaults(catalog.prompt_info(p), chosen.distinct())
    return out.select("p_partkey", "name", F.col("version").cast("int").alias("version"), "template_preview", "examples_count", "has_parameters", "is_default")


@query(r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{"a":1}' WHEN 1 THEN 'x' WHEN 2 THEN '[1]' WHEN 3 THEN 'a ``` b' ELSE '```' END AS plain, CASE o_orderkey % 5 WHEN 0 THEN 'missing_b' WHEN 2 THEN 'no_object' ELSE 'no_json' END AS error,
 CASE o_orderkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_short' END AS key_error, CASE WHEN o_orderkey % 4 = 1 THEN 'no_scheme' END AS url_error FROM orders""")
def answer_forms(spark, sf):
    """X13 in its fuller forms, P19 by kind and fields, R13 for keys and addresses."""
    n, out = F.col("o_orderkey"), F
    for i, raw in enumerate(['```json\n{"a":1}\n```', "```x\nx\n```py", "```json [1]```", "a ``` b", " ``` \n"]):
        out = out.when(n % 5 == i, raw)
    plain = text.unfence_all(out)
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (n % len(v)).cast("int"))
    return _read(spark, sf, "orders").select("o_orderkey", plain.alias("plain"), checks.schema_error(plain, "object", ["a", "b"]).alias("error"), checks.api_key(pick(" ", " short ", "long enough")).alias("key_error"), checks.base_url(pick(None, "host", "https://h", " http://h")).alias("url_error"))


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""")
def added_rows(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return catalog.added(c.where("k % 3 > 0"), c.where("k % 2 = 0").withColumn("v", F.lit("new")), "k")


@query("""WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text, CASE WHEN turn % 2 = 0 THEN turn * 7.25::DOUBLE END AS ts FROM conversations), y AS (SELECT *, coalesce(ts, (n - 1) * 5.0::DOUBLE) AS s FROM x),
z AS (SELECT *, s + greatest(2.0::DOUBLE, least(10.0::DOUBLE, length(replace(replace(coalesce(text, ''), ' ', ''), chr(10), '')) / 2.5::DOUBLE)) AS e FROM y)
SELECT conv_id AS file_id, n || chr(10) || """ + _HMS.format("CAST(floor(s * 1000) AS BIGINT)") + """ || ' --> ' || """ + _HMS.format("CAST(floor(e * 1000 + 0.0001) AS BIGINT)") + """ || chr(10) || coalesce(text, '') || chr(10) AS block FROM z""")
def narration_files(spark, sf):
    """SRT blocks of narrations, some of whose segments have no time."""
    c = _read(spark, sf, "conversations").withColumn("timestamp", F.when(F.col("turn") % 2 == 0, F.col("turn") * 7.25))
    cues = timeline.narration_cues(c, "conv_id", "turn").withColumnRenamed("conv_id", "file_id")
    cues = cues.withColumn("end", F.round("end", 3) + 0.0001)  # thousandths are cut
    return files.srt_blocks(cues, ["cue_no"]).select("file_id", "block")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 's' WHEN 1 THEN '5' WHEN 2 THEN left('no json ' || repeat('x', 600), 500) WHEN 3 THEN 'AI未能返回有效结果' ELSE '' END AS summary, CASE o_orderkey % 5 WHEN 0 THEN 15 ELSE 0 END AS moments,
 CASE WHEN o_orderkey % 5 = 1 THEN 'dark' ELSE '' END AS tone, CASE o_orderkey % 5 WHEN 2 THEN 608 WHEN 3 THEN 0 END AS raw_length, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'parse_failed' END AS error FROM orders""")
def plot_answers(spark, sf):
    """Plot answers as JSON, in a fence, unreadable, blank and empty."""
    k, out = F.col("o_orderkey") % 5, F
    moments = ",".join(["\"m\""] * 20)
    for i, raw in enumerate(['{"summary": "s", "key_moments": [' + moments + "]}", 'x ```json\n{"summary": 5, "tone": "dark"}\n``` y', "no json " + "x" * 600, " \n　", " {} "]):
        out = out.when(k == i, raw)
    r = text.plot_analysis(out)
    return _read(spark, sf, "orders").select("o_orderkey", r["summary"].alias("summary"), F.size(r["key_moments"]).alias("moments"), r["tone"].alias("tone"), F.length(r["raw_response"]).alias("raw_length"), r["error"].alias("error"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1920' WHEN 1 THEN '640' ELSE '1280' END AS width, CASE c_custkey % 3 WHEN 0 THEN '29.5' WHEN 1 THEN 'N/A' ELSE '25' END AS fps, CASE c_custkey % 3 WHEN 0 THEN c_custkey || '.5=x' WHEN 2 THEN '0' END AS duration, left(md5(c_custkey || '/' || c_name), 8) AS id FROM customer""")
def probed_videos(spark, sf):
    n = F.col("c_custkey")
    out = F.when(n % 3 == 0, F.concat(F.lit("width=1920\nnoise\nr_frame_rate=59/2\nduration="), n.cast("string"), F.lit(".5=x"))).when(n % 3 == 1, "width=640\nr_frame_rate=N/A")
    info = media.probe_info(out)
    return _read(spark, sf, "customer").select("c_custkey", *[F.try_element_at(info, F.lit(k)).alias(k) for k in ("width", "fps", "duration")], text.short_id(n, F.col("c_name")).alias("id"))


# --- words, lines and files by hand ------------------------------------------------------------------------------

#: Texts with their keyword, pattern, intensity and whole scores, worked out by hand from the published lists.
_FEELINGS = [
    ("你背叛我，这是谎言", 0.6667, 0.0, 0.0, 0.4), ("真相大白，永远不要后悔", 1.0, 0.0, 0.0, 0.6), ("天哪！！", 0.2, 1.0, 0.5, 0.445), ("", 0.0, 0.0, 0.0, 0.0), ("nooo way", 0.0, 1.0, 0.1, 0.265), ("plain", 0.0, 0.0, 0.0, 0.0),
]


def _feeling(k: int) -> str:
    return f"CASE event_id % {len(_FEELINGS)} " + " ".join(f"WHEN {i} THEN {v[k]}" for i, v in enumerate(_FEELINGS)) + " END::DOUBLE"


@query(f"SELECT event_id, {_feeling(1)} AS keyword, {_feeling(2)} AS pattern, {_feeling(3)} AS intensity, {_feeling(4)} AS total FROM events")
def emotion_by_hand(spark, sf):
    said = F.get(F.array(*[F.lit(v[0]) for v in _FEELINGS]), (F.col("event_id") % len(_FEELINGS)).cast("int"))
    out = emotion.emotion_scores(_read(spark, sf, "events").select("event_id", said.alias("text")))
    names = {"keyword": "keyword_score", "pattern": "pattern_score", "intensity": "intensity_score", "total": "emotion_score"}
    return out.select("event_id", *[F.round(c, 4).alias(n) for n, c in names.items()])


@query("""SELECT o_orderkey AS file_id, CAST(0 AS INTEGER) AS cue_idx, 1.0::DOUBLE AS start, 2.5::DOUBLE AS "end", 'A' || o_orderkey AS text FROM orders UNION ALL SELECT o_orderkey, 2, 60.25, 61.0, 'B' || chr(10) || 'C' FROM orders""")
def srt_blocks_parse(spark, sf):
    """Files of several blocks: one without an arrow and one without text go."""
    n = F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))
    srt = F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,500\n"), n, F.lit("\n\n2\nno arrow\nx\n\n3\n00:01:00.250 --> 00:01:01,000\nB\nC\n\n \n4\n00:00:09,000 --> 00:00:10,000\n"))
    return files.parse_srt(_read(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), srt.alias("text")))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def natural_order(spark, sf):
    """Places by name where digits count as numbers and case does not: clip 9 comes before Clip 10."""
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Clip ").otherwise("clip "), F.col("c_custkey").cast("string"), F.lit(".mp4"))
    w = Window.partitionBy("c_nationkey").orderBy(text.natural_key(name))
    return _read(spark, sf, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '(\d{2}:\d{2}:\d{2})\.(\d{3})', '\1,\2', 'g'), ' ') AS normal, regexp_matches(text, '[?,.、;:!…？，。；：！\n]') AS marked, length(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\p{Pc}]', '', 'g')) AS letters, 'mp4' AS ending,
 CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] END AS strings, CASE WHEN doc_id % 3 = 0 THEN '-20.5' END AS loudness FROM documents""")
def text_forms(spark, sf):
    """X1, X3, X7, X11, X18 and X21 side by side."""
    n = F.col("doc_id")
    log = F.when(n % 3 == 0, 'x\n{\n"input_i": "-20.5"\n}\n').otherwise("x {")
    return _read(spark, sf, "documents").select(
        n, text.normalize_subtitle(F.col("text")).alias("normal"), text.has_mark(F.col("text")).alias("marked"), F.length(text.line_key(F.col("text"), 2)).cast("long").alias("letters"), text.extension(F.lit("a.b.MP4")).alias("ending"),
        text.string_list(F.when(n % 2 == 0, 'so ["a", "b"] ok').otherwise("[1]")).alias("strings"), F.try_variant_get(text.loudness_report(log), "$.input_i", "string").alias("loudness"),
    )


@query("""WITH w AS (SELECT conv_id, turn, turn * 20000000 AS s, CASE WHEN conv_id % 5 > 0 THEN turn * 20000000 + (turn % 3 - 1) * 5000000 END AS e FROM conversations), l AS (SELECT conv_id, coalesce(max_by(e, turn) / 10000000.0::DOUBLE, 0.0) AS seconds FROM w GROUP BY 1)
SELECT w.conv_id, turn, coalesce(greatest(0, e - s), 0) AS duration, seconds FROM w JOIN l USING (conv_id)""")
def spoken_words(spark, sf):
    """Words whose end lies before their start, clips without ends."""
    t = F.col("turn")
    words = _read(spark, sf, "conversations").select("conv_id", "turn", (t * 20000000).alias("start"), F.when(F.col("conv_id") % 5 > 0, t * 20000000 + (t % 3 - 1) * 5000000).alias("end"))
    return timeline.word_events(words).join(timeline.speech_length(words, "conv_id", "turn"), "conv_id").select("conv_id", "turn", "duration", "seconds")


@query("""WITH v AS (SELECT user_id AS job, event_id AS index, (event_id % 8) / 4.0::DOUBLE AS d, event_id % 3 = 0 AS k FROM events), p AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY job ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM v)
SELECT job, index, start, 'f' || index || '-1' AS file FROM p WHERE k AND index % 2 = 0""")
def audio_places(spark, sf):
    """Where kept sounds start, the first of two files of an index."""
    e, n = _read(spark, sf, "events"), F.col("event_id")
    videos = e.select(F.col("user_id").alias("job"), n.alias("index"), (n % 8 / 4.0).alias("duration"), (n % 3 == 0).alias("keep_audio"))
    audio = e.where(n % 2 == 0).select(F.col("user_id").alias("job"), n.alias("index"), F.explode(F.array(F.lit(2), F.lit(1))).alias("ord"))
    audio = audio.withColumn("path", F.concat(F.lit("f"), F.col("index").cast("string"), F.lit("-"), F.col("ord").cast("string")))
    return timeline.audio_starts(videos, audio)


@query("""WITH x AS (SELECT event_id AS n, CAST(event_id % 50 + 1 AS INTEGER) AS w, (event_id % 3) * 1000.0::DOUBLE AS r FROM events) SELECT n AS event_id, CASE n % 4 WHEN 0 THEN 'empty_analysis' WHEN 1 THEN 'analysis_too_short' WHEN 2 THEN 'warning_no_keyword' END AS analysis, CASE n % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'u' END AS option,
 n AS saved, 2 AS forced, ['x(c1)', 'b(c2)'] AS matched, 2 AS hits, round(CASE WHEN r > 0 THEN 20 * log10(r / 32768.0::DOUBLE) ELSE -60.0 END, 6) AS level, CASE WHEN w * 40 > 100 THEN w * 40 / 10000.0::DOUBLE ELSE 0.01 END AS face, CASE WHEN w * 40 > 100 THEN (20 + w / 2.0::DOUBLE) / 100.0::DOUBLE ELSE 0.05 END AS center_x, w * 40 > 1500 AS closeup FROM x""")
def unit_rules(spark, sf):
    """P20, P24, P27, F12b, F16, F24 and F32 side by side."""
    n = F.col("event_id")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (n % len(v)).cast("int"))
    saved, defaults = F.create_map(F.lit("b"), n, F.lit("c"), F.lit(3).cast("long")), F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(2).cast("long"))
    box = lambda x, w, h: F.struct(F.lit(x).alias("x"), F.lit(x).alias("y"), w.alias("w"), F.lit(h).alias("h"))
    face = media.largest_face(F.array(box(0, F.lit(10).cast("long"), 10), box(20, n % 50 + 1, 40)), F.lit(100.0), F.lit(100.0))
    return _read(spark, sf, "events").select(
        "event_id", checks.analysis(pick(" ", "short 剧情", "x" * 60, "剧情" * 30)).alias("analysis"), checks.chosen_option(pick("d", "u", None), F.lit("d"), F.lit("r")).alias("option"),
        checks.merged(defaults, saved)["b"].alias("saved"), checks.merged(defaults, saved, force=True)["b"].cast("int").alias("forced"), text.matched_terms(F.lit("xaybz"), {"c1": ["x", "q"], "c2": ["b"]}).alias("matched"),
        text.lexicon_hits(F.lit("ab"), ["ab", "c", "d"], F.array(F.lit("c"), F.lit("x"))).alias("hits"), F.round(scoring.rms_db(n % 3 * 1000.0), 6).alias("level"), face["size_ratio"].alias("face"), face["center_x"].alias("center_x"), face["is_closeup"].alias("closeup"),
    )


@query("""WITH p AS (SELECT p_brand AS category, p_type AS name, lpad(p_size::VARCHAR, 3, '0') AS version, min(p_partkey) AS id FROM part GROUP BY ALL), w AS (SELECT p_partkey, p_brand AS category, p_type AS name, CASE p_partkey % 3 WHEN 1 THEN lpad(p_size::VARCHAR, 3, '0') WHEN 2 THEN 'zzz' END AS version FROM part),
d AS (SELECT category, name, max(version) AS v FROM p GROUP BY 1, 2), a AS (SELECT p_partkey, w.category, w.name, coalesce(w.version, d.v) AS version FROM w LEFT JOIN d ON w.category = d.category AND w.name = d.name) SELECT p_partkey, a.version, id FROM a LEFT JOIN p ON p.category = a.category AND p.name = a.name AND p.version = a.version""")
def picked_prompts(spark, sf):
    """Prompts of a version, of the default one, and of one that there is not."""
    p = _read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("category"), F.col("p_type").alias("name"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("version"))
    prompts = p.groupBy("category", "name", "version").agg(F.min("p_partkey").alias("id"))
    wanted = p.withColumn("version", F.when(F.col("p_partkey") % 3 == 1, F.col("version")).when(F.col("p_partkey") % 3 == 2, "zzz"))
    return reports.pick_prompts(wanted, prompts).select("p_partkey", "version", "id")


@query("""SELECT vec_id AS segment_id, round(sqrt(avg(x * x)), 6) AS rms, round(CASE WHEN sqrt(avg(x * x)) > 0 THEN 20 * log10(sqrt(avg(x * x)) / 32768.0::DOUBLE) ELSE -60.0 END, 6) AS rms_db FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 1000 AS x FROM embeddings) GROUP BY 1""")
def segment_loudness(spark, sf):
    """F24 over the samples of each segment."""
    samples = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("segment_id"), F.explode("embedding").alias("x")).withColumn("value", F.col("x").cast("double") * 1000)
    return features.loudness_by_segment(samples).select("segment_id", F.round("rms", 6).alias("rms"), F.round("rms_db", 6).alias("rms_db"))
