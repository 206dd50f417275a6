"""Edit timelines, subtitle tracks, cut lists and their key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc


def edit_timeline(items: DataFrame, group: str = "script_id", order: str = "ord") -> DataFrame:
    """Running start and end of each item in the edit; items without length take no time and no range."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(0.0)
    end = F.sum(length).over(w)
    out = items.withColumns({"edited_end": end, "edited_start": end - length})
    rng = F.concat(tc.to_clock(F.col("edited_start")), F.lit("-"), tc.to_clock(F.col("edited_end")))
    return out.withColumn("editedTimeRange", F.when(F.col("duration") > 0, rng))


def attach_media(items: DataFrame, media: DataFrame) -> DataFrame:
    """media(_id, timestamp, path, ord) by _id (0 and null go by timestamp alone), else by timestamp; of several rows of a key the last by ord counts."""
    by_id = media.where("_id <> 0").groupBy("_id").agg(F.max_by("path", "ord").alias("_p1"))
    by_time = media.groupBy("timestamp").agg(F.max_by("path", "ord").alias("_p2"))
    out = items.join(by_id, "_id", "left").join(by_time, "timestamp", "left")
    return out.withColumn("path", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")


def join_speech(items: DataFrame, speech: DataFrame) -> DataFrame:
    """Items with their speech, and ``rejected``: whether an item needs speech and has none."""
    out = items.join(speech, "_id", "left")
    return out.withColumn("rejected", F.coalesce(F.col("OST").isin(0, 2), F.lit(False)) & F.col("speech_duration").isNull())


def plot_script(plots: DataFrame, group: str = "script_id") -> DataFrame:
    """The script items of each row's ``plot_points`` (timestamp, picture), numbered from 1, with the sound of the film and a tag for narration.

    The tag is made from the key and the number, so it is the same in every run. Null and empty lists give no rows.
    """
    each = plots.select(group, F.posexplode("plot_points").alias("_at", "_point")).withColumn("_id", F.col("_at") + 1)
    # Fixed value: how a tag begins.
    tag = F.concat(F.lit("播放原生_"), F.substring(F.md5(F.concat_ws("/", F.col(group).cast("string"), F.col("_id").cast("string"))), 1, 8))
    return each.select(group, "_id", F.col("_point.timestamp").alias("timestamp"), F.col("_point.picture").alias("picture"), tag.alias("narration"), F.lit(1).alias("OST"))


def new_timestamps(items: DataFrame, group: str = "script_id", order: str = "ord", minutes: bool = False) -> DataFrame:
    """``new_timestamp``, the place of each item of ``timestamp`` 'A-B' in the edit, as HH:MM:SS,mmm; W12 (``minutes``): as MM:SS, and
    blank narrations get a tag of their own. Minutes pass 99 where the edit does. A range without exactly two parts takes no time and gets null."""
    # Codes are cut, and lengths and ends taken, once a row: a column for each step, as an expression used several times is computed as often.
    halves = [F.get("_codes", F.lit(i)) for i in range(2)]
    cut = items.withColumn("_codes", F.split("timestamp", "-")).withColumns({f"_parts{i}": tc.clock_parts(half) for i, half in enumerate(halves)})
    length = tc.relaxed(halves[1], F.col("_parts1")) - tc.relaxed(halves[0], F.col("_parts0"))
    timed = cut.withColumn("_length", F.when(F.size("_codes") == 2, length)).drop("_codes", "_parts0", "_parts1")
    end = F.sum("_length").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    clock = tc.to_minutes if minutes else tc.to_srt
    placed = timed.withColumn("_end", end).withColumns({"_from": F.round(F.col("_end") - F.col("_length"), 3), "_to": F.round("_end", 3)})
    span = F.concat(clock(F.col("_from")), F.lit("-"), clock(F.col("_to")))
    out = placed.withColumn("new_timestamp", F.when(F.col("_length").isNotNull(), span)).drop("_length", "_end", "_from", "_to")
    if not minutes:
        return out
    # Fixed value: how a tag begins.
    tag = F.concat(F.lit("原声播放_"), F.substring(F.md5(F.concat_ws("/", F.col(group).cast("string"), F.col(order).cast("string"))), 1, 8))
    return out.withColumn("narration", F.when(F.coalesce(F.col("narration"), F.lit("")) == "", tag).otherwise(F.col("narration")))


def attach_episodes(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """items(episode, from 0; null: 0) with the ``path`` of episodes(ordinal, path); ``rejected``: whether there is none."""
    n = F.coalesce(F.col("episode"), F.lit(0))
    return items.join(episodes.withColumnRenamed("ordinal", "_at"), n == F.col("_at"), "left").drop("_at").withColumn("rejected", F.col("path").isNull())


def audio_starts(videos: DataFrame, audio: DataFrame, group: str = "job") -> DataFrame:
    """The start in the edit of each video that keeps its sound, with the first audio file (job, index, path, ord) of its index."""
    before = F.sum("duration").over(Window.partitionBy(group).orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    placed = videos.withColumn("start", F.coalesce(before, F.lit(0.0))).where("keep_audio").select(group, "index", "start")
    first = audio.groupBy(group, "index").agg(F.min_by("path", "ord").alias("file"))
    return placed.join(first, [group, "index"])


def word_events(words: DataFrame) -> DataFrame:
    """R2: words(start, end in ticks) with their duration, 0 at least."""
    return words.withColumn("duration", F.greatest(F.lit(0), F.col("end") - F.col("start")))


def speech_length(words: DataFrame, group: str = "clip", order: str = "ord") -> DataFrame:
    """Seconds of each clip: the end of its last word; a clip whose words have no end has 0."""
    return words.groupBy(group).agg(F.coalesce(F.max_by("end", order) / 1e7, F.lit(0.0)).alias("seconds"))


def cut_list(joined: DataFrame) -> DataFrame:
    """How each item is cut: 0 muted to the speech's length, 1 as scripted, 2 with sound to the speech's length; other kinds go."""
    length = F.when(F.col("OST") == 1, F.col("scripted")).otherwise(F.coalesce("speech_duration", "scripted"))
    return joined.where(F.col("OST").isin(0, 1, 2)).withColumns({"cut_start": F.col("start"), "cut_end": F.col("start") + length, "mute": F.col("OST") == 0})


def merge_subtitles(items: DataFrame, cues: DataFrame) -> DataFrame:
    """Cues shifted to their item's place in the edit, numbered from 1."""
    out = items.select("script_id", "_id", "edited_start").join(cues, "_id").withColumns(
        {"start": F.col("cue_start") + F.col("edited_start"), "end": F.col("cue_end") + F.col("edited_start")}
    )
    n = F.row_number().over(Window.partitionBy("script_id").orderBy("start", "_id", "cue_idx"))
    return out.select("script_id", n.alias("cue_no"), "start", "end", "text")


def concat_srt(cues: DataFrame, faithful: bool = False) -> DataFrame:
    """Files one after another; each is shifted by the last cue's end of all before it.

    cues(job, file_no, cue_idx, start, end, text). ``faithful`` shifts the end by end - start instead, as the
    formula's sign slip does.
    """
    last = cues.groupBy("job", "file_no").agg(F.max_by(F.struct("start", "end"), "cue_idx").alias("l"))
    step = F.col("l.end") - F.col("l.start") if faithful else F.col("l.end")
    before = Window.partitionBy("job").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.withColumn("_step", step).select("job", "file_no", F.coalesce(F.sum("_step").over(before), F.lit(0.0)).alias("offset"))
    out = cues.join(offsets, ["job", "file_no"])
    end = F.col("offset") + F.col("end") - F.col("start") if faithful else F.col("offset") + F.col("end")
    n = F.row_number().over(Window.partitionBy("job").orderBy("file_no", "cue_idx"))
    return out.select("job", n.alias("cue_no"), (F.col("offset") + F.col("start")).alias("start"), end.alias("end"), "text")


def overlay_cues(scenes: DataFrame, cues: DataFrame, bucket: float = 8.0) -> DataFrame:
    """J9 (an extension): texts of the cues that overlap a scene, by equal buckets of time and then the exact bounds."""
    cut = cues.withColumn("_b", F.explode(F.sequence(F.floor(F.col("cue_start") / bucket), F.floor(F.col("cue_end") / bucket))))
    s = scenes.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    hit = s.join(cut, ["episode_id", "_b"]).where((F.col("start_time") < F.col("cue_end")) & (F.col("end_time") > F.col("cue_start")))
    hit = hit.select("episode_id", "scene_id", "cue_idx", "text").distinct()
    texts = F.array_sort(F.collect_list(F.struct("cue_idx", "text")))
    return hit.groupBy("episode_id", "scene_id").agg(F.count("*").alias("n_cues"), F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("subtitle_text"))


def assemble_subtitles(segments: DataFrame, cues: DataFrame, group: str = "job", order: str = "rank", faithful: bool = False) -> DataFrame:
    """The subtitle track of the chosen segments(group, order, segment_id, duration, subtitle_text).

    A segment brings the cues(segment_id, cue_idx, start, end, text) of its file; without a file (no cue) lines made from its text, of equal
    length (SNK2); without text nothing, but the time of every segment passes, silent ones too. Cues start where their segment does and are
    numbered from 1. ``faithful`` keeps the sums of the formula to match: a file starts at the last shown length of the files before it (not of
    segments), made-up lines are shifted by the segment's start besides, and an end is its start's shift plus its length.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("_at", F.coalesce(F.sum("duration").over(w), F.lit(0.0))).select(group, order, "segment_id", "_at", "duration", "subtitle_text")
    own = placed.join(cues.select("segment_id", "cue_idx", F.col("start").alias("_s"), F.col("end").alias("_e"), "text"), "segment_id")
    texts = placed.join(cues.select("segment_id").distinct(), "segment_id", "left_anti").where("subtitle_text != ''")
    made = split_evenly(texts.withColumns({"text": F.col("subtitle_text"), "start": F.col("_at") if faithful else F.lit(0.0)})).select(
        group, order, "segment_id", "_at", F.col("line_no").alias("cue_idx"), F.col("cue_start").alias("_s"), F.col("cue_end").alias("_e"), F.trim("line").alias("text")
    )
    both = own.select(*made.columns).unionByName(made)
    if faithful:
        last = both.groupBy(group, order).agg(F.max_by(F.col("_e") - F.col("_s"), "cue_idx").alias("_step"))
        offsets = last.select(group, order, F.coalesce(F.sum("_step").over(w), F.lit(0.0)).alias("_off"))
        both = both.join(offsets, [group, order]).withColumns({"start": F.col("_off") + F.col("_s"), "end": F.col("_off") + F.col("_e") - F.col("_s")})
    else:
        both = both.withColumns({"start": F.col("_at") + F.col("_s"), "end": F.col("_at") + F.col("_e")})
    n = F.row_number().over(Window.partitionBy(group).orderBy(order, "cue_idx"))
    return both.select(group, n.alias("cue_no"), "segment_id", "start", "end", "text")


def context_tail(rows: DataFrame, group: str, order: str, text: str = "text", length: int = 50) -> DataFrame:
    """``context``, the last ``length`` characters of the last text before each row that is not empty; null for the first.

    A row takes at most ``length`` characters of another, so what moves is small whatever the texts are.
    """
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tail = F.right(F.nullif(F.col(text), F.lit("")), F.lit(length))
    return rows.withColumn("context", F.last(tail, ignorenulls=True).over(w))


def split_evenly(texts: DataFrame, most: int = 5) -> DataFrame:
    """SNK2: the first ``most`` lines of a text as cues of equal length."""
    lines = F.slice(F.split(F.trim(F.col("text")), "\n"), 1, most)
    out = texts.withColumn("_lines", lines).withColumn("_n", F.size("_lines")).select("*", F.posexplode("_lines").alias("line_no", "line"))
    each = F.col("duration") / F.col("_n")
    return out.withColumns({"cue_start": F.col("start") + each * F.col("line_no"), "cue_end": F.col("start") + each * (F.col("line_no") + 1)}).drop("_lines", "_n")


def narration_lengths(texts: DataFrame) -> DataFrame:
    """SNK3: seconds of a narration: characters without blanks / 2.5, between 2 and 10."""
    chars = F.length(F.regexp_replace("text", "[ \n]", ""))
    return texts.withColumn("duration", F.greatest(F.lit(2.0), F.least(F.lit(10.0), chars / 2.5)))


def narration_cues(segments: DataFrame, group: str, order: str) -> DataFrame:
    """SNK3: cues of a narration's segments(group, order, timestamp, text), numbered from 1: from their time (without one: 5 seconds a segment
    before it) for as long as their text is spoken; :func:`..sources.files.srt_blocks` makes the file's blocks of them."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    start = F.coalesce(F.col("timestamp"), (place - 1) * 5.0)
    out = narration_lengths(segments.withColumns({"cue_no": place, "start": start, "text": F.coalesce("text", F.lit(""))}))
    return out.withColumn("end", F.col("start") + F.col("duration")).select(group, "cue_no", "start", "end", "text")


def transcript(cues: DataFrame, most: int = 8000) -> DataFrame:
    """Non-empty texts of a job as lines '[E1 5s]: text' in order, cut to ``most`` characters.

    Lines that start beyond the cut go before they are collected (a running length), so a job of any size gives a row of at most ``most`` characters.
    """
    line = F.concat(F.lit("[E"), F.col("episode").cast("string"), F.lit(" "), F.bround("start", 0).cast("long").cast("string"), F.lit("s]: "), F.col("text"))
    some = cues.where("text is not null and text != ''").withColumn("_line", line)
    before = Window.partitionBy("job").orderBy("episode", "start", "_line").rowsBetween(Window.unboundedPreceding, -1)
    near = some.withColumn("_line", F.left("_line", F.lit(most + 1))).withColumn("_used", F.coalesce(F.sum(F.length("_line") + 1).over(before), F.lit(0))).where(F.col("_used") < most)
    rows = F.array_sort(F.collect_list(F.struct("episode", "start", "_line")))
    return near.groupBy("job").agg(F.left(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n"), F.lit(most)).alias("transcript"))
