"""The flagship plan: score, choose, order and show highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import weighted_total
from ..operators import selection


def highlights(segments: DataFrame, ratio: float = 0.3, min_duration: float = 2.0, per_episode: int = 1, target: float | None = None) -> DataFrame:
    """Scored segments in, ordered highlights out; short segments go before they are scored."""
    scored = selection.long_enough(segments, min_duration).withColumn("total_score_raw", weighted_total())
    scored = scored.withColumn("total_score", F.round("total_score_raw", 4))
    return selection.emotion_ramp(selection.select_highlights(scored, ratio, min_duration, per_episode, target))


def score_segments(segments: DataFrame, audio: DataFrame | None = None, emotion: DataFrame | None = None, visual: DataFrame | None = None) -> DataFrame:
    """F1 to F10 in one row: segments(segment_id, start_time, end_time, duration, audio_path, subtitle_text, video_path) with their four scores.

    audio(segment_id, audio_score), emotion(segment_id, emotion_score) and visual(segment_id, visual_score, has_face, closeup) hold a row for what could be
    scored. Without a sound, text or video the fallbacks count (F2, F3), for one that could not be scored those of errors. The rhythm score takes the
    episode's length from ``episode_duration``, else the segment's end, and falls back to the length alone (F10) where a time is missing.
    """
    out = segments
    for table, columns in ((audio, ["audio_score"]), (emotion, ["emotion_score"]), (visual, ["visual_score", "has_face", "closeup"])):
        if table is None:
            out = out.withColumns({c: F.lit(None).cast("boolean" if c in ("has_face", "closeup") else "double") for c in columns})
        else:
            out = out.join(table.select("segment_id", *columns), "segment_id", "left")
    d, start = F.col("duration"), F.col("start_time")
    episode = F.coalesce("episode_duration", "end_time") if "episode_duration" in segments.columns else F.col("end_time")
    return out.withColumns({
        "audio_score": scoring.audio_or_default(F.col("audio_score"), F.col("audio_path"), scoring.audio_default(d)),
        "emotion_score": scoring.emotion_or_default(F.col("emotion_score"), F.col("subtitle_text")),
        "visual_score": scoring.visual_or_default(F.col("visual_score"), F.col("video_path")),
        "rhythm_score": F.when(d.isNull() | start.isNull() | episode.isNull(), scoring.rhythm_default(d)).otherwise(scoring.rhythm_total(d, start, episode)),
        "has_face": F.coalesce("has_face", F.lit(False)), "closeup": F.coalesce("closeup", F.lit(False)),
    })


def shown(chosen: DataFrame) -> DataFrame:
    """What is shown of the chosen segments: place, episode, rounded score, start and length, and the reason."""
    action = F.col("has_action") if "has_action" in chosen.columns else F.lit(False)
    why = scoring.reason(F.col("closeup"), F.col("has_face"), action, F.col("audio_score"), F.col("emotion_score"), F.col("visual_score"), F.coalesce("subtitle_text", F.lit("")))
    return chosen.select(
        "drama_id", "rank", F.col("episode_index").alias("episode"), F.bround(F.coalesce("total_score", F.lit(0.0)), 3).alias("score"), F.bround("start_time", 1).alias("start_time"),
        F.bround("duration", 1).alias("duration"), why.alias("reason"),
    )


def direct_cut(segments: DataFrame, audio: DataFrame | None = None, emotion: DataFrame | None = None, visual: DataFrame | None = None, ratio: float = 0.3, min_duration: float = 2.0,
               per_episode: int = 1, target: float | None = 30.0) -> DataFrame:
    """The whole way from scenes and features to ordered highlights: short segments go first, the rest are scored, chosen and ordered."""
    return highlights(score_segments(selection.long_enough(segments, min_duration), audio, emotion, visual), ratio, min_duration, per_episode, target)


def in_edit(chosen: DataFrame) -> DataFrame:
    """Where each chosen segment starts in the edit."""
    before = Window.partitionBy("drama_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return chosen.withColumn("edited_start", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
