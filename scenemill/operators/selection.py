"""Choosing and ordering highlight segments with windows per drama."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _drama():
    return Window.partitionBy("drama_id")


def _episode():
    return Window.partitionBy("drama_id", "episode_index")


def _best():
    return [F.col("total_score_raw").desc(), F.col("ord")]


def long_enough(segments: DataFrame, min_duration: float = 2.0) -> DataFrame:
    """Segments of at least ``min_duration``; put before scoring, so that short ones are never scored."""
    return segments.where(F.col("duration") >= min_duration)


def rank_top(segments: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Adds ``top``: whether a segment is in its drama's best max(1, int(n * ratio)) by unrounded score."""
    place = F.row_number().over(_drama().orderBy(*_best()))
    most = F.greatest(F.lit(1), (F.count("*").over(_drama()) * F.lit(ratio)).cast("int"))
    return segments.withColumn("top", place <= most)


def cover_episodes(ranked: DataFrame, per_episode: int = 1) -> DataFrame:
    """Keeps the top and fills every episode up to ``per_episode`` (at least its best one).

    Adds ``ep_rank`` and ``phase`` (0 top, 1 best of an uncovered episode, 2 filled up), which order ties later.
    """
    out = ranked.withColumn("ep_rank", F.row_number().over(_episode().orderBy(*_best())))
    out = out.withColumn("_top", F.sum(F.col("top").cast("int")).over(_episode()))
    phase = F.when(F.col("top"), 0).when((F.col("_top") == 0) & (F.col("ep_rank") == 1), 1).otherwise(2)
    return out.withColumn("phase", phase).where(F.col("ep_rank") <= F.greatest("_top", F.lit(1), F.lit(per_episode))).drop("_top")


def cap_episodes(ranked: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` segments of an episode (an option that the default selection leaves off)."""
    return ranked.withColumn("_n", F.row_number().over(_episode().orderBy(*_best()))).where(F.col("_n") <= most).drop("_n")


def fit_duration(covered: DataFrame, target: float | None) -> DataFrame:
    """Greedy prefix by score until 95 % of the target; from 70 % on nothing that would pass 130 %. No target: all."""
    if not target:
        return covered
    order = _drama().orderBy(F.col("total_score_raw").desc(), "phase", "episode_index", "ep_rank")
    upto = F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("_upto") - F.col("duration")
    fits = (before < 0.95 * target) & ~((before >= 0.70 * target) & (F.col("_upto") > 1.30 * target))
    return covered.withColumn("_upto", upto).where(fits).drop("_upto")


def finalize(chosen: DataFrame) -> DataFrame:
    """Rank by episode and time."""
    order = _drama().orderBy("episode_index", "start_time", "ord")
    return chosen.withColumns({"rank": F.row_number().over(order), "selected": F.lit(True)})


def select_highlights(
    segments: DataFrame, ratio: float = 0.3, min_duration: float = 2.0, per_episode: int = 1, target: float | None = None, cap: int | None = None
) -> DataFrame:
    """W1 to W4. All windows share one exchange by drama."""
    ranked = rank_top(long_enough(segments, min_duration), ratio)
    covered = cover_episodes(cap_episodes(ranked, cap) if cap else ranked, per_episode)
    return finalize(fit_duration(covered, target))


def emotion_ramp(selected: DataFrame, reach: float = 30.0) -> DataFrame:
    """By episode and time; an episode with over two segments rises by score if its extremes start within ``reach`` seconds."""
    by_score = _episode().orderBy("total_score", "start_time", "ord")
    full = by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = selected.withColumns({
        "_n": F.count("*").over(_drama()), "_ne": F.count("*").over(_episode()),
        "_near": F.abs(F.first("start_time").over(full) - F.last("start_time").over(full)) <= reach,
        "_s": F.row_number().over(by_score), "_t": F.row_number().over(_episode().orderBy("start_time", "ord")),
    })
    place = F.when((F.col("_n") > 2) & (F.col("_ne") > 2) & F.col("_near"), F.col("_s")).otherwise(F.col("_t"))
    out = out.withColumn("_place", place).withColumn("rank", F.row_number().over(_drama().orderBy("episode_index", "_place")))
    return out.drop("_n", "_ne", "_near", "_s", "_t", "_place")


def ordering_quality(ordered: DataFrame) -> DataFrame:
    """A3: one row of ordering measures per drama (``status`` too_few_segments under two)."""
    w = _drama().orderBy("rank")
    step = ordered.withColumns({"_e": F.lag("episode_index").over(w), "_s": F.lag("start_time").over(w), "_v": F.lag("total_score").over(w)})
    same = F.col("_e") == F.col("episode_index")
    g = step.groupBy("drama_id").agg(
        F.count("*").alias("segment_count"),
        F.count_if(F.col("_e") > F.col("episode_index")).alias("inv"), F.count_if(same).alias("checks"),
        F.count_if(same & (F.col("_s") > F.col("start_time"))).alias("errors"),
        F.count_if(F.col("total_score") > F.col("_v")).alias("inc"), F.count_if(F.col("total_score") < F.col("_v")).alias("dec"),
        F.avg("duration").alias("mu"), F.stddev_pop("duration").alias("sd"), F.sum("duration").alias("total"),
        F.min("total_score").alias("lo"), F.max("total_score").alias("hi"), F.avg("total_score").alias("mean"),
    )
    trend = F.when(F.col("inc") >= F.col("dec"), "rising").when(F.col("dec") > F.col("inc") * 1.5, "falling").otherwise("stable")
    return g.select(
        "drama_id", F.when(F.col("segment_count") < 2, "too_few_segments").otherwise("ok").alias("status"), "segment_count",
        F.round(1.0 - F.col("inv") / F.greatest(F.lit(1), F.col("segment_count") - 1), 3).alias("episode_continuity"),
        F.round(1.0 - F.col("errors") / F.greatest(F.lit(1), F.col("checks")), 3).alias("temporal_order"), trend.alias("emotion_trend"),
        F.round(F.col("inc") / F.greatest(F.lit(1), F.col("segment_count") - 1), 3).alias("trend_ratio"),
        F.round(F.when(F.col("mu") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("sd") / F.col("mu"))).otherwise(0.0), 3).alias("rhythm_balance"),
        F.round("mu", 2).alias("avg_duration"), F.round("sd", 2).alias("duration_std"), F.round("total", 1).alias("total_duration"),
        F.format_string("%.2f ~ %.2f", "lo", "hi").alias("score_range"), F.round("mean", 3).alias("avg_score"),
    )


def selection_stats(segments: DataFrame, selected: DataFrame) -> DataFrame:
    """A1: counts, share, episodes, duration and scores of the selection per drama, zeros where nothing was chosen."""
    n = segments.groupBy("drama_id").agg(F.count("*").alias("total_segments"))
    s = selected.groupBy("drama_id").agg(
        F.count("*").alias("selected_segments"), F.countDistinct("episode_index").alias("episodes"), F.sum("duration").alias("total_duration"),
        F.round(F.avg("total_score_raw"), 4).alias("avg_score"), F.max("total_score_raw").alias("max_score"), F.min("total_score_raw").alias("min_score"),
    )
    out = n.join(s, "drama_id", "left").na.fill(0)
    return out.withColumn("selected_ratio", F.round(F.col("selected_segments") / F.col("total_segments"), 4))


def result_summary(selected: DataFrame) -> DataFrame:
    """A2."""
    return selected.groupBy("drama_id").agg(
        F.count("*").alias("segment_count"), F.round(F.sum("duration"), 1).alias("total_duration"),
        F.countDistinct("episode_index").alias("episode_count"), F.round(F.avg("total_score_raw"), 3).alias("avg_score"),
    )


def best_segment(segments: DataFrame) -> DataFrame:
    """The first best segment of each drama."""
    return segments.withColumn("_n", F.row_number().over(_drama().orderBy(*_best()))).where("_n = 1").drop("_n")
