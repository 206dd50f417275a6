"""Sampled frames: grids of frame numbers and the stored frames that stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc

#: Grid points of a video that share one task.
POINTS = 4096


def _dealt(lots: DataFrame) -> DataFrame:
    """Rows that stand for POINTS points each, dealt over all tasks before they are made points: a small file is one task's, whatever it grows to.

    With a number of partitions, so that Spark does not join the small rows again.
    """
    return lots.repartition(int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id", "_lot")


def frame_grid(videos: DataFrame, sample_fps: float = 1.0) -> DataFrame:
    """SRC20: the frame numbers that are looked at in each of videos(video_id, fps, total_frames): every max(1, int(fps / sample_fps)).

    A missing or zero fps counts as 25. Returns video_id, interval, sample (from 0) and frame_no; a video without frames has no row.
    """
    fps = F.coalesce(F.when(F.col("fps") != 0, F.col("fps")), F.lit(25.0))
    step = F.greatest(F.lit(1), F.floor(fps / sample_fps)).cast("long")
    some = videos.where("total_frames > 0").select("video_id", step.alias("interval"), F.col("total_frames").cast("long").alias("_total"))
    # Long videos are spread first: a row for each POINTS points, then the points.
    last = F.floor((F.col("_total") - 1) / F.col("interval"))
    lots = some.withColumn("_last", last).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / POINTS))))
    low = F.col("_lot") * POINTS
    each = _dealt(lots).withColumn("sample", F.explode(F.sequence(low, F.least(low + POINTS - 1, F.col("_last")))))
    return each.select("video_id", "interval", "sample", (F.col("sample") * F.col("interval")).alias("frame_no"))


def frames_at(points: DataFrame, frames: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The last stored frame at or before each point: points(video_id, frame_no, ...), frames(video_id, frame_no, ...).

    As-of join without a range join: frames and points meet in ranges of ``width`` frame numbers; what stands before a range is
    carried in from the last frame of the nearest earlier range that has any (one row a range). A video of any length is spread over its
    ranges and every row is sorted once. Of several frames of one number the greatest row counts. Points without a frame before
    them have nulls. The frame's columns come as they are, its number as ``found_no``.
    """
    names = [c for c in frames.columns if c not in ("video_id", "frame_no")]
    kept = [c for c in points.columns if c not in ("video_id", "frame_no")]
    row = F.struct(F.col("frame_no").alias("found_no"), *names)
    of = F.floor(F.col("frame_no") / width)
    stored = frames.where("frame_no is not null").select("video_id", of.alias("_range"), "frame_no", row.alias("_frame"))
    asked = points.withColumn("_range", of).withColumn("_point", F.struct(*kept) if kept else F.struct(F.lit(True).alias("_")))
    last = stored.groupBy("video_id", "_range").agg(F.max("_frame").alias("_last"))
    wanted = asked.select("video_id", "_range").distinct().withColumn("_asked", F.lit(True))
    steps = last.join(wanted, ["video_id", "_range"], "full")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = steps.withColumn("_frame", before).where("_asked and _frame is not null").select("video_id", "_range", (F.col("_range") * width).alias("frame_no"), "_frame", F.lit(0).alias("_kind"))
    both = carried.unionByName(stored.withColumn("_kind", F.lit(1)), allowMissingColumns=True).unionByName(
        asked.select("video_id", "_range", "frame_no", "_point").withColumn("_kind", F.lit(2)), allowMissingColumns=True
    )
    w = Window.partitionBy("video_id", "_range").orderBy("frame_no", "_kind", "_frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_frame", ignorenulls=True).over(w)).where("_kind = 2")
    return found.select("video_id", "frame_no", *[F.col("_point")[c].alias(c) for c in kept], "_found.*")


def sampled_frames(videos: DataFrame, frames: DataFrame, sample_fps: float = 1.0) -> DataFrame:
    """SRC20: the frames that a video's picture score is made of: the stored frame at each point of the grid."""
    return frames_at(frame_grid(videos, sample_fps), frames)


def keyframes(videos: DataFrame, step: float = 5.0) -> DataFrame:
    """SRC21: seconds, frame number and file name of a picture every ``step`` seconds of videos(video_id, fps, duration).

    The last one lies before the end; milliseconds are cut, not rounded. A video without length has no row.
    """
    count = F.ceil(F.col("duration") / step).cast("long")
    lots = videos.where("duration > 0").withColumn("_n", count).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / POINTS))))
    low = F.col("_lot") * POINTS
    t = _dealt(lots).withColumn("_i", F.explode(F.sequence(low, F.least(low + POINTS, F.col("_n")) - 1))).withColumn("seconds", F.col("_i") * F.lit(float(step)))
    t = t.withColumn("frame_no", (F.col("seconds") * F.col("fps")).cast("long"))
    at = [F.floor(F.col("seconds") / 3600), F.floor(F.col("seconds") % 3600 / 60), F.floor(F.col("seconds") % 60), F.floor(F.col("seconds") % 1 * 1000)]
    name = F.concat(F.lit("keyframe_"), tc.digits(F.col("frame_no"), 6), F.lit("_"), *[tc.digits(x.cast("long"), n) for x, n in zip(at, (2, 2, 2, 3))], F.lit(".jpg"))
    return t.select("video_id", "seconds", "frame_no", name.alias("file_name"))
