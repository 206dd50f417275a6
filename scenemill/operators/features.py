"""Aggregates over audio frames and picture frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import visual_parts
from ..functions.scoring import clamp


def audio_scores(frames: DataFrame, sample_rate: int = 22050) -> DataFrame:
    """One score row for each segment of audio_frames(segment_id, frame_idx, rms, rms_db, zcr, centroid)."""
    w = Window.partitionBy("segment_id").orderBy("frame_idx")
    d = frames.withColumn("_d", F.abs(F.col("rms") - F.lag("rms").over(w)))
    g = d.groupBy("segment_id").agg(
        F.count("*").alias("n"), F.avg((F.col("rms_db") > -10).cast("double")).alias("loud"), F.max("rms_db").alias("max_db"),
        F.avg("_d").alias("d_mean"), F.max("_d").alias("d_max"), F.stddev_pop("_d").alias("d_std"),
        F.max("rms").alias("hi"), F.min("rms").alias("lo"), F.avg("zcr").alias("z_mean"), F.stddev_pop("zcr").alias("z_std"),
        F.avg("centroid").alias("c_mean"), F.stddev_pop("centroid").alias("c_std"),
    )
    one = F.lit(1.0)
    peak = 0.6 * F.least(one, (F.col("max_db") + 80.0) / 80.0) + 0.4 * F.least(one, 5.0 * F.col("loud"))
    change = F.when(F.col("d_std") > 0, F.least(one, 2.0 * F.col("d_mean") / F.col("d_std"))).otherwise(0.0)
    energy = F.when(F.col("n") < 2, 0.0).otherwise(0.5 * change + 0.5 * F.least(one, 5.0 * F.col("d_max")))
    dynamic = F.when(F.col("hi") > 0, F.least(one, 2.0 * (F.col("hi") - F.col("lo")) / F.col("hi"))).otherwise(0.0)
    zcr = 0.7 * F.least(one, F.col("z_mean") / 0.15) + 0.3 * F.least(one, F.col("z_std") / 0.05)
    spectral = 0.6 * F.least(one, F.col("c_mean") / (sample_rate / 4.0)) + 0.4 * F.least(one, F.col("c_std") / 1000.0)
    parts = g.select("segment_id", "n", peak.alias("peak"), energy.alias("energy"), dynamic.alias("dynamic"), zcr.alias("zcr"), spectral.alias("spectral"))
    total = 0.30 * F.col("peak") + 0.25 * F.col("energy") + 0.20 * F.col("dynamic") + 0.15 * F.col("zcr") + 0.10 * F.col("spectral")
    return parts.withColumn("audio_score", clamp(total))


def visual_scores(frames: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """One row for each video of frames(video_id, frame_idx, face_count, is_closeup, center_x, center_y, edge_density, sharpness).

    With ``videos`` (video_id) those without a frame have a row too, scored 0.17 as without faces, edges and blur.
    """
    away = (F.abs(F.col("center_x") - 0.5) + F.abs(F.col("center_y") - 0.5)) / 2
    g = frames.groupBy("video_id").agg(
        F.count("*").alias("frames_analyzed"), F.avg((F.col("face_count") > 0).cast("double")).alias("face_ratio"),
        F.avg(F.col("is_closeup").cast("double")).alias("closeup_ratio"), F.avg((F.col("sharpness") < 100).cast("double")).alias("blurry_ratio"),
        F.avg("face_count").alias("avg_faces"), F.avg("sharpness").alias("avg_sharpness"), F.avg("edge_density").alias("avg_edge"),
        F.coalesce(1.0 - F.least(F.lit(1.0), F.avg(away)), F.lit(0.0)).alias("center_score"),
        F.min_by(F.struct("center_x", "center_y"), F.when(F.col("center_x").isNotNull(), F.col("frame_idx"))).alias("face_center"),
    )
    if videos is not None:
        g = videos.select("video_id").distinct().join(g, "video_id", "left").na.fill(0)
    parts = visual_parts(*map(F.col, ("face_ratio", "avg_faces", "center_score", "closeup_ratio", "avg_edge", "avg_sharpness", "blurry_ratio")))
    return g.withColumns(parts).withColumns({"has_face": F.col("face_ratio") > 0.3, "closeup": F.col("closeup_ratio") > 0.3})


def loudness_by_segment(samples: DataFrame) -> DataFrame:
    """F24 over samples(segment_id, value): root mean square and its level."""
    from ..functions.scoring import rms_db

    g = samples.groupBy("segment_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return g.withColumn("rms_db", rms_db(F.col("rms")))
