"""Scenes from change points; cues from words; batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_points(diffs: DataFrame, threshold: float, min_length: float, duration: str = "duration") -> DataFrame:
    """Accepted change points of each video, from diffs(video_id, ts, diff, duration).

    A sampled point counts if its difference passes 2.5 thresholds and it lies ``min_length`` or more after the last
    accepted one (from 0); the end is added if it is more than a second after the last. An ordered fold, in the JVM.
    """
    g = diffs.groupBy("video_id").agg(
        F.max(duration).alias("duration"), F.array_sort(F.collect_list(F.when(F.col("diff") > threshold * 2.5, F.col("ts")))).alias("ts")
    )
    points = F.aggregate(
        "ts", F.array(F.lit(0.0)), lambda acc, x: F.when(x - F.element_at(acc, -1) >= min_length, F.concat(acc, F.array(x))).otherwise(acc)
    )
    g = g.withColumn("points", points)
    tail = F.when(F.col("duration") - F.element_at("points", -1) > 1.0, F.concat("points", F.array("duration"))).otherwise(F.col("points"))
    return g.select("video_id", "duration", tail.alias("points"))


def scenes(points: DataFrame, min_length: float, max_length: float) -> DataFrame:
    """Neighbouring points to scenes; short ones go, long ones are cut into pieces of ``max_length`` without short rests."""
    pair = F.transform(
        F.sequence(F.lit(1), F.size("points") - 1),
        lambda i: F.struct(F.element_at("points", i).alias("start_time"), F.element_at("points", i + 1).alias("end_time"), i.alias("i")),
    )
    raw = points.where(F.size("points") > 1).select("video_id", F.explode(pair).alias("s")).select("video_id", "s.*")
    return split_long(raw.where(F.col("end_time") - F.col("start_time") >= min_length), min_length, max_length)


def split_long(raw: DataFrame, min_length: float, max_length: float) -> DataFrame:
    """S3."""
    d = F.col("end_time") - F.col("start_time")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(d / max_length).cast("int") - 1, F.lit(0))))
    piece = raw.withColumn("piece", k)
    lo = F.col("start_time") + F.col("piece") * F.lit(float(max_length))
    out = piece.withColumns({"_lo": lo, "_hi": F.least(F.col("end_time"), lo + max_length)})
    keep = F.col("_hi") - F.col("_lo") >= min_length
    return out.where(keep).withColumns({"start_time": F.col("_lo"), "end_time": F.col("_hi"), "duration": F.col("_hi") - F.col("_lo")}).drop("_lo", "_hi")


def numbered_scenes(raw: DataFrame, min_length: float, max_length: float, group: str = "video_id") -> DataFrame:
    """S2/S3 with W16: scenes of raw(group, i, start_time, end_time), i from 0 in order, with their ``scene_index``.

    Short raw scenes go, long ones are cut into pieces, and each scene's number is its place i, plus 1, plus how many scenes came out of
    the raw ones before it, plus its own piece's number: numbers skip where raw scenes went or were cut. One prefix sum over a video's counts,
    taken before the pieces are made.
    """
    d = F.col("end_time") - F.col("start_time")
    whole = F.floor(d / max_length).cast("long")
    cut_count = whole + (d - whole * F.lit(float(max_length)) >= min_length).cast("long")
    count = F.when(d < min_length, 0).when(d > max_length, cut_count).otherwise(1)
    before = Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("i") + 1 + F.coalesce(F.sum(count).over(before), F.lit(0))
    some = raw.withColumns({"_n": count, "_base": base}).where("_n > 0")
    each = some.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    long = F.col("end_time") - F.col("start_time") > max_length
    lo = F.col("start_time") + F.when(long, F.col("piece") * F.lit(float(max_length))).otherwise(0.0)
    out = each.withColumns({"_lo": lo, "_hi": F.when(long, F.least(F.col("end_time"), lo + max_length)).otherwise(F.col("end_time"))})
    return out.select(group, (F.col("_base") + F.col("piece")).alias("scene_index"), F.col("_lo").alias("start_time"), F.col("_hi").alias("end_time"), (F.col("_hi") - F.col("_lo")).alias("duration"))


def raw_scenes(points: DataFrame, group: str = "video_id") -> DataFrame:
    """Neighbouring ``points`` of each video as raw scenes, numbered from 0."""
    pair = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))),
        lambda k: F.struct((k - 1).cast("long").alias("i"), F.get("points", k - 1).alias("start_time"), F.get("points", k).alias("end_time")),
    )
    return points.where(F.size("points") > 1).select(group, F.inline(pair))


def episode_scenes(episodes: DataFrame, diffs: DataFrame, threshold: float = 30.0, min_length: float = 2.0, max_length: float = 8.0) -> DataFrame:
    """The scenes of all episodes(drama_id, ord, video_id, duration) from frame differences diffs(video_id, ts, diff), in one job.

    Episodes are numbered from 1 by ``ord`` within a drama. An episode without a frame, or without a length, could not be scanned: it
    is one scene of its whole length (60 seconds if that is unknown), numbered 1. One all of whose scenes are too short has none.
    """
    number = F.row_number().over(Window.partitionBy("drama_id").orderBy("ord"))
    known = episodes.withColumn("episode_index", number)
    seen = diffs.join(known.where("duration is not null").select("video_id", "duration"), "video_id")
    found = numbered_scenes(raw_scenes(change_points(seen, threshold, min_length)), min_length, max_length)
    scanned = seen.select("video_id").distinct()
    length = F.coalesce("duration", F.lit(60.0))
    whole = known.join(scanned, "video_id", "left_anti").select("video_id", F.lit(1).cast("long").alias("scene_index"), F.lit(0.0).alias("start_time"), length.alias("end_time"), length.alias("duration"))
    return known.select("drama_id", "episode_index", "video_id").join(found.unionByName(whole), "video_id").select("drama_id", "episode_index", "video_id", "scene_index", "start_time", "end_time", "duration")


def as_segments(scenes: DataFrame) -> DataFrame:
    """Scenes as segments with an id of episode, number and start."""
    start = F.format_string("%.1f", F.bround("start_time", 1))
    name = F.concat(F.lit("ep"), F.col("episode_index").cast("string"), F.lit("_scn"), F.col("scene_index").cast("string"), F.lit("_"), start, F.lit("s"))
    return scenes.withColumn("segment_id", name)


def with_fallback(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """An episode without scenes becomes one scene of its whole length."""
    whole = episodes.join(found.select("video_id").distinct(), "video_id", "left_anti")
    return found.select("video_id", "start_time", "end_time").unionByName(
        whole.select("video_id", F.lit(0.0).alias("start_time"), F.col("duration").alias("end_time"))
    )


def word_cues(words: DataFrame, marks: str) -> DataFrame:
    """Cues from words(_id, word_idx, start, end, text), closed by a word that holds one of ``marks``.

    A word that is one mark alone at the start of a cue closes nothing and adds no text, but its start counts.
    The final mark of a closed cue is stripped; empty cues go.
    """
    w = Window.partitionBy("_id").orderBy("word_idx")
    p = F.col("text").rlike(f"[{marks}]")
    out = words.withColumn("_p", p)
    out = out.withColumn("_sw", F.col("_p") & (F.length("text") == 1) & F.coalesce(F.lag("_p").over(w), F.lit(True)))
    out = out.withColumn("_b", F.col("_p") & ~F.col("_sw"))
    island = F.coalesce(F.sum(F.col("_b").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct("word_idx", F.when(F.col("_sw"), "").otherwise(F.col("text")).alias("t"))))
    g = out.withColumn("cue", island).groupBy("_id", "cue").agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("t"), F.max("_b").alias("closed"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    text = F.when(F.col("closed"), F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    return g.select("_id", "cue", text.alias("text"), "start", "end").where("text != ''")


def batch_ranges(files: DataFrame, size: int) -> DataFrame:
    """First and last time of each batch of ``size`` files; a batch of one borrows the previous batch's last as its start."""
    b = files.withColumn("batch", F.floor(F.col("ord") / size).cast("long"))
    g = b.groupBy("group_id", "batch").agg(F.count("*").alias("n"), F.min_by("t", "ord").alias("first_t"), F.max_by("t", "ord").alias("last_t"))
    before = F.lag("last_t").over(Window.partitionBy("group_id").orderBy("batch"))
    return g.select("group_id", "batch", "n", F.when(F.col("n") == 1, F.coalesce(before, F.col("first_t"))).otherwise(F.col("first_t")).alias("start_t"), F.col("last_t").alias("end_t"))
