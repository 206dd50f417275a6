"""Summaries, batches and texts for people and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_batches(rows: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """The number of each row's batch of ``size`` within its group; put the episode into ``group`` for unmixed batches."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("batch_index", F.floor(place / size).cast("long"))


def analysis_texts(frames: DataFrame) -> DataFrame:
    """One text per batch from frames(group_id, batch_index, frame_no, episode, timestamp, text): a headline and the text of each frame."""
    part = F.concat(F.lit("=== [E"), F.col("episode").cast("string"), F.lit("] "), "timestamp", F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("frame_no", part.alias("t"))))
    return frames.groupBy("group_id", "batch_index").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))


# The lines of the frame report.
_HEAD, _TIME, _WHAT, _DETAIL = "## 片段 ", "- 时间范围：", "- 片段描述：", "- 详细描述："


def frame_report(summaries: DataFrame, frames: DataFrame) -> DataFrame:
    """SNK13/J5: a Markdown report per group of summaries(group_id, ord, batch_index, time_range, summary) with their frames.

    frames(group_id, batch_index, frame_no, timestamp, observation); a batch without frames keeps its heading, nulls are empty.
    """
    line = F.concat(F.lit("  - "), F.coalesce("timestamp", F.lit("")), F.lit(": "), F.coalesce("observation", F.lit("")), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("frame_no", line.alias("t"))))
    seen = frames.groupBy("group_id", "batch_index").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("_frames"))
    n = F.row_number().over(Window.partitionBy("group_id").orderBy("ord")).cast("string")
    nl = F.lit("\n")
    part = F.concat(
        F.lit(_HEAD), F.col("_n"), nl, F.lit(_TIME), F.coalesce("time_range", F.lit("")), nl, F.lit(_WHAT), F.coalesce("summary", F.lit("")), nl,
        F.lit(_DETAIL), nl, F.coalesce("_frames", F.lit("")), nl,
    )
    out = summaries.withColumn("_n", n).join(seen, ["group_id", "batch_index"], "left")
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("t"))))
    return out.groupBy("group_id").agg(F.array_join(F.transform(parts, lambda r: r["t"]), "").alias("markdown"))


def prompt_timeline(segments: DataFrame) -> DataFrame:
    """The chosen segments of a drama, in rank order, as one JSON list with their places in the edit."""
    w = Window.partitionBy("drama_id").orderBy("rank")
    start = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = [F.bround(c, 0).cast("long").cast("string") for c in (F.col("start_time"), F.col("start_time") + F.col("duration"))]
    span = F.concat(F.lit("E"), F.col("episode_index").cast("string"), F.lit(" "), whole[0], F.lit("s-"), whole[1], F.lit("s"))
    item = F.struct(
        F.col("rank").cast("int").alias("index"), F.col("episode_index").alias("episode"), F.round("_at", 1).alias("start_in_video"), F.round("duration", 1).alias("duration"),
        span.alias("original_time"), F.left(F.coalesce("subtitle_text", F.lit("")), F.lit(80)).alias("subtitle_preview"), F.col("total_score").alias("score"),
    )
    return segments.withColumn("_at", start).groupBy("drama_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("timeline"))


def audio_timeline(items: DataFrame, group: str = "script_id", order: str = "ord") -> DataFrame:
    """Where each item's sound starts; items without a sound leave their gap."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("duration").over(w), F.lit(0.0))
    return items.withColumn("position", at).where("coalesce(audio, '') != ''")


def mix_table(items: DataFrame, group: str = "script_id", order: str = "ord") -> DataFrame:
    """How each sound of an edit is mixed: its delay in milliseconds and its volume, the number of sounds and one for the silent track,
    which makes up for what mixing them takes away."""
    out = audio_timeline(items, group, order)
    count = F.count("*").over(Window.partitionBy(group))
    return out.withColumns({"delay_ms": (F.col("position") * 1000).cast("long"), "volume": count + 1})


def any_original_sound(items: DataFrame, group: str = "script_id") -> DataFrame:
    """Whether any item of a script plays the film's own sound."""
    return items.groupBy(group).agg(F.coalesce(F.bool_or(F.col("OST") == 1), F.lit(False)).alias("original_sound"))


def joined_texts(rows: DataFrame, group: str, order: str, text: str = "text", between: str = "\n") -> DataFrame:
    """The texts of a group in order as one."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda r: r["t"]), between).alias("text"))


def frame_report_of_files(analyses: DataFrame) -> DataFrame:
    """SRC11/SNK13: the Markdown report of each of analyses(group_id, summaries, frames), the two lists of one nested file.

    One scan: summaries and frames become rows of one table, meet by batch in one exchange (no join; a batch of null meets a null one) and the headed
    parts come together by file. Frames of a batch stand under each of its summaries.
    """
    rows = F.concat(
        F.transform(F.coalesce("frames", F.array().cast(analyses.schema["frames"].dataType)), lambda f, i: F.struct(
            f["batch_index"].alias("batch_index"), i.alias("n"), F.lit(True).alias("is_frame"), F.lit(None).cast("string").alias("time_range"), F.lit(None).cast("string").alias("summary"),
            F.concat(F.lit("  - "), F.coalesce(f["timestamp"], F.lit("")), F.lit(": "), F.coalesce(f["observation"], F.lit("")), F.lit("\n")).alias("line"))),
        F.transform(F.coalesce("summaries", F.array().cast(analyses.schema["summaries"].dataType)), lambda s, i: F.struct(
            s["batch_index"].alias("batch_index"), i.alias("n"), F.lit(False).alias("is_frame"), s["time_range"].alias("time_range"), s["summary"].alias("summary"), F.lit(None).cast("string").alias("line"))),
    )
    each = analyses.select("group_id", F.inline(rows))
    lines = F.array_sort(F.collect_list(F.when(F.col("is_frame"), F.struct("n", "line"))))
    heads = F.collect_list(F.when(~F.col("is_frame"), F.struct("n", "time_range", "summary")))
    batches = each.groupBy("group_id", "batch_index").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "").alias("_frames"), heads.alias("_heads"))
    nl = F.lit("\n")
    part = F.concat(
        F.lit(_HEAD), (F.col("h.n") + 1).cast("string"), nl, F.lit(_TIME), F.coalesce("h.time_range", F.lit("")), nl, F.lit(_WHAT), F.coalesce("h.summary", F.lit("")), nl, F.lit(_DETAIL), nl, "_frames", nl
    )
    parts = batches.select("group_id", F.explode("_heads").alias("h"), "_frames").select("group_id", F.col("h.n").alias("n"), part.alias("t"))
    return parts.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda r: r["t"]), "").alias("markdown"))


def pick_prompts(wanted: DataFrame, prompts: DataFrame) -> DataFrame:
    """The prompt of each wanted(category, name, version), the default version where none is given; null id where there is none."""
    default = prompts.groupBy("category", "name").agg(F.max("version").alias("_default"))
    out = wanted.join(default, ["category", "name"], "left").withColumn("version", F.coalesce("version", "_default")).drop("_default")
    return out.join(prompts, ["category", "name", "version"], "left")


def config_summary(checks: DataFrame) -> DataFrame:
    """Per kind of provider the number of providers, of valid ones, and the errors of the others, from checks(kind, provider, errors)."""
    bad = F.size("errors") > 0
    errors = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("provider", "errors")))), lambda r: r["errors"]))
    return checks.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), errors.alias("errors"))


def failure_levels(results: DataFrame, group: str) -> DataFrame:
    """Counts, success in percent, and ``failed`` (nothing succeeded), ``warn`` (over half failed) or ``ok``, from results(ok)."""
    g = results.groupBy(group).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    level = F.when(F.col("n_ok") == 0, "failed").when((F.col("n") - F.col("n_ok")) * 2 > F.col("n"), "warn").otherwise("ok")
    return g.withColumns({"success_rate": F.round(F.col("n_ok") * 100.0 / F.col("n"), 1), "level": level})
