"""Small row rules over task results, configurations, messages and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What debug messages are dropped for, and how far apart two segments may be swapped.
NOISE = ["已注册模板过滤器", "已注册提示词", "注册视觉模型提供商", "注册文本模型提供商", "LLM服务提供商注册", "FFmpeg支持的硬件加速器", "硬件加速测试优先级", "硬件加速方法"]
SWAP_SECONDS = 30.0


def without_errors(results: DataFrame, error: str = "error") -> DataFrame:
    """Results that have no error."""
    return results.where(F.coalesce(F.col(error), F.lit("")) == "")


def shown_messages(messages: DataFrame, patterns: list[str] = NOISE) -> DataFrame:
    """messages(level, message) without the debug ones that hold one of some texts."""
    noisy = F.lit(False)
    for p in patterns:
        noisy = noisy | F.contains(F.col("message"), F.lit(p))
    return messages.where(~((F.col("level") == "DEBUG") & F.coalesce(noisy, F.lit(False))))


def swappable(a: Column, b: Column, most: float = SWAP_SECONDS) -> Column:
    """Whether two segments (episode_index, start_time) may change places: of one episode and at most ``most`` seconds apart."""
    return (a["episode_index"] == b["episode_index"]) & (F.abs(a["start_time"] - b["start_time"]) <= most)


def swap_candidates(segments: DataFrame) -> DataFrame:
    """For each segment in rank order the next one and whether the two may change places."""
    w = Window.partitionBy("drama_id").orderBy("rank")
    me, other = F.struct("episode_index", "start_time"), F.lead(F.struct("ord", "episode_index", "start_time")).over(w)
    return segments.withColumn("_next", other).where("_next is not null").select("drama_id", "rank", "ord", F.col("_next.ord").alias("next_ord"), swappable(me, F.col("_next")).alias("safe"))


def in_turn(requests: DataFrame, keys: list[str], order: str, group: str) -> DataFrame:
    """The key that each request of a group gets, in turn: the second one first."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return requests.withColumn("api_key", F.get(F.array(*map(F.lit, keys)), F.pmod(n, F.lit(len(keys)))) if keys else F.lit(None).cast("string"))


def measured_loudness(log: Column) -> Column:
    """The loudness in the report of a log; null if there is none."""
    from ..functions.text import loudness_report

    return F.try_variant_get(loudness_report(log), "$.input_i", "string").try_cast("double")


def simple_gain(level: Column, target: float = -20.0) -> Column:
    """Decibels to the target level."""
    return F.lit(target) - level


def normalized_name(path: Column, folder: Column) -> Column:
    """The file that the normalised form of a sound goes to."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), stem, F.lit("_normalized.mp3"))


def script_choices(files: DataFrame, current: str = "", none: str = "None", upload: str = "Upload Script") -> DataFrame:
    """What a script is chosen from: two fixed rows, then the files(path, modified), newest first; ``selected`` marks the current path, else the first row. A script's time of change stands for that of its creation."""
    spark = files.sparkSession
    fixed = spark.createDataFrame([(0, none, "", None), (1, upload, "upload_script", None)], "kind int, name string, path string, modified timestamp")
    rows = fixed.unionByName(files.select(F.lit(2).alias("kind"), F.col("path").alias("name"), "path", F.col("modified").cast("timestamp").alias("modified")))
    known = rows.agg(F.coalesce(F.bool_or(F.col("path") == current), F.lit(False)).alias("_known"))
    marked = rows.join(F.broadcast(known)).withColumn("selected", F.when(F.col("_known"), F.col("path") == current).otherwise(F.col("kind") == 0))
    return marked.orderBy("kind", F.col("modified").desc(), "path").select("name", "path", "selected")


def upload_check(text: Column) -> Column:
    """``unreadable`` for a subtitle without text, ``too_short`` under 10 characters, else null."""
    return F.when(F.coalesce(text, F.lit("")) == "", "unreadable").when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")) < 10, "too_short")


def base_urls(providers: DataFrame, urls: DataFrame) -> DataFrame:
    """The address of each provider's gateway from urls(provider, url), and whether one must be given; other providers need none."""
    known = urls.select(F.lower("provider").alias("_p"), F.col("url").alias("base_url"))
    out = providers.join(known, F.lower(F.coalesce("provider", F.lit(""))) == F.col("_p"), "left")
    return out.withColumns({"required": F.col("_p").isNotNull(), "base_url": F.coalesce("base_url", F.lit(""))}).drop("_p")


def message_tokens(messages: DataFrame, tokens: Column, group: str) -> DataFrame:
    """Tokens of each conversation of messages(role, content): those of role and content by any tokenizer (``tokens``, a Column of both), 4 a message and 3."""
    return messages.groupBy(group).agg((F.sum(tokens + 4) + 3).alias("n_tokens"))


def provider_check(key: Column, model: Column, url: Column, prefix: Column) -> Column:
    """struct(is_valid, errors, warnings) of a provider's settings."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    errors = F.array_compact(F.array(F.when(empty(key), F.concat(F.lit("no "), prefix, F.lit("_api_key"))), F.when(empty(model), F.concat(F.lit("no "), prefix, F.lit("_model_name")))))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), F.array_compact(F.array(F.when(empty(url), "default base_url"))).alias("warnings"))


def chat_messages(prompt: Column, system: Column) -> Column:
    """The messages of a call: the system's where there is one, then the user's."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array_compact(F.array(F.when(F.coalesce(system, F.lit("")) != "", one("system", system)), one("user", prompt)))


def attach_clips(scenes: DataFrame, clips: DataFrame) -> DataFrame:
    """Scenes with the path of the clip of their time stamp; those without one keep their row (null)."""
    last = clips.groupBy("timestamp").agg(F.max("path").alias("path"))
    return scenes.join(last, "timestamp", "left")


def by_edit_start(items: DataFrame) -> DataFrame:
    """Items by where their range 'A-B' starts in the edit, those without one at 0, ties by ``_id``."""
    from ..functions.timecode import clock_bounds

    return items.withColumn("edit_start", F.coalesce(clock_bounds(F.col("editedTimeRange"))["start"], F.lit(0.0))).orderBy("edit_start", "_id")


def script_time(text: Column) -> Column:
    """H:M:S, M:S or S, with ,mmm, as HH:MM:SS,mmm; seconds and minutes of 60 and more carry over. Under four signs, or no such form: zero."""
    p = F.split(text, ",")
    at = F.split(F.get(p, F.lit(0)), ":")
    n = F.size(at)
    num = lambda c: F.trim(c).try_cast("long")
    h = F.when(n == 3, num(F.get(at, F.lit(0)))).otherwise(F.lit(0).cast("long"))
    m = F.when(n == 3, num(F.get(at, F.lit(1)))).when(n == 2, num(F.get(at, F.lit(0)))).otherwise(F.lit(0).cast("long"))
    s = F.when(n == 3, num(F.get(at, F.lit(2)))).when(n == 2, num(F.get(at, F.lit(1)))).otherwise(num(F.get(at, F.lit(0))))
    ms = F.when(F.size(p) == 1, F.lit(0).cast("long")).when(F.size(p) == 2, num(F.get(p, F.lit(1))))
    m2 = m + F.when(s >= 60, F.floor(s / 60)).otherwise(0)
    code = F.format_string("%02d:%02d:%02d,%03d", h + F.when(m2 >= 60, F.floor(m2 / 60)).otherwise(0), F.when(m2 >= 60, m2 % 60).otherwise(m2), F.when(s >= 60, s % 60).otherwise(s), ms)
    return F.when(~(F.length(text) < 4) & (h + m + s + ms).isNotNull(), code).otherwise("00:00:00,000")
