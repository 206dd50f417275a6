"""File sources and sinks."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timecode as tc
from ..functions.text import natural_key, normalize_subtitle

#: The video types that a folder scan takes.
VIDEO_TYPES = ["mp4", "mov", "avi", "mkv", "flv", "wmv", "webm"]
#: Encodings tried for subtitles, in order.
ENCODINGS = ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "gbk", "gb2312"]


def file_table(spark: SparkSession, folder: str, types: list[str] | None = VIDEO_TYPES) -> DataFrame:
    """SRC1/SRC2: (path, size, modified) of the files of some types (None: all), folders included, without reading them; Spark lists no empty files."""
    some = "*.{" + ",".join(types) + "}" if types else "*"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", some).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Kinds of the catalogues of videos, songs and fonts.
CATALOGUES = {"videos": ["mp4", "mov", "avi", "mkv"], "songs": ["mp3"], "fonts": ["ttf", "ttc", "otf"]}


def catalogue(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """SRC3/O6/O13: the files of a kind: fonts by name, whatever the case of their ending, songs by path, videos by path from the last."""
    name = F.element_at(F.split("path", "/"), -1)
    case = "(?i)" if kind == "fonts" else ""
    files = file_table(spark, folder, None).withColumn("name", name).where(name.rlike(case + r"\.(" + "|".join(CATALOGUES[kind]) + r")\z"))
    return files.orderBy(F.col("path").desc() if kind == "videos" else F.col("name") if kind == "fonts" else F.col("path"))


def sorted_files(files: DataFrame, by: str = "modified", descending: bool = True) -> DataFrame:
    """SRC2: files by modification time, size or name (the last part of the path), ties by path; times of creation are not known to Spark's
    readers, so the modification time stands for them. Another ``by`` leaves the order."""
    keys = {"modified": F.col("modified"), "mtime": F.col("modified"), "ctime": F.col("modified"), "size": F.col("size"), "name": F.element_at(F.split("path", "/"), -1)}
    if by not in keys:
        return files
    return files.orderBy(keys[by].desc() if descending else keys[by].asc(), "path")


def in_natural_order(files: DataFrame, col: str = "path") -> DataFrame:
    """O3: digits count as numbers."""
    return files.orderBy(natural_key(F.col(col)))


def decode_subtitles(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC8: bytes to text: the first encoding that gives a time code, else the first that decodes, else UTF-8 with replacements."""

    @F.pandas_udf("string")
    def decode(column):
        import re

        stamp = re.compile(r"\d{2}:\d{2}:\d{2}[,.]\d{3}")

        def one(data):
            if data is None:
                return None
            usable = None
            for name in ENCODINGS:
                try:
                    text = data.decode(name)
                except (UnicodeDecodeError, UnicodeError):
                    continue
                usable = text if usable is None else usable
                if stamp.search(text):
                    return text
            return data.decode("utf-8", "replace") if usable is None else usable

        return column.map(one)

    return df.withColumn("text", normalize_subtitle(decode(content)))


def one_line_cues(cues: DataFrame) -> DataFrame:
    """SRC6: cues with their lines joined by spaces, trimmed, without those that hold no text."""
    joined = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+\z", "")
    return cues.withColumn("text", joined).where("text != ''")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """SRC4/SRC9: cues of SRT files in any of the known encodings."""
    return parse_srt(decode_subtitles(spark.read.format("binaryFile").load(path).select("path", "content")).select(F.col("path").alias("file_id"), "text"))


def parse_srt(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC4/SRC7: blocks of index, times and text between blank lines; blocks under three lines or without an arrow go."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    blocks = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(strip(F.col(text)), r"\n\s*\n")).alias("cue_idx", "block"))
    lines = F.split(strip(F.col("block")), "\n")
    times = F.split(F.get(lines, F.lit(1)), "-->")
    good = blocks.where((F.size(lines) >= 3) & F.contains(F.get(lines, F.lit(1)), F.lit("-->")))
    return good.select(
        *[c for c in df.columns if c != text], "cue_idx", tc.from_srt(F.get(times, F.lit(0))).alias("start"), tc.from_srt(F.get(times, F.lit(1))).alias("end"),
        F.array_join(F.slice(lines, 3, F.size(lines)), "\n").alias("text"),
    )


#: White space as a line may hold it, but for line feeds.
_BLANK = r"(?:[^\S\n]|[\x1c-\x1f])"
#: A time as a strict SRT line holds it.
_TIME = "[0-9]*:[0-9]*:[0-9]*,[0-9]*"


def strict_srt(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC5: cues of SRT texts read line by line: ``index`` from 1, the raw line of ``times`` and the text.

    A line with a time starts a cue (a later one before the blank line replaces its times), a blank line ends it, lines before the first time are
    nothing. So only what a blank line ends is a cue: the last one is lost where the text ends without a blank line. Cues are independent between blank
    lines, so a text is cut there once and every paragraph is looked at alone. Nulls and empty texts have no cues.
    """
    names = [c for c in df.columns if c != text]
    lines_only = F.regexp_replace(F.col(text), "\r\n?", "\n")
    paragraphs = F.split(lines_only, rf"(?Ud)(?<![^\n])(?:{_BLANK}*\n|{_BLANK}+\z)", -1)
    whole = F.slice(paragraphs, 1, F.size(paragraphs) - 1)  # what follows the last blank line has no end
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")

    def cue(paragraph):
        lines = F.split(paragraph, "\n")
        timed = F.transform(lines, lambda x: x.rlike(_TIME))
        first = F.array_position(timed, True).cast("int")
        said = F.filter(F.slice(lines, first, F.size(lines)), lambda x: ~x.rlike(_TIME))
        return F.struct(strip(F.element_at(F.filter(lines, lambda x: x.rlike(_TIME)), -1)).alias("times"), strip(F.array_join(said, "\n")).alias("text"))

    cues = F.transform(F.filter(whole, lambda p: p.rlike(_TIME)), cue)
    return df.select(*names, F.posexplode(cues).alias("_at", "_cue")).select(*names, (F.col("_at") + 1).alias("index"), "_cue.times", "_cue.text")


def read_strict_srt(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the cues of UTF-8 SRT files; a path without files has none."""
    try:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "file_id string, text string")
    return strict_srt(files)


#: What is read of a frame analysis.
ANALYSIS = (
    "struct<overall_activity_summaries:array<struct<batch_index:long,time_range:string,summary:string>>,"
    "frame_observations:array<struct<batch_index:long,frame_number:long,timestamp:string,observation:string>>>"
)


def frame_analyses(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC11: the two lists of frame-analysis JSON texts, ``summaries`` and ``frames``, in one row a text; nulls where a text is no such JSON."""
    names = [c for c in df.columns if c != text]
    parsed = F.from_json(text, ANALYSIS)
    return df.select(*names, parsed.alias("_a")).select(*names, F.col("_a.overall_activity_summaries").alias("summaries"), F.col("_a.frame_observations").alias("frames"))


def read_frame_analyses(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: the same from files, by ``group_id``, the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("group_id"), F.col("value").alias("text"))
    return frame_analyses(files)


def analysis_rows(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC11: summaries(group_id, ord, batch_index, time_range, summary) and frames(group_id, frame_no, batch_index, timestamp, observation), sharing group_id and
    batch_index; :func:`..operators.reports.frame_report_of_files` makes the report from the nested rows in one scan instead."""
    summaries = analyses.select("group_id", F.posexplode("summaries").alias("ord", "s")).select("group_id", "ord", "s.*")
    frames = analyses.select("group_id", F.posexplode("frames").alias("frame_no", "f")).select("group_id", "frame_no", "f.batch_index", "f.timestamp", "f.observation")
    return summaries, frames


def srt_blocks(cues: DataFrame, order: list[str]) -> DataFrame:
    """SNK1: one SRT block for each cue(start, end, text), numbered in order within ``file_id``."""
    n = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
    return cues.withColumn("n", n).withColumn(
        "block", F.concat(F.col("n").cast("string"), F.lit("\n"), tc.to_srt(F.col("start")), F.lit(" --> "), tc.to_srt(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    )


def srt_files(cues: DataFrame, order: list[str]) -> DataFrame:
    """SNK1: whole SRT texts by file."""
    rows = F.array_sort(F.collect_list(F.struct("n", "block")))
    return srt_blocks(cues, order).groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n").alias("srt"))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: script items with their place in the file."""
    item = "struct<_id:int,timestamp:string,picture:string,narration:string,OST:int,episode:int>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("ord", "item")).select("ord", "item.*")


def concat_list(paths: DataFrame, order: str) -> DataFrame:
    """SNK5: lines of a concat list, quotes escaped."""
    return paths.orderBy(order).select(F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'")).alias("value"))


def voices(blocks: DataFrame, locales: list[str] | None = None, block: str = "block") -> DataFrame:
    """SRC14: the voices of 'Name: ' / 'Gender: ' blocks (one a row), optionally of some locales, sorted; a block without both has none.

    Each block is looked at alone; of several names the last before a gender counts.
    """
    lines = F.transform(F.split(block, "\r\n|\r|\n"), lambda x: F.trim(x))
    known = blocks.withColumn("_lines", F.filter(lines, lambda x: x.startswith("Name: ") | x.startswith("Gender: ")))
    name = lambda i: F.trim(F.substring(F.get("_lines", i), F.lit(7), F.length(F.get("_lines", i))))
    pair = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_lines") - 1, F.lit(1))),
        lambda i: F.when(F.get("_lines", i - 1).startswith("Name: ") & F.get("_lines", i).startswith("Gender: "), F.struct(name(i - 1).alias("name"), F.trim(F.substring(F.get("_lines", i), F.lit(9), F.length(F.get("_lines", i)))).alias("gender"))),
    )
    g = known.select(F.inline(F.filter(pair, lambda p: p.isNotNull()))).where("name != '' and gender != ''")
    some = g if not locales else g.where(F.lower("name").rlike("^(" + "|".join(re.escape(x.lower()) for x in locales) + ")"))
    return some.select("name", "gender").orderBy("name", "gender")


def read_voices(spark: SparkSession, path: str, locales: list[str] | None = None) -> DataFrame:
    """SRC14: the voices of a catalogue file, which is read in blocks between blank lines, so that a file of any size is split."""
    return voices(spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "block"), locales)


def write_batches(rows: DataFrame, path: str, batch: str, order: list[str], line: str = "text") -> None:
    """SNK6: a text file for each batch, its lines in order: rows are dealt and sorted by batch, and a folder named by it gets one file.

    No batch is ever held in memory. Null lines are empty. What was in ``path`` goes.
    """
    out = rows.repartition(batch).sortWithinPartitions(batch, *order).select(batch, F.coalesce(F.col(line), F.lit("")).alias("value"))
    out.write.mode("overwrite").partitionBy(batch).text(path)


def analysis_file_names(results: DataFrame) -> DataFrame:
    """SNK6: the name of the file of each of results(image_paths, response), from the times in the names of its first and last picture, and its stripped
    text; results without pictures go. A time is what stands after the last underline, read as a code of seconds (digits alone are seconds too); what is none is 0."""
    some = results.where(F.size("image_paths") > 0)

    def stamp(path):
        stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
        last = F.element_at(F.split(stem, "_"), -1)
        return tc.to_srt(tc.from_flexible(last))

    name = F.concat(F.lit("frame_"), stamp(F.element_at("image_paths", 1)), F.lit("_"), stamp(F.element_at("image_paths", -1)), F.lit(".txt"))
    return some.withColumns({"file_name": name, "text": F.regexp_replace("response", r"(?U)^\s+|\s+\z", "")})


def json_lines_of_lists(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The lines of one JSON list for each group, an item a line with its bracket or comma, in order: (group, order, text)."""
    item = F.to_json(F.struct(*[c for c in rows.columns if c not in (group, order)]), {"ignoreNullFields": "false"})
    w = Window.partitionBy(group).orderBy(order)
    ends = rows.withColumns({"_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull()})
    return ends.select(group, order, F.concat(F.when(F.col("_first"), "[").otherwise(""), item, F.when(F.col("_last"), "]").otherwise(",")).alias("text"))


def write_scripts(items: DataFrame, path: str, group: str = "script_id", order: str = "ord") -> None:
    """SNK4/SNK7: a JSON file for each script, a list of its items in order, written item by item; :func:`read_script` reads it."""
    write_batches(json_lines_of_lists(items, group, order), path, group, [order])
