"""Script lines laid over recognised cues and spoken words, one file (job) at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NOT_WORD = r"[^\p{L}\p{N}_]"
_SIGN = r"[^\p{L}\p{N}_\s]"


def _core(c):
    return F.regexp_replace(c, _NOT_WORD, "")


def match_words(lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, jobs without cues) from lines(job, line_no, line) and words(job, word_no, start, end, word).

    A line takes the next words until they spell it, signs and blanks aside; a job has cues only if all its lines
    are spelt. Lines and words are met by their running count of word characters, so no state is folded. Words after
    the last line are left over; a line without a word character is never spelt; null texts count as empty; a
    cue keeps its line, without signs where only those of the words differ from it.
    """
    by_line = Window.partitionBy("job").orderBy("line_no")
    numbered = lines.select("job", "line_no", F.coalesce("line", F.lit("")).alias("line")).withColumn("_n", F.length(_core(F.col("line"))))
    numbered = numbered.withColumns({"_k": F.row_number().over(by_line), "_upto": F.sum("_n").over(by_line.rowsBetween(Window.unboundedPreceding, 0))})
    by_word = Window.partitionBy("job").orderBy("word_no")
    spoken = words.select("job", "word_no", "start", "end", F.coalesce("word", F.lit("")).alias("word")).withColumn("_n", F.length(_core(F.col("word"))))
    spoken = spoken.withColumn("_upto", F.sum("_n").over(by_word.rowsBetween(Window.unboundedPreceding, 0)))
    # the word that brings the count to a line's end closes the line
    ends = numbered.where("_n > 0").select("job", "_upto", F.lit(True).alias("_closes"))
    marked = spoken.withColumn("_upto", F.when(F.col("_n") > 0, F.col("_upto"))).join(ends, ["job", "_upto"], "left")
    closed = F.count("_closes").over(by_word.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("_k", closed + 1).groupBy("job", "_k").agg(
        F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("_words"),
        F.min_by("start", "word_no").alias("start"), F.max_by("end", "word_no").alias("end"),
    )
    runs = runs.withColumn("_raw", F.array_join(F.transform("_words", lambda x: x["word"]), ""))
    met = numbered.join(runs, ["job", "_k"], "left").withColumn("_ok", (F.col("_n") > 0) & (_core(F.col("_raw")) == _core(F.col("line"))))
    whole = Window.partitionBy("job")
    met = met.withColumn("_all", F.min(F.coalesce("_ok", F.lit(False))).over(whole))
    bare = F.regexp_replace("line", _SIGN, "")
    shown = F.when((F.col("_raw") != F.col("line")) & (F.regexp_replace("_raw", _SIGN, "") == bare), bare).otherwise(F.col("line"))
    cues = met.where("_all").select("job", F.col("_k").cast("long").alias("cue_no"), "start", "end", F.regexp_replace(shown, r"^\s+|\s+$", "").alias("text"))
    return cues, met.where("not _all").select("job").distinct()


def _distance(x: str, y: str) -> int:
    """Edit distance: what both begin and end with goes, then a row of the table is two whole numbers of a bit a character (Myers)."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:  # the longest common prefix, then the longest common suffix of the rest
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    x, y = x[lo:], y[lo:]
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[len(x) - mid :] == y[len(y) - mid :] else (lo, mid - 1)
    x, y = sorted((x[: len(x) - lo], y[: len(y) - lo]), key=len)
    if not x:
        return len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    plus, minus, out = full, 0, len(x)
    for c in y:
        equal = where.get(c, 0)
        down = equal | minus
        right = (((equal & plus) + plus) ^ plus) | equal
        up, less = minus | ~(right | plus) & full, plus & right
        out += bool(up & top) - bool(less & top)
        up, less = up << 1 | 1, less << 1
        plus, minus = (less | ~(down | up)) & full, up & down & full
    return out


def likeness(a: str, b: str) -> float:
    """X5 for the fold below: 1 - edit distance of the lower-case texts / longer length; two empty texts are alike."""
    return 1 - _distance(a.lower(), b.lower()) / max(len(a), len(b), 1)


def fit_lines(lines: list[str], cues: list[tuple], least: float = 0.8) -> Iterator[tuple]:
    """(start, end, text, state) for each line in turn; cues are (start, end, text)."""
    at = 0
    for line in lines:
        if at >= len(cues):
            yield None, None, line, "extra"
            continue
        start, end, said = cues[at]
        at += 1
        if said == line:
            yield start, end, line, "same"
            continue
        score = likeness(line, said)
        while at < len(cues) and (wider := likeness(line, f"{said} {cues[at][2]}")) > score:
            score, said, end = wider, f"{said} {cues[at][2]}", cues[at][1]
            at += 1
        yield start, end, line, "merged" if score > least else "mismatch"


def correct_cues(lines: DataFrame, cues: DataFrame, least: float = 0.8) -> DataFrame:
    """Each script line with the time of the cues it resembles most, in order: one row per line.

    lines(job, line_no, line), cues(job, cue_no, start, end, text). A line equal to the next cue takes it; another takes cues as long
    as each makes the joined text more alike, and is ``merged`` over ``least``, else ``mismatch``. Lines left when the
    cues end are ``extra``, at 0. Null texts count as empty; texts are trimmed; a job without lines has no
    rows. A group is the cues of one file.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["line_no", "line"]), right.sort_values(["cue_no", "start"])
        rows = fit_lines(left["line"].tolist(), list(zip(right["start"], right["end"], right["text"])), least)
        out = pd.DataFrame(list(rows), columns=["start", "end", "text", "state"]).fillna({"start": 0.0, "end": 0.0})
        out.insert(0, "job", left["job"].iloc[0] if len(left) else None)
        out.insert(1, "cue_no", range(1, len(out) + 1))
        return out

    def plain(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "").alias(c)

    a = lines.select("job", "line_no", plain("line"))
    b = cues.select("job", "cue_no", F.col("start").cast("double"), F.col("end").cast("double"), plain("text"))
    kind = lines.schema["job"].dataType.simpleString()
    schema = f"job {kind}, cue_no long, start double, end double, text string, state string"
    return a.groupBy("job").cogroup(b.groupBy("job")).applyInPandas(run, schema)


def phrase_words(words: Iterable[tuple], sentences: list[str], most: int = 15) -> Iterator[tuple]:
    """(start, end, text) from words (part, start, end, text): a cue at each sentence met, at over ``most`` characters and at a part's end."""
    ahead = iter([s for s in sentences if s])
    wanted, part, held, start, end = next(ahead, None), None, "", None, None
    for of, begin, stop, word in words:
        if of != part:
            if held:
                yield start, end, held
            part, held, start = of, "", begin
        end, held = stop, held + word.strip()
        while wanted is not None and len(wanted) <= len(held) and wanted in held:
            before, _, after = held.partition(wanted)
            yield start, end, wanted.strip()
            held, start, wanted = (before + after).strip(), end, next(ahead, None)
        if len(held) > most:
            yield start, end, held.strip()
            held, start = "", end
    if held.strip():
        yield start, end, held.strip()


def phrase_cues(items: DataFrame, words: DataFrame, sentences: DataFrame, most: int = 15) -> DataFrame:
    """Cues of spoken parts on the script's clock.

    items(job, item_no, start, end, OST), words(job, part, word_no, start, end, word), sentences(job, sentence_no, sentence). The parts, from 1,
    belong in order to the items whose OST is 0; their times are stretched to the item's length (by 1 where a part has no length). Words
    of parts beyond the items go. Null texts count as empty; a job without words has no rows. The rows of
    a file meet once, in order, and are folded as they come: only its sentences are held.
    """
    by_item = Window.partitionBy("job").orderBy("item_no")
    none = {"word_no": words.schema["word_no"].dataType, "sentence_no": sentences.schema["sentence_no"].dataType, "start": "double", "end": "double", "text": "string", "_from": "double", "_length": "double", "_item": "boolean"}

    def rows(df: DataFrame, part, **columns):
        return df.select("job", part.cast("int").alias("part"), *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in none.items()])

    placed = rows(items.where("OST = 0"), F.row_number().over(by_item), _from=F.col("start"), _length=F.col("end") - F.col("start"), _item=F.lit(True))
    spoken = rows(words.where("part > 0"), F.col("part"), word_no=F.col("word_no"), start=F.col("start"), end=F.col("end"), text=F.coalesce("word", F.lit("")))
    lines = rows(sentences, F.lit(0), sentence_no=F.col("sentence_no"), text=F.coalesce("sentence", F.lit("")))
    order = [F.col("word_no").asc_nulls_last(), F.col("sentence_no").asc_nulls_last(), F.col("text")]
    mine = Window.partitionBy("job", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    took, begins = F.max_by("end", "word_no").over(mine), F.max("_from").over(mine)
    ratio = F.when(F.col("_took") > 0, F.col("_long") / F.col("_took")).otherwise(1.0)
    # one exchange: what is dealt by job is dealt by job and part too
    dealt = spoken.unionByName(placed).unionByName(lines).where("job is not null").repartition("job")
    known = dealt.withColumns({"_took": took, "_at": begins, "_long": F.max("_length").over(mine), "_placed": F.max("_item").over(mine)})
    timed = known.where("_item is null and (part = 0 or _placed)").sortWithinPartitions("job", "part", *order)
    timed = timed.select("job", "part", (F.col("_at") + F.col("start") * ratio).alias("start"), (F.col("_at") + F.col("end") * ratio).alias("end"), "text")

    def run(batches):
        kinds, out = None, []

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(zip(*out), kinds)], ["job", "cue_no", "start", "end", "text"])
            out.clear()
            return got

        def ordered():
            nonlocal kinds
            for b in batches:
                kinds = kinds or [b.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.string()]
                plain = pa.types.is_integer(kinds[0]) or pa.types.is_string(kinds[0])
                jobs = b.column(0).to_numpy(zero_copy_only=False).tolist() if plain else b.column(0).to_pylist()
                yield from zip(jobs, *(c.to_numpy(zero_copy_only=False).tolist() for c in b.columns[1:]))  # a tenth of to_pylist's time

        for job, own in groupby(ordered(), itemgetter(0)):
            ahead = []
            for row in own:
                if row[1]:
                    for k, cue in enumerate(phrase_words(map(itemgetter(1, 2, 3, 4), chain([row], own)), ahead, most), 1):
                        out.append((job, k, *cue))
                        if len(out) == 5000:
                            yield batch()
                else:
                    ahead.append(row[4])
        if out:
            yield batch()

    kind = words.schema["job"].dataType.simpleString()
    return timed.mapInArrow(run, f"job {kind}, cue_no long, start double, end double, text string")
