"""Time codes as Column functions; seconds are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(sec: Column) -> tuple[Column, Column, Column]:
    return F.floor(sec / 3600).cast("int"), ((sec % 3600) / 60).cast("int"), (sec % 60).cast("int")


def digits(number: Column, width: int) -> Column:
    """A whole number as ``%0{width}d`` prints it; numbers that fit, nearly all, need no formatter."""
    fits = (number >= 0) & (number < 10**width)
    return F.when(fits, F.substring((number + F.lit(10**width)).cast("string"), 2, width)).otherwise(F.format_string(f"%0{width}d", number))


def _joined(sec: Column, numbers: list[Column], widths: tuple, marks: tuple) -> Column:
    """Numbers of fixed widths, each after its mark; from 0 to 99 hours, nearly always, by their digits, as a formatter is slow and makes the generated code too long to be compiled."""
    parts = [x for n, w, m in zip(numbers, widths, marks) for x in (F.lit(m), F.substring((n + F.lit(10**w)).cast("string"), 2, w))]
    known = (sec >= 0) & (sec < (360000 if len(numbers) > 2 else 6000))
    return F.when(known, F.concat(*parts)).otherwise(F.format_string("".join(f"{m}%0{w}d" for m, w in zip(marks, widths)), *numbers))


def to_srt(sec: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    return _joined(sec, [*_parts(sec), ((sec % 1) * 1000).cast("int")], (2, 2, 2, 3), ("", ":", ":", ","))


def to_srt_modulo(sec: Column) -> Column:
    """The same with milliseconds from the whole count."""
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(sec), F.pmod((sec * 1000).cast("long"), F.lit(1000)).cast("int"))


def to_dotted(sec: Column) -> Column:
    """HH:MM:SS.mmm, rounded (may print 60.000)."""
    hours, minutes, _ = _parts(sec)
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, sec % 60)


def to_clock(sec: Column) -> Column:
    """HH:MM:SS, truncated."""
    return F.format_string("%02d:%02d:%02d", *_parts(sec))


def to_minutes(sec: Column) -> Column:
    """MM:SS, truncated."""
    return _joined(sec, [F.floor(sec / 60).cast("int"), (sec % 60).cast("int")], (2, 2), ("", ":"))


def _num(c: Column) -> Column:
    return c.try_cast("double")


def from_srt(text: Column) -> Column:
    """HH:MM:SS with , or . milliseconds; anything else is 0."""
    p = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    whole = _num(F.get(p, F.lit(0))) * 3600 + _num(F.get(p, F.lit(1))) * 60 + _num(F.get(p, F.lit(2)))
    return F.coalesce(F.when(F.size(p) == 3, whole), F.lit(0.0))


def from_flexible(text: Column) -> Column:
    """T5: H:M:S, M:S or S, with ,mmm or -mmm; anything else is 0."""
    p = F.split(F.regexp_replace(F.trim(text), "[,-](?=[0-9]{1,3}$)", "."), ":")
    at = [_num(F.get(p, F.lit(i))) for i in range(3)]
    out = F.when(F.size(p) == 3, at[0] * 3600 + at[1] * 60 + at[2]).when(F.size(p) == 2, at[0] * 60 + at[1]).when(F.size(p) == 1, at[0])
    return F.coalesce(out, F.lit(0.0))


def from_strict(text: Column) -> Column:
    """HH:MM:SS[,mmm]; a bad value raises."""
    p = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def range_bounds(text: Column) -> Column:
    """T8/T9: 'A-B' to struct(start, end) in seconds, nulls unless there are two parts."""
    p = F.split(text, "-")
    ok = F.size(p) == 2
    return F.struct(F.when(ok, from_flexible(F.get(p, F.lit(0)))).alias("start"), F.when(ok, from_flexible(F.get(p, F.lit(1)))).alias("end"))


def _clock(text: Column) -> Column:
    """H:M:S[,mmm] to seconds; null for anything else."""
    p = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    return F.when(F.regexp_like(F.trim(text), F.lit(r"^\d+:\d+:\d+(,\d+)?$")), _num(p[0]) * 3600 + _num(p[1]) * 60 + _num(p[2]))


def clock_bounds(text: Column) -> Column:
    """T9: 'H:M:S[,mmm]-H:M:S[,mmm]' to struct(start, end) in seconds, nulls for any other form."""
    p = F.split(text, "-")
    two = F.size(p) == 2
    return F.struct(F.when(two, _clock(F.get(p, F.lit(0)))).alias("start"), F.when(two, _clock(F.get(p, F.lit(1)))).alias("end"))


def range_duration(text: Column) -> Column:
    """Length of a range of two H:M:S[,mmm] codes to two decimals; 0 for any other form."""
    b = clock_bounds(text)
    return F.round(F.coalesce(b["end"] - b["start"], F.lit(0.0)), 2)


# The two forms of clip names with times.
_CLIP = r"vid_(\d{2})-(\d{2})-(\d{2})-(\d{3})@(\d{2})-(\d{2})-(\d{2})-(\d{3})\.mp4"
_CLIP_SHORT = r"vid-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})\.mp4"


def file_range(name: Column) -> Column:
    """Time range in a clip's file name, in either form; null if there is none."""
    g = [F.regexp_extract(name, _CLIP, i) for i in range(1, 9)]
    s = [F.regexp_extract(name, _CLIP_SHORT, i) for i in range(1, 7)]
    full = F.format_string("%s:%s:%s,%s-%s:%s:%s,%s", *g)
    short = F.format_string("%s:%s:%s-%s:%s:%s", *s)
    return F.when(F.regexp_like(name, F.lit(_CLIP)), full).when(F.regexp_like(name, F.lit(_CLIP_SHORT)), short)


def audio_range(name: Column) -> Column:
    """audio_HH_MM_SS-HH_MM_SS.mp3 to a range."""
    return F.replace(F.regexp_replace(name, r"^audio_|\.[A-Za-z0-9]+$", ""), F.lit("_"), F.lit(":"))


def from_digits(text: Column) -> Column:
    """HHMMSSmmm, padded on the right with 0, to seconds."""
    t = F.rpad(text, 9, "0")
    return _num(F.substring(t, 1, 2)) * 3600 + _num(F.substring(t, 3, 2)) * 60 + _num(F.substring(t, 5, 2)) + _num(F.substring(t, 7, 3)) / 1000


def add_seconds(start: Column, duration: Column, extra: Column) -> Column:
    """End of a clip in whole milliseconds, in the same format."""
    return to_srt_modulo((F.round(from_srt(start) * 1000) + F.round(duration * 1000) + F.round(extra * 1000)) / 1000)


def clock_parts(text: Column) -> Column:
    """The parts of H:M:S, M:S or S before ,mmm."""
    return F.split(F.substring_index(F.trim(text), ",", 1), ":")


def relaxed(text: Column, parts: Column | None = None) -> Column:
    """H:M:S, M:S or S, each with ,mmm, to seconds; a bad one is 0. ``parts``: a column that holds its :func:`clock_parts`, so that they are cut once."""
    p = clock_parts(text) if parts is None else parts
    comma = F.instr(text, ",")
    at = [_num(F.get(p, F.lit(i))) for i in range(3)]
    whole = F.when(F.size(p) == 3, at[0] * 3600 + at[1] * 60 + at[2]).when(F.size(p) == 2, at[0] * 60 + at[1]).otherwise(_num(p[0]))
    return F.coalesce(whole + F.coalesce(_num(F.when(comma > 0, F.substring_index(F.substr(text, comma + 1), ",", 1))), F.lit(0.0)) / 1000, F.lit(0.0))


def ticks(text: Column) -> Column:
    """H:M:S.f to ticks of 100 ns, cut to whole milliseconds; null for any other form."""
    p = F.split(text, "[:.]")
    ms = F.substring(F.rpad(F.get(p, F.lit(3)), 6, "0"), 1, 3).cast("long")
    whole = (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")) * 1000
    return F.when(F.regexp_like(text, F.lit(r"^\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$")), (whole + ms) * 10000)


def minute_range(text: Column) -> Column:
    """T16: 'MM:SS-MM:SS' to two HH:MM:SS codes."""
    return F.transform(F.split(text, "-"), lambda p: F.concat(F.lit("00:"), F.trim(p)))


def has_timecode(text: Column) -> Column:
    """Whether an SRT time line occurs."""
    return F.regexp_like(text, F.lit(r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"))


def sane_duration(duration: Column, rng: Column) -> Column:
    """Outside (0, 300] the range's length counts; if that is not positive, 5 seconds."""
    alt = range_duration(rng)
    return F.when((duration > 0) & (duration <= 300), duration).when(alt > 0, alt).otherwise(F.lit(5.0))


def path_safe(text: Column) -> Column:
    """Colons and commas to dashes."""
    return F.translate(text, ":,", "--")


def frame_number(sec: Column, fps: Column) -> Column:
    """T20."""
    return (sec * fps).cast("long")


def ticks_to_seconds(ticks: Column) -> Column:
    """100-nanosecond ticks."""
    return ticks / 1e7


def grid(duration: Column, step: float) -> Column:
    """0, step, 2 step ... below the duration."""
    n = F.ceil(F.greatest(duration, F.lit(0.0)) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))
