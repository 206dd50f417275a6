"""Column functions of picture, sound and speech measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp

# Volumes by kind of video, and sizes by shape in the two tables of the data model.
VOLUMES = {"educational": (0.9, 0.8, 0.2), "entertainment": (0.8, 1.2, 0.4), "news": (1.0, 0.6, 0.1)}
SIZES = {"16:9": (1920, 1080), "4:3": (1440, 1080), "9:16": (1080, 1920), "3:4": (1080, 1440), "1:1": (1080, 1080)}
SECOND_SIZES = {"16:9": (1920, 1080), "4:3": (1280, 720), "9:16": (1080, 1920), "3:4": (720, 1280), "1:1": (1080, 1080)}
PROFILES = {"balanced": (0.8, 1.2, 0.3), "voice_focused": (1.0, 0.7, 0.2), "original_focused": (0.7, 1.5, 0.2), "quiet_background": (0.8, 1.3, 0.1)}
CONTENTS = {"mixed": (0.8, 1.3, 0.3), "voice_only": (1.0, 0.5, 0.2), "original_heavy": (0.6, 1.6, 0.1), "music_video": (0.7, 1.8, 0.0)}
DEFAULT_SIZE = (1080, 1920)


def audio_from_peak(peak_dbfs: Column) -> Column:
    """score from the peak level alone; levels under -20 dB go below 0, as no lower bound is set."""
    return F.least(F.lit(1.0), (peak_dbfs + 20) / 20) * 0.6


def visual_parts(face_ratio: Column, avg_faces: Column, center: Column, closeup: Column, edge: Column, sharpness: Column, blurry: Column) -> dict[str, Column]:
    """scores of faces, closeups, dynamics and quality and their clamped total, all unrounded."""
    one = F.lit(1.0)
    face = face_ratio * 0.6 + F.least(one, avg_faces / 3) * 0.3 + center * 0.1
    dynamic = F.least(one, edge * 3) * 0.5 + F.least(one, sharpness / 500) * 0.3 + (1 - blurry) * 0.2
    quality = (1 - blurry) * 0.6 + F.least(one, edge * 2) * 0.4
    total = clamp(face * 0.30 + closeup * 0.25 + dynamic * 0.25 + quality * 0.20)
    return {"face_score": face, "closeup_score": closeup, "dynamic_score": dynamic, "quality_score": quality, "visual_score": total}


def visual_from_size(width: Column, height: Column, duration: Column) -> Column:
    """score from resolution and length alone."""
    return F.least(F.lit(1.0), width * height / (1920.0 * 1080.0)) * 0.3 + F.least(F.lit(1.0), duration / 5.0) * 0.2 + 0.1


def largest_face(faces: Column, width: Column, height: Column) -> Column:
    """F32: of faces array<struct(x, y, w, h)> the largest, with its relative centre and whether it makes a closeup (over 0.15); null for none."""
    all_faces = F.transform(faces, lambda f: F.struct(
        (f["w"] * f["h"] / (width * height)).alias("size_ratio"), ((f["x"] + f["w"] / 2) / width).alias("center_x"), ((f["y"] + f["h"] / 2) / height).alias("center_y"),
    ))
    best = F.array_max(all_faces)
    return F.when(best.isNotNull(), F.struct(best["size_ratio"].alias("size_ratio"), best["center_x"].alias("center_x"), best["center_y"].alias("center_y"), (best["size_ratio"] > 0.15).alias("is_closeup")))


def speech_seconds(text: Column, each: float = 0.21531) -> Column:
    """whole seconds of a text read aloud."""
    return (F.length(text) * each).cast("int")


def speech_seconds_default(text: Column) -> Column:
    """a third of a second a character, one second at least."""
    return F.greatest(F.lit(1.0), F.length(text) / 3.0)


def speech_seconds_by_size(size: Column) -> Column:
    """from the bytes of the sound file."""
    return F.greatest(F.lit(1.0), size / 20000.0)


def smart_volume(volume: Column, gain: Column, high: float) -> Column:
    """a volume times its gain, between 0.1 and ``high`` (1.5 speech, 2.0 original sound)."""
    return clamp(volume * gain, 0.1, high)


def volume(v: Column) -> Column:
    """Between 0 and 2."""
    return clamp(v, 0.0, 2.0)


def volumes_for(kind: Column, default: tuple[float, float, float], table: dict[str, tuple[float, float, float]] = VOLUMES) -> Column:
    """struct(speech, original, music) of a kind of video (or, by another ``table``, a profile or a content), the default for others."""

    def row(v):
        return F.struct(*[F.lit(x).alias(n) for n, x in zip(("tts_volume", "original_volume", "bgm_volume"), v)])

    out = None
    for name, v in table.items():
        out = F.when(kind == name, row(v)) if out is None else out.when(kind == name, row(v))
    return out.otherwise(row(default))


def volumes_for_content(content: Column) -> Column:
    """The volumes for a content; ``mixed`` for unknown ones."""
    return volumes_for(content, CONTENTS["mixed"], CONTENTS)


def size_for(aspect: Column, table: dict[str, tuple[int, int]] = SIZES) -> Column:
    """struct(width, height) of a shape by one of two tables, upright for unknown ones."""

    def row(v):
        return F.struct(F.lit(v[0]).alias("width"), F.lit(v[1]).alias("height"))

    out = None
    for name, v in table.items():
        out = F.when(aspect == name, row(v)) if out is None else out.when(aspect == name, row(v))
    return out.otherwise(row(DEFAULT_SIZE))


def padded_size(vw: Column, vh: Column, tw: int, th: int) -> Column:
    """size and place of a picture fitted into a target with bars; the target's own size if the shapes agree."""
    ratio, target = vw / vh, tw / th
    scale = F.when(ratio > target, F.lit(float(tw)) / vw).otherwise(F.lit(float(th)) / vh)
    w = F.when(ratio == target, F.lit(tw)).otherwise((vw * scale).cast("int"))
    h = F.when(ratio == target, F.lit(th)).otherwise((vh * scale).cast("int"))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((tw - w) / 2).cast("int").alias("x"), F.floor((th - h) / 2).cast("int").alias("y"))


def subtitle_y(position: Column, video_height: Column, text_height: Column, percent: Column, margin: int = 10) -> Column:
    """upper edge of a subtitle: bottom, top, a percentage inside the margins, else centred."""
    free = video_height - text_height
    custom = F.greatest(F.lit(float(margin)), F.least(free * (percent / 100), (free - margin).cast("double")))
    return F.when(position == "bottom", video_height * 0.95 - text_height).when(position == "top", video_height * 0.05).when(position == "custom", custom).otherwise(free / 2)


def subtitle_y_fixed(position: Column, video_height: Column, text_height: Column, margin: int = 50) -> Column:
    """F28, second form: fixed margins; a number is a share of the height, anything unknown means bottom."""
    share = position.try_cast("double")
    return (
        F.when(share.isNotNull(), (video_height * share).cast("int")).when(position == "top", F.lit(margin))
        .when(position == "center", F.floor(video_height / 2).cast("int")).otherwise((video_height - margin - text_height).cast("int"))
    )


def cover_frame(start: Column, fps: Column) -> Column:
    """the frame two seconds into a segment, the first at least."""
    return F.greatest(F.lit(1), (start * fps).cast("int") + (fps * 2.0).cast("int"))


def signed_change(rate: Column, unit: str = "%") -> Column:
    """a rate as a signed change in percent; no change is +0."""
    percent = F.bround((rate - 1.0) * 100, 0).cast("int")
    sign = F.when((percent > 0) | (rate == 1.0), "+").otherwise("")
    return F.concat(sign, percent.cast("string"), F.lit(unit))


def speed_tag(speed: Column) -> Column:
    """Slow or fast beyond a twentieth, by the speed clamped to 0.5 to 2."""
    s = clamp(speed, 0.5, 2.0)
    return F.when(s < 0.95, "slow").when(s > 1.05, "fast").otherwise("normal")


def loops(target: Column, duration: Column) -> Column:
    """How often a sound plays to fill the target; null for a sound without length."""
    return F.floor(target / F.nullif(duration, F.lit(0.0))).cast("int") + 1


def size_in(size: Column, unit: str = "MB") -> Column:
    """Bytes in B, KB, MB or GB; other units give bytes."""
    return size / float({"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}.get(unit.upper(), 1))


def probe_info(output: Column) -> Column:
    """SRC18: the ``key=value`` lines of a probed video as a map of strings, with ``fps`` from a rate of two whole numbers (any other rate as
    it stands); a probe that failed (null) gives 1280 x 720 at 25 without length."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)=", 1).alias("key"), F.regexp_extract(x, "(?s)^[^=]*=(.*)", 1).alias("value")))
    info = F.map_from_entries(pairs)
    rate = F.try_element_at(info, F.lit("r_frame_rate"))
    fps = F.when(rate.rlike(r"^\s*[+-]?\d+\s*/\s*[+-]?\d+\s*$"), frame_rate(F.regexp_replace(rate, r"\s", "")).cast("string")).otherwise(rate)
    known = F.when(rate.isNotNull(), F.map_concat(info, F.create_map(F.lit("fps"), fps))).otherwise(info)
    return F.coalesce(known, F.create_map(*[F.lit(x) for x in ("width", "1280", "height", "720", "fps", "25", "duration", "0")]))


def frame_rate(text: Column) -> Column:
    """X34: '30000/1001' or '25' to a number; null for a bad one."""
    p = F.split(text, "/")
    return F.try_divide(F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0)))
