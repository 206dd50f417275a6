"""Score expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the four scores.
WEIGHTS = {"audio_score": 0.4, "emotion_score": 0.3, "visual_score": 0.2, "rhythm_score": 0.1}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted_total(weights: dict[str, float] = WEIGHTS) -> Column:
    """clamped weighted sum, not rounded."""
    total = None
    for name, w in weights.items():
        term = F.col(name) * w
        total = term if total is None else total + term
    return clamp(total)


def audio_default(d: Column) -> Column:
    """F2."""
    return F.when(d.between(2, 5), 0.45).when(d.between(1, 8), 0.30).otherwise(0.15)


def duration_fit(d: Column, low: float = 2.0, high: float = 6.0, ideal: float = 4.0) -> Column:
    """F6."""
    far = max(1.0, ideal - low, high - ideal)
    return (
        F.when(d < 0.5, 0.05).when(d < low, 0.3 + 0.5 * d / low)
        .when(d <= high, F.greatest(F.lit(0.7), 1.0 - 0.3 * F.abs(d - ideal) / far))
        .otherwise(F.greatest(F.lit(0.3), 0.8 - (d - high) / 15.0))
    )


def position_factor(r: Column) -> Column:
    """piecewise in start / episode length."""
    return (
        F.when(r < 0.10, 0.75)
        .when(r < 0.25, 0.55 + 0.2 * (r / 0.25))
        .when(r < 0.50, 0.70 + 0.15 * ((r - 0.25) / 0.25))
        .when(r < 0.75, 0.85 + 0.12 * ((r - 0.50) / 0.25))
        .when(r < 0.90, 0.90 + 0.05 * ((r - 0.75) / 0.15))
        .otherwise(0.80)
    )


def rhythm(d: Column, start: Column) -> Column:
    """F8: shorter is livelier; a bonus for starts near a whole second."""
    step = F.when(d < 2, 0.9).when(d < 4, 0.7).when(d < 6, 0.5).otherwise(0.3)
    frac = start % 1
    return 0.8 * step + 0.2 * (0.85 + F.when((frac < 0.3) | (frac > 0.7), 0.15).otherwise(0.0))


def boundary(start: Column, d: Column, episode: Column) -> Column:
    """margins of half a second before and after."""
    n = (start >= 0.5).cast("int") + ((episode - (start + d)) >= 0.5).cast("int")
    return F.when(n == 2, 1.0).when(n == 1, 0.6).otherwise(0.3)


def rhythm_total(d: Column, start: Column, episode: Column, digits: int = 3) -> Column:
    """F5, rounded to ``digits``."""
    r = start / episode
    total = 0.4 * duration_fit(d) + 0.3 * position_factor(r) + 0.2 * rhythm(d, start) + 0.1 * boundary(start, d, episode)
    return F.round(F.when(d <= 0, 0.0).when(episode <= 0, 0.4 * duration_fit(d)).otherwise(total), digits)


def rhythm_default(d: Column, digits: int = 3) -> Column:
    """the rhythm score of a length alone: from the start of an episode three times as long, 10 seconds at least; without a length 0.2."""
    return F.when(d.isNull(), 0.2).otherwise(rhythm_total(d, F.lit(0.0), F.greatest(d * 3, F.lit(10.0)), digits))


# The labels shown for scores, durations and reasons.
SCORE_LABELS = ["精品", "优质", "普通", "一般"]
DURATION_LABELS = ["过短", "偏短", "理想", "偏长", "过长"]
REASONS = {"closeup": "特写", "face": "有人物", "action": "动作", "audio": "音频爆点", "emotion": "情绪", "visual": "画面佳"}
NO_REASON = "高光片段"


def score_label(s: Column) -> Column:
    """P4."""
    a, b, c, d = SCORE_LABELS
    return F.when(s >= 0.7, a).when(s >= 0.5, b).when(s >= 0.3, c).otherwise(d)


def duration_rating(d: Column) -> Column:
    """P5."""
    a, b, c, e, f = DURATION_LABELS
    return F.when(d < 1, a).when(d < 2, b).when(d <= 6, c).when(d <= 10, e).otherwise(f)


def reason(closeup: Column, face: Column, action: Column, audio: Column, emotion: Column, visual: Column, subtitle: Column) -> Column:
    """Tags of flags and of scores over 0.6, then the quoted start of the subtitle."""
    quote = F.concat(F.lit('"'), F.replace(F.left(subtitle, F.lit(20)), F.lit("\n"), F.lit(" ")), F.lit('"'))
    tests = {"closeup": closeup, "face": face, "action": action, "audio": audio > 0.6, "emotion": emotion > 0.6, "visual": visual > 0.6}
    tags = [F.when(test, REASONS[k]) for k, test in tests.items()] + [F.when(F.length(subtitle) > 0, quote)]
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(NO_REASON)


def loudness_gain(lufs: Column, low: float = 0.1, high: float = 2.0, default: float = 0.7) -> Column:
    """gain to -20, clamped; a default without a measurement."""
    return F.coalesce(clamp(F.pow(F.lit(10.0), (-20.0 - lufs) / 20.0), low, high), F.lit(default))


def rms_db(rms: Column) -> Column:
    """F24."""
    return F.when(rms > 0, 20.0 * F.log10(rms / 32768.0)).otherwise(-60.0)


def word_budget(d: Column) -> Column:
    """words for a time span."""
    return F.coalesce(F.greatest(F.lit(10), F.least(F.lit(500), (d / 0.4).cast("int"))), F.lit(100))


def crop_window(vw: Column, vh: Column, tw: int, th: int, face_x: Column | None = None) -> Column:
    """window of the target shape at the smaller scale, centred on the face (without one: in the picture), inside the picture."""
    scale = F.least(F.lit(float(tw)) / vw, F.lit(float(th)) / vh)
    w, h = F.least(vw, (tw / scale).cast("int")), F.least(vh, (th / scale).cast("int"))
    middle = F.greatest(F.lit(0), F.floor((vw - w) / 2).cast("int"))
    x = middle if face_x is None else F.greatest(F.lit(0), F.least(face_x - F.floor(w / 2).cast("int"), vw - w))
    return F.struct(w.alias("w"), h.alias("h"), x.alias("x"), F.floor((vh - h) / 2).cast("int").alias("y"))


def emotion_or_default(score: Column, text: Column) -> Column:
    """0.1 without text, 0.2 where a text could not be scored."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.1).otherwise(F.coalesce(score, F.lit(0.2)))


def visual_or_default(score: Column, path: Column) -> Column:
    """0.2 without a video, 0.3 where a video could not be scored."""
    return F.when(F.coalesce(path, F.lit("")) == "", 0.2).otherwise(F.coalesce(score, F.lit(0.3)))


def audio_or_default(score: Column, path: Column, default: Column) -> Column:
    """the default of the length (F2) without sound, 0.3 where a sound could not be scored."""
    return F.when(F.coalesce(path, F.lit("")) == "", default).otherwise(F.coalesce(score, F.lit(0.3)))


def cue_milliseconds(text: Column, kind: str = "floor_800") -> Column:
    """Length of a cue whose engine gives no times: 180 ms a character and 800 at least, or 200 a character (``floor_1000``: 1000 at least)."""
    n = F.length(text)
    if kind == "floor_800":
        return F.greatest(F.lit(800), n * 180)
    return F.greatest(F.lit(1000), n * 200) if kind == "floor_1000" else n * 200
