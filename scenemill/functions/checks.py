"""Checks that give the first broken rule of a value, null for a good one; normalisers of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"\d{2}:\d{2}:\d{2},\d{3}-\d{2}:\d{2}:\d{2},\d{3}"
_SHORT = r"\d{2}:\d{2}:\d{2}-\d{2}:\d{2}:\d{2}"

# Words of error messages, class by class, and of a plot analysis.
TOOL_ERRORS = {
    "filter_chain_error": ["impossible to convert", "filter", "format", "scale", "auto_scale", "null", "parsed_null", "reinitializing filters"],
    "hardware_error": ["cuda", "nvenc", "amf", "qsv", "d3d11va", "dxva2", "videotoolbox", "hardware", "hwaccel", "gpu", "device"],
    "encoder_error": ["encoder", "codec", "h264", "libx264", "bitrate", "preset"],
    "file_error": ["no such file", "permission denied", "access denied", "file not found"],
}
ANALYSIS_WORDS = ["剧情", "情节", "角色", "故事", "内容"]


def blank(c: Column) -> Column:
    """Whether a text is null or holds nothing but white space of any kind."""
    return F.coalesce(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "") == "", F.lit(True))


def narration_item(timestamp: Column, picture: Column, narration: Column, id_: Column) -> Column:
    """The time range need only begin the text, and the number may have decimals."""
    return (
        F.when(~F.coalesce(timestamp, F.lit("")).rlike("^" + _STAMP), "timestamp_format").when(blank(picture), "empty_picture")
        .when(blank(narration), "empty_narration").when(F.coalesce(id_ <= 0, F.lit(True)), "invalid_id")
    )


def strict_narration_item(timestamp: Column, picture: Column, narration: Column, id_: Column, ost: Column) -> Column:
    """Number first, whole time range, texts, then the kind of sound where it is given."""
    return (
        F.when(F.coalesce((id_ <= 0) | (id_ != F.floor(id_)), F.lit(True)), "invalid_id").when(~F.coalesce(timestamp, F.lit("")).rlike(f"^{_STAMP}$"), "timestamp_format")
        .when(blank(picture), "empty_picture").when(blank(narration), "empty_narration").when(ost.isNotNull() & ~ost.isin(0, 1, 2), "invalid_ost")
    )


def plot_point(timestamp: Column, title: Column, picture: Column) -> Column:
    """Three texts, and a time range with or without milliseconds."""
    bad = ~F.coalesce(timestamp, F.lit("")).rlike(f"^(?:{_STAMP}|{_SHORT})$")
    return F.when(blank(timestamp), "empty_timestamp").when(blank(title), "empty_title").when(blank(picture), "empty_picture").when(bad, "timestamp_format")


def missing_fields(json: Column, required: list[str]) -> Column:
    """Required fields that a JSON object lacks; null if it is no object."""
    return F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(F.when(F.try_parse_json(json).isNotNull() & F.startswith(F.ltrim(json), F.lit("{")), json)))


def schema_error(json: Column, kind: str | None = None, required: list[str] | None = None) -> Column:
    """The first broken part of a simple schema: ``no_json``, ``no_object`` or ``no_array`` by the wanted kind, ``missing_<field>`` of an object."""
    v = F.try_parse_json(json)
    shape = F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    out = F.when(v.isNull(), "no_json")
    if kind in ("object", "array"):
        out = out.when(shape != kind.upper(), f"no_{kind}")
    for field in required or []:
        out = out.when((shape == "OBJECT") & ~F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), field), f"missing_{field}")
    return out


def analysis(text: Column) -> Column:
    """P20: blank or under 50 characters is an error, a text without any usual word a warning."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(t == "", "empty_analysis").when(F.length(t) < 50, "analysis_too_short").when(~t.rlike("|".join(ANALYSIS_WORDS)), "warning_no_keyword")


def tool_error(message: Column) -> Column:
    """The first class one of whose words occurs, without case."""
    low, out = F.lower(F.coalesce(message, F.lit(""))), None
    for kind, words in TOOL_ERRORS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown_error")


def http_error(status: Column) -> Column:
    """Class of a failed call."""
    return F.when(status == 401, "authentication").when(status == 429, "rate_limit").when(status.isin(502, 503, 504), "server").when(status == 524, "timeout").otherwise("api")


def api_key(key: Column) -> Column:
    """R13."""
    return F.when(blank(key), "empty").when(F.length(F.trim(key)) < 10, "too_short")


def base_url(url: Column) -> Column:
    """Empty, or with a scheme."""
    return F.when(~blank(url) & ~F.trim(url).rlike("^https?://"), "no_scheme")


def model_name(name: Column) -> Column:
    """R13: 'provider/model' or a plain name of 3 to 200 characters."""
    t = F.trim(name)
    p = F.split(t, "/")
    slash = F.contains(t, F.lit("/"))
    return (
        F.when(blank(name), "empty").when(slash & ((F.get(p, F.lit(0)) == "") | (F.get(p, F.lit(1)) == "")), "bad_form")
        .when(slash & ~F.get(p, F.lit(0)).rlike(r"(?U)^[_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$"), "bad_provider").when(F.length(t) < 3, "too_short").when(F.length(t) > 200, "too_long")
    )


def plain_model_name(name: Column, provider: str = "openai") -> Column:
    """Trimmed, without the provider's prefix in any case."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return F.regexp_replace(t, f"(?i)^{provider}/", "")


def is_voice_name(name: Column) -> Column:
    """Language-REGION-NameNeural."""
    return F.coalesce(F.trim(name).rlike(r"(?U)^[a-z]{2}-[A-Z]{2}-\w+Neural$"), F.lit(False))


def chosen_option(given: Column, default: Column, recommended: Column) -> Column:
    """The user's value unless it is the default, else the recommended one."""
    return F.when(given.eqNullSafe(default), recommended).otherwise(given)


def merged(defaults: Column, saved: Column, force: bool = False) -> Column:
    """Two maps; the saved values win, or with ``force`` the defaults."""
    first, second = (saved, defaults) if force else (defaults, saved)
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
