"""Text functions: splitting, cleaning, likeness, emotion terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence marks at which a line is cut (a full stop between digits stays).
BREAKS = r"(?<![0-9])\.|\.(?![0-9])|[?,、;:!…？，。；：！\n]"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_marks(text: Column) -> Column:
    """Parts between sentence marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, BREAKS), lambda p: F.trim(p)), lambda p: p != "")


def has_mark(text: Column) -> Column:
    """X3."""
    return F.regexp_like(text, F.lit(r"[?,.、;:!…？，。；：！\n]"))


def normalize_subtitle(text: Column) -> Column:
    """No byte-order mark or NUL, line feeds only, commas before milliseconds, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "[﻿\u0000]", ""), "\r\n?", "\n")
    return F.trim(F.regexp_replace(t, r"(\d{2}:\d{2}:\d{2})\.(\d{3})", "$1,$2"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, without case; null for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.nullif(longest, F.lit(0))


def speakable(text: Column) -> Column:
    """Brackets, quotes and line ends to spaces."""
    return F.trim(F.regexp_replace(text, r"[\[\](){}<>\"'“”‘’\n]", " "))


def line_key(text: Column, level: int) -> Column:
    """Level 0 raw, 1 without signs, 2 word characters only."""
    return {0: text, 1: F.regexp_replace(text, r"(?U)[^\w\s]", ""), 2: F.regexp_replace(text, r"(?U)\W", "")}[level]


def unfence(text: Column) -> Column:
    """Without Markdown fence lines."""
    return F.trim(F.regexp_replace(text, r"(?m)^```.*$", ""))


def unfence_all(text: Column) -> Column:
    """X13, the fuller forms: without fence lines and without fences at both ends, trimmed."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?md)^```json\s*", ""), r"(?md)^```\s*$", ""), r"(?md)^```.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "^```", ""), r"```(?=\n?\z)", ""), r"(?U)^\s+|\s+\z", "")


def extension(name: Column) -> Column:
    """X11."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def cache_key(url: Column) -> Column:
    """Hash of an address without its query."""
    return F.md5(F.get(F.split(url, "[?]"), F.lit(0)))


def natural_key(name: Column) -> Column:
    """O3: runs of digits as numbers, the rest in lower case."""
    return F.transform(
        F.regexp_extract_all(name, F.lit(r"(\d+|\D+)")), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))
    )


def count_terms(text: Column, terms: list[str]) -> Column:
    """how many of the terms occur."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(text, k)))


def matched_terms(text: Column, terms: dict[str, list[str]], most: int = 10) -> Column:
    """F16: the terms that occur as term(category), at most ``most``."""
    all_terms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for c, ks in terms.items() for k in ks])
    found = F.filter(all_terms, lambda t: F.contains(text, t["k"]))
    return F.slice(F.transform(found, lambda t: F.concat(t["k"], F.lit("("), t["c"], F.lit(")"))), 1, most)


def keyword_score(text: Column, conflict: list[str], climax: list[str], intense: list[str]) -> Column:
    """F12."""
    total = count_terms(text, conflict) * 1.0 + count_terms(text, climax) * 0.8 + count_terms(text, intense) * 0.6
    return F.least(F.lit(1.0), total / 3.0)


def lexicon_hits(text: Column, terms: list[str], words: Column | None = None) -> Column:
    """Terms of several characters that occur, and terms of one character among ``words`` (none without a tokenizer)."""
    long_terms, single = [t for t in terms if len(t) > 1], [t for t in terms if len(t) == 1]
    hits = count_terms(text, long_terms)
    return hits if words is None or not single else hits + F.size(F.array_intersect(F.array(*map(F.lit, single)), words))


def density_score(words: Column, terms: list[str]) -> Column:
    """share of the words that are terms, times 15, at most 1; 0 without words."""
    known = F.array(*map(F.lit, dict.fromkeys(terms)))
    n = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    return F.coalesce(F.least(F.lit(1.0), n / F.nullif(F.size(words), F.lit(0)) * 15.0), F.lit(0.0))


def pattern_score(text: Column, patterns: list[str]) -> Column:
    """hits of all patterns by a tenth of the length."""
    hits = sum((F.regexp_count(text, F.lit("(?iud)" + p)) for p in patterns), F.lit(0))
    return F.least(F.lit(1.0), hits * 2.0 / F.greatest(F.lit(1.0), F.length(text) / 10.0))


def intensity_score(text: Column) -> Column:
    """short lines, repeated characters, ellipses."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)
    short = F.size(F.filter(lines, lambda p: F.length(F.trim(p)).between(1, 4))) / F.greatest(F.size(lines), F.lit(1))
    repeats = F.regexp_count(text, F.lit(r"(?d)(.)\1{2,}"))
    dots = F.regexp_count(text, F.lit(r"…|\.{3}"))
    return short * 0.5 + F.least(F.lit(1.0), repeats / 3.0) * 0.3 + F.least(F.lit(1.0), dots / 2.0) * 0.2


def emotion_total(keyword: Column, pattern: Column, density: Column, intensity: Column) -> Column:
    """F11."""
    return keyword * 0.40 + pattern * 0.25 + density * 0.20 + intensity * 0.15


#: A variable with a filter in a template.
_FILTERED = r"\$\{([^}]+)\|([^}]+)\}"


def render(template: Column, values: dict[str, Column]) -> Column:
    """${k}, then $k, in the order given; then each ${k|filter} by the filters of :data:`FILTERS`, once.

    Blanks around the name and the filter do not count; what names an unknown variable or filter stays as it is. Values that are put in
    may hold filters of their own, but what a filter gives is not looked at again.
    """
    out = template
    for k, v in values.items():
        out = F.replace(F.replace(out, F.lit("${" + k + "}"), v.cast("string")), F.lit("$" + k), v.cast("string"))
    parts, found = F.split(out, _FILTERED, -1), F.regexp_extract_all(out, F.lit(_FILTERED), F.lit(0))

    def applied(place: Column) -> Column:
        key = F.concat(F.trim(F.regexp_extract(place, _FILTERED, 1)), F.lit("|"), F.trim(F.regexp_extract(place, _FILTERED, 2)))
        known = None
        for k, v in values.items():
            for name, f in FILTERS.items():
                known = (F if known is None else known).when(key == f"{k}|{name}", f(v).cast("string"))
        return F.coalesce(known, place) if known is not None else place

    joined = F.array_join(F.zip_with(parts, found, lambda part, place: F.concat(part, F.coalesce(applied(place), F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(out)


def missing_values(template: Column, values: dict[str, Column], required: list[str] | None = None) -> Column:
    """The required variables (by default all of the template) that are not given, sorted; to be asked before :func:`render`."""
    asked = F.array(*map(F.lit, required)) if required is not None else variables(template)
    return F.array_sort(F.array_except(asked, F.array(*map(F.lit, values)).cast("array<string>")))


def title_case(text: Column) -> Column:
    """Each run of cased letters with a capital first and small letters after it; any other sign ends a run."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def truncate(text: Column, length: int = 100) -> Column:
    """The first ``length`` characters and ``...``; shorter texts stay."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("...")))


def json_text(value: Column) -> Column:
    """A string, number or truth value as JSON; null gives ``null``. Lists and records stay on one line."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


#: The filters of templates by name.
FILTERS = {
    "upper": F.upper, "lower": F.lower, "title": title_case, "truncate": truncate, "json": json_text,
    "strip": lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+\z", ""),
}


#: Strings in either kind of quotation marks, what lies between them, or one sign.
_TOKENS = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""


def _as_json(token: Column) -> Column:
    """A token of a written Python value as JSON; words that only JSON knows make it unreadable."""
    single = F.replace(F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
    bare = F.when(token.rlike(r"\b(true|false|null|NaN|Infinity)\b"), "?").otherwise(token)
    for pattern, by in (
        (r"\(", "["), (r"\)", "]"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), (r"(?<=\d)_(?=\d)", ""), (r"([{,]\s*)(-?\d+(?:\.\d+)?|true|false|null)\s*:", '$1"$2":'),
        (r",\s*([\]}])", "$1"), (r"(?<![\w.])\.(?=\d)", "0."), (r"(?<=\d)\.(?!\d)", ".0"), (r"(^|[\[,:]\s*)\+(?=\d)", "$1"),
    ):
        bare = F.regexp_replace(bare, pattern, by)
    return F.when(token.rlike("^'.*'$"), F.concat(F.lit('"'), single, F.lit('"'))).when(F.startswith(token, F.lit('"')), F.replace(token, F.lit("\\'"), F.lit("'"))).otherwise(bare)


def recover_type(text: Column) -> Column:
    """A stored string as the value it was written from, a variant: a list, tuple, map, string, number, True, False or None as Python
    writes it, else digits as a number, else the string itself.

    Tuples become lists and the keys of maps strings; both kinds of quotation marks, ``1_000``, ``.5``, ``+5`` and trailing commas are read.
    Sets, bytes, numbers of another base and escapes that JSON does not know stay strings.
    """
    one = F.regexp_replace(F.trim(text), r"^\(\s*([^(),]+?)\s*\)$", "$1")
    literal = F.array_join(F.transform(F.regexp_extract_all(one, F.lit(_TOKENS), F.lit(0)), _as_json), "")
    digits = F.when(text.rlike(r"^[0-9]+$"), text.try_cast("decimal(38,0)")).cast("variant")
    return F.coalesce(F.try_parse_json(literal), digits, text.cast("variant"))


def variables(template: Column) -> Column:
    """The names in ${name} and ${name|filter}, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(template, F.lit(r"\$\{([^}|]+)(?:\|[^}]+)?\}"), F.lit(1)), lambda v: F.trim(v)))


def _braces(text: Column) -> Column:
    """From the first { to the last }; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def _repaired(text: Column) -> Column:
    """Single braces, comments and trailing commas gone, keys in double quotes."""
    out = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    out = F.coalesce(_braces(out), out)
    # What is replaced, in order.
    for pattern, by in (("#.*", ""), ("//.*", ""), (r",\s*\}", "}"), (r",\s*\]", "]"), (r"'([^']*)':", '"$1":'), (r"(\w+)(\s*):", '"$1"$2:'), (r'""([^"]*?)""', '"$1"')):
        out = F.regexp_replace(out, pattern, by)
    return out


def parse_json(text: Column, schema: str) -> Column:
    """An object as it is, with double braces made single, from a fenced block, from the outermost braces, repaired; null if
    nothing parses."""
    text = F.trim(text)
    single = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), F.lit(""))
    repaired = _repaired(text)
    tries = [text, single, fenced, _braces(text), repaired, F.replace(repaired, F.lit("'"), F.lit('"'))]
    return F.try_variant_get(F.coalesce(*[F.when(F.startswith(t, F.lit("{")), F.try_parse_json(t)) for t in tries]), "$", schema)


def placeholder_item(text: Column) -> Column:
    """The script item that stands for an answer that does not parse: its first 100 characters as narration."""
    # The item's texts.
    short = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)
    return F.struct(
        F.lit(1).alias("_id"), F.lit("00:00:00,000-00:00:10,000").alias("timestamp"), F.lit("解析失败，使用默认内容").alias("picture"), short.alias("narration"), F.lit(0).alias("OST")
    )


def clip_list(text: Column, item: str) -> Column:
    """The list of clips in an answer: a list itself, its ``clips``, else the first field that is a list, as they stand in the text; null
    if there is none or its items do not fit."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```json\s*", ""), r"\s*```$", "")
    whole = F.try_parse_json(clean)
    fields = F.try_variant_get(whole, "$", "map<string,variant>")
    names = F.filter(F.json_object_keys(F.when(fields.isNotNull(), clean)), lambda k: F.schema_of_variant(F.try_element_at(fields, k)).startswith("ARRAY"))
    first = F.try_element_at(fields, F.get(names, F.lit(0)))
    return F.coalesce(
        F.try_variant_get(whole, "$", f"array<{item}>"), F.try_variant_get(whole, "$.clips", f"array<{item}>"), F.when(~F.array_contains(F.map_keys(fields), "clips"), F.try_variant_get(first, "$", f"array<{item}>"))
    )


def string_list(text: Column) -> Column:
    """A list of strings, or one between the first [ and the last ] of a line; null if there is none."""
    def strings(t):
        v = F.try_parse_json(t)
        return F.when(F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), F.try_variant_get(v, "$", "array<string>"))

    return F.coalesce(strings(text), strings(F.nullif(F.regexp_extract(text, r"(\[.*\])", 1), F.lit(""))))


def plot_result(answer: Column) -> Column:
    """A parsed plot answer with defaults and limits: texts of 500 and 200 characters, lists of 15, 20 and 10."""
    empty = F.array().cast("array<string>")
    get = lambda k: F.coalesce(answer[k], F.lit(""))
    some = lambda k, n: F.slice(F.coalesce(answer[k], empty), 1, n).alias(k)
    return F.struct(
        F.substring(get("summary"), 1, 500).alias("summary"), some("key_moments", 15), some("characters", 20), F.substring(get("main_conflict"), 1, 200).alias("main_conflict"),
        some("tags", 10), get("tone").alias("tone"), get("target_audience").alias("target_audience"),
    )


def plot_analysis(answer: Column) -> Column:
    """A plot answer as :func:`plot_result` gives it, read as JSON, in a fence or between the outermost braces; one that does not parse
    gives a degraded record: its first 500 characters as summary, 2000 as ``raw_response``, and the ``error``."""
    names = ("summary", "key_moments", "characters", "main_conflict", "tags", "tone", "target_audience")

    def read(fields: Column) -> Column:
        text = lambda k: F.try_variant_get(F.try_element_at(fields, F.lit(k)), "$", "string")
        some = lambda k: F.try_variant_get(F.try_element_at(fields, F.lit(k)), "$", "array<string>")
        return F.struct(*[text(k).alias(k) for k in ("summary", "main_conflict", "tone", "target_audience")], *[some(k).alias(k) for k in ("key_moments", "characters", "tags")], fields.isNull().alias("bad"))

    def record(t: Column, got: Column) -> Column:
        good, bad = plot_result(got), got["bad"]
        degraded = F.when(F.coalesce(t, F.lit("")) == "", "AI未能返回有效结果").otherwise(F.substring(t, 1, 500))
        return F.struct(
            *[F.when(bad, degraded).otherwise(good[k]).alias(k) if k == "summary" else good[k].alias(k) for k in names],
            F.when(bad, F.substring(t, 1, 2000)).alias("raw_response"), F.when(bad, "parse_failed").alias("error"),
        )

    stripped = F.regexp_replace(answer, r"(?U)^\s+|\s+\z", "")
    return let(stripped, lambda t: let(let(F.try_variant_get(_object(t), "$", "map<string,variant>"), read), lambda got: record(t, got)))


def _object(text: Column) -> Column:
    """The JSON object that a text is, that stands in its fence or between its outermost braces."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), F.lit(""))
    return F.coalesce(*[F.when(F.startswith(F.ltrim(t), F.lit("{")), F.try_parse_json(t)) for t in (text, fenced, _braces(text))])


def short_id(*parts: Column, length: int = 8) -> Column:
    """A short tag made from a row's key, the same in every run."""
    return F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, length)


def full_text(written: Column, segments: Column, raw: Column) -> Column:
    """The text of a narration: as written, else its segments' texts joined, else the first 2000 characters of the answer."""
    joined = F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return F.coalesce(F.nullif(written, F.lit("")), F.when(F.size(segments) > 0, joined), F.substring(raw, 1, 2000))


def loudness_report(log: Column) -> Column:
    """The first block of a log from a line of { to a line of }, as a variant; null if there is none or it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(log, r"(?s)(?:^|\n)([ \t]*\{[ \t]*\n.*?\n[ \t]*\}[ \t]*)(?:\n|$)", 1), F.lit("")))


def unescape_xml(text: Column) -> Column:
    """&lt;, &gt; and, last, &amp; to their characters; other entities stay."""
    for name, sign in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def strip_signs(text: Column, signs: str = "`json") -> Column:
    """Without any of some signs at both ends, then without white space: signs of the text itself go too, those behind white space stay."""
    some = "".join("\\" + c if not c.isalnum() else c for c in signs)
    return F.regexp_replace(F.regexp_replace(text, f"^[{some}]+|[{some}]+\\z", ""), r"(?U)^\s+|\s+\z", "")


def clock_in_name(name: Column) -> Column:
    """The first HH:MM:SS in a name; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"(\d{2}:\d{2}:\d{2})", 1), F.lit(""))


def _truth(v: Column) -> Column:
    """Whether a variant is neither absent, null, false, zero nor empty."""
    kind = F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    return (
        F.when(v.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.isin("OBJECT", "ARRAY"), ~F.to_json(v).isin("[]", "{}")).otherwise(F.try_variant_get(v, "$", "double") != 0)
    )


def narration_script(answer: Column, title: str = "AI解说文案") -> Column:
    """struct(title, full_text, segments) of a narration answer, as JSON, in a fence or between the outermost braces.

    Segments are records (timestamp as a number, 0 where it is none; text as a string; emphasis by truth) or plain strings; anything else is left
    out. Without a text of its own the segments' texts are joined; an answer that does not parse, or without either, gives its first 2000 characters.
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)

    def segment(v: Column) -> Column:
        fields = F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))
        said = F.try_element_at(fields, F.lit("text"))
        said = F.when(said.isNull(), "").when(kind(said) == "VOID", "None").otherwise(F.try_variant_get(said, "$", "string"))
        return F.struct(
            F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit("timestamp")), "$", "double"), F.lit(0.0)).alias("timestamp"),
            F.when(fields.isNull(), F.try_variant_get(v, "$", "string")).otherwise(said).alias("text"), F.coalesce(_truth(F.try_element_at(fields, F.lit("emphasis"))), F.lit(False)).alias("emphasis"),
        )

    def record(whole: Column) -> Column:
        items = F.coalesce(F.try_variant_get(whole, "$.segments", "array<variant>"), F.array().cast("array<variant>"))
        return let(F.transform(F.filter(items, lambda v: kind(v).isin("OBJECT", "STRING")), segment), lambda segments: F.struct(
            F.coalesce(F.try_variant_get(whole, "$.title", "string"), F.lit(title)).alias("title"), full_text(F.try_variant_get(whole, "$.full_text", "string"), segments, answer).alias("full_text"), segments.alias("segments"),
        ))

    return let(_object(answer), record)
