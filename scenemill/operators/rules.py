"""Validation of model answers by rules that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a rule table: which kind of answer, in which order, where (``field`` of the object, or of each item of ``list``), what is asked and with which argument.
RULES = "kind string, ord int, list string, field string, check string, arg string, error string"

# The forms of time ranges.
_STAMP = r"\d{2}:\d{2}:\d{2},\d{3}-\d{2}:\d{2}:\d{2},\d{3}"
_SHORT = r"\d{2}:\d{2}:\d{2}-\d{2}:\d{2}:\d{2}"


def _item(kind: str, name: str, start: int, checks: list[tuple]) -> list[tuple]:
    return [(kind, start + i, name, field, check, arg, error) for i, (field, check, arg, error) in enumerate(checks)]


def default_rules(spark: SparkSession) -> DataFrame:
    """The rules of narrations and plot analyses (R19): the first broken one in order counts, items before later items."""
    fields = ("_id", "timestamp", "picture", "narration")
    narration = [(f, "present", None, f"missing_{f}") for f in fields] + [
        ("_id", "positive", None, "bad__id"), ("timestamp", "text", None, "timestamp_no_text"), ("timestamp", "matches", f"^{_STAMP}$", "timestamp_format"),
        ("picture", "filled", None, "empty_picture"), ("narration", "filled", None, "empty_narration"), ("OST", "one_of", "0,1,2", "bad_OST"),
    ]
    points = ("timestamp", "title", "picture")
    plot = [(f, "present", None, f"missing_{f}") for f in points] + [(f, "filled", None, f"empty_{f}") for f in points] + [("timestamp", "matches", f"^(?:{_STAMP}|{_SHORT})$", "timestamp_format")]
    rows = [
        ("narration", 1, None, "items", "present", None, "missing_items"), ("narration", 2, None, "items", "list", None, "items_no_list"), ("narration", 3, None, "items", "not_empty", None, "empty_items"),
        *_item("narration", "items", 4, narration), ("plot", 1, None, "summary", "present", None, "missing_summary"), ("plot", 2, None, "plot_points", "present", None, "missing_plot_points"),
        ("plot", 3, None, "plot_points", "list", None, "plot_points_no_list"), *_item("plot", "plot_points", 4, plot),
    ]
    return spark.createDataFrame(rows, RULES)


def clean_answer(text: Column) -> Column:
    """Without fence lines, trimmed, and from the first { to the last } where there are any."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?md)^```json\s*", ""), r"(?md)^```\s*$", "")
    out = F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")
    return F.coalesce(F.nullif(F.regexp_extract(out, r"(?s)(\{.*\})", 1), F.lit("")), out)


def kind_of(name: Column, output_format: Column) -> Column:
    """The kind of check by the prompt's format and name: narration, plot, json, or text for what is not checked."""
    low = F.lower(name)
    of_json = F.when(low.rlike("narration|script"), "narration").when(low.rlike("plot|analysis"), "plot").otherwise("json")
    return F.when(output_format == "json", of_json).when(output_format == "structured", "json").when(output_format.isin("text", "markdown"), "text")


def _shape(value: Column) -> Column:
    """Kind of a variant in one word: OBJECT, ARRAY, STRING, BIGINT, ...; null for an absent field."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _broken(value: Column, check: Column, arg: Column) -> Column:
    """Whether a field (null: absent) breaks a check. Truth values count as the numbers 1 and 0."""
    kind = _shape(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    number = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "long")).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long"))
    no = F.lit(False)
    return (
        F.when(check == "present", value.isNull()).when(check == "list", value.isNotNull() & (kind != "ARRAY"))
        .when(check == "not_empty", F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) == 0, no)).when(check == "positive", F.coalesce(number <= 0, F.lit(True)))
        .when(check == "text", text.isNull()).when(check == "matches", ~F.coalesce(F.regexp_like(text, arg), no)).when(check == "filled", F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True)))
        .when(check == "one_of", value.isNotNull() & ~F.coalesce(F.array_contains(F.split(arg, ","), number.cast("string")), no))
        .when(check == "type", value.isNotNull() & (kind != arg)).otherwise(no)
    )


def validate(answers: DataFrame, rules: DataFrame, key: str = "answer_id") -> DataFrame:
    """The first broken rule of each of answers(key, name, output_format, output), as ``error`` and ``item`` (from 1; null: the whole).

    An answer is cleaned and parsed once; its items are rows, joined with the rules of its kind, which are few and broadcast: a kind may be most answers, and dealt by kind they would be one task's;
    each rule looks at one field. ``error`` is null for a good answer, ``no_json`` where nothing parses or, for a kind with rules, where it is no object,
    ``no_object`` for an item that is none, ``bad_format`` for an unknown format. New prompts need new rows, no code.
    """
    kind = kind_of(F.col("name"), F.col("output_format"))
    # dealt once by key: a small file is read by one task, and the first broken rule and the answer meet where they are
    dealt = answers.select(key, "name", "output_format", "output").repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    parsed = dealt.select(key, kind.alias("kind"), F.when(kind != "text", F.try_parse_json(clean_answer(F.col("output")))).alias("v"))
    shape = _shape(F.col("v"))
    # The object itself is item 0, then the items of every list that rules of its kind name.
    known = rules.groupBy("kind").agg(F.collect_set("list").alias("lists"))
    whole = parsed.join(F.broadcast(known), "kind", "left").withColumn("fields", F.when(shape == "OBJECT", F.try_variant_get("v", "$", "map<string,variant>")))
    first = F.when(F.col("kind").isNull(), "bad_format").when((F.col("kind") != "text") & (F.col("v").isNull() | (F.col("lists").isNotNull() & (shape != "OBJECT"))), "no_json")
    whole = whole.withColumn("broken", first).drop("v")
    found = F.transform("lists", lambda name: F.transform(F.try_variant_get(F.try_element_at("fields", name), "$", "array<variant>"), lambda item, i: F.struct(name.alias("list"), (i + 1).alias("item"), item.alias("value"))))
    each = F.flatten(F.filter(found, lambda items: items.isNotNull()))
    items = whole.where("broken is null").select(key, "kind", F.explode(each).alias("e")).select(key, "kind", "e.list", "e.item", "e.value")
    objects = whole.where("broken is null and lists is not null").select(key, "kind", F.lit(None).cast("string").alias("list"), F.lit(0).alias("item"), "fields", F.lit(False).alias("no_object"))
    of_items = items.select(key, "kind", "list", "item", F.when(_shape(F.col("value")) == "OBJECT", F.try_variant_get("value", "$", "map<string,variant>")).alias("fields"), (_shape(F.col("value")) != "OBJECT").alias("no_object"))
    r = rules.select(F.col("kind").alias("_kind"), F.col("list").alias("_list"), "ord", "field", "check", "arg", "error")
    tested = objects.unionByName(of_items).join(F.broadcast(r), (F.col("kind") == F.col("_kind")) & F.col("list").eqNullSafe(F.col("_list")))
    bad = tested.where(F.col("no_object") | _broken(F.try_element_at("fields", F.col("field")), F.col("check"), F.col("arg")))
    worst = bad.groupBy(key).agg(F.min(F.struct("item", "ord", F.when(F.col("no_object"), "no_object").otherwise(F.col("error")).alias("error"))).alias("first"))
    out = whole.select(key, "broken").join(worst.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce("broken", "first.error").alias("error"), F.nullif(F.col("first.item"), F.lit(0)).alias("item"))
