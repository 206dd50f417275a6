"""Catalogues, dedup, limits, validation and task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import blank


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A frame that is dealt by one column of the key already is not dealt again."""
    name = "n"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))).where(F.col(name) == 1).drop(name)


def take_budget(clips: DataFrame, group: str, order: str, budget: Column, most: float) -> DataFrame:
    """Clips until their lengths (each at most ``most``) pass the budget, the one that passes it included."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.least(F.col("duration"), F.lit(most))).over(w), F.lit(0.0))
    return clips.withColumn("used_before", used).where(F.col("used_before") <= budget)


def without(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """P10/P12/J7/SET2: rows without a partner."""
    return df.join(others, on, "left_anti")


def group_with_empty(groups: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """The sorted items of every group, an empty list where it has none."""
    g = items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = groups.join(g, key, "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(out.schema["items"].dataType)))


def latest_state(events: DataFrame, merge: bool = False) -> DataFrame:
    """SNK11: the state of each task: the last event as it is, or with ``merge`` the last non-null value of each field."""
    fields = [c for c in events.columns if c not in ("task_id", "seq")]
    if merge:
        aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
        return events.groupBy("task_id").agg(*aggs)
    return events.groupBy("task_id").agg(F.max_by(F.struct(*fields), "seq").alias("s")).select("task_id", "s.*")


#: Fixed value: the form of a script item's time range.
RANGE = r"^\d{2}:\d{2}:\d{2},\d{3}-\d{2}:\d{2}:\d{2},\d{3}$"


def check_script(items: DataFrame) -> DataFrame:
    """The first broken rule of each typed script item (null: valid); :func:`check_script_text` checks a whole script."""
    first = (
        F.when(F.col("_id").isNull() | (F.col("_id") <= 0), "bad_id")
        .when(F.col("timestamp").isNull() | ~F.col("timestamp").rlike(RANGE), "bad_timestamp")
        .when(blank(F.col("picture")), "blank_picture")
        .when(blank(F.col("narration")), "blank_narration")
        .when(F.col("OST").isNull() | ~F.col("OST").isin(0, 1, 2), "bad_ost")
    )
    return items.withColumn("error", first)


def check_script_text(script: Column) -> Column:
    """The first broken rule of a script as JSON text, with the number of the item from 1: struct(item, error), nulls where it is valid.

    Rules in order: no JSON, no list, empty list; then item by item: no object, a field that is absent, and the form of each field.
    """
    whole = F.try_parse_json(script)
    items = F.try_variant_get(whole, "$", "array<variant>")
    fields = ["_id", "timestamp", "picture", "narration", "OST"]

    def kind(item: Column, field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(item, f"$.{field}", "variant"))

    def broken(item: Column) -> Column:
        text = {f: F.try_variant_get(item, f"$.{f}", "string") for f in fields[1:4]}
        out = F.when(~F.schema_of_variant(item).startswith("OBJECT"), "no_object")
        for f in fields:
            out = out.when(~F.array_contains(F.map_keys(F.try_variant_get(item, "$", "map<string,variant>")), f), f"no_{f}")
        out = out.when((kind(item, "_id") != "BIGINT") | (F.try_variant_get(item, "$._id", "long") <= 0), "bad__id")
        out = out.when((kind(item, "timestamp") != "STRING") | ~text["timestamp"].rlike(RANGE), "bad_timestamp")
        for f in ("picture", "narration"):
            out = out.when((kind(item, f) != "STRING") | blank(text[f]), f"bad_{f}")
        return out.when(kind(item, "OST") != "BIGINT", "bad_OST")

    each = F.filter(F.transform(items, lambda item, i: F.struct((i + 1).alias("item"), broken(item).alias("error"))), lambda r: r["error"].isNotNull())
    whole_error = F.when(whole.isNull(), "no_json").when(items.isNull(), "no_list").when(F.size(items) == 0, "empty_list")
    none = F.lit(None).cast("int")
    return F.when(whole_error.isNotNull(), F.struct(none.alias("item"), whole_error.alias("error"))).otherwise(F.coalesce(F.get(each, F.lit(0)), F.struct(none.alias("item"), F.lit(None).cast("string").alias("error"))))


def export(prompts: DataFrame) -> DataFrame:
    """A row per category with its prompts: name to version to description, in order; of equal keys the greatest description.

    Rows without category, name or version are in no registry and do not go out. A category is held by one task.
    """
    keys = ["category", "name", "version"]
    each = prompts.dropna(subset=keys).groupBy(*keys).agg(F.max("description").alias("description"))

    def nested(rows: DataFrame, by: list[str], key: str, value: str, out: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(F.col(value).alias("_v")).alias("_e"))), _by_key(key))).alias("_m")).select(
            *by, F.transform_values("_m", lambda _, v: v["_v"]).alias(out)
        )

    return nested(nested(each, keys[:2], "version", "description", "versions"), keys[:1], "name", "versions", "prompts")


def _by_key(key: str):
    """Orders records by a field; maps in them have no order."""
    return lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)


def default_versions(prompts: DataFrame) -> DataFrame:
    """The default version of each prompt is the greatest version as a string."""
    return prompts.groupBy("category", "name").agg(F.max("version").alias("default_version"))


def search(prompts: DataFrame, keyword: str) -> DataFrame:
    """Keyword in name or description, without case."""
    k = F.lit(keyword.lower())
    return prompts.where(F.contains(F.lower("name"), k) | F.contains(F.lower("description"), k))


def added(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The rows and those of ``more`` whose key they do not hold; of new rows with one key each stays."""
    return rows.unionByName(more.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns))


def prompt_info(prompts: DataFrame) -> DataFrame:
    """Prompts with a preview of their template (500 characters), the number of their examples and whether they take parameters."""
    preview = F.when(F.length("template") > 500, F.concat(F.left("template", F.lit(500)), F.lit("..."))).otherwise(F.col("template"))
    return prompts.withColumns({"template_preview": preview, "examples_count": F.coalesce(F.size("examples"), F.lit(0)), "has_parameters": F.coalesce(F.size("parameters") > 0, F.lit(False))}).drop("template", "examples")


def with_defaults(prompts: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Prompts with ``is_default``: the version of chosen(category, name, version) where it exists, else the greatest as a string."""
    greatest = F.max("version").over(Window.partitionBy("category", "name"))
    if chosen is None:
        return prompts.withColumn("is_default", F.col("version") == greatest)
    wanted = chosen.join(prompts.select("category", "name", "version").distinct(), ["category", "name", "version"], "left_semi").groupBy("category", "name").agg(F.max("version").alias("_set"))
    out = prompts.withColumn("_greatest", greatest).join(wanted, ["category", "name"], "left")
    return out.withColumn("is_default", F.col("version") == F.coalesce("_set", "_greatest")).drop("_set", "_greatest")


def registry_stats(prompts: DataFrame) -> DataFrame:
    """A18."""
    return prompts.agg(
        F.countDistinct("category").alias("n_categories"), F.countDistinct("category", "name").alias("n_prompts"),
        F.countDistinct("category", "name", "version").alias("n_versions"),
    )
