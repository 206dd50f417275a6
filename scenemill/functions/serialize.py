"""JSON of nested values with what has no JSON form masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what stands for binary data.
MASK = "*** binary data ***"
_PLAIN = (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.FloatType, T.NullType, T.VariantType)


def _plain(kind: T.DataType) -> bool:
    """Whether a type has a JSON form all through."""
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.MapType):
        return _plain(kind.keyType) and _plain(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return isinstance(kind, _PLAIN)


def masked(value: Column, kind: T.DataType) -> Column:
    """The value with every binary field at any depth replaced by :data:`MASK` and what JSON cannot hold (dates, times, decimals, intervals) by null.

    The expression is made by walking the schema through arrays, maps and records; parts that need nothing stay as they are, null parts null.
    Keys of maps that are no strings are written as text.
    """
    if _plain(kind):
        return value
    if isinstance(kind, T.BinaryType):
        return F.when(value.isNotNull(), F.lit(MASK))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        out = value if isinstance(kind.keyType, T.StringType) else F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))))
        return out if _plain(kind.valueType) else F.transform_values(out, lambda _, v: masked(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[masked(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return F.lit(None).cast("string")


def to_json(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value of any depth, nulls written; a value alone (no record, list or map) is written as itself."""
    whole = F.to_json(F.struct(masked(value, kind).alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def envelope(status: Column, data: Column | None = None, message: Column | None = None) -> Column:
    """{status, data, message} as JSON without what is null or empty; ``data`` is JSON text already."""
    parts = [F.concat(F.lit('"status":'), status.cast("string"))]
    if data is not None:
        parts.append(F.when(~F.coalesce(data, F.lit("null")).isin("null", '""', "0", "false", "[]", "{}"), F.concat(F.lit('"data":'), data)))
    if message is not None:
        text = F.to_json(F.struct(message.alias("v")))
        parts.append(F.when(F.coalesce(message, F.lit("")) != "", F.concat(F.lit('"message":'), F.substr(text, F.lit(6), F.length(text) - 6))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
