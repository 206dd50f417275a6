"""Places of rows in a group of any size, joins by place, seeded orders, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that share one task when rows are numbered.
WIDTH = 1 << 16


def places(rows: DataFrame, group: str, order: str, name: str = "place", width: int = WIDTH) -> DataFrame:
    """Adds each row's place from 0 within its group by a whole-number column; ties are numbered in any order, rows without a number go.

    Counts by range of ``width`` values (one small row each) are summed up over the ranges of a group; rows are numbered
    within a range only, so that no task holds a group. ``width`` should let a range hold many rows: the larger the gaps between numbers, the wider.
    """
    ranged = rows.where(F.col(order).isNotNull()).withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) - 1
    placed = ranged.withColumn("_in", within).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn(name, (F.col("_first") + F.col("_in")).cast("long")).drop("_range", "_in", "_group", "_of", "_first")


def zip_rows(left: DataFrame, right: DataFrame, group: str, order: str, width: int = WIDTH) -> DataFrame:
    """Pairs the rows of two lists by their place within the group, whatever numbers ``order`` holds; the shorter list ends it.

    The result has ``place`` and the other columns of both sides (which must differ in name but for group and order; the left order stays).
    """
    a, b = places(left, group, order, "place", width), places(right, group, order, "place", width).drop(order).withColumnRenamed(group, "_group").withColumnRenamed("place", "_place")
    return a.join(b, F.col(group).eqNullSafe(F.col("_group")) & (F.col("place") == F.col("_place"))).drop("_group", "_place")


def keeps_audio(ost: Column, has_audio: Column) -> Column:
    """Sound is kept only where it is wanted and there is any."""
    return (F.coalesce(ost, F.lit(0)) > 0) & F.coalesce(has_audio, F.lit(False))


def lot(seed: int, key: Column) -> Column:
    """A hash of seed and key: the same in every run, engine and partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def shuffled(rows: DataFrame, key: str, seed: int = 0, name: str | None = None) -> DataFrame:
    """A seeded random order by a key; with ``name`` the rows get their lot as a column and are not sorted. Equal keys share a lot."""
    if name:
        return rows.withColumn(name, lot(seed, F.col(key)))
    return rows.orderBy(lot(seed, F.col(key)), key)


def pick_one(rows: DataFrame, key: str, seed: int = 0, group: list[str] | None = None, wanted: Column | None = None) -> DataFrame:
    """SRC23: one row of each group: the one whose key is ``wanted`` if there is one, else the one of the least lot. One aggregation, no sort."""
    first = F.struct(*([~F.coalesce(F.col(key) == wanted, F.lit(False))] if wanted is not None else []), lot(seed, F.col(key)), F.col(key))
    names = [c for c in rows.columns if c not in (group or [])]
    return rows.groupBy(*(group or [])).agg(F.min_by(F.struct(*names), first).alias("_one")).where("_one is not null").select(*(group or []), "_one.*")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
