"""Shared-folder tables that cut lineage, and shipping of this package to workers."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = __name__.split(".")[0]
#: Rows of an Arrow batch; Spark's own number is 10,000.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def release(spark: SparkSession) -> None:
    """Collects garbage here and in the driver's JVM: Spark then drops shuffle files that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a durable table.

    Driver garbage is collected afterwards so that Spark can drop the shuffle
    files behind the written table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that :func:`cut` has returned (others and None are left alone).

    Only for tables that no later job reads: whatever was made from them must stand in a table of its own.
    """
    for table in tables:
        if path := getattr(table, "cut_path", None):
            spark = table.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def of(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, made of columns of ``table``, with its place, so that :func:`drop` removes it."""
    df.cut_path = getattr(table, "cut_path", None)
    return df


#: Words of 64 bits of a sieve (about 20 MB when it is broadcast), whatever the tables' sizes.
WORDS = 1 << 19


def _at(*columns: str) -> tuple:
    h = F.xxhash64(*columns)
    return F.pmod(h, F.lit(WORDS)), F.pmod(F.shiftright(h, 19), F.lit(64)).cast("int")


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """A bit for each key of a table, in at most WORDS rows (``_word``, ``_bits``): a Bloom filter with one hash, of bounded size.

    Where there are more keys than bits it lets everything through, which is slower but right.
    """
    word, bit = _at(*columns)
    return keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def sifted(rows: DataFrame, bits: DataFrame, *columns: str, inside: bool = True) -> DataFrame:
    """The rows that a sieve lets through (all whose columns are a key of it, few others), or with ``inside`` off the others. No shuffle of ``rows``."""
    word, bit = _at(*columns)
    marked = rows.withColumns({"_own": word, "_bit": bit}).join(F.broadcast(bits), F.col("_own") == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftright(_bits, _bit) & 1L) = 1L"), F.lit(False))
    return marked.where(hit if inside else ~hit).drop("_own", "_bit", "_word", "_bits")


def numbered_columns(df: DataFrame) -> DataFrame:
    """The frame with columns named by their places: names with dots, or twice the same, then trouble no Arrow step."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    A no-op where the package's parent folder is on PYTHONPATH already; elsewhere
    the package goes out once per application with ``addPyFile``. Arrow batches of the session get BATCH_ROWS
    rows unless the session has a number of its own: texts make wide rows, and a batch lives several times in an executor.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_shipped_" + PACKAGE, False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="ship-"), PACKAGE)
    sc.addPyFile(shutil.make_archive(base, "zip", root, PACKAGE))
    setattr(sc, "_shipped_" + PACKAGE, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra_col: str | None = None) -> DataFrame:
    """Only the input columns asked for, as ``doc_id``, ``text`` (and ``extra``): other columns cannot clash."""
    ship(docs.sparkSession)
    extra = [F.col(f"`{extra_col}`").alias("extra")] if extra_col else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *extra)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``th``, a hash of the text: (doc_id, th) names a row up to exact repeats."""
    return docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
