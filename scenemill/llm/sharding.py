"""Sharding by a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashing import U, mix
from .store import cut, id_text, numbered_columns


def _keys(seed: int, rounds: int) -> np.ndarray:
    return mix(np.arange(1, rounds + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


def _shape(n: int) -> tuple[int, int]:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    return half, (1 << half) - 1


def permute(rows: np.ndarray, n: int, seed: int = 0, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Feistel permutation of 0..n-1 with cycle walking.

    The network permutes the smallest 2**(2k) >= n; a value that lands at n or
    above goes through it again until it falls below n, which keeps the map a
    bijection on 0..n-1. ``inverse`` undoes it, so the row behind any (shard, slot)
    can be computed.
    """
    half, mask = _shape(n)
    keys = _keys(seed, rounds)
    keys = keys[::-1] if inverse else keys
    out = np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & U(mask)
        for key in keys:
            if inverse:
                left, right = right ^ (mix(left + key) & U(mask)), left
            else:
                left, right = right, left ^ (mix(right + key) & U(mask))
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Global row numbers 0..n-1 in the order of ``order``, without a single-task sort.

    Two passes: a range-partitioned, sorted table is written with each row's place in
    its partition; the partitions' counts (one number each) give the offsets.
    Rows equal in all of ``order`` take neighbouring numbers in any order. Columns may have any name.
    """
    names, df = df.columns, numbered_columns(df)
    schema = StructType([*df.schema.fields]).add("part", "integer").add("place", "long")

    def place(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))],
                [*b.schema.names, "part", "place"],
            )
            seen += n

    keys = [F.col(f"c{names.index(c)}").asc_nulls_first() for c in order]
    table = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(place, schema), "numbered")
    counts = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(base.items()), "part int, base long")
    return table.join(F.broadcast(offsets), "part").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], (F.col("base") + F.col("place")).alias(name), F.lit(total).cast("long").alias("n_rows")
    )


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under law ``rows``: shard sizes differ by at most one.

    Rows are numbered by (doc_id, text checksum, size), so the result depends neither on
    partitioning nor on file order; rows that are equal in all three are
    interchangeable. Null doc_id sorts first; null text has size 1 and checksum 0.
    An empty table gives an empty result. Only the id and two numbers per row are
    shuffled, never texts. ``grown_shard`` is null: this law gives no promise about
    one more shard.
    """
    small = id_text(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered = number_rows(small, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(row, n):
        return row.__class__(permute(row.to_numpy(), int(n.iloc[0]) if len(n) else 1, seed))

    return numbered.withColumn("place", place("row_number", "n_rows")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
