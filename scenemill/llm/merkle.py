"""Merkle manifests of a table: trees of hashes by group, collapsed in blocks with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, drop

#: Nodes that become one, and levels that one block collapses.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
#: Bits of a row's place within its partition in Spark's monotonically increasing ids.
_PLACE = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _depth(n: Column) -> Column:
    """Levels above ``n`` nodes within one block: the least d with FAN**d >= n, at most LEVELS."""
    return sum(((n > FAN**level).cast("int") for level in range(LEVELS)), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1; an empty array for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def _collapse(leaves: Column, depth: Column) -> Column:
    """All levels of a block: its nodes, then ``depth`` times the digests of each FAN consecutive ones."""

    def above(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), ((F.size(below) - 1) / FAN).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * FAN + 1, F.lit(FAN)), ""), 256))))

    return F.aggregate(_upto(depth), F.array(leaves), above)


def _path(levels: Column, place: Column) -> Column:
    """(left, right) digests beside a node of the lowest level on its way to the block's root, from below."""
    powers = F.array(*[F.lit(FAN**i) for i in range(LEVELS + 1)])

    def beside(level: Column) -> Column:
        node = F.floor(place / powers[level]).cast("int")
        start = node - node % FAN
        nodes = levels[level]
        return F.struct(
            F.array_join(F.slice(nodes, start + 1, node - start), "").alias("left"),
            F.array_join(F.slice(nodes, node + 2, F.greatest(start + FAN - 1 - node, F.lit(0))), "").alias("right"),
        )

    return F.transform(_upto(F.size(levels) - 1), beside)


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` (from 0, in order, within ``g``) and ``n`` (rows of ``g``), without sorting a group in one task.

    A range-sorted table is written with each row's partition and place; the runs of each group in each partition
    (one small row each) give the offsets.
    """
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = cut(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    table = table.withColumn("part", F.shiftright("at", _PLACE))
    runs = table.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    same = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "part", (F.col("first") - before).alias("origin"), F.sum("rows").over(same).alias("n"))
    placed = table.join(runs, ["g", "part"]).withColumn("pos", F.col("at") - F.col("origin")).drop("at", "part", "origin")
    placed.cut_path = table.cut_path if hasattr(table, "cut_path") else None
    return placed


def _blocks(nodes: DataFrame, entry: list[str], name: str) -> DataFrame:
    """A row for each BLOCK consecutive nodes of a group: their entries in order, all levels of digests, and n, the group's nodes."""
    rows = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *entry))).alias("nodes"), F.first("n").alias("n")
    )
    levels = _collapse(F.transform("nodes", lambda x: x["node"]), _depth(F.col("n")))
    entries = F.transform("nodes", lambda x: F.struct(*[x[c].alias(c) for c in ["node", *entry]]))
    return cut(rows.select("g", "block", "n", entries.alias("entries"), levels.alias("levels")), name)


def _root(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as nodes of the next level."""
    return blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1)[0].alias("node"))


def _climb(blocks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Collapses the roots of blocks again and again until each group has one.

    Returns (g, subroot) and (g, block, upper): for each block of the lowest level, the digests beside its root on the way up.
    """
    higher = [blocks]
    most = blocks.agg(F.max("n")).first()[0]
    while most > BLOCK:
        higher.append(_blocks(_root(higher[-1]), [], name))
        most = -(-most // BLOCK)
    roots = _root(higher[-1]).select("g", F.col("node").alias("subroot"))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    upper = higher[-1].select("g", "block", nothing.alias("upper"))
    for table in higher[:0:-1]:
        paths = F.transform(_upto(F.size("entries")), lambda i: F.struct((F.col("block") * BLOCK + i).alias("block"), F.concat(_path(F.col("levels"), i), "upper").alias("upper")))
        upper = table.join(upper, ["g", "block"]).select("g", F.inline(paths))
    return roots, upper


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    changed: dict[str, Column] | None = None, with_path: bool = False,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether a changed row still folds to the root.

    A leaf is the digest of the row's ``fields`` (see :func:`field`; numbers in decimal). Per group, leaves ascend by id; while several nodes
    remain, each FAN consecutive ones become their digest. The groups' roots, null first and then bytewise, give the root likewise.
    ``proof_sha256`` is the digest of all digests beside the row's way to the root; ``folded_root`` folds the leaf of the row with the
    ``changed`` columns (without them: the leaf itself) with those, and ``verified`` says whether that is the root.

    Rows are placed by a range sort on (group, id, leaf), so a group of any size is spread; blocks of 729 nodes are collapsed by higher-order
    functions and their roots again, until one is left. Texts are read once and never shuffled. Null ids sort first; rows equal in id and
    leaf are interchangeable; other columns are not read; an empty table gives no rows. ``with_path`` adds the array of (left, right).
    """
    col = lambda c: F.col(f"`{c}`")
    of = lambda c: (changed or {}).get(c, col(c))
    leaf, altered = digest(*[field(col(c)) for c in fields]), digest(*[field(of(c)) for c in fields])
    group = F.coalesce(F.concat(F.lit("s"), col(group_col).cast("string")), F.lit("n"))
    differs = F.lit(False)
    for c, value in (changed or {}).items():
        differs = differs | ~value.eqNullSafe(col(c))
    rows = docs.select(
        group.alias("g"), col(id_col).cast("long").alias("id"), leaf.alias("node"), (F.when(differs, altered) if changed else F.lit(None).cast("string")).alias("altered")
    )
    leaves = cut(rows, "leaves")
    placed = _placed(leaves, ["id", "node"], "ranged")
    blocks = _blocks(placed, ["id", "altered"], "blocks")
    drop(leaves, placed)
    columns = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path array<struct<left:string,right:string>>"
    if not blocks.limit(1).count():
        return _named(docs.sparkSession.createDataFrame([], columns), id_col, with_path)
    subroots, upper = _climb(blocks, "blocks")
    top = _placed(subroots.withColumnRenamed("g", "name").withColumn("g", F.lit("")).withColumnRenamed("subroot", "node"), ["name"], "subroots")
    tops = _blocks(top, ["name"], "tops")
    drop(top)
    roots, over = _climb(tops, "tops")
    root = F.lit(roots.first()["subroot"])
    inner = F.transform(
        _upto(F.size("entries")),
        lambda i: F.struct(F.col("entries")[i]["name"].alias("g"), F.col("entries")[i]["node"].alias("subroot"), F.concat(_path(F.col("levels"), i), "upper").alias("rest")),
    )
    above = tops.join(over, ["g", "block"]).select(F.inline(inner))
    whole = upper.join(above, "g").select("g", "block", "subroot", F.concat("upper", "rest").alias("upper"))

    def one(i: Column) -> Column:
        entry = F.col("entries")[i]
        path = F.concat(_path(F.col("levels"), i), "upper")
        beside = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
        folded = F.aggregate(path, F.coalesce(entry["altered"], entry["node"]), lambda d, s: digest(s["left"], d, s["right"]))
        return F.struct(
            entry["id"].alias("id"), entry["node"].alias("leaf"), F.col("subroot"), F.sha2(beside, 256).alias("proof_sha256"),
            folded.alias("folded_root"), *([path.alias("path")] if with_path else []),
        )

    out = blocks.join(whole, ["g", "block"]).select(F.inline(F.transform(_upto(F.size("entries")), one)))
    out = out.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
    return _named(out, id_col, with_path)


def _named(out: DataFrame, id_col: str, with_path: bool) -> DataFrame:
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["path"] * with_path]
    return out.select(F.col("id").alias(id_col), *names)
