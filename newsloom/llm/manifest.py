"""Merkle manifest of a dataset: a hash tree per group of rows, one over the groups, and every row's proof.

A row's leaf is the SHA-256 (lowercase hex) of its columns, each written as ``-`` if null, else as its UTF-8 byte
count, a colon and the value.  The leaves of a group are ordered by id; while several nodes remain, every three
neighbours (the last run may have one or two) become the hash of their joined hashes.  What remains is the group's
subroot, a lone leaf itself.  The subroots, ordered by group (null first, then by UTF-8 bytes), give the root alike.

Slot pivot: a node's slot is its place modulo three, and conditional aggregates spread the children of a run into
the columns ``s0``, ``s1``, ``s2``.  Joined, the columns hash to the parent; without the own slot's column they are
the siblings.  The aggregates are windows over the run, so ``LEVELS`` levels are climbed on rows that were shuffled
and sorted once by the block of 3^LEVELS leaves they lie in; the few nodes above the blocks go the same way, and
each block's way to the root is joined back to its rows.  No task holds a whole group.

Rows without an id come first in their group, rows equal in id are ordered by leaf, equal rows are leaves of their
own.  Null texts are null fields.  An empty table has no root and no rows.  Other columns are not hashed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import stage

FANOUT = 3
LEVELS = 7  # climbed in one go: a block has 2,187 leaves
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Hash of the parts joined, nulls left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place`` (gapless from 0 in each ``tree``) and ``size`` (rows of the tree).

    Rows are sorted in ranges over all trees; each range's count per tree then says where it begins.
    """
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order)]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = stage(ranges.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranges")
    counted = ranges.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")  # a row for each range the tree reaches into
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stage(counted.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("size")), "starts")
    return ranges.join(starts, ["tree", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``way`` (left and right siblings at each of LEVELS levels), ``block`` and its node, ``top``."""
    place = lambda k: F.floor(F.col("place") / FANOUT ** k)
    rows = nodes.select("*", F.col("hash").alias("h0"), *(place(k).alias(f"p{k}") for k in range(1, LEVELS + 1))).repartition("tree", f"p{LEVELS}")
    slots = ["s0", "s1", "s2"]
    for k in range(LEVELS):
        # runs of higher levels are prefixes of this order: one sort serves all
        run = Window.partitionBy("tree", *(f"p{j}" for j in range(LEVELS, k, -1)))
        slot = F.pmod(F.col(f"p{k}") if k else F.col("place"), F.lit(FANOUT))
        rows = rows.withColumns({s: F.max(F.when(slot == i, F.col(f"h{k}"))).over(run) for i, s in enumerate(slots)})
        siblings = F.struct(F.concat_ws("", *(F.when(slot > i, F.col(s)) for i, s in enumerate(slots))).alias("left"),
                            F.concat_ws("", *(F.when(slot < i, F.col(s)) for i, s in enumerate(slots))).alias("right"))
        several = F.col("size") > FANOUT ** k
        rows = rows.withColumns({f"w{k}": F.when(several, siblings), f"h{k + 1}": F.when(several, digest(*map(F.col, slots))).otherwise(F.col(f"h{k}"))})
    way = F.filter(F.array(*(F.col(f"w{k}") for k in range(LEVELS))), lambda w: w.isNotNull())
    return rows.select(*nodes.columns, way.alias("way"), F.col(f"p{LEVELS}").alias("block"), F.col(f"h{LEVELS}").alias("top"))


def grown(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their ways to the roots of their trees, and (tree, root).

    ``nodes`` (tree, place, size, hash, ...) is read twice, once for the nodes above, once for the ways.
    """
    rows, blocks = climbed(nodes), 3 ** LEVELS
    above = stage(rows.filter(F.col("place") % blocks == 0).select(
        "tree", F.col("block").alias("place"), F.ceil(F.col("size") / blocks).alias("size"), F.col("top").alias("hash")), "above")
    if (above.agg(F.max("size")).first()[0] or 0) <= 1:  # every tree has come to its root
        return rows.drop("block", "top"), above.select("tree", F.col("hash").alias("root"))
    upper, roots = grown(above)
    upper = stage(upper.select("tree", F.col("place").alias("block"), F.col("way").alias("rest")), "ways")
    return rows.join(upper, ["tree", "block"]).withColumn("way", F.concat("way", "rest")).drop("block", "top", "rest"), roots


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", id_col: str = "doc_id", **also: Column) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, ``proof`` (array of left and right siblings, leaf first).

    ``also``: further light columns to carry along, by name.
    """
    name = F.col(group).cast("string")
    tree = F.when(name.isNull(), "").otherwise(F.concat(F.lit("s"), name))  # sorts null first, is never null
    light = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(*(F.col(c) for c in columns)).alias("hash"),
                        F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in also.items())).alias("also"), F.monotonically_increasing_id().alias("seq"))
    leaves = stage(placed(stage(light, "leaves"), "id", "hash", "seq"), "placed")
    ways, subroots = grown(leaves)
    tops = stage(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash")), "subroots")
    tops, roots = grown(stage(placed(tops, "name"), "placed-subroots"))
    tops = stage(tops.join(roots, "tree").select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("way").alias("rest")), "roots")
    return ways.join(tops, "tree").select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", F.concat("way", "rest").alias("proof"),
                                          *(F.col(f"also.{n}").alias(n) for n in also))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(s["left"], h, s["right"]))
