"""A Merkle manifest of a dataset: leaf digests, roots, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 2
# Nodes of a block at most. One shuffle serves all the levels that a block has.
BLOCK_NODES = 1024

_PATH = "array<struct<left:string,right:string>>"


def encoded_field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value as text, a colon, the text."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, one after the other."""
    return F.sha2(F.concat(*[encoded_field(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    sides = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(sides, ""), 256)


def placed(rows: DataFrame, tree: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``pos``, from 0 in order within each tree, and ``nodes``, the tree's size.

    Rows are range-partitioned by tree and order, numbered within a partition, and shifted by
    the counts of the partitions before, so a tree of any size spreads over partitions.
    """
    ranged = rows.repartitionByRange(F.col(tree), *order).withColumn("part", F.spark_partition_id())
    stored = materialise(ranged, "manifest-rows")
    counts = stored.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy(tree)
    shifts = counts.select(
        tree,
        "part",
        (F.sum("here").over(whole.orderBy("part")) - F.col("here")).alias("shift"),
        F.sum("here").over(whole).alias("nodes"),
    )
    within = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order))
    numbered = stored.withColumn("pos", within.cast("long")).join(shifts, [tree, "part"])
    return numbered.withColumn("pos", F.col("pos") - 1 + F.col("shift")).drop("part", "shift")


def _levels(fanout: int) -> int:
    """Levels within a block."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK_NODES:
        levels += 1
    return levels


def _climbed(nodes: DataFrame, tree: str, fanout: int) -> DataFrame:
    """A block's levels up: ``block``, the block's digest ``above``, and each node's ``path``.

    At each level the digests of a parent's children are spread into one column per slot by
    conditional aggregates. All columns joined are the parent's digest; all but the own slot,
    left and right of it, are the node's siblings. Trees with one node left stay as they are.
    """
    levels = _levels(fanout)
    slots = [f"slot_{k}" for k in range(fanout)]
    up = nodes.withColumn("block", F.expr(f"pos div {fanout**levels}")).repartition(tree, "block")
    up = up.withColumns({"above": F.col("digest"), "path": F.array().cast(_PATH)})
    for level in range(levels):
        own, over = (F.expr(f"pos div {fanout**k}") for k in (level, level + 1))
        up = up.withColumns({"parent": over, "slot": F.pmod(own, F.lit(fanout))})
        parent = Window.partitionBy(tree, "block", "parent")
        up = up.withColumns({s: F.max(F.when(F.col("slot") == k, F.col("above"))).over(parent) for k, s in enumerate(slots)})
        left = F.concat_ws("", *[F.when(F.col("slot") > k, F.col(s)) for k, s in enumerate(slots)])
        right = F.concat_ws("", *[F.when(F.col("slot") < k, F.col(s)) for k, s in enumerate(slots)])
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        joined = F.sha2(F.concat_ws("", *slots), 256)
        grows = F.col("nodes") > fanout**level
        up = up.withColumns(
            {
                "path": F.when(grows, F.concat("path", step)).otherwise(F.col("path")),
                "above": F.when(grows, joined).otherwise(F.col("above")),
            }
        )
    return up.drop("parent", "slot", *slots)


def climb(nodes: DataFrame, tree: str, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with ``top``, the root of its tree, and ``path``, its siblings on the way there.

    ``nodes`` has ``pos``, ``nodes`` and ``digest``. Consecutive nodes, ``fanout`` at a time,
    become one until one is left; the last run may be shorter, even one node. Blocks of nodes
    climb all their levels at once, in one shuffle; the blocks are the nodes of the next
    round. Paths of the rounds are joined block by block, so no key is hot.
    """
    size = fanout ** _levels(fanout)
    largest = nodes.agg(F.max("nodes")).first()[0] or 0
    climbed = _climbed(nodes, tree, fanout)
    if largest <= size:
        return climbed.withColumnRenamed("above", "top").drop("block")
    stored = materialise(climbed, "manifest-level")
    blocks = stored.groupBy(tree, "block").agg(
        F.max("above").alias("digest"), F.expr(f"(max(nodes) + {size - 1}) div {size}").alias("nodes")
    )
    higher = climb(blocks.withColumnRenamed("block", "pos"), tree, fanout)
    rest = higher.select(tree, F.col("pos").alias("block"), "top", F.col("path").alias("upper"))
    whole = stored.join(rest, [tree, "block"])
    return whole.withColumn("path", F.concat("path", "upper")).drop("above", "block", "upper")


def dataset_manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: list[str] | None = None,
    changed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """A row per row of ``docs``: ``key, group, leaf, subroot, root, path, changed_leaf``.

    A leaf is :func:`row_digest` of the row's ``fields``. Each value of ``group`` has a tree of
    its own: leaves ascend by ``key`` (nulls first; rows of one key by their digest, so equal
    rows follow each other). The trees' roots, in the order of the group's values (null first,
    then by UTF-8 bytes), are the nodes of the tree above, which ends in ``root``. ``path``
    lists, from the leaf to the root, the siblings left and right of the own node, as text; a
    node alone in its run has none. ``changed_leaf`` is the digest of the row after ``changed``
    replaced columns by others, for checking rows against the manifest: :func:`fold` with the
    path gives the root only if the row is as it was.

    Nulls in any column, empty and very long texts are values like others; rows repeated are
    leaves of their own. A single leaf is its own subroot, a single subroot the root. An empty
    table gives an empty table. Columns that are not named are not read.

    Texts are digested where they are read and never shuffled. Hot groups spread by ranges of
    position; a block has at most ``BLOCK_NODES`` nodes (or one run). Groups of any number are handled
    as rows, never on the driver.
    """
    fields = fields or FIELDS
    changed = changed or {}
    plain = {c: f"_field_{k}" for k, c in enumerate(fields)}
    source = docs.select(
        docs[key].alias("key"),
        docs[group].alias("group"),
        *[docs[c].alias(plain[c]) for c in fields],
        *[column.alias(f"_changed_{c}") for c, column in changed.items()],
    )
    leaf = row_digest([F.col(plain[c]) for c in fields])
    other = row_digest([F.col(f"_changed_{c}" if c in changed else plain[c]) for c in fields])
    # A null group has a name of its own, and every tree name is text.
    named = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))
    # Equal rows are dealt to ranges by where they were read; which is which shows nowhere.
    read = F.monotonically_increasing_id().alias("read")
    leaves = source.select("key", "group", named.alias("tree"), leaf.alias("digest"), other.alias("changed_leaf"), read)
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("read")]
    ready = materialise(climb(placed(leaves, "tree", *order).drop("read"), "tree", fanout), "manifest-leaves")
    roots = ready.groupBy("tree").agg(F.max("top").alias("digest"), F.max("group").alias("group"))
    one = roots.withColumn("all", F.lit(0))
    above = climb(placed(one, "all", F.col("group").asc_nulls_first(), F.col("tree")), "all", fanout)
    above = above.select("tree", F.col("top").alias("root"), F.col("path").alias("upper"))
    whole = ready.join(above, "tree")
    return whole.select(
        F.col("key").alias(key),
        *([] if group.lower() == key.lower() else [F.col("group").alias(group)]),
        F.col("digest").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        F.concat("path", "upper").alias("path"),
        "changed_leaf",
    )
