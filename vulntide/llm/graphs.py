"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``node, label`` of every node of ``links`` (``a, b``) and of ``start``.

    The label is the least node of the component. ``start`` (``node, label``) may hold
    components known before. Each round hands labels over links, hooks the label itself to
    the least one that reaches its members, and halves the chains of labels; each is a
    stored table, so a lost executor repeats one round at most. Rounds grow with the
    logarithm of the longest path. An empty table of links gives ``start``, or no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if start is None:
        labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    else:
        new = both.select(F.col("a").alias("node")).distinct().join(start, "node", "left_anti")
        labels = start.unionByName(new.withColumn("label", F.col("node")))
    labels = materialise(labels, "labels")
    if links.isEmpty():
        return labels
    while True:
        a, b = (
            labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
            for side in ("a", "b")
        )
        over = (
            both.join(a, "a")
            .join(b, "b")
            .where("label_b < label_a")
            .groupBy(F.col("label_a").alias("label"))
            .agg(F.min("label_b").alias("lower"))
        )
        hooks = materialise(over, "hooks")
        if hooks.isEmpty():
            return labels
        hooks = _followed(hooks)
        labels = materialise(
            labels.join(hooks, "label", "left").select("node", F.coalesce("lower", "label").alias("label")),
            "labels",
        )


def _followed(hooks: DataFrame) -> DataFrame:
    """``label, lower`` with each chain of hooks followed to its end by doubling."""
    while True:
        ahead = hooks.select(F.col("label").alias("lower"), F.col("lower").alias("further"))
        longer = hooks.join(ahead, "lower", "left")
        if longer.where("further is not null").isEmpty():
            return hooks
        hooks = materialise(longer.select("label", F.coalesce("further", "lower").alias("lower")), "hooks")
