"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .shards import _numbered
from .workers import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 20_231

DRAW_DIGITS = 15  # hexadecimal digits of a draw
CELL_BITS = 10  # draws fall into 2**10 cells per source
_SHIFT = 4 * DRAW_DIGITS - CELL_BITS
_NEW = ["size", "source_size", "target", "copies", "taken"]


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` (words of the text) and ``draw`` (its seeded place, 60 bits of a digest)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text))
    draw = F.conv(F.substring(F.md5(named), 1, DRAW_DIGITS), 16, 10).cast("long")
    return docs.drop("size", "draw").withColumns({"size": size, "draw": draw})


def _told_apart(rows: DataFrame, source: str, light: DataFrame) -> DataFrame | None:
    """``rows`` in which equal rows of a source have draws of their own; None if all have.

    ``light`` has ``source`` and ``draw`` of all rows. Only rows whose draw another has are
    looked at. They are numbered, in their input partitions first, and all but the first take
    a draw from the digest of theirs and their number. So a source of equal rows is cut at
    any one of them, however many there are.
    """
    key = lambda name: F.xxhash64(F.col(name), F.col("draw"))
    shared = light.groupBy(key("source").alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = materialise(shared.select("key"), "mixing-equal")
    if shared.isEmpty():
        return None
    keyed = rows.withColumn("__key", key(source))
    alike = keyed.join(shared, F.col("__key") == F.col("key"), "left_semi")
    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    numbered = _numbered(alike.select(F.col("__key").alias("draw"), columns.alias("row"))).select("number", "row.*")
    named = F.concat_ws("|", F.lit("copy"), F.col("draw").cast("string"), F.col("number").cast("string"))
    other = F.conv(F.substring(F.md5(named), 1, DRAW_DIGITS), 16, 10).cast("long")
    apart = numbered.withColumn("draw", F.when(F.col("number") == 0, F.col("draw")).otherwise(other))
    single = keyed.join(shared, F.col("__key") == F.col("key"), "left_anti")
    return single.select(*rows.columns).unionByName(apart.select(*rows.columns))


def water_filling(totals: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """Targets per source, from ``source`` and ``source_size``: adds ``target``.

    Sources by code point, null last, take the weights in turn and share ``share`` of all
    sizes by weight. No target passes ``epochs`` times its source's size; what is cut off
    goes to the others by weight until none is above. Cutting in order of size per weight
    reaches that state in one pass: the level is that of the first source under its cap.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights))
    weighed = totals.withColumn("turn", turn).withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1),
    )
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    levels = capped.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onwards),
    )
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    level = F.max(free).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), level * F.col("weight"))
    )
    return levels.withColumn("target", target).select("source", "source_size", "target")


def mixing_plan(rows: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """How to sample each source, from ``source, size, draw`` of all documents.

    A row per source: ``source, source_size, target, whole, last_draw``. Every document is
    taken ``whole`` times, and once more if its draw is at most ``last_draw``. Sizes are
    summed per source and cell of draws before they are shuffled; only the one cell per
    source in which the fraction ends is looked at document by document.
    """
    cells = materialise(
        rows.groupBy("source", F.shiftright("draw", _SHIFT).alias("cell")).agg(F.sum("size").alias("words")),
        "mixing-cells",
    )
    totals = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = materialise(water_filling(totals, weights, share, epochs), "mixing-targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    fractions = targets.withColumn("whole", F.floor(rate).cast("int")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("words").over(earlier), F.lit(0).cast("long"))
    edges = (
        cells.withColumn("ahead", ahead)
        .alias("c")
        .join(fractions.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")))
        .where("c.ahead + c.words > f.rest")
        .groupBy("f.source")
        .agg(F.min(F.struct("c.cell", "c.ahead", "f.rest")).alias("edge"))
    )
    inside = (
        rows.withColumn("cell", F.shiftright("draw", _SHIFT))
        .alias("r")
        .join(
            edges.alias("e"),
            F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.cell") == F.col("e.edge.cell")),
        )
        .select("e.source", "r.draw", "r.size", "e.edge")
    )
    running = Window.partitionBy("source").orderBy("draw")
    end = F.sum("size").over(running)  # rows of one draw go together
    own = F.sum("size").over(Window.partitionBy("source", "draw"))
    reached = (
        inside.withColumn("end", end)
        .withColumn("own", own)
        .where("edge.ahead + end - own / 2 <= edge.rest")
        .groupBy("source")
        .agg(F.max("draw").alias("reached"))
    )
    return (
        fractions.alias("f")
        .join(edges.alias("e"), F.col("f.source").eqNullSafe(F.col("e.source")), "left")
        .join(reached.alias("r"), F.col("f.source").eqNullSafe(F.col("r.source")), "left")
        .select(
            "f.source",
            "f.source_size",
            "f.target",
            "f.whole",
            F.when(F.col("e.edge").isNull(), F.lit(-1))
            .otherwise(F.coalesce("r.reached", F.shiftleft(F.col("e.edge.cell"), _SHIFT) - 1))
            .cast("long")
            .alias("last_draw"),
        )
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    ``size`` counts words (null text: 0), ``target`` is the source's, ``copies`` how often
    the mix takes the document whole, ``taken`` the words of these copies. A source's taken
    words miss its target by at most half of one document, also where rows are equal in id
    and text. Texts of any length count whole; an empty table gives an empty table. A null source is a source. Sources without words get the target 0. The same
    rows and seed give the same mix, however they are partitioned. ``keep`` names the
    columns to carry (default: all); columns of the new names are replaced.
    """
    rows = measured(docs, text, doc_id, seed)
    carried = [
        c
        for c in docs.columns
        if c.lower() not in (*_NEW, "draw") and (keep is None or c in keep)
    ]
    if keep is not None and text not in keep:  # without the texts, all of it is light
        rows = materialise(rows.select(*{*carried, source}, "size", "draw"), "mixing-rows")
        light = rows.select(F.col(source).alias("source"), "size", "draw")
    else:
        light = materialise(rows.select(F.col(source).alias("source"), "size", "draw"), "mixing-rows")
    apart = _told_apart(rows, source, light)
    if apart is not None:
        rows = materialise(apart, "mixing-apart")
        light = rows.select(F.col(source).alias("source"), "size", "draw")
    plan = materialise(mixing_plan(light, weights, share, epochs), "mixing-plan").select(
        F.col("source").alias("__source"), "source_size", "target", "whole", "last_draw"
    )
    copies = F.col("whole") + F.when(F.col("draw") <= F.col("last_draw"), 1).otherwise(0)
    return (
        rows.join(plan, F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("copies", copies.cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select(*carried, *_NEW)
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row of ``columns`` for each copy that the mix takes."""
    return (
        mixed.where("copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*columns)
    )

