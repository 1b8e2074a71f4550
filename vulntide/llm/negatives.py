"""Hard negatives by exact integer products of tiles, Strassen's way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .workers import bounded_batches

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80

# Rows of a lane before it grows, the most lanes, and bytes of an anchor block's vectors.
LANE_ROWS = 8192
MOST_LANES = 1024
BLOCK_BYTES = 8 << 20

# Anchors of one tile, entries of a tile's scores, and the side at which a product is direct.
TILE_ANCHORS = 128
TILE_SCORES = 1 << 20
LEAF = 32

# Squared integer length up to which every score, and four times it, fits a long.
MOST_SQUARED = float(1 << 60)

_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact where its entries fit 64 bits.

    Both are padded with zeros until each side halves down to a leaf. Sums that leave 64
    bits on the way wrap around, which the final additions undo.
    """
    sides = a.shape[0], a.shape[1], b.shape[1]
    levels = max(0, int(math.log2(max(1, min(sides)) / LEAF)))
    step = 1 << levels
    m, k, n = (-(-side // step) * step for side in sides)
    padded = [np.zeros(shape, np.int64) for shape in ((m, k), (k, n))]
    padded[0][: sides[0], : sides[1]] = a
    padded[1][: sides[1], : sides[2]] = b
    return _halved(*padded, levels)[: sides[0], : sides[2]]


def _halved(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return _direct(a, b)
    (m, k), n = a.shape, b.shape[1]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = _halved(a11 + a22, b11 + b22, levels - 1)
    p2 = _halved(a21 + a22, b11, levels - 1)
    p3 = _halved(a11, b12 - b22, levels - 1)
    p4 = _halved(a22, b21 - b11, levels - 1)
    p5 = _halved(a11 + a12, b22, levels - 1)
    p6 = _halved(a21 - a11, b11 + b12, levels - 1)
    p7 = _halved(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((m, n), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    term = np.empty_like(out)
    for k in range(a.shape[1]):
        np.multiply(a[:, k, None], b[k], out=term)
        out += term
    return out


class Heaps:
    """The best ``size`` entries of each of many lists, by score and then by smaller id."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.score = np.full((lists, size), _LEAST)
        self.ids = np.zeros((lists, size), np.int64)
        self.copies = np.zeros((lists, size), np.int64)

    def floor(self) -> np.ndarray:
        """Score an entry needs at least to enter each list; lists with room take any."""
        return self.score[:, -1]

    def merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        """Add entries; ``at`` names the list of each."""
        lists = np.unique(at)
        held = self.copies[lists] > 0
        where = np.nonzero(held)
        at = np.concatenate([lists[where[0]], at])
        score = np.concatenate([self.score[lists][held], score])
        ids = np.concatenate([self.ids[lists][held], ids])
        copies = np.concatenate([self.copies[lists][held], copies])
        order = np.lexsort((ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = (x[place < self.size] for x in (order, at, place))
        self.score[at, place], self.ids[at, place] = score[order], ids[order]
        self.copies[at, place] = copies[order]

    def entries(self) -> tuple[np.ndarray, ...]:
        at, place = np.nonzero(self.copies > 0)
        return at, self.score[at, place], self.ids[at, place], self.copies[at, place]


def integer_rows(
    vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int = SCALE
) -> DataFrame:
    """``vec_id, label, vector, copies, place``: the rows that take part, equal ones once.

    ``vector`` holds ``floor(scale * x)`` as 64-bit integers. ``place`` is a hash of label
    and vector, which with ``vec_id`` names the row.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double")).alias("scaled"),
    )
    finite = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    squared = F.aggregate("scaled", F.lit(0.0), lambda total, x: total + F.floor(x) * F.floor(x).cast("double"))
    small = F.forall("scaled", lambda x: F.abs(x) < F.lit(2.0**31))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    kept = known.where(F.coalesce(finite, F.lit(False))).where(small).where(squared <= MOST_SQUARED)
    whole = kept.select("vec_id", "label", F.transform("scaled", lambda x: F.floor(x)).alias("vector"))
    once = whole.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    return once.withColumn("place", F.xxhash64("label", "vector"))


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``. A component x counts as ``floor(scale * x)``,
    and a row's score is its exact integer inner product with the anchor; higher scores come
    first, ties by smaller id. An anchor's positives are its first ``positives`` other rows
    of its label. For each, the first ``negatives`` rows of another label are returned whose
    score is at most the positive's and at least ``low_percent`` of it in hundredths.

    Rows without id or label, vectors that are null or hold nulls or non-finite numbers take
    no part. Nor do vectors beyond what a 64-bit score can hold: components of 2**31 or a
    squared length of 2**60 after scaling. Only vectors of one width meet; empty ones score
    0. Another row with the anchor's id is another row. Equal rows are one row with a number
    while the work is done, and as many in the result: as anchors, positives and negatives.
    An anchor without positives, a positive without negatives, and an empty table give no
    rows. Only the named columns are read, so names of others do not matter.

    The integer rows are stored once, in lanes: ranges of width, label and hash, so a label
    of any size spreads over lanes and a lane knows which labels it holds. Anchors are dealt
    to blocks of bounded bytes. A task takes one block and streams one lane past it, tile by
    tile; a block's heaps are all that stays. The first pass sends a block's anchors to the
    lanes of their own label and finds the positives, the second to all others and finds the
    windows below each positive score. Heaps of the lanes merge by rank.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = materialise(integer_rows(vectors, vec_id, embedding, label, scale), "negatives-rows")
    total = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("width"), F.count_if(anchors).alias("asked")
    ).first()
    order = [F.size("vector"), "label", "place", "vec_id"]
    lanes = max(1, min(math.ceil(total["rows"] / LANE_ROWS), MOST_LANES))
    ranged = rows.repartitionByRange(lanes, *order).withColumn("lane", F.spark_partition_id())
    index = materialise(ranged, "negatives-lanes")
    # One row per lane: at most MOST_LANES, or the least number of ranges the session asks for.
    kind = F.struct(F.size("vector").alias("width"), "label")
    spans = index.groupBy("lane").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).collect()
    block_rows = max(1, BLOCK_BYTES // (8 * max(1, total["width"] or 1)))
    blocks = max(1, math.ceil(total["asked"] / block_rows))

    asked = index.where(anchors).select(
        F.pmod("place", F.lit(blocks)).cast("int").alias("block"),
        F.size("vector").alias("width"),
        "vec_id", "label", "vector", "copies", "place",
    )
    own = _meet(index, asked, spans, blocks, True, positives, low_percent)
    first = _ranked(own, ["anchor_id", "anchor_place"], positives)
    first = first.select(
        "anchor_id", "anchor_place", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    chosen = materialise(first, "negatives-positives")
    scores = chosen.groupBy("anchor_id", "anchor_place").agg(F.collect_set("positive_score").alias("scores"))
    scores = scores.withColumnsRenamed({"anchor_id": "vec_id", "anchor_place": "place"})
    windows = _meet(index, asked.join(scores, ["vec_id", "place"]), spans, blocks, False, negatives, low_percent)
    key = ["anchor_id", "anchor_place", "positive_score"]
    below = _ranked(windows, key, negatives).select(
        *key, "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"), "anchor_copies"
    )
    each = chosen.join(below, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("anchor_copies"))))
    return each.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _ranked(entries: DataFrame, key: list[str], most: int) -> DataFrame:
    """The first ``most`` of each list over all lanes, equal rows one by one, with ``rank``."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "row_id")
    best = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    single = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(most)))))
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _meet(
    index: DataFrame, asked: DataFrame, spans: list, blocks: int, same_label: bool, most: int, low_percent: int
) -> DataFrame:
    """Heap entries of each anchor block and lane: positives, or windows below ``scores``."""
    kind = F.struct("width", "label")
    lanes = F.array(
        *[
            F.struct(
                F.lit(s["lane"]).alias("lane"),
                *[
                    F.struct(F.lit(s[end]["width"]).alias("width"), F.lit(s[end]["label"]).cast("long").alias("label")).alias(end)
                    for end in ("low", "high")
                ],
            )
            for s in spans
        ]
    )
    if same_label:
        wanted = F.filter(lanes, lambda s: (s["low"] <= kind) & (kind <= s["high"]))
    else:
        wanted = F.filter(
            lanes,
            lambda s: (s["low"]["width"] <= F.col("width"))
            & (F.col("width") <= s["high"]["width"])
            & ~((s["low"] == kind) & (s["high"] == kind)),
        )
    if not spans:
        wanted = F.array().cast("array<struct<lane:int>>")
    shared = ["vec_id", "label", "vector", "copies", "place"]
    none = F.lit(None).cast("array<bigint>")
    sent = asked.withColumn("lane", F.explode(F.transform(wanted, lambda s: s["lane"]))).select(
        "lane", "block", "width", F.lit(0).alias("side"), *shared, "scores" if not same_label else none.alias("scores")
    )
    streamed = index.select(
        "lane",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.size("vector").alias("width"),
        F.lit(1).alias("side"),
        *shared,
        none.alias("scores"),
    )
    key = ["lane", "block", "width"]
    met = sent.unionByName(streamed).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
                name, side = tuple(values[:3, a]), values[3, a]
                if name != now:
                    yield from _given(held)
                    held, now = None, name
                rows = batch.slice(a, z - a)
                if side == 0:
                    held = held or _Block(same_label, most, low_percent)
                    held.add(rows)
                elif held:
                    held.stream(rows)
        yield from _given(held)

    return met.mapInArrow(run, _ENTRIES)


_ENTRIES = (
    "anchor_id long, anchor_place long, anchor_copies long, positive_score long, "
    "row_id long, score long, copies long"
)
_ENTRY_NAMES = [part.split()[0] for part in _ENTRIES.split(",")]


def _given(held: _Block | None) -> Iterator[pa.RecordBatch]:
    if held:
        yield held.entries()


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(6).flatten().to_numpy().reshape(rows.num_rows, rows.column(2)[0].as_py())


class _Block:
    """The anchors of a block, and their heaps over the rows streamed past so far."""

    def __init__(self, same_label: bool, most: int, low_percent: int):
        self.same_label, self.most, self.low_percent = same_label, most, low_percent
        self.parts: list[pa.RecordBatch] = []
        self.heaps: Heaps | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def _ready(self) -> None:
        column = lambda k: np.concatenate([p.column(k).to_numpy() for p in self.parts])
        self.ids, self.labels, self.copies, self.places = column(4), column(5), column(7), column(8)
        self.vectors = np.concatenate([_matrix(p) for p in self.parts])
        # A list for each anchor, or for each anchor and score of a positive.
        if self.same_label:
            self.top, self.list_anchor = None, np.arange(len(self.ids))
        else:
            lists = [p.column(9) for p in self.parts]
            self.top = np.concatenate([x.flatten().to_numpy() for x in lists])
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
            self.list_anchor = np.repeat(np.arange(len(self.ids)), sizes)
            # Least score of a window: the hundredths of its top, rounded up; none below zero.
            high, rest = np.divmod(self.top, 100)
            self.low = high * self.low_percent - (-rest * self.low_percent // 100)
        self.heaps = Heaps(len(self.list_anchor), self.most)

    def stream(self, rows: pa.RecordBatch) -> None:
        if self.heaps is None:
            self._ready()
        ids, labels, copies, places = (rows.column(k).to_numpy() for k in (4, 5, 7, 8))
        vectors = _matrix(rows).T
        for a in range(0, len(self.ids), TILE_ANCHORS):
            z = min(a + TILE_ANCHORS, len(self.ids))
            step = max(1, TILE_SCORES // (z - a))
            for b in range(0, len(ids), step):
                part = slice(b, b + step)
                scores = strassen(self.vectors[a:z], vectors[:, part])
                alike = self.labels[a:z, None] == labels[part]
                if self.same_label:
                    itself = (self.ids[a:z, None] == ids[part]) & (self.places[a:z, None] == places[part])
                    self._positives(a, scores, alike, itself, ids[part], copies[part])
                else:
                    self._windows(a, z, scores, ~alike, ids[part], copies[part])

    def _positives(self, a, scores, alike, itself, ids, copies) -> None:
        m, n = scores.shape
        floor = self.heaps.floor()[a : a + m]
        if n > self.most:
            # Of this tile alone, too, only the first few can enter; ties at the edge stay.
            seen = np.where(alike & ~itself, scores, _LEAST)
            floor = np.maximum(floor, np.partition(seen, n - self.most, axis=1)[:, n - self.most])
        at, col = np.nonzero(alike & (scores >= floor[:, None]))
        left = copies[col] - itself[at, col]
        at, col, left = at[left > 0], col[left > 0], left[left > 0]
        if len(at):
            self.heaps.merge(a + at, scores[at, col], ids[col], left)

    def _windows(self, a, z, scores, other, ids, copies) -> None:
        # Lists of the tile's anchors, one place of the list after the other.
        first, last = np.searchsorted(self.list_anchor, [a, z])
        lists = np.arange(first, last)
        place = lists - np.searchsorted(self.list_anchor, self.list_anchor[lists])
        for k in range(int(place.max(initial=-1)) + 1):
            now = lists[place == k]
            mine = scores[self.list_anchor[now] - a]
            inside = other[self.list_anchor[now] - a] & (mine <= self.top[now, None]) & (mine >= self.low[now, None])
            floor = self.heaps.floor()[now]
            if mine.shape[1] > self.most:
                seen = np.where(inside, mine, _LEAST)
                edge = mine.shape[1] - self.most
                floor = np.maximum(floor, np.partition(seen, edge, axis=1)[:, edge])
            at, col = np.nonzero(inside & (mine >= floor[:, None]))
            if len(at):
                self.heaps.merge(now[at], mine[at, col], ids[col], copies[col])

    def entries(self) -> pa.RecordBatch:
        if self.heaps is None:
            at = score = ids = copies = np.zeros(0, np.int64)
            anchor, top = at, at
            keys = [np.zeros(0, np.int64)] * 3
        else:
            at, score, ids, copies = self.heaps.entries()
            anchor = self.list_anchor[at]
            top = score if self.top is None else self.top[at]
            keys = [self.ids[anchor], self.places[anchor], self.copies[anchor]]
        columns = [pa.array(c, pa.int64()) for c in (*keys, top, ids, score, copies)]
        return pa.RecordBatch.from_arrays(columns, names=_ENTRY_NAMES)
