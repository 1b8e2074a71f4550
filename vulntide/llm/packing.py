"""Sequences of bounded length, packed by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bpe import WORDS, word_encoder
from .neardup import _groups
from .workers import bounded_batches

CAPACITY = 2048
END_ID = 0
BUCKET_PIECES = 32_768
# Tasks that the buckets are dealt to at most; a task packs one bucket after the other.
MOST_TASKS = 10_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, ids binary"
_NEVER = np.iinfo(np.int64).max


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order.

    ``open_bins[g]`` counts the open bins with room for ``g`` more. A piece goes where the
    sum of the squared counts becomes smallest: into a bin of some gap, or into a new one;
    an old bin before a new one and a small gap before a large one where the sums are equal.
    Once there are as many bins as the total length needs at least, a new one is opened
    only for a piece that fits nowhere. ``capacity`` steps a piece, in one vector.
    """
    open_bins = np.zeros(capacity + 1, np.int64)  # gaps 0 and ``capacity`` are never open
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    needed, used = math.ceil(int(lengths.sum()) / capacity), 0
    for k, size in enumerate(lengths.tolist()):
        # The sum's change: one bin leaves gap g, and one more is at gap g - size.
        now, then = open_bins[size:capacity], open_bins[: capacity - size]
        change = np.where(now > 0, 2 * (then - now) + 2, _NEVER)
        if len(change) and now[0]:
            change[0] = 1 - 2 * now[0]  # a bin that is full is not open
        best = int(change.argmin()) if len(change) else 0
        fits = len(change) > 0 and change[best] < _NEVER
        fresh = 2 * open_bins[capacity - size] + 1 if size < capacity else 0
        if fits and (used >= needed or change[best] <= fresh):
            gap = size + best
            bins[k] = waiting[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, bins[k], used = capacity, used, used + 1
        offsets[k] = capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            waiting[gap - size].append(int(bins[k]))
    return bins, offsets


def cut_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, number, ids``: the documents' ids in pieces.

    A document's ids are its text's and ``end_id``. Those of up to ``capacity`` ids are one
    piece; longer ones are cut every ``capacity`` ids. ``number`` names the piece in the
    table. ``ids`` holds little-endian unsigned 32-bit integers, or null unless kept.
    """
    bounded_batches(docs.sparkSession)
    path = path or public_tokenizers.path(WORDS)
    names = [field.split()[0] for field in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found, bounds = word_encoder(path).encode(batch.column(1))
            lengths = np.diff(bounds) + 1
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(lengths[row] - start, capacity)
            ids = np.insert(found, bounds[1:], end_id).astype("<u4")
            first = (bounds[:-1] + np.arange(len(lengths)))[row] + start
            parts = [ids[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())]
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(part) for part in parts], pa.int64()),
                pa.array(number + np.arange(len(row)), pa.int64()),
                pa.array(parts if keep_ids else [None] * len(parts), pa.binary()),
            ]
            number += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, _PIECES)


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    bucket_pieces: int = BUCKET_PIECES,
) -> DataFrame:
    """All pieces of all documents with their place: adds ``sequence_id`` and ``offset``.

    A null or empty text is ``end_id`` alone; rows without an id, and repeated rows, are
    documents like others. Texts of any length are cut and never shortened. An empty table
    gives an empty table. Only the two named columns are read. ``ids`` is null unless
    ``keep_ids``; :func:`packed_sequences` then gives the sequences themselves.

    Pieces are stored once (narrow rows: the texts are encoded once and never shuffled). Full
    pieces are sequences of their own. The others are dealt by a hash of their number to
    buckets of about ``bucket_pieces``, so neither equal documents nor equal lengths meet in
    one bucket more than by chance, and every bucket holds a fair sample of the lengths. A
    bucket is packed on its own, longest pieces first, by :func:`sum_of_squares`; sequence ids
    carry the bucket.
    """
    pieces = materialise(cut_pieces(docs, doc_id, text, path, capacity, end_id, keep_ids), "pieces")
    full = F.col("length") == capacity
    buckets = max(1, math.ceil(pieces.where(~full).count() / bucket_pieces))
    alone = pieces.where(full).select(
        *pieces.columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    bucket = F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int")
    dealt = pieces.where(~full).select(bucket.alias("bucket"), "length", "number")
    ordered = dealt.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", F.desc("length"), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            at, offset = sum_of_squares(group.column(1).to_numpy(), capacity)
            base = group.column(0)[0].as_py() << 32
            yield pa.RecordBatch.from_arrays(
                [group.column(2).combine_chunks(), pa.array(base + at), pa.array(offset)],
                names=["number", "sequence_id", "offset"],
            )

    placed = ordered.mapInArrow(run, "number long, sequence_id long, offset long")
    together = pieces.where(~full).join(placed, "number").select(*alone.columns)
    return together.unionByName(alone).drop("number")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, parts``: each sequence's ids, and which document's part is where.

    ``packed`` has to keep its ids. A sequence has at most as many parts as ids, so its
    group is bounded by the capacity.
    """
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    parts = F.transform("all", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"]))
    return gathered.select("sequence_id", ids.alias("ids"), parts.alias("parts"))
