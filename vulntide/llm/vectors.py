"""Nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import _groups
from .workers import bounded_batches, per_process

NEIGHBOURS = 5
BLOCK_ROWS = 2048
QUERY_ROWS = 2048
SEED = 40_961

# Half-width of the bounds in standard errors of the estimate.
BOUND = 3.0

# Bits of a query's components, and queries that are estimated at a time.
QUERY_BITS = 8
QUERIES_AT_ONCE = 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite, no nulls, not zero."""
    number = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False)
    )
    return number & F.exists(vector, lambda x: x != 0)


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""

    def build() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng([seed, width]).standard_normal((width, width)))
        return q * np.sign(np.diag(r))

    return per_process(("rotation", seed, width), build)


def encoded(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """The index: each vector's code and correction scalar.

    The code holds the signs of the rotated unit vector, one bit each; ``aligned`` is the
    inner product of that unit vector with the corner of the cube that the code names.
    """
    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = np.diff(lists.offsets.to_numpy())
            codes: list[bytes] = [b""] * len(lists)
            aligned = np.zeros(len(lists))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.cumsum(widths) - widths
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                rows = _in_range(values[start[at][:, None] + np.arange(width)])
                turned = (rows / _norms(rows)[:, None]) @ rotation(int(width), seed)
                for k, bits in zip(at, np.packbits(turned > 0, axis=1)):
                    codes[k] = bits.tobytes()
                aligned[at] = np.abs(turned).sum(axis=1) / math.sqrt(width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(codes, pa.binary()), pa.array(aligned)],
                names=["vec_id", "embedding", "code", "aligned"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(
        run, f"vec_id long, embedding {kind}, code binary, aligned double"
    )


def _in_range(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which is exact, so that no product leaves the range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows**2).sum(axis=1))


def estimated_products(codes: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the corners that ``codes`` name, as signs, with rotated queries.

    From packed bits alone: a query's components become integers of ``QUERY_BITS`` bits, and
    each of their bits a plane packed like the codes, so a product is a sum of counted bits.
    The second array bounds, per query, what rounding to integers can change.
    """
    rows, width = len(codes), turned.shape[1]
    words = -(-width // 64)
    packed = np.zeros((rows, 8 * words), np.uint8)
    packed[:, : codes.shape[1]] = codes
    packed = packed.view(np.uint64)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**QUERY_BITS - 1), 1e-300)
    whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    out = np.empty((rows, len(turned)))
    for a in range(0, len(turned), QUERIES_AT_ONCE):
        part = slice(a, a + QUERIES_AT_ONCE)
        total = np.zeros((rows, len(whole[part])), np.int32)
        for bit in range(QUERY_BITS):
            plane = np.zeros((len(whole[part]), 8 * words), np.uint8)
            bits = np.packbits((whole[part] >> bit) & 1, axis=1)
            plane[:, : bits.shape[1]] = bits
            plane = plane.view(np.uint64)
            for word in range(words):
                total += np.bitwise_count(packed[:, word, None] & plane[:, word]).astype(np.int32) << bit
        out[:, part] = 2 * (total * step[part] + ones[:, None] * low[part]) - turned[part].sum(axis=1)
    return out, step * width


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = NEIGHBOURS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query by cosine.

    ``queries`` is a condition on ``vec_id``. Candidates are all rows but those of the
    query's id; a query with fewer than ``k`` of them gets them all. Rows whose id is null,
    and vectors that are null, zero, or hold nulls or non-finite numbers, take no part;
    only vectors of one width are compared. Equal scores go to the smaller id; equal rows
    count once as a query. Clashing names of other columns do not matter: only the two
    named ones are read.

    Rows are dealt to blocks by a hash, and each block of queries meets each block of rows
    in one group of bounded size. There the codes give estimates of all inner products; the
    bounds of an estimate tell which vectors can still be among the ``k`` nearest, and only
    they are scored, in double precision on the original vectors, be they floats or doubles
    of any size. A group gives its ``k``
    best per query, and the best of these are the result.
    """
    plain = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    kind = "array<float>" if plain else "array<double>"
    valid = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = valid.where(queries).distinct()
    rows, questions = valid.count(), asked.count()
    blocks = max(1, math.ceil(rows / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(questions / QUERY_ROWS))
    place = F.xxhash64("vec_id", "embedding")
    index = encoded(valid, seed).select(
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        F.size("embedding").alias("width"),
        F.lit(0).alias("side"),
        "vec_id",
        "embedding",
        "code",
        "aligned",
    )
    dealt = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"),
        F.size("embedding").alias("width"),
        F.lit(1).alias("side"),
        "vec_id",
        "embedding",
        F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("double").alias("aligned"),
    )
    names = ["block", "query_block", "width"]
    met = index.unionByName(dealt).repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            found = _search(group, k, seed)
            if found:
                yield found

    best = met.mapInArrow(run, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(group: pa.Table, k: int, seed: int) -> pa.RecordBatch | None:
    width = group.column(2)[0].as_py()
    side = group.column(3).to_numpy()
    data, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(data) or not len(asked):
        return None
    ids = group.column(4).to_numpy()
    all_rows = group.column(5).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    originals = all_rows.astype(np.float64).reshape(-1, width)
    all_rows = _in_range(originals)
    norms = _norms(all_rows)
    rows, row_ids, row_norms = all_rows[data], ids[data], norms[data]
    codes = np.frombuffer(b"".join(group.column(6).take(pa.array(data)).to_pylist()), np.uint8)
    aligned = group.column(7).to_numpy()[data]
    turned = (all_rows[asked] / norms[asked][:, None]) @ rotation(width, seed)
    products, rounding = estimated_products(codes.reshape(len(data), -1), turned)
    error = BOUND * np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned / math.sqrt(max(width - 1, 1))
    upper = (products + rounding) / (math.sqrt(width) * aligned)[:, None] + error[:, None] + 1e-5
    out: list[tuple] = []
    for q, at in enumerate(asked):
        high = np.where(row_ids == ids[at], -np.inf, upper[:, q])
        first = np.argpartition(-high, min(k, len(high) - 1))[:k]
        scores = _cosine(rows[first], row_norms[first], all_rows[at], norms[at])
        scores[np.isneginf(high[first])] = -np.inf
        floor = np.sort(scores)[0] if len(first) == k else -np.inf
        left = np.flatnonzero((high >= floor) & ~np.isneginf(high))
        scores = _cosine(rows[left], row_norms[left], all_rows[at], norms[at])
        order = np.lexsort((row_ids[left], -scores))[:k]
        key = int.from_bytes(hashlib.blake2b(originals[at].tobytes(), digest_size=8).digest(), "little", signed=True)
        out += [(ids[at], key, row_ids[left[o]], scores[o]) for o in order]
    if not out:
        return None
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "query_key", "vec_id", "score"])


def _cosine(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    # Row by row in one fixed order of additions, so equal vectors get equal scores.
    return (rows * query).sum(axis=1) / (norms * norm)
