"""Helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

BATCH_ROWS = 8192
BATCH_BYTES = 4 << 20

# Bytes that are hashed at once, and the entries of a table of powers that a worker keeps.
HASH_BLOCK = 1 << 18
POWERS_KEPT = 1 << 19

# ASCII white space; every other byte of UTF-8 belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a task holds few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_process(key: tuple, build: Callable[[], object]) -> object:
    """``build()`` once per Python worker; later tasks of the worker reuse the object."""
    store = sys.modules.setdefault("vulntide_worker_store", types.ModuleType("vulntide_worker_store"))
    objects = store.__dict__.setdefault("objects", {})
    if key not in objects:
        objects[key] = build()
    return objects[key]


def append_columns(
    df: DataFrame,
    column: str,
    fields: list[StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """``df``'s columns and ``fields``, computed batch by batch from ``column``.

    ``keep`` names the columns to carry along (default: all). A carried column whose name
    clashes with a new one, in any case, gives way to it.
    """
    bounded_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    wanted = None if keep is None else {name.lower() for name in keep}
    kept = [
        f
        for f in df.schema.fields
        if f.name.lower() not in taken and (wanted is None or f.name.lower() in wanted)
    ]
    names = [f.name for f in kept]
    schema = StructType(kept + fields)
    labels = [f.name for f in schema.fields]
    source = df.select(df[column].alias("__input"), *[df[name] for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            made = compute(batch.column(0))
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + made, names=labels)

    return source.mapInArrow(run, schema)


class FlatText:
    """A batch of texts as one array of UTF-8 bytes, with the words' and documents' bounds.

    Null texts are empty. ``first`` and ``last`` hold the first and the one-past-last byte
    of each word, ``doc_first`` the number of words before each document (one more entry
    than documents).
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.bytes = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
        self.offsets = (offsets - low) if len(offsets) else np.zeros(1, np.int64)
        b = self.bytes
        self.space = (b == 32) | ((b >= 9) & (b <= 13))
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~self.space
        start = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        inner = self.offsets[:-1]
        inner = inner[inner < len(b)]
        start[inner] |= inside[1:-1][inner]  # a document starts a word of its own
        before = inner[inner > 0] - 1
        end[before] |= inside[1:-1][before]
        self.first = np.flatnonzero(start)
        self.last = np.flatnonzero(end) + 1
        self.doc_first = np.searchsorted(self.first, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of set bytes of ``mask`` in each document."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.doc_first))

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.span_hashes(self.first, self.last)

    def span_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each of the given runs of bytes, which ascend and hold a byte.

        The runs that start in one block are hashed together, so that the arrays of 64-bit
        numbers are of a block's size and not of the batch's, but for a longer run.
        """
        raw = np.zeros(len(first), np.uint64)
        cuts = np.searchsorted(first, np.arange(0, len(self.bytes) + HASH_BLOCK, HASH_BLOCK))
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            low, high = int(first[a]), int(last[a:z].max())
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.bytes[low:high].astype(np.uint64) + np.uint64(1)) * _powers(high - low), out=sums[1:])
            starts = first[a:z] - low
            raw[a:z] = (sums[last[a:z] - low] - sums[starts]) * _inverse_powers(high - low)[starts]
        return mix(raw + mix((last - first).astype(np.uint64)))

    def window_hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``width`` words in a document, and the run's first word."""
        words = self.word_hashes()
        total = max(len(words) - width + 1, 0)
        out = np.zeros(total, np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + total] + np.uint64(k))
        ends = np.repeat(self.doc_first[1:], np.diff(self.doc_first))
        at = np.flatnonzero(np.arange(total) + width <= ends[:total])
        return out[at], at


_RADIX = 0xD1342543DE82EF95
_INVERSE = pow(_RADIX, -1, 1 << 64)


def _table(name: str, radix: int, n: int) -> np.ndarray:
    def build(size: int) -> np.ndarray:
        steps = np.full(size, radix & (2**64 - 1), np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    if n > POWERS_KEPT:  # for a run longer than a block, and not kept
        return build(n)
    return per_process(("powers", name), lambda: build(POWERS_KEPT))[:n]


def _powers(n: int) -> np.ndarray:
    return _table("radix", _RADIX, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table("inverse", _INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
