"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, new_folder
from .bpe import WORDS, word_encoder
from .workers import bounded_batches

END_ID = 1
READ_DOCS = 4096

_PART = "part int, docs long, null_docs long, tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@dataclass
class TokenFiles:
    """A written set of files.

    Part ``p`` is three files: ``p.ids`` (the ids, flat, of type ``dtype``), ``p.offsets``
    (64-bit offsets of its documents in ``p.ids``, one more than documents) and ``p.docs``
    (64-bit document ids; the first ``null_docs`` documents have none). ``parts`` has a row
    per part: ``part, docs, null_docs, tokens, base``, where ``base`` is the number of ids
    in all parts before it.
    """

    folder: str
    dtype: str
    parts: DataFrame


def local_path(folder: str) -> str:
    """The path of a shared folder that every node mounts; files there can be mapped."""
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted folder, not {folder}")
    return at.path


def _write(path: str, data: np.ndarray) -> None:
    """Whole or not at all, however often a task is tried."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    data.tofile(attempt)
    os.replace(attempt, path)


def write_token_files(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    partitions: int | None = None,
) -> TokenFiles:
    """Encode every text, append ``end_id``, and write the ids in ascending ``doc_id`` order.

    A null text counts as empty, so its ids are ``end_id`` alone. Null ids come first.
    Rows of one id follow each other by the hash of their text, so a repeated id, however
    often it occurs, still spreads over parts. An empty table writes no part with rows.
    The texts are range-partitioned once; ids never cross the network. A part's three files
    replace those of an earlier attempt by a rename each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or public_tokenizers.path(WORDS)
    folder = new_folder(spark, "token-files")
    place = local_path(folder)
    os.makedirs(place, exist_ok=True)
    width = _width(path, end_id)
    keyed = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.xxhash64(docs[text]).alias("text_hash"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
    )
    order = ["doc_id", "text_hash"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ordered = ranged.sortWithinPartitions(*order).select("part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nulls, total, sizes, ids = None, 0, 0, [], []
        attempt = f"{place}/{uuid.uuid4().hex}"
        with open(attempt, "wb") as file:
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column(0)[0].as_py()
                found, bounds = word_encoder(path).encode(batch.column(2))
                ends = bounds[1:] + np.arange(1, len(bounds))
                out = np.empty(len(found) + batch.num_rows, width)
                inner = np.ones(len(out), bool)
                inner[ends - 1] = False
                out[inner] = found
                out[ends - 1] = end_id
                out.tofile(file)
                sizes.append(np.diff(ends, prepend=0))
                total += len(out)
                nulls += batch.column(1).null_count
                ids.append(batch.column(1).fill_null(0).to_numpy())
        if part is None:
            os.remove(attempt)
            return
        size = np.concatenate(sizes)
        os.replace(attempt, f"{place}/{part}.ids")
        _write(f"{place}/{part}.offsets", np.concatenate([[0], np.cumsum(size)]).astype("<u8"))
        _write(f"{place}/{part}.docs", np.concatenate(ids).astype("<i8"))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                *[pa.array([k], pa.int64()) for k in (len(size), nulls, total)],
            ],
            names=["part", "docs", "null_docs", "tokens"],
        )

    written = materialise(ordered.mapInArrow(run, _PART), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))
    return TokenFiles(folder, width, written.withColumn("base", base))


def _width(path: str, end_id: int) -> str:
    """The narrowest of the unsigned types that holds every id."""
    top = max(word_encoder(path).library.get_vocab_size(with_added_tokens=True) - 1, end_id)
    return "<u2" if top < 1 << 16 else "<u4"


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """A row per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all parts. The ids are read
    through a memory map, a bounded number of documents at a time; the checksum is over
    them as little-endian unsigned 32-bit integers.
    """
    place, width = local_path(files.folder), files.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{place}/{row['part']}"
                offsets = np.memmap(f"{at}.offsets", "<u8", "r")
                doc_ids = np.memmap(f"{at}.docs", "<i8", "r")
                ids = np.memmap(f"{at}.ids", width, "r")
                for low in range(0, row["docs"], READ_DOCS):
                    high = min(low + READ_DOCS, row["docs"])
                    bounds = offsets[low : high + 1].astype(np.int64)
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:])]
                    known = np.arange(low, high) < row["null_docs"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(doc_ids[low:high]), pa.int64(), mask=known),
                            pa.array(bounds[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(run, _ROWS)
