import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vulntide.llm.bpe import WORDS
from vulntide.llm.packing import pack_documents, packed_sequences, sum_of_squares

KEY = ["doc_id", "piece", "start", "length", "ids_crc32"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def plain_rule(lengths, capacity):
    """Every option's sum of squares counted out, over all open bins."""
    fills, needed = [], math.ceil(sum(lengths) / capacity)
    out = []

    def total(levels):
        gaps = [capacity - f for f in levels if f < capacity]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for size in lengths:
        options = []
        for gap in sorted({capacity - f for f in fills if capacity - f >= size and f < capacity}):
            at = fills.index(capacity - gap)
            options.append((total(fills[:at] + [fills[at] + size] + fills[at + 1 :]), 0, gap))
        new = (total([*fills, size]), 1, capacity)
        options = options if options and len(fills) >= needed else [*options, new]
        _, fresh, gap = min(options)
        out.append((capacity - gap))
        if fresh:
            fills.append(size)
        else:
            fills[fills.index(capacity - gap)] += size
    return out, sorted(fills)


@pytest.mark.parametrize("seed", range(12))
def test_rule_equals_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(4, 30))
    lengths = rng.integers(1, capacity + 1, 60)
    if seed % 2:
        lengths = np.sort(lengths)[::-1]
    bins, offsets = sum_of_squares(lengths, capacity)
    want, fills = plain_rule(lengths.tolist(), capacity)
    assert offsets.tolist() == want
    assert sorted(np.bincount(bins, lengths).astype(int).tolist()) == fills


def pieces_of(rows, library, capacity, end=0):
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            out.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def held(rows, capacity):
    """Number of sequences of a packing, all of them gapless and within the capacity."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity,bucket", [(2048, 32_768), (64, 7), (1, 3)])
def test_odd_documents(spark, odd_docs, library, capacity, bucket):
    docs = odd_docs.withColumns({"SEQUENCE_ID": F.lit(1), "offset": F.lit("x"), "number": F.lit(2)})
    rows = pack_documents(docs, capacity=capacity, bucket_pieces=bucket).collect()
    want = pieces_of([(r.doc_id, r.text) for r in odd_docs.collect()], library, capacity)
    assert sorted((tuple(r[c] for c in KEY) for r in rows), key=repr) == want
    held(rows, capacity)


def test_few_sequences(documents, library):
    rows = pack_documents(documents).collect()
    assert sorted((tuple(r[c] for c in KEY) for r in rows), key=repr) == pieces_of(
        [(r.doc_id, r.text) for r in documents.collect()], library, 2048
    )
    least = math.ceil(sum(r.length for r in rows) / 2048)
    assert held(rows, 2048) <= least + 1


def test_buckets_lose_little(spark):
    lengths = np.random.default_rng(1).integers(1, 300, 6000).tolist()
    docs = spark.createDataFrame([(k, "a " * (n - 1)) for k, n in enumerate(lengths)], "doc_id long, text string")
    rows = pack_documents(docs.repartition(5), bucket_pieces=1000).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 6
    assert held(rows, 2048) <= math.ceil(sum(lengths) / 2048) + 2 * 6


def test_equal_documents_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000, "doc_id long, text string").repartition(4)
    rows = pack_documents(docs, bucket_pieces=500).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 3000 and len(sizes) == 6 and max(sizes.values()) < 650


def test_sequences_hold_the_ids(odd_docs, library):
    packed = pack_documents(odd_docs, capacity=100, keep_ids=True)
    texts = {}
    for r in odd_docs.where("doc_id IS NOT NULL").distinct().collect():
        texts[r.doc_id] = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
    for r in packed_sequences(packed).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == sum(p.length for p in r.parts) <= 100
        for p in r.parts:
            if p.doc_id is not None:
                start = p.piece * 100
                assert ids[p.offset : p.offset + p.length] == texts[p.doc_id][start : start + p.length]


def test_no_documents(no_docs):
    assert pack_documents(no_docs).collect() == []
    assert packed_sequences(pack_documents(no_docs, keep_ids=True)).collect() == []
