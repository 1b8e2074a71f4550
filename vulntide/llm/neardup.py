"""Near-duplicate documents by ProbMinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .graphs import components
from .workers import FlatText, bounded_batches, mix

SHINGLE = 5
LEAST_SIMILARITY = 0.8

# 160 components. At similarity 0.8 a band agrees with probability 0.33, and two documents
# agree in no band with probability 3e-6.
ROWS = 5
BANDS = 32
COMPONENTS = ROWS * BANDS

# Agreeing components from which a pair is verified: 4.5 standard deviations below 0.8.
LEAST_AGREEING = 105

# Members of a band's bucket that one comparison takes from either side.
BLOCK = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xA0761D6478BD642F)


def weighted_shingles(flat: FlatText) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and number of occurrences of each distinct shingle, by document and hash.

    A shingle is ``SHINGLE`` consecutive words; a document of fewer words has the one shingle
    of all its words, a document without words none.
    """
    hashes, at = flat.window_hashes(SHINGLE)
    docs = flat.word_doc()[at]
    counts = np.diff(flat.doc_first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        words, whole = flat.word_hashes(), []
        for doc in short:
            value = np.full(1, counts[doc], np.uint64)
            for word in words[flat.doc_first[doc] : flat.doc_first[doc + 1]]:
                value = mix(value * _STEP + word)
            whole.append(value)
        hashes, docs = np.concatenate([hashes, *whole]), np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(new)
    return docs[first], hashes[first], np.diff(np.append(first, len(hashes)))


def signatures(docs: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures, a row of ``COMPONENTS`` shingles per document.

    Each shingle is a Poisson process whose rate is its weight; each arrival falls to a
    random component, and a component keeps the shingle that arrives first. All documents
    of the batch advance together, one arrival per shingle and round; a shingle stops when
    its time has passed the latest first arrival of its document. Two documents agree in a
    component with their probability Jaccard similarity. A row without shingles is zero.
    """
    times = np.full(n * COMPONENTS, np.inf)
    kept = np.zeros(n * COMPONENTS, np.uint64)
    latest = np.full(n, np.inf)
    now = np.zeros(len(shingles))
    arrival = 0
    while len(shingles):
        drawn = mix(shingles + np.uint64((int(_STEP) * (arrival + 1)) & (2**64 - 1)))
        now = now - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights
        early = now < latest[docs]
        if not early.all():
            docs, shingles, weights, now, drawn = (a[early] for a in (docs, shingles, weights, now, drawn))
        slot = docs * COMPONENTS + (mix(drawn ^ _SPREAD) % np.uint64(COMPONENTS)).astype(np.int64)
        np.minimum.at(times, slot, now)
        won = times[slot] == now
        kept[slot[won]] = shingles[won]
        if arrival < 4 or arrival % 8 == 0:
            open_docs = np.unique(docs)
            latest[open_docs] = times.reshape(n, COMPONENTS)[open_docs].max(axis=1)
        arrival += 1
    return kept.reshape(n, COMPONENTS)


def short_signatures(signature: np.ndarray) -> np.ndarray:
    """Sixteen bits of each component."""
    return (mix(signature) >> np.uint64(48)).astype(np.uint16)


def band_hashes(short: np.ndarray) -> np.ndarray:
    """A hash per band of ``ROWS`` components; it tells the bands apart too."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(short), 1))
    for row in range(ROWS):
        out = mix(out * _STEP + short[:, row::ROWS].astype(np.uint64))
    return out


def probability_jaccard(
    left: np.ndarray, left_counts: np.ndarray, right: np.ndarray, right_counts: np.ndarray
) -> float:
    """Probability Jaccard similarity of two weighted sets of sorted hashes.

    The sum over common elements ``d`` of ``1 / sum over e of max(a_e / a_d, b_e / b_d)``.
    The inner sum splits where ``a_e / b_e`` passes ``a_d / b_d``, so sorted ratios and
    running totals give all of them.
    """
    _, in_left, in_right = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    if not len(in_left):
        return 0.0
    a, b = left_counts[in_left].astype(float), right_counts[in_right].astype(float)
    only_left = left_counts.sum() - a.sum()
    only_right = right_counts.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    # For e above d in ratio, a_e / a_d is the larger; below, b_e / b_d.
    below = np.concatenate([[0.0], np.cumsum(b)])
    above = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])
    cut = np.searchsorted(ratio, ratio, side="right")
    return float((1.0 / ((only_left + above[cut]) / a + (only_right + below[cut]) / b)).sum())


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, signature`` of every document.

    ``key`` is the text's MD5, equal for equal texts; a null text is empty. ``signature``
    holds sixteen bits per component, and is null for a text without words.
    """
    bounded_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = FlatText(batch.column(2))
            short = short_signatures(signatures(*weighted_shingles(flat), len(flat)))
            spoken = np.diff(flat.doc_first) > 0
            packed = [row.tobytes() if known else None for row, known in zip(short, spoken)]
            columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "signature"])

    return rows.mapInArrow(run, "doc_id long, key binary, signature binary")


def banded(texts: DataFrame) -> DataFrame:
    """``key, bucket`` for each band of each distinct text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = _unpack(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(short)), BANDS))),
                    pa.array(band_hashes(short).astype(np.int64).ravel()),
                ],
                names=["key", "bucket"],
            )

    rows = texts.where("signature is not null").select("key", "signature")
    return rows.mapInArrow(run, "key binary, bucket long")


def _unpack(signature: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signature.to_pylist()), np.uint16).reshape(-1, COMPONENTS)


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts ``text_a, text_b`` are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (Profiles(batch.column(k)) for k in (2, 3))
            found = [
                k
                for k in range(batch.num_rows)
                if probability_jaccard(*left[k], *right[k]) >= LEAST_SIMILARITY
            ]
            kept = batch.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


class Profiles:
    """The weighted shingles of each text of a batch."""

    def __init__(self, texts: pa.Array):
        flat = FlatText(texts)
        docs, self.hashes, self.counts = weighted_shingles(flat)
        self.bounds = np.searchsorted(docs, np.arange(len(flat) + 1))

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.bounds[k], self.bounds[k + 1])
        return self.hashes[own], self.counts[own]


def settled_by_blocks(members: DataFrame) -> DataFrame:
    """Links between members of one bucket that are not of one component yet.

    ``members`` has ``bucket, low, high, block, key, label, signature, text``: the rows of
    one ``bucket, low, high`` are the members of blocks ``low`` and ``high`` of a bucket.
    Every pair of different labels over the two blocks (within one, if they are the same)
    that agrees in enough components is verified, in the first band that it shares, unless
    links found before already join it. Only the links come out, fewer than rows came in.
    """
    names = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            links = _links(group)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(side, pa.binary()) for side in zip(*links)], names=["a", "b"]
                )

    columns = [*names, "block", "key", "label", "signature", "text"]
    together = members.select(*columns).repartition(*names).sortWithinPartitions(*names)
    return together.mapInArrow(run, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``width`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(width)])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            name = tuple(values[:, a])
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _links(group: pa.Table) -> list[tuple[bytes, bytes]]:
    bucket, low, high = (group.column(k)[0].as_py() for k in range(3))
    block, keys, labels = (group.column(k).to_pylist() for k in (3, 4, 5))
    names, label = np.unique(np.array(labels, object), return_inverse=True)
    if len(names) < 2:
        return []
    block = np.array(block)
    rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
    short = _unpack(group.column(6).combine_chunks())
    bands = band_hashes(short)
    band = int(np.flatnonzero(bands[0] == np.int64(bucket).astype(np.uint64))[0])
    profiles = None
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in rows:
        others = columns[(label[columns] != label[i]) & ((columns > i) if low == high else True)]
        if not len(others):
            continue
        agreeing = (short[others] == short[i]).sum(axis=1)
        others = others[agreeing >= LEAST_AGREEING]
        if band and len(others):
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
        for j in others:
            x, y = root(label[i]), root(label[j])
            if x == y:
                continue
            profiles = profiles or Profiles(group.column(7).combine_chunks())
            if probability_jaccard(*profiles[i], *profiles[j]) >= LEAST_SIMILARITY:
                parent[x] = y
                links.append((keys[i], keys[j]))
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, class_id, class_size, is_first``: one row per document.

    Equal texts are one node (``key``, the text's MD5). Two texts are linked if the
    probability Jaccard similarity of their 5-word shingles, weighted by their number, is
    0.8 or more; classes are the connected components. ``class_id`` is the least id of the
    class, ``is_first`` marks the rows with that id and the least key that has it.

    A null text is empty; texts without words are only ever copies of each other. A text of
    fewer than five words has the one shingle of all its words. Null ids come after others:
    a class of null ids only has a null id, and its rows of the least key are its first.
    Repeated rows are members like others. An empty table gives an empty table.

    Candidates are pairs that share a band. Each bucket's members are first compared with
    its least key alone; copies of a hot group so cost one comparison each. Pairs of a
    bucket that this leaves in different components are compared in blocks, within tasks;
    no row per pair is made. Every link that bands show is found or implied.
    """
    rows = materialise(signed(docs, doc_id, text), "signatures")
    texts = rows.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")
    )
    texts = materialise(texts, "distinct-texts")
    bands = materialise(banded(texts), "bands")
    shared = bands.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("members"))
    in_shared = materialise(
        bands.join(shared.where("members > 1"), "bucket").select("bucket", "key", "leader", "members"),
        "shared-bands",
    )
    stars = in_shared.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    needed = in_shared.select("key").distinct().join(texts, "key").select("key", "first_id")
    whole = F.coalesce(F.col(text), F.lit(""))
    bodies = (
        docs.select(F.col(doc_id).cast("long").alias("first_id"), F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))
        .alias("d")
        .join(
            needed.alias("n"),
            (F.col("d.key") == F.col("n.key")) & F.col("d.first_id").eqNullSafe(F.col("n.first_id")),
        )
        .groupBy(F.col("d.key").alias("key"))
        .agg(F.first("d.text").alias("text"))
    )
    bodies = materialise(bodies, "candidate-texts")
    paired = stars.join(bodies.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        bodies.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b"
    )
    links = materialise(similar(paired), "star-links")
    labels = components(links)
    rest = materialise(settled_by_blocks(_unsettled(in_shared, labels, texts, bodies)), "block-links")
    labels = components(links.unionByName(rest), labels)

    nodes = texts.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first_id", "copies", F.coalesce("label", "key").alias("label")
    )
    classes = nodes.groupBy("label").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("unknown"), "first_id", "key")).alias("least"),
        F.sum("copies").alias("class_size"),
    )
    known = nodes.join(classes, "label").select(
        "key", F.col("least.first_id").alias("class_id"), F.col("least.key").alias("first_key"), "class_size"
    )
    return rows.join(known, "key").select(
        "doc_id",
        "key",
        "class_id",
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first_key"))).alias("is_first"),
    )


def _unsettled(shared: DataFrame, labels: DataFrame, texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, dealt to pairs of blocks."""
    named = shared.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "label", F.coalesce("label", "key")
    )
    named = materialise(named, "named-bands")
    open_buckets = (
        named.groupBy("bucket")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"))
        .where("x <> y")
        .select("bucket")
    )
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        named.join(open_buckets, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    return (
        dealt.join(texts.select("key", "signature"), "key")
        .join(bodies, "key")
        .select("bucket", "low", "high", "block", "key", "label", "signature", "text")
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of near duplicates, with the columns of ``docs``.

    The one with the least id stays; of rows equal in id and text, one.
    """
    firsts = near_duplicates(docs, doc_id, text).where("is_first").groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("rows")
    )
    firsts = materialise(firsts, "first-documents")
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))

    def chosen(some: DataFrame) -> DataFrame:
        own = some.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
        same = (F.col("__key") == key) & F.col("__id").eqNullSafe(F.col(doc_id).cast("long"))
        return docs.join(own, same, "left_semi")

    once = chosen(firsts.where("rows = 1"))
    repeated = firsts.where("rows > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(chosen(repeated).dropDuplicates([doc_id, text]))
