import re
import zlib

import pytest

from vulntide.llm import mixing, shards

WORDS = re.compile("[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 4000, 1])
def test_shards_hold_every_row_once(spark, documents, bucket_bytes):
    rows = shards.shuffled_shards(documents, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in documents.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, ())) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_shuffled_and_repeat(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(7)
    place = lambda df: {r.doc_id: r.slot * 16 + r.shard for r in df.collect()}
    first = place(shards.shuffled_shards(docs, bucket_bytes=2000))
    order = sorted(first, key=first.get)
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.45 < rising / len(order) < 0.55
    assert first != place(shards.shuffled_shards(docs, bucket_bytes=2000, seed=1))


def test_order_does_not_depend_on_the_cluster(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(CAST(id AS STRING), 9) AS text")
    before, orders = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = shards.shuffled_shards(docs.repartition(partitions), bucket_bytes=4000, task_bytes=20000)
            orders.append({(r.doc_id, r.shard, r.slot) for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert orders[0] == orders[1] and len(orders[0]) == 5000


def test_copies_are_spread_over_buckets(spark):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "id AS other")
    docs = docs.union(spark.range(300).selectExpr("id AS doc_id", "'abc' AS text", "-id AS other")).repartition(5)
    sharded = shards.shuffled_shards(docs, bucket_bytes=200)
    rows = sharded.collect()
    assert sorted(r.other for r in rows) == sorted(r.other for r in docs.collect())
    assert sorted(r.slot * 16 + r.shard for r in rows) == list(range(3300))
    # A bucket is a run of places, so copies in one bucket would leave the others apart from them.
    places = sorted(r.slot * 16 + r.shard for r in rows if r.doc_id is not None)
    assert max(b - a for a, b in zip(places, places[1:])) < 1500


def test_odd_tables_are_sharded(spark, odd_docs, no_docs):
    rows = shards.shuffled_shards(odd_docs.withColumnRenamed("lang", "SLOT")).collect()
    assert len(rows) == odd_docs.count() and "SLOT" not in rows[0].asDict()
    sharded = shards.shuffled_shards(no_docs)
    assert shards.read_shards(spark, shards.write_shards(sharded), sharded).count() == 0


def test_written_shards_are_read_back(spark, odd_docs):
    sharded = shards.shuffled_shards(odd_docs)
    back = shards.read_shards(spark, shards.write_shards(sharded), sharded)
    assert back.columns == sharded.columns
    key = lambda rows: sorted((str(r.doc_id), zlib.crc32((r.text or "").encode())) for r in rows)
    assert key(back.collect()) == key(odd_docs.collect())


def filled(sizes, weights, share, epochs):
    """Water-filling as stated: cut what is above its cap, share the excess, until none is."""
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(capped.values())
        total = sum(weights[s] for s in free)
        target = {s: left * weights[s] / total for s in free}
        above = [s for s in free if target[s] >= epochs * sizes[s]]
        if not above:
            return capped | target
        capped |= {s: float(epochs * sizes[s]) for s in above}


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_sources(docs).collect()
    sizes, taken, targets, longest = {}, {}, {}, {}
    for r in out:
        assert r.size == len(WORDS.findall(r.text)) and r.taken == r.copies * r.size <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        targets[r.source] = r.target
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = filled(sizes, weights, 1.5, 2)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1
    again = mixing.mix_sources(docs.repartition(7), keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    assert len(mixing.repeated(mixing.mix_sources(docs), docs.columns).collect()) == sum(r.copies for r in out)


@pytest.mark.parametrize("parts", [1, 6])
def test_equal_rows_meet_their_target(spark, parts):
    rows = [(None, "a", "three little words")] * 1000 + [(k, "b", "word " * (k % 50)) for k in range(400)]
    rows += [(7, "a", "three little words")] * 285 + [(9, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    for keep in (None, ["doc_id"]):
        out = mixing.mix_sources(docs, weights=(1, 9, 1), share=0.7, keep=keep).collect()
        assert len(out) == len(rows)
        for source_size in {r.source_size for r in out}:
            mine = [r for r in out if r.source_size == source_size]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
            assert all(r.taken <= 2 * r.size for r in mine)
        assert 0 < sum(r.taken for r in out if r.source_size == 3855) < 3855


def test_odd_tables_are_mixed(spark, odd_docs, no_docs):
    out = mixing.mix_sources(odd_docs.withColumnRenamed("lang", "Taken")).collect()
    assert len(out) == odd_docs.count()
    sums = {}
    for r in out:
        assert r.size == len(WORDS.findall(r.text or ""))
        assert r.source_size >= r.size
        sums[r.source] = sums.get(r.source, 0) + r.size
    assert None in sums and all(r.source_size == sums[r.source] for r in out)
    assert mixing.mix_sources(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(empty).collect()] == [(0.0, 0)] * 2


def test_plans_hold_no_python(spark, documents):
    for frame in (mixing.mix_sources(documents), shards.shuffled_shards(documents)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
