import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulntide.llm import negatives
from vulntide.llm.negatives import Heaps, mine_hard_negatives, strassen

SCHEMA = "vec_id long, embedding array<double>, label int, score string, lane int, rank int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sides", [(1, 1, 1), (33, 64, 200), (128, 70, 513), (200, 300, 129), (3, 0, 5), (64, 64, 64)])
def test_strassen_is_exact(sides):
    rng = np.random.default_rng(sum(sides))
    a, b = rng.integers(-(1 << 27), 1 << 27, sides[:2]), rng.integers(-(1 << 27), 1 << 27, sides[1:])
    want = np.array(a.astype(object) @ b.astype(object) if sides[1] else np.zeros((3, 5)), dtype=np.int64)
    assert np.array_equal(strassen(a, b), want)


def test_sums_that_leave_64_bits_come_back():
    a = np.full((64, 64), 1 << 26) * np.where(np.arange(64) % 2, 1, -1)
    assert np.array_equal(strassen(a << 4, a.T << 4), (a @ a.T) << 8)


def test_heaps_keep_the_best_whatever_the_order():
    rng = np.random.default_rng(3)
    at, score, ids = rng.integers(0, 4, 400), rng.integers(0, 30, 400), rng.permutation(400)
    one, parts = Heaps(4, 5), Heaps(4, 5)
    one.merge(at, score, ids, np.ones(400, np.int64))
    for part in np.array_split(rng.permutation(400), 23):
        parts.merge(at[part], score[part], ids[part], np.ones(len(part), np.int64))
    for k in range(4):
        want = sorted((-s, i) for a, s, i in zip(at.tolist(), score.tolist(), ids.tolist()) if a == k)[:5]
        for heaps in (one, parts):
            assert list(zip((-heaps.score[k]).tolist(), heaps.ids[k].tolist())) == want


def brute(rows, asked, positives=5, negatives=5, low=80):
    ok = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, v, label) in enumerate(ok):
        if not asked(i):
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), j, other)
            for n, (j, w, other) in enumerate(ok) if n != k and len(w) == len(v)
        ]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            below = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= 100 * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(below, 1)]
    return sorted(out)


def mined(frame, **more):
    found = mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r[c] for c in NAMES) for r in found.collect())


def frame_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert mined(table) == brute(rows, lambda i: i % 10 == 0)


def test_hot_label_many_lanes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LANE_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 6 * 20)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 7)
    monkeypatch.setattr(negatives, "TILE_SCORES", 100)
    rng = np.random.default_rng(5)
    # Few values, so scores tie; half of the rows have one label; negative scores occur.
    vectors = (rng.integers(-2, 4, (700, 6)) / 256).tolist()
    rows = [(k, v, 7 if k % 2 else int(rng.integers(0, 40))) for k, v in enumerate(vectors)]
    assert mined(frame_of(spark, rows)) == brute(rows, lambda i: i % 10 == 0)
    got = mined(frame_of(spark, rows), positives=2, negatives=9, low_percent=33)
    assert got == brute(rows, lambda i: i % 10 == 0, 2, 9, 33)


def test_repeated_rows_count_one_by_one(spark):
    rows = [(0, [0.5, 0.5], 1)] * 3 + [(1, [0.5, 0.4], 2)] * 4 + [(2, [0.5, 0.45], 1)] * 2 + [(0, [0.5, 0.5], 2)] * 2
    rows += [(3, [0.49, 0.45], 3)]
    got = mined(frame_of(spark, rows))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 2.0], None),
        (6, [0.9, 2.0], 1), (7, [1.0, 1.9], 2), (10, [0.0, 0.0], 1), (11, [1.0, 2.0, 3.0], 2), (20, [1.0, 2.0, 3.0], 1),
        (30, [], 1), (31, [], 1), (32, [], 2), (40, [-0.001, 0.001], 3), (None, [1.0, 2.0], 1), (12, [1.0, 1.95], -3),
        (50, [3e4] * 5, 1), (51, [3e4] * 5, 1), (52, [2.9e4] * 5, 2), (60, [1.0] * 600, 4), (61, [1.0] * 600, 4), (62, [1.0] * 600, 5),
    ]
    got = mined(frame_of(spark, rows))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in got} == {0, 10, 30, 50, 60}
    # Vectors whose scores no long can hold take no part.
    assert mined(frame_of(spark, [*rows, (53, [1e300] * 5, 1), (54, [1e9] * 5, 2)])) == got


def test_no_rows(spark):
    assert mined(frame_of(spark, []).where("false")) == []
    assert mined(frame_of(spark, [(0, [1.0], 1)])) == []
    assert mined(frame_of(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []


def test_named_columns(spark):
    frame = frame_of(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]).toDF("ID", "v", "l", "vec_id_", "copies", "place")
    got = mine_hard_negatives(frame, F.col("vec_id") == 0, "ID", "v", "l").collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == [(0, 1, 1, 2, 65536, 65536)]
