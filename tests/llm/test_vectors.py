import numpy as np
import pytest
from pyspark.sql import functions as F

from vulntide.llm.vectors import estimated_products, nearest

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v
          and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if asked(i):
            near = [(-(float(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v))), j) for j, v in ok if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def result(frame, condition):
    out = {}
    for r in sorted(nearest(frame, condition).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = result(table, F.col("vec_id") % 50 == 0), brute(rows, lambda i: i % 50 == 0)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_blocks_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(3000 + k, rows[7][1]) for k in range(900)]  # one vector very often
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    got, want = result(frame, F.col("vec_id") % 100 == 7), brute(rows, lambda i: i % 100 == 7)
    assert [j for j, _ in got[7]] == [3000, 3001, 3002, 3003, 3004]
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_odd_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, []), (7, [2.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [3.0, 2.0, 1.0]), (10, [1e-30, 1e-30]), (11, [1e30, -1e30]),
        (None, [1.0, 1.0]), (12, [5.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]),
    ]
    frame = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = result(frame, F.col("vec_id") >= 0)
    assert set(got) == {0, 7, 8, 9, 10, 11, 50}
    assert [j for j, _ in got[8]] == [9] and got[0][0][0] == 50 and [j for j, _ in got[0]][:2] == [50, 50]
    assert result(frame.limit(0), F.col("vec_id") >= 0) == {}


def test_doubles_keep_their_precision_and_range(spark):
    rows = [
        (0, [1e300, 1e300]), (1, [1e300, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0 + 1e-13]), (4, [1e-300, 1e-300]),
        (5, [-1e300, 1e300]), (6, [3e38, 1e39]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(frame, F.col("vec_id") == 0)[0]
    assert {j for j, _ in got[:3]} == {2, 3, 4}
    assert {j for j, _ in got} == {1, 2, 3, 4, 6} and dict(got)[1] == pytest.approx(0.5**0.5, abs=1e-15)
    assert dict(got)[6] == pytest.approx(1.3 / (2 * 1.09) ** 0.5, abs=1e-15)
    one = result(frame, F.col("vec_id") == 3)[3]
    assert dict(one)[2] == pytest.approx(1.0, abs=1e-15)


@pytest.mark.parametrize("width", [1, 7, 64, 65, 200])
def test_products_from_packed_bits(width):
    rng = np.random.default_rng(width)
    signs = rng.integers(0, 2, (300, width)).astype(bool)
    turned = rng.normal(size=(150, width))
    got, bound = estimated_products(np.packbits(signs, axis=1), turned)
    want = (signs * 2.0 - 1) @ turned.T
    assert (np.abs(got - want) <= bound + 1e-9).all()
