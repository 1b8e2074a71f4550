import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vulntide.llm import manifest
from vulntide.llm.manifest import FIELDS, dataset_manifest, fold, proof_digest
from vulntide.llm.queries import op13_manifest


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(values):
    parts = []
    for v in values:
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*parts)


def tree(digests, fanout):
    """Root, and for each digest the siblings on its way, in order."""
    proofs = [[] for _ in digests]
    nodes = [(d, [k]) for k, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for k, (_, members) in enumerate(run):
                for m in members:
                    proofs[m].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            above.append((sha(*[d for d, _ in run]), sum((m for _, m in run), [])))
        nodes = above
    return nodes[0][0], proofs


def brute(rows, fanout=2):
    """rows of FIELDS -> list of results like those of the query."""
    leaves = [(r, leaf_of(r)) for r in rows]
    trees = {}
    for r, leaf in leaves:
        trees.setdefault(r[2], []).append((r, leaf))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    lower = {lang: tree([leaf for _, leaf in trees[lang]], fanout) for lang in order}
    root, upper = tree([lower[lang][0] for lang in order], fanout)
    out = []
    for k, lang in enumerate(order):
        for (r, leaf), proof in zip(trees[lang], lower[lang][1]):
            path = proof + upper[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf_of([*r[:3], r[3] + 1, r[4]]) if tampered else leaf
            for left, right in path:
                folded = sha(*left, folded, *right)
            siblings = [d for left, right in path for d in left + right]
            out.append((r[0], leaf, lower[lang][0], root, sha(*siblings), folded, folded == root))
    return sorted(out, key=repr)


def result(monkeypatch, spark, docs):
    monkeypatch.setattr("vulntide.llm.queries.table", lambda *_: docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in names) for r in op13_manifest(spark, "").collect()), key=repr)


def plain(docs):
    return [tuple(r[c] for c in FIELDS) for r in docs.collect()]


ODD = [
    (1, "a", "en", 5, "text"), (1, "a", "en", 5, "text"), (None, None, None, None, None), (None, None, None, None, None),
    (2, "", "", 0, ""), (3, "é", "日本", -4, "x" * 70_000), (4, "-", "-", 2**63 - 1, "-"), (2**63 - 1, "1:", "en", 1, "\x00\n"),
    (-7, "s", "=", 3, None), (0, "s", "=", None, "t"), (None, "s", "en", 3, "u"), (12, "s", "𐍈", 3, "u"), (13, "s", "ﬁ", 3, "u"),
]


@pytest.mark.parametrize("block", [1024, 4, 2])
def test_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK_NODES", block)
    rows = ODD + [(100 + k, f"s{k}", "de" if k % 3 else "en", k, f"text {k}") for k in range(75)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({"LEAF": F.lit(1), "pos": F.lit(2), "tree": F.lit("x")}).repartition(5)
    got = result(monkeypatch, spark, docs)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and sum(r[-1] for r in got) > 60


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_documents(spark, monkeypatch, n):
    rows = [(k, "s", "en", k, "t") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(monkeypatch, spark, docs) == brute(rows)


def test_no_documents(spark, monkeypatch, no_docs):
    assert result(monkeypatch, spark, no_docs) == []


def test_given_documents(spark, monkeypatch, documents):
    assert result(monkeypatch, spark, documents) == brute(plain(documents))


def test_wide_runs_and_other_fields(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_NODES", 9)
    rows = [(k, f"s{k}", f"l{k % 5}", None, "t") for k in range(100)]
    docs = spark.createDataFrame(rows, "id long, source string, lang string, n_chars long, text string")
    got = dataset_manifest(docs, "id", "lang", ["id", "lang"], {"lang": F.lit("z")}, fanout=3)
    got = got.withColumns({"proof": proof_digest(F.col("path")), "again": fold(F.col("leaf"), F.col("path"))}).collect()
    want = {}
    subroots = {}
    for lang in sorted({r[2] for r in rows}):
        subroots[lang] = tree([leaf_of([r[0], lang]) for r in rows if r[2] == lang], 3)
    root, upper = tree([subroots[lang][0] for lang in sorted(subroots)], 3)
    for k, lang in enumerate(sorted(subroots)):
        for r, proof in zip([r for r in rows if r[2] == lang], subroots[lang][1]):
            want[r[0]] = sha(*[d for left, right in proof + upper[k] for d in left + right])
    assert {r.id: r.proof for r in got} == want
    assert all(r.root == root == r.again and r.changed_leaf == leaf_of([r.id, "z"]) for r in got)


def test_hot_group_of_equal_rows_spreads(spark):
    rows = [(None, "s", "en", 1, "same")] * 2000 + [(k, "s", "de", 1, "t") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    leaves = docs.select(F.lit("en").alias("tree"), F.col("doc_id"), F.monotonically_increasing_id().alias("read"))
    parts = manifest.placed(leaves, "tree", F.col("doc_id").asc_nulls_first(), "read")
    assert sorted(r.pos for r in parts.select("pos").collect()) == list(range(2200))
    assert dataset_manifest(docs).select("root").distinct().count() == 1
