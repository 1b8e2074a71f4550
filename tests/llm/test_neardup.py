import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from vulntide.llm import neardup
from vulntide.llm.graphs import components
from vulntide.llm.workers import FlatText


def shingles(text):
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    if 0 < len(words) < 5:
        return collections.Counter([tuple(words)])
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def similarity(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def arrays_similarity(a, b):
    """The operator's formula, which a test below holds against the definition."""
    name = {e: n for n, e in enumerate(sorted(a.keys() | b.keys()))}
    arrays = []
    for c in (a, b):
        ids = sorted(name[e] for e in c)
        own = {name[e]: c[e] for e in c}
        arrays += [np.array(ids, np.uint64), np.array([own[k] for k in ids])]
    return neardup.probability_jaccard(*arrays)


def classes(rows):
    """Least id per row by comparing all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    by = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for e in s:
            by[e].append(k)
        by["text", rows[k][1] or ""].append(k)
    for j, k in {(j, k) for group in by.values() for n, k in enumerate(group) for j in group[:n]}:
        if root(j) != root(k):
            same = (rows[j][1] or "") == (rows[k][1] or "")
            # Similarity needs most of the elements to be common.
            near = 2 * len(sets[j].keys() & sets[k].keys()) > min(len(sets[j]), len(sets[k]))
            if same or near and arrays_similarity(sets[j], sets[k]) >= 0.8:
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def found(frame):
    out = neardup.near_duplicates(frame).collect()
    return sorted(((r.doc_id, r.class_id) for r in out), key=str)


def test_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == classes(rows)
    assert found(no_docs) == []
    assert neardup.without_near_duplicates(no_docs).count() == 0


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents) == classes(rows)


@pytest.mark.parametrize("block", [512, 7])
def test_hot_groups(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [" ".join(base)] * 40
    for k in range(60):  # near copies at all distances
        near = list(base)
        for _ in range(draw.randint(1, 12)):
            near[draw.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [" ".join(passage + [word() for _ in range(draw.randint(5, 60))]) for _ in range(60)]  # a shared passage
    texts += [" ".join(word() for _ in range(50)) for _ in range(40)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == classes(rows)


def test_one_document_of_each_class_stays(spark, odd_docs):
    kept = neardup.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert kept.count() == len({c for _, c in classes(rows)})


def test_probability_jaccard_matches_its_definition():
    draw = random.Random(2)
    for _ in range(200):
        a, b = (collections.Counter(draw.choices(range(20), k=draw.randint(1, 30))) for _ in range(2))
        arrays = [x for c in (a, b) for x in (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))]
        assert neardup.probability_jaccard(*arrays) == pytest.approx(similarity(a, b))


def test_signatures_estimate_the_similarity():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
    other = words[:200] + ["".join(draw.choices("abcdefgh", k=6)) for _ in range(100)]
    texts = [" ".join(words), " ".join(other), " ".join(words * 2)]
    flat = FlatText(pa.array(texts))
    short = neardup.short_signatures(neardup.signatures(*neardup.weighted_shingles(flat), 3))
    want = similarity(shingles(texts[0]), shingles(texts[1]))
    assert abs((short[0] == short[1]).mean() - want) < 0.15
    assert (short[0] == short[2]).mean() > 0.9  # weights count by their shares


def test_components(spark):
    edges = [(bytes([a]), bytes([b])) for a, b in [(1, 2), (2, 3), (9, 3), (20, 21), (22, 21), (30, 31)]]
    edges += [(bytes([40 + k]), bytes([41 + k])) for k in range(30)]
    got = {r.node[0]: r.label[0] for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30} | {40 + k: 40 for k in range(31)}
    assert got == want
