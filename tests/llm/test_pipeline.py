import collections
import hashlib
import re

import numpy as np
import public_tokenizers
from test_neardup import classes
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from vulntide.llm import bpe, quality
from vulntide.llm.queries import QUERIES


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    clean, single, masked, mixed, coded = (t.collect() for t in tables[1:])
    assert all(t.columns == columns for t in tables[1:5])

    verdict = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    assert {r.doc_id: r.text for r in clean} == {i: r.clean_text for i, r in verdict.items() if r.kept}
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in classes([(r.doc_id, r.text) for r in clean])})
    planted = re.compile(r'(?i)token = "[0-9a-f]{40}"')
    assert any(planted.search(r.text) for r in single) and not any(planted.search(r.text) for r in masked)
    assert len(masked) == len(single) and all(r.n_chars == len(r.text) for r in masked if "[SECRET]" in r.text)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert max(copies.values()) == 2 and {r.text for r in mixed} <= {r.text for r in masked}
    library = Tokenizer.from_file(public_tokenizers.path(bpe.WORDS))
    digest = {}
    for r in masked:
        ids = library.encode(r.text, add_special_tokens=False).ids
        digest[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in coded) == sorted((r.doc_id, *digest[r.doc_id]) for r in mixed)


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    extra = odd_docs.selectExpr("*", "1 AS kept", "'x' AS clean_text", "2 AS size", "3 AS copies", "4 AS key")
    for docs in (extra, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
