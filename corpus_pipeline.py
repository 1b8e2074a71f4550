"""The training-data pipeline: quality, near duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulntide.llm.bpe import encode_and_decode
from vulntide.llm.mixing import mix_sources, repeated
from vulntide.llm.neardup import without_near_duplicates
from vulntide.llm.quality import apply_rules
from vulntide.llm.secretscan import scan_secrets
from vulntide.llm.tables import table
from vulntide.session import new_folder


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``docs`` with columns that clash with nothing, and their names."""
    names = {name: f"column_{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names.__getitem__


def _as_before(docs: DataFrame, done: DataFrame, text: str | None = None) -> DataFrame:
    """``done`` with the columns of ``docs``; ``text`` names the column of a changed text."""
    plain, name = _plain(docs)
    columns = {c: F.col(name(c)) for c in docs.columns}
    if text:
        columns["text"] = F.col(text)
        if "n_chars" in columns:
            kind = docs.schema["n_chars"].dataType
            changed = F.length(text) != F.length(name("text"))
            columns["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(columns["n_chars"])
    return done.select(*[column.alias(c) for c, column in columns.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that break one."""
    plain, name = _plain(docs)
    judged = apply_rules(plain, name("text"))
    return _as_before(docs, judged.where("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id."""
    plain, name = _plain(docs)
    return _as_before(docs, without_near_duplicates(plain, name("doc_id"), name("text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mask."""
    plain, name = _plain(docs)
    return _as_before(docs, scan_secrets(plain, name("text")), "redacted_text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    plain, name = _plain(docs)
    mixed = mix_sources(plain, name("doc_id"), name("source"), name("text"))
    return _as_before(docs, repeated(mixed, plain.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, language and source, and the digests of its tokens."""
    plain, name = _plain(docs)
    coded = encode_and_decode(plain, name("text"))
    kept = [F.col(name(c)).alias(c) for c in ("doc_id", "lang", "source")]
    return coded.select(*kept, "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mixing", mixing),
    ("tokens", tokens),
]

# The forest, the signatures and the vocabulary are beyond SQL; the tests hold the result
# against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        folder = new_folder(spark, f"stage-{k}")
        done.write.parquet(folder)
        docs = spark.read.schema(done.schema).parquet(folder)
    return docs
