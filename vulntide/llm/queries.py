"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, manifest, mixing, neardup, negatives, packing, pages, quality, secretscan, shards, tokenfiles, tokens, vectors
from .oracles import ORACLES  # noqa: F401  (registered beside the queries)
from .tables import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    clean = F.sha2(F.col("clean_text"), 256).alias("clean_sha256")
    return judged.select("doc_id", *[c for c in judged.columns if c not in ("doc_id", "clean_text")], clean)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secretscan.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    clean = F.sha2(F.col("redacted_text"), 256).alias("redacted_sha256")
    return scanned.select("doc_id", "n_candidates", "n_secrets", "secrets", clean)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_token_files(table(spark, sf_dir, "documents"))
    return tokenfiles.read_token_files(spark, files)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shards.shuffled_shards(table(spark, sf_dir, "documents"))
    written = shards.read_shards(spark, shards.write_shards(sharded), sharded)
    return written.select(
        "doc_id",
        shards.record_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "is_first")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # As a decimal, so that the greatest long has a successor.
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    changed = {"n_chars": F.when(tampered, n_chars + 1).otherwise(n_chars).cast("decimal(20,0)")}
    rows = manifest.dataset_manifest(docs, changed=changed)
    rows = rows.withColumn("folded_root", manifest.fold(F.col("changed_leaf"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality,
        op3_secrets,
        op4_bpe,
        op5_token_files,
        op6_shards,
        op7_mixing,
        op8_main_text,
        op9_nearest,
        op10_near_duplicates,
        op11_hard_negatives,
        op12_packing,
        op13_manifest,
    )
}
