"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain.llm import alignment, byte_bpe, clustering, decontamination, exact_dedup, language, line_dedup, packing, quality, secret_scan, sharding, simhash, vector_dedup
from daygrain.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines of repeated passages removed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern matches and all secret spans of every document."""
    found = secret_scan.scan(read(spark, sf_dir, "documents")).select("doc_id", "secrets")

    def joined(spans: Column) -> Column:
        return F.concat_ws(
            ",",
            F.transform(
                spans,
                lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
            ),
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def fold(modulus: int) -> Column:
    """The fold of a document: CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four of five folds."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(5) == 0)
    found = language.identify(docs, ~F.col("held_out"), carry=("held_out",))
    return found.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), "score", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    docs = read(spark, sf_dir, "documents").withColumn("text_sha256", exact_dedup.whole_digest(F.col("text")))
    return exact_dedup.exact_duplicates(docs, carry=("text_sha256",), digest="text_sha256").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dedup.similar_vectors(read(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, of 40 with nearly the same bytes, and the slot in it of every document."""
    placed = sharding.minimax_shards(read(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from three of four folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, read(spark, sf_dir, "labels"), fold(4) != 2)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(read(spark, sf_dir, "documents"), path)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every usable vector."""
    return clustering.centroid_clusters(read(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in passages of the benchmark, and its items."""
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit(F.col("starts"), F.col("ends"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give every document."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.token_links(read(spark, sf_dir, "documents"), *paths)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_simhash,
        op3_secret_scan,
        op4_language,
        op5_exact_dedup,
        op6_vector_dedup,
        op7_sharding,
        op8_packing,
        op9_quality,
        op10_byte_bpe,
        op11_centroid_clustering,
        op12_decontamination,
        op13_cross_tokenizer,
    )
}
