"""The training-data pipeline: stages over the documents, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain.llm import line_dedup, packing, quality, secret_scan, simhash
from daygrain.llm.common import read, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_length(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Labels of every fourth fold are not learnt from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    scored = quality.classify(docs, read(spark, sf_dir, "labels"), fold != 2)
    return scored.where("predicted = 1").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of passages that occur earlier."""
    return _with_length(line_dedup.dedup_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles at two bits or fewer."""
    return simhash.drop_near_duplicates(docs, words=3, distance=2).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a marker in place of every secret."""
    return _with_length(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    # a smaller cache than in a job of its own, as the workers of earlier stages still hold memory
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), cached_words=200_000)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the scans: tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between two stages is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
