"""The corpus pipeline: quality rules, exact and near deduplication, personal data, packing.

Defined results: a null text is empty and fails the quality rules; of equal texts the
largest doc_id stays, of linked fingerprints the smallest, null doc_ids last in either
case; rows repeated in full leave one; very long texts are cut into pieces, not dropped;
extra columns pass through all stages but packing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import exact_dedup, line_quality, packing, personal_data, simhash
from palisade.llm.common import shared_folder, table
from palisade.llm.queries import END_ID, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, or fail the base limits, go whole."""
    return line_quality.clean_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the row with the smallest doc_id stays."""
    return simhash.near_dedup(docs)


def private_terms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it leave the texts."""
    return personal_data.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    pieces = packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), END_ID)
    return packing.assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("personal data", private_terms),
    ("packing", packed),
]

#: SimHash and the tokenizer have no SQL; tests run the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
