"""The registered queries of the training-data operators: each applies one operator,
with production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bitplane, divergence, exact_dedup, line_quality, main_text, packing, personal_data, sentence_spans, sentencepieces, simhash, toxicity, weak_labels, whitening
from palisade.llm.common import shared_folder, table

#: The id that ends each document.
END_ID = 2


def tokenizer_path(name: str) -> str:
    """Of a public tokenizer; on the driver, executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitplane.write_ids(docs, folder, tokenizer_path("byte_bpe_50k.json"), END_ID)
    return bitplane.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_labels.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_sentence_spans, and the repeated passages that start or end inside other sentences."""
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept"
    )


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), END_ID)
    return packing.assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"n_{kind}" for kind in personal_data.BASE],
        F.sha2(personal_data.spans_text("base_spans").cast("binary"), 256).alias("base_sha256"),
        personal_data.spans_text("spans").alias("spans"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = exact_dedup.mark_duplicates(docs.withColumn("text_sha256", exact_dedup.text_sha256()))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(docs, model)
    spans = encoded.withColumn("spans_crc32", F.crc32(F.concat("begins", "ends"))).drop("begins", "ends")
    return sentencepieces.decode(spans, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "spans_crc32",
    )


def op11_spectrum_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_count_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_attentive_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).drop("text")


QUERIES = {
    f.__name__: f
    for f in (op1_bitplane_ids, op2_weak_labels, op3_best_region, op4_sentence_spans, op4_passage_spans, op5_line_quality, op6_simhash_trie, op7_bin_slack, op8_disclosure, op9_exact_dedup, op10_offset_pieces, op11_spectrum_slices, op12_count_trees, op13_attentive_gru)
}
