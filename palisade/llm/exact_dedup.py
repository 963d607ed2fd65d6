"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
equal texts the row with the largest doc_id stays. Defined results: a null doc_id
is smaller than any other; rows that repeat the doc_id that stays are tied and
exactly one of them is kept; an empty table gives an empty result; input columns
named like a result column are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import ascii_lower, fresh, set_aside, text_of, without, written

PREFIX_CHARS = 256
#: A table of group keys of at most so many rows (about 40 bytes each) is broadcast;
#: beyond that the join is left to Spark, which shuffles and splits hot keys.
BROADCAST_ROWS = 200_000
RESULTS = ("keep_id", "group_size", "kept")


def text_sha256(text: str | Column = "text") -> Column:
    return F.sha2(ascii_lower(text_of(text)).cast("binary"), 256)


def _sized(keys: DataFrame) -> DataFrame:
    keys = written(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size and kept on every row, dropped ones too."""
    docs = without(docs, *RESULTS)
    length, prefix, full, repeats, many, ties = fresh(
        docs, "__length", "__prefix", "__full", "__repeats", "__many", "__ties"
    )
    text = text_of()
    sized = docs.withColumn(length, F.octet_length(text))

    # 1. Lengths that occur more than once. Lower-casing A-Z keeps a text's length.
    lengths = _sized(sized.groupBy(length).agg(F.count("*").alias(many)).where(F.col(many) > 1).select(length))

    # 2. Among those, prefixes that occur more than once.
    headed = sized.withColumn(prefix, F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))))
    groups = _sized(
        headed.join(lengths, length, "left_semi")
        .groupBy(length, prefix)
        .agg(F.count("*").alias(many))
        .where(F.col(many) > 1)
        .select(length, prefix, F.lit(True).alias(repeats))
    )

    # 3. Only surviving groups have their full content hashed.
    hashed = headed.join(groups, [length, prefix], "left").withColumn(
        full, F.when(F.col(repeats), F.sha2(ascii_lower(text).cast("binary"), 256))
    )
    key = [length, prefix, full]
    found = _sized(
        hashed.where(F.col(repeats))
        .groupBy(*key, "doc_id")
        .agg(F.count("*").alias(many))
        .groupBy(*key)
        .agg(
            F.max("doc_id").alias("keep_id"),
            F.sum(many).alias("group_size"),
            F.coalesce(F.max_by(many, "doc_id"), F.sum(many)).alias(ties),
        )
        .where(F.col("group_size") > 1)
    )
    single = F.col("group_size").isNull()
    out = (
        hashed.join(found, key, "left")
        .withColumn("kept", single | F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .withColumn("keep_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns] + [F.col(c) for c in RESULTS]
    if found.where(F.col(ties) > 1).isEmpty():
        return out.select(*columns)
    # Only rows that repeat a kept doc_id need one chosen among them.
    tied = F.col("kept") & (F.coalesce(F.col(ties), F.lit(1)) > 1)
    first = F.row_number().over(Window.partitionBy(*key, "doc_id").orderBy(F.xxhash64(text))) == 1
    chosen = out.where(tied).withColumn("kept", first)
    return out.where(~tied).select(*columns).unionByName(chosen.select(*columns))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    renamed, own = set_aside(docs, RESULTS)
    return mark_duplicates(renamed).where("kept").select(*own)
