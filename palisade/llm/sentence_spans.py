"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences (from each sentence on, the shortest that has
MIN_SENTENCES sentences and MIN_WORDS words) is hashed. Hashes are counted over all
documents; a run that occurs more than once keeps its first occurrence, by doc_id and
place, and every sentence covered by any other occurrence is removed. Runs are
compared by their words, after lower-casing A-Z. With passages, runs of words that do
not keep to sentences are removed in the same way (see passages.py).

Defined results: a null text stays null, an empty one empty; null doc_ids come last;
rows that repeat both doc_id and text are one document here and get the same result;
within a text the first occurrence stays, too; an empty table gives an empty result;
input columns named like a result column are replaced, all others pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import fresh, text_of, without, written
from palisade.llm.passages import passage_spans, repeated_passages

MIN_SENTENCES = 2
MIN_WORDS = 16
#: Each alternative begins a run of its class, so that no run is tried from every place in it.
_END = re.compile(r"(?<![.!?])[.!?]+\s+|(?<!\s)\s*\n\s*")
RESULTS = ("n_removed", "removed")
RUNS = "doc_id long, text_id long, hash long, check int, first int, last int"


def sentences(text: str) -> list[str]:
    """The sentences of text, each with what separates it from the next: joined, they are the text."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """(hash, check, first, last) of each run of sentences."""
    import xxhash

    words = [s.encode().lower().split() for s in sentences(text)]
    total = np.cumsum([0, *map(len, words)])
    last = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS) - 1, np.arange(len(words)) + MIN_SENTENCES - 1)
    joined = [b" ".join(w) + b" " if w else b"" for w in words]
    place, all_words = np.cumsum([0, *map(len, joined)]).tolist(), b"".join(joined)
    out = []
    for i, j in enumerate(last.tolist()):
        if j >= len(words):
            break
        digest = xxhash.xxh128_intdigest(all_words[place[i] : place[j + 1]])
        out.append(((digest & (1 << 64) - 1) - (1 << 63), (digest >> 96) - (1 << 31), i, j))
    return out


def all_runs(docs: DataFrame) -> DataFrame:
    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        names = ["doc_id", "text_id", "hash", "check", "first", "last"]
        for batch in batches:
            rows = []
            for doc_id, text_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc_id, text_id, *r) for r in runs(text)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text")).mapInArrow(run, RUNS)


def covered_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, spans): the runs (first, last) of each document that are not first occurrences."""
    found = written(all_runs(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "first")
    counted = found.groupBy("hash", "check").agg(F.min(place).alias("kept"), F.count("*").alias("n"))
    # As a table of its own: a join with what a shuffle has just summed up could not split a hot hash.
    repeated = written(counted.where("n > 1").select("hash", "check", "kept"))
    others = found.join(repeated, ["hash", "check"]).where(place != F.col("kept"))
    return others.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


def remove_spans(text: str, spans, passages=None) -> tuple[str, list[int], list[int]]:
    """text without the covered sentences and passages, and where they lay."""
    parts = sentences(text)
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    covered = [(ends[s["first"]], ends[s["last"] + 1]) for s in (() if spans is None else spans)]
    covered += () if passages is None else passage_spans(text, passages)
    gone: list[list[int]] = []
    for begin, end in sorted(covered):
        if gone and begin <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], end)
        else:
            gone.append([begin, end])
    begins, ends = [b for b, _ in gone], [e for _, e in gone]
    return "".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)])), begins, ends


@F.pandas_udf(CLEANED)
def _clean(texts: pd.Series, spans: pd.Series, passages: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else remove_spans(t, s, p) for t, s, p in zip(texts, spans, passages)]
    return pd.DataFrame(rows, columns=CLEANED.names)


def dedup_spans(docs: DataFrame, passages: bool = False) -> DataFrame:
    """docs with repeated sentences (and passages) taken out of text; n_removed characters lay at removed, (begin, end) each."""
    docs = without(docs, *RESULTS)
    text_id, other, other_id, spans, runs_, clean = fresh(docs, "__text_id", "__doc", "__other_id", "__spans", "__passages", "__clean")
    covered = covered_sentences(docs).withColumn("passages", F.lit(None).cast("array<int>"))
    if passages:
        more = repeated_passages(docs).withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>"))
        both = covered.unionByName(more).groupBy("doc_id", "text_id")
        covered = both.agg(F.any_value("spans", F.lit(True)).alias("spans"), F.any_value("passages", F.lit(True)).alias("passages"))
    covered = written(covered).toDF(other, other_id, spans, runs_)
    rows = docs.withColumn(text_id, F.xxhash64(text_of())).join(
        covered, (F.col(text_id) == F.col(other_id)) & F.col("doc_id").eqNullSafe(F.col(other)), "left"
    )
    some = F.col(spans).isNotNull() | F.col(runs_).isNotNull()
    rows = rows.withColumn(clean, _clean(F.when(some, F.col("text")), F.col(spans), F.col(runs_)))
    now = F.when(some, F.col(clean)["text"]).otherwise(F.col("text"))
    removed = F.when(some, F.arrays_zip(F.col(clean)["begins"].alias("begin"), F.col(clean)["ends"].alias("end")))
    size = F.aggregate(removed, F.lit(0), lambda n, x: n + x["end"] - x["begin"]).cast("long")
    return rows.select(
        *[now.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(size, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.array_join(F.transform(removed, lambda x: F.concat_ws(":", x["begin"], x["end"])), ","), F.lit("")).alias("removed"),
    )
