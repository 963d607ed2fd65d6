"""Repeated passages that do not keep to sentences, word by word.

Every run of PASSAGE words that occurs more than once keeps its first occurrence, by
doc_id and place; every word of any other occurrence is removed. To find them without
hashing every run of every document, each run names an anchor: of the ANCHOR-word runs
in it, the one with the smallest hash. Equal runs have equal anchors, so that only runs
whose anchor occurs more than once need to be hashed and counted; nothing is lost.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import text_of, written

PASSAGE = 51
ANCHOR = 16
_WORD = re.compile(rb"\S+")
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FOUND = "doc_id long, text_id long, hash long, first int"


def _run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words, put together from runs of powers of two."""
    power, done, out, runs = 1, 0, None, words
    while True:
        if size & power:
            part = runs[done : done + len(words) - size + 1]
            out = part if out is None else _mixed(out * np.uint64(_ODD[0]) + part)
            done += power
        if power * 2 > size:
            return out
        runs = _mixed(runs[:-power] * np.uint64(_ODD[1]) + runs[power:])
        power *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()], np.uint64)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every ANCHOR-word run, and the place of each PASSAGE-word run's anchor."""
    grams = _run_hashes(words, ANCHOR)
    windows = np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - ANCHOR + 1)
    return grams, np.arange(len(windows)) + windows.argmin(axis=1)


def _mapped(rows: DataFrame, each) -> DataFrame:
    """(doc_id, text_id, hash, first) of what each(text, places) finds: hashes and places."""

    def run(batches):
        for batch in batches:
            doc_ids, text_ids, texts, *places = (c.to_pylist() for c in batch.columns)
            parts, size = [], 0
            for i, text in enumerate(texts):
                words = word_hashes(text)
                if len(words) < PASSAGE:
                    continue
                hashes, first = each(words, *(np.array(p[i]) for p in places))
                parts.append((doc_ids[i], text_ids[i], hashes.view(np.int64), first.astype(np.int32)))
                size += len(hashes)
                if size > 200_000:
                    yield _batch(parts)
                    parts, size = [], 0
            if parts:
                yield _batch(parts)

    return rows.mapInArrow(run, FOUND)


def _batch(parts) -> pa.RecordBatch:
    repeat = lambda k: pa.array([p[k] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])))
    hashes, first = (pa.array(np.concatenate([p[k] for p in parts])) for k in (2, 3))
    return pa.RecordBatch.from_arrays([repeat(0), repeat(1), hashes, first], names=["doc_id", "text_id", "hash", "first"])


def _anchor_rows(words):
    grams, chosen = anchors(words)
    places = np.unique(chosen)
    return grams[places], places


def _passage_rows(words, repeated):
    _, chosen = anchors(words)
    first = np.flatnonzero(np.isin(chosen, repeated))
    return _run_hashes(words, PASSAGE)[first], first


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, passages): the first words of each document's runs that are not first occurrences."""
    text = text_of()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    marks = written(_mapped(keyed, _anchor_rows))
    # Tables of their own: a join with what a shuffle has just summed up could not split a hot hash.
    # Copies of a row (equal doc_id and text) are one document.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "first")
    again = lambda rows: written(rows.groupBy("hash").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last").select("hash", "kept"))
    shared = marks.join(again(marks).select("hash"), "hash").groupBy("doc_id", "text_id").agg(F.collect_set("first").alias("places"))
    shared = written(shared).toDF("other", "other_id", "places")
    chosen = keyed.join(shared, (F.col("text_id") == F.col("other_id")) & F.col("doc_id").eqNullSafe(F.col("other")))
    found = written(_mapped(chosen.select("doc_id", "text_id", "text", "places"), _passage_rows))
    others = found.join(again(found), "hash").where(place != F.col("kept"))
    return others.groupBy("doc_id", "text_id").agg(F.collect_set("first").alias("passages"))


def passage_spans(text: str, passages) -> list[tuple[int, int]]:
    """[begin, end) in characters of what the runs that begin at these words cover, each with the blanks after it."""
    data = text.encode()
    begins = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    spans: list[list[int]] = []
    for first in sorted(passages):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = first + PASSAGE
        else:
            spans.append([first, first + PASSAGE])
    # Characters before each byte: those bytes count that go on with no character.
    upto = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
    return [(int(upto[begins[a]]), int(upto[begins[b]])) for a, b in spans]
