"""Packing by minimum bin slack.

Each document's ids (with its end id) are cut into full windows and one remainder.
What is left to pack is a histogram of remainder lengths, which has fewer entries
than a window has tokens however large the input is. For each window the longest
remaining length is set and a bitset subset-sum over the histogram finds the
multiset of other lengths that comes closest to capacity; its counts are traced
back, and the pattern is used as often as the histogram allows. Pieces then find
their place by their rank among the pieces of their length.

Defined results: a null text is empty, its piece holds the end id alone; equal or
repeated rows are packed each on its own; null doc_ids are packed like any other;
other columns of documents are ignored, those of pieces pass through, and those named
like a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import fresh, text_of, without, written
from palisade.llm.encode import library_encoder, slices

WINDOW = 4096
#: Ranks are counted within buckets of about so many pieces of one length, however common it is.
BUCKET = 500_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, keeps_space: bool = False) -> DataFrame:
    """Pieces of at most window ids (binary, little-endian unsigned 32-bit integers)."""

    def run(batches):
        encoder, end = library_encoder(tokenizer, keeps_space), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1).to_pylist()):
                rows = []
                for ids in encoder.encode(texts):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_ids[at], k, min(window, n - k), ids[4 * k : 4 * (k + window)], n) for k in range(0, n, window)]
                    at += 1
                columns = zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of the lengths, out of counts, whose sum comes closest to capacity from below."""
    full, reached, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, some = min(counts[length], capacity // length), 1
        while left > 0:
            some = min(some, left)
            steps.append((length, some, reached))
            reached |= (reached << (length * some)) & full
            left -= some
            some *= 2
        if reached >> capacity:
            break
    at, taken = reached.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + some
            at -= length * some
    return taken


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(how often, counts by length): windows that use up the histogram."""
    counts, out = dict(histogram), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = best_fill(counts, window - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in taken.items())
        for x, n in taken.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((times, taken))
    return out


def _slots(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """For each length and pattern: the first rank it serves (with the length, as one
    sorted key), the pieces a window, the first sequence, and the offset in a window."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in plan:
        offset = 0
        for length in sorted(taken, reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, taken[length], sequence, offset))
            used[length] = rank + times * taken[length]
            offset += length * taken[length]
        sequence += times
    length, rank, each, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return length, rank, each, first, offset


def assign_sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (doc_id, start, length and any others) with sequence_id and offset."""
    pieces = without(pieces, "sequence_id", "offset")
    others = [F.col(f"`{c}`") for c in pieces.columns]
    bucket, n, before, rank, row, total = fresh(pieces, "__bucket", "__n", "__before", "__rank", "__row", "__total")
    # A number of its own for each row, since repeated rows have nothing else to part them by.
    stored = written(pieces.withColumn(row, F.monotonically_increasing_id()))
    totals = stored.groupBy("length").agg(F.count("*").alias(total))
    # At most `window` rows.
    histogram = {r["length"]: r[total] for r in totals.collect()}
    plan = stored.sparkSession.sparkContext.broadcast(_slots(patterns(histogram, window)))
    buckets = F.from_json(F.lit(json.dumps([-(-histogram.get(k, 0) // BUCKET) for k in range(window + 1)])), "array<bigint>")
    dealt = stored.withColumn(bucket, F.pmod(F.xxhash64(row), F.greatest(F.get(buckets, F.col("length").cast("int")), F.lit(1))))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = dealt.groupBy("length", bucket).agg(F.count("*").alias(n))
    by_bucket = written(by_bucket.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))))

    within = Window.partitionBy("length", bucket).orderBy("doc_id", "start", row)
    # A row for each BUCKET pieces and length: Spark broadcasts it while it is small.
    ranked = (
        dealt.withColumn(rank, F.row_number().over(within) - 1)
        .join(by_bucket.drop(n), ["length", bucket])
        .select(*others, (F.col(rank) + F.col(before)).alias(rank))
    )

    def place(batches):
        length, served, each, first, offset = plan.value
        shift = np.int64(1) << 40
        keys = length * shift + served
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = table["length"].to_numpy().astype(np.int64)
            mine = table[rank].to_numpy().astype(np.int64)
            slot = np.searchsorted(keys, own * shift + mine, "right") - 1
            turn = mine - served[slot]
            yield from (
                table.drop([rank])
                .append_column("sequence_id", pa.array(first[slot] + turn // each[slot], pa.int64()))
                .append_column("offset", pa.array(offset[slot] + turn % each[slot] * own, pa.int64()))
                .to_batches()
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != rank)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """The pieces of docs, ids included, with their places."""
    return assign_sequences(cut_pieces(docs, tokenizer, end_id, window), window)
