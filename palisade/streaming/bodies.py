"""Bodies that arrive in chunks, and WebSocket frames: as windows over finished data.

Chunks are ordered by their index within a body; every operator shuffles by the body's
key alone. A null chunk or frame is empty. palisade.streaming.stateful has the same operators as state
of a stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palisade.config import Config
from palisade.functions import binding
from palisade.functions.detect import detect
from palisade.model import DETECTIONS
from palisade.operators import scoring
from palisade.plans.requests import responded
from palisade.rules import Rule, load

#: Bytes of chunks that are Python values at a time, besides one buffer.
SLICE = 4 << 20
CONTROL = ("ping", "pong", "close")


def decoded(data: str | Column) -> Column:
    """Bytes of base64 text, none of null; null, which is let through, if it is not base64."""
    return F.try_to_binary(F.coalesce(F.col(data) if isinstance(data, str) else data, F.lit("")), F.lit("base64"))


def as_text(data: Column) -> Column:
    """UTF-8 with replacement characters for bad bytes."""
    return F.make_valid_utf8(data.cast("string"))


def _in_buffers(rows: DataFrame, keys: list[str], index: str, data: str, ends: str, limit: int, last_counts: bool) -> DataFrame:
    """keys, buffer, first, last, size, too_large, body, n of the buffers that have ended.

    Chunks of a key join a buffer in order; one that makes it larger than limit ends it without
    a body, and the next chunk begins a new one. A chunk with ends set ends its buffer, too;
    whether it is held against the limit is last_counts. Chunks are sorted within their
    partition and folded one after the other, so that no more than limit bytes of one buffer,
    and a batch of chunks, are held at a time."""
    size = F.coalesce(F.octet_length(data), F.lit(0))
    at_, bytes_, ends_, data_ = binding.fresh(rows.select(*keys), "index_", "bytes_", "ends_", "data_")
    # What is larger than the limit on its own is never joined: its bytes need not travel.
    joined = (size <= limit) | (F.lit(not last_counts) & F.col(ends))
    sent = rows.select(*keys, F.col(index).alias(at_), size.cast("long").alias(bytes_), F.coalesce(F.col(ends), F.lit(False)).alias(ends_), F.when(joined, F.coalesce(F.col(data), F.lit(b""))).alias(data_))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[: len(keys)])
    at = sent.schema[at_].dataType.simpleString()
    schema = f"{kinds}, buffer long, first {at}, last {at}, size long, too_large boolean, body binary, n long"

    def portions(batches):
        """Rows as Python values, of at most SLICE bytes (or one row) at a time."""
        for batch in batches:
            ends = np.cumsum(np.minimum(np.asarray(batch.column(len(keys) + 1)), limit + 1))
            begin = 0
            while begin < len(ends):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
                yield zip(*(column.to_pylist() for column in batch.slice(begin, end - begin).columns))
                begin = end

    def fold(batches):
        now, number, held, total, first, n = None, 0, [], 0, None, 0
        for rows in portions(batches):
            out = []
            for *key, i, length, last, data in rows:
                if key != now:
                    now, number, held, total, n = key, 0, [], 0, 0
                first = i if n == 0 else first
                total, n = total + length, n + 1
                over = total > limit if last_counts or not last else False
                if not over:
                    held.append(data)
                if over or last:
                    out.append((*key, number, first, i, total, over, None if over else b"".join(held), n))
                    number, held, total, n = number + 1, [], 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    plain = sent.sparkSession.createDataFrame([], schema).schema
    names, types = plain.names, [to_arrow_type(f.dataType) for f in plain.fields]
    return sent.repartition(*keys).sortWithinPartitions(*keys, at_).mapInArrow(fold, schema)


def buffered(chunks: DataFrame, key: str, index: str, data: str, last: str, config: Config = Config()) -> DataFrame:
    """key, buffer, first, last, size, too_large, body: the chunks of each body joined up to its last
    one. What exceeds max_body is let through unseen, and the chunk after it begins a fresh buffer."""
    return _in_buffers(chunks, [key], index, data, last, config.max_body, True).drop("n")


def decide_bodies(chunks: DataFrame, key: str, index: str, data: str, last: str, config: Config = Config()) -> DataFrame:
    """key, last, detections, score, decision, response of every request body that ends, from chunks in base64.

    Without body_inspection nothing is looked at; what is no base64 is let through unseen. With
    streaming, chunks are looked at as they come (inspected and finalized)."""
    rules = load(config)
    known = chunks.withColumn(data, decoded(data)).where(F.col(data).isNotNull() & F.lit(config.body_inspection))
    if config.streaming:
        found = finalized(inspected(known, key, index, data, config, rules), key, index, config, rules)
        ended = known.where(last).groupBy(key).agg(F.max(index).alias("last"))
        rows = ended.join(found.select(key, "detections"), key, "left").withColumn("detections", F.coalesce("detections", F.expr(f"cast(array() as {DETECTIONS})")))
    else:
        rows = buffered(known, key, index, data, last, config).select(key, "last", detect(as_text(F.col("body")), "body", rules).alias("detections"))
    rows = rows.withColumn("score", scoring.total(F.col("detections"), rules, config))
    rows = rows.withColumn("decision", scoring.decide(F.col("detections"), F.col("score"), config))
    return rows.withColumn("response", responded(F.col("decision"), F.col("detections"), F.col("score")))


def log_responses(chunks: DataFrame, key: str, index: str, data: str, last: str, config: Config = Config()) -> DataFrame:
    """key, last, detections, header of every response body that ends: they are never blocked; a
    header names the rules found. Nothing is looked at unless config.response_inspection is set."""
    known = chunks.withColumn(data, decoded(data)).where(F.col(data).isNotNull() & F.lit(config.response_inspection))
    found = detect(as_text(F.col("body")), "response_body", load(config))
    # Made to a row by explode: as a mere column, a filter on the header would match every rule a second time.
    rows = buffered(known, key, index, data, last, config).select(key, "last", F.explode(F.array(found)).alias("detections"))
    ids = F.array_join(F.transform("detections", lambda d: d["rule_id"].cast("string")), ",")
    return rows.withColumn("header", F.when(F.size("detections") > 0, ids))


def overlapped(chunks: DataFrame, key: str, index: str, data: str, overlap: int) -> DataFrame:
    """chunks with window: the last bytes of the chunk before, and the chunk. Binary throughout."""
    here = F.coalesce(F.col(data), F.lit(b""))
    before = F.lag(here).over(Window.partitionBy(key).orderBy(index))
    tail = F.substring(before, F.greatest(F.octet_length(before) - overlap + 1, F.lit(1)), F.lit(overlap))
    return chunks.withColumn("window", F.concat(F.coalesce(tail, F.lit(b"")), here))


def inspected(chunks: DataFrame, key: str, index: str, data: str, config: Config = Config(), rules: tuple[Rule, ...] | None = None, location: str = "body") -> DataFrame:
    """key, index, detection, score, running, stopped: the first detection of each rule in a
    body, until the running score of a chunk reaches early_threshold; later chunks are dropped.

    The running score has severity 1; the decision is made on the final severities."""
    rules = load(config) if rules is None else rules
    windows = overlapped(chunks, key, index, data, config.overlap)
    found = windows.select(key, index, F.explode(detect(as_text(F.col("window")), location, rules)).alias("detection"))
    first = Window.partitionBy(key, F.col("detection.rule_id")).orderBy(index)
    rank, before = binding.fresh(found, "__rank", "__before")
    firsts = found.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    firsts = firsts.withColumn("score", scoring.detection_score(F.col("detection"), (), config))
    # All of a chunk counts before the threshold is looked at.
    upto = Window.partitionBy(key).orderBy(index).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(index).rangeBetween(Window.unboundedPreceding, -1)
    rows = firsts.withColumn("running", F.sum("score").over(upto)).withColumn(before, F.coalesce(F.sum("score").over(earlier), F.lit(0)))
    return rows.where(F.col(before) < config.early_threshold).drop(before).withColumn("stopped", F.col("running") >= config.early_threshold)


def finalized(rows: DataFrame, key: str, index: str, config: Config = Config(), rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row for each body with detections: rule ids in order, scores, stopped, decision."""
    rules = load(config) if rules is None else rules
    order = F.struct(F.col(index), F.col("detection.rule_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col("detection").alias("d")))), lambda x: x["d"])
    grouped = rows.groupBy(key).agg(listed.alias("detections"), F.sum("score").alias("stream_score"), F.bool_or("stopped").alias("stopped"))
    grouped = grouped.withColumn("score", scoring.total(F.col("detections"), rules, config))
    return grouped.withColumn("decision", scoring.decide(F.col("detections"), F.col("score"), config))


def wanted_frames(opcode: Column, data: Column, config: Config = Config()) -> Column:
    """Whether a frame is looked at: no control frame, text (with what continues it) and binary ones as
    config says, unknown opcodes always, none that is too large. Null is an unknown opcode and no data."""
    unwanted = [*CONTROL, *(() if config.websocket_text else ("text", "continuation")), *(() if config.websocket_binary else ("binary",))]
    return F.lit(config.websocket) & ~F.coalesce(opcode.isin(*unwanted), F.lit(False)) & (F.coalesce(F.octet_length(data), F.lit(0)) <= config.max_frame)


def frames(rows: DataFrame, opcode: str, data: str, config: Config = Config()) -> DataFrame:
    """The frames that are looked at."""
    return rows.where(wanted_frames(F.col(opcode), F.col(data), config))


def messages(rows: DataFrame, keys: list[str], index: str, fin: str, data: str, opcode: str, config: Config = Config()) -> DataFrame:
    """keys, message, opcode (of the final frame), first and last index, body, n_frames, overflow.

    A message ends with a final frame, which is not counted against max_message, or with the
    frame that makes it too large; what has not ended yet is not returned."""
    found = _in_buffers(rows, keys, index, data, fin, config.max_message, False)
    opcodes = rows.select(*keys, F.col(index).alias("last"), F.col(opcode).alias("opcode"))
    return found.join(opcodes, [*keys, "last"]).select(
        *keys, F.col("buffer").alias("message"), "opcode", "first", "last", F.col("n").alias("n_frames"), F.col("too_large").alias("overflow"), "body"
    )


def decide_messages(found: DataFrame, client_to_server: str, config: Config = Config()) -> DataFrame:
    """messages with detections, score and action: allow, drop, or close with a code."""
    rules = load(config)
    side = F.when(F.col(client_to_server), "c2s").otherwise("s2c")
    place = F.concat_ws(":", F.lit("websocket"), side, F.col("opcode"))
    rows = found.withColumn("detections", F.when(~F.col("overflow"), detect(as_text(F.col("body")), place, rules)).otherwise(detect(F.lit(None).cast("string"), place, rules)))
    rows = rows.withColumn("score", scoring.total(F.col("detections"), rules, config))
    decision = scoring.decide(F.col("detections"), F.col("score"), config, config.websocket_block_mode)
    # What does not block drops nothing but the frames that are too much.
    close = F.lit(f"close:{config.websocket_close_code}" if config.websocket_block_mode else "drop")
    action = F.when(F.col("overflow"), close).when(decision == "block", close).otherwise("allow")
    return rows.withColumn("decision", decision).withColumn("action", action)
