"""Bodies, WebSocket messages, early stops, request timing and failed logins as state of a stream.

Each is a stateful processor: what is open of a body or a connection lives in the state store
(`state_store` chooses the one that these need), keyed by it, and a micro-batch touches
only the keys that it has rows of. The rows that come out are those of
palisade.streaming.bodies, and palisade.operators.bots, over the whole of the data.

Chunks and frames of a key are numbered from 0 on without gaps. They are taken in
that order, whichever batch they come in: one ahead of its turn waits in the state, one
whose turn has passed is a repeat and left out. With `idle_ms` a timer forgets a key
that has been silent so long, with all that waits or is open; without it, a few bytes of each
key stay for good. A null chunk is empty, a null key is a key like any other."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palisade.config import Config
from palisade.functions.detect import detect
from palisade.model import DETECTION
from palisade.operators import bots, scoring
from palisade.rules import load
from palisade.streaming.bodies import as_text, decide_messages, wanted_frames

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> SparkSession:
    """Has the session's new streams keep their state on disk, in column families: lists, maps and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class InOrder(StatefulProcessor):
    """Takes the rows of a key by `idx`: 0, 1, 2 ... across batches, and forgets silent keys."""

    #: DDL of what a row that waits for its turn consists of; its values by these names.
    waiting: str

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long")
        self.early = handle.getMapState("early", "idx long", self.waiting)
        self.names = [c.split()[0] for c in self.waiting.split(",")]
        self.states()

    def states(self) -> None:
        """Declares further state."""

    def take(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        """Takes (idx, *values) whose turn it is, in order."""
        return iter(())

    def forget(self) -> None:
        """Clears further state."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        following = self.turn.get()[0] if self.turn.exists() else 0
        # Of repeats within a batch, the one that is smallest stays, whatever order they come in.
        ready: dict[int, tuple] = {}
        for row in rows:
            values = tuple(row[n] for n in self.names)
            if row["idx"] >= following:
                ready[row["idx"]] = min(values, ready.get(row["idx"], values), key=repr)
        now: list[tuple] = []
        while True:
            if following in ready:
                values = ready.pop(following)
                if self.early.containsKey((following,)):
                    values = self.early.getValue((following,))
                    self.early.removeKey((following,))
            elif self.early.exists() and self.early.containsKey((following,)):
                values = self.early.getValue((following,))
                self.early.removeKey((following,))
            else:
                break
            now.append((following, *values))
            following += 1
        for idx, values in ready.items():
            if not self.early.containsKey((idx,)):
                self.early.updateValue((idx,), values)
        self.turn.update((following,))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self.take(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.turn.clear()
        self.early.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class Buffer(InOrder):
    """Joins the chunks of a body until one is its last, or until they are too large."""

    waiting = "data binary, is_last boolean"

    def __init__(self, limit: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.limit = limit

    def states(self) -> None:
        self.open = self.handle.getValueState("open", "buffer long, first long, size long")
        self.chunks = self.handle.getListState("chunks", "data binary")

    def take(self, key, rows):
        number, first, size = self.open.get() if self.open.exists() else (0, None, 0)
        new: list[tuple] = []  # chunks of the open buffer that are not in the state yet
        for idx, data, last in rows:
            data = bytes(data or b"")
            first, size = idx if first is None else first, size + len(data)
            over = size > self.limit
            if not over:
                new.append((data,))
            if over or last:
                body = None if over else b"".join([*(bytes(c[0]) for c in self.chunks.get()), *(c[0] for c in new)])
                self.chunks.clear()
                yield Row(key=key[0], buffer=number, first=first, last=idx, size=size, too_large=over, body=body)
                number, first, size, new = number + 1, None, 0, []
        if new:
            self.chunks.appendList(new)
        self.open.update((number, first, size))

    def forget(self) -> None:
        self.open.clear()
        self.chunks.clear()


def _mode(idle_ms: int | None) -> str:
    return "ProcessingTime" if idle_ms else "None"


def buffered(chunks: DataFrame, config: Config = Config(), idle_ms: int | None = None) -> DataFrame:
    """bodies.buffered of a stream of chunks (key, idx, data, is_last)."""
    key = chunks.schema["key"].dataType.simpleString()
    out = f"key {key}, buffer long, first long, last long, size long, too_large boolean, body binary"
    sent = chunks.select("key", F.col("idx").cast("long").alias("idx"), "data", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    return sent.groupBy("key").transformWithState(Buffer(config.max_body, idle_ms), out, "append", _mode(idle_ms))


class Reassembly(InOrder):
    """Joins the fragments of the messages of a connection, each direction on its own."""

    waiting = "data binary, fin boolean, c2s boolean, opcode string, wanted boolean"

    def __init__(self, limit: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.limit = limit

    def states(self) -> None:
        # A direction's open message, and its fragments by their place in it.
        self.open = self.handle.getMapState("open", "c2s boolean", "message long, first long, size long, n long")
        self.fragments = self.handle.getMapState("fragments", "c2s boolean, place long", "data binary")

    def take(self, key, rows):
        known = {}  # of the directions in this batch: message, first, size, n, fragments not in the state yet
        for idx, data, fin, c2s, opcode, wanted in rows:
            if not wanted:
                continue
            if c2s not in known:
                known[c2s] = [*(self.open.getValue((c2s,)) if self.open.containsKey((c2s,)) else (0, None, 0, 0)), []]
            message, first, size, n, new = known[c2s]
            data = bytes(data or b"")
            first, size, n = idx if first is None else first, size + len(data), n + 1
            over = not fin and size > self.limit  # a final frame is not held against the limit
            if not over:
                new.append(data)
            if over or fin:
                stored = n - len(new) - over
                body = None if over else b"".join([*(bytes(self.fragments.getValue((c2s, k))[0]) for k in range(stored)), *new])
                for k in range(stored):
                    self.fragments.removeKey((c2s, k))
                yield Row(key=key[0], c2s=c2s, message=message, opcode=opcode, first=first, last=idx, n_frames=n, overflow=over, body=body)
                message, first, size, n, new = message + 1, None, 0, 0, []
            known[c2s] = [message, first, size, n, new]
        for c2s, (message, first, size, n, new) in known.items():
            for k, data in enumerate(new, n - len(new)):
                self.fragments.updateValue((c2s, k), (data,))
            self.open.updateValue((c2s,), (message, first, size, n))

    def forget(self) -> None:
        self.open.clear()
        self.fragments.clear()


def messages(frames: DataFrame, config: Config = Config(), idle_ms: int | None = None) -> DataFrame:
    """bodies.messages of a stream of frames (key, idx, opcode, data, c2s, fin) of both directions, which
    share one numbering. Frames that are not looked at (bodies.frames) take their turn and no more."""
    key = frames.schema["key"].dataType.simpleString()
    out = f"key {key}, c2s boolean, message long, opcode string, first long, last long, n_frames long, overflow boolean, body binary"
    wanted = F.coalesce(wanted_frames(F.col("opcode"), F.col("data"), config), F.lit(False))
    sent = frames.select("key", F.col("idx").cast("long").alias("idx"), F.when(wanted, F.col("data")).alias("data"), F.coalesce("fin", F.lit(False)).alias("fin"), F.coalesce("c2s", F.lit(False)).alias("c2s"), "opcode", wanted.alias("wanted"))
    return sent.groupBy("key").transformWithState(Reassembly(config.max_message, idle_ms), out, "append", _mode(idle_ms))


def decided_messages(frames: DataFrame, config: Config = Config(), idle_ms: int | None = None) -> DataFrame:
    """messages with detections, score, decision and action, as soon as a message ends or is too large."""
    return decide_messages(messages(frames, config, idle_ms), "c2s", config)


class Windows(InOrder):
    """Gives each chunk the end of the one before it; a body known to have stopped has none."""

    waiting = "data binary, is_last boolean, stop boolean"

    def __init__(self, overlap: int, idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.overlap = overlap

    def states(self) -> None:
        self.tail = self.handle.getValueState("tail", "data binary")
        self.stopped = self.handle.getValueState("stopped", "stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        chunks = []
        for row in rows:
            if row["stop"]:
                self.stopped.update((True,))
            else:
                chunks.append(row)
        if chunks:
            yield from super().handleInputRows(key, iter(chunks), timerValues)

    def take(self, key, rows):
        stopped = self.stopped.exists()
        tail = bytes(self.tail.get()[0]) if self.tail.exists() and not stopped else b""
        for idx, data, last, _ in rows:
            data = bytes(data or b"")
            yield Row(key=key[0], idx=idx, is_last=last, window=None if stopped else tail + data)
            tail = data[max(0, len(data) - self.overlap) :]
        if rows and not stopped:
            self.tail.update((tail,))
        elif stopped:
            self.tail.clear()

    def forget(self) -> None:
        self.tail.clear()
        self.stopped.clear()


class FirstOfEachRule(StatefulProcessor):
    """Lets the first detection of each rule through, until the running score stops the body, and
    gives all of them again with the body's last chunk. Detections are JSON here."""

    def __init__(self, threshold: float, idle_ms: int | None = None):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "rule_id int", "idx long, detection string, score int")
        self.score = handle.getValueState("score", "running long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        running, stopped = self.score.get() if self.score.exists() else (0, False)
        for row in sorted(rows, key=lambda r: r["idx"]):
            new = []
            for hit in [] if stopped else row["found"]:
                rule = (hit["rule_id"],)
                if not self.seen.containsKey(rule):
                    self.seen.updateValue(rule, (row["idx"], hit["detection"], hit["score"]))
                    new.append(hit)
            # All of a chunk counts before the threshold is looked at.
            running += sum(hit["score"] for hit in new)
            reached = running >= self.threshold
            for hit in new:
                yield Row(key=key[0], idx=row["idx"], detection=hit["detection"], score=hit["score"], running=running, stopped=reached, detections=None)
            stopped = stopped or reached
            if row["is_last"] and self.seen.exists():
                kept = sorted((value[0], rule[0], value[1]) for rule, value in self.seen.iterator())
                yield Row(key=key[0], idx=row["idx"], detection=None, score=None, running=running, stopped=stopped, detections=[d for _, _, d in kept])
        self.score.update((running, stopped))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        self.score.clear()
        return iter(())

    def close(self) -> None:
        pass


def windows(chunks: DataFrame, config: Config = Config(), idle_ms: int | None = None, stops: DataFrame | None = None) -> DataFrame:
    """key, idx, is_last, window of a stream of chunks (key, idx, data, is_last): the end of the chunk before,
    and the chunk; null in a body that stops (a stream of key) has named."""
    key = chunks.schema["key"].dataType.simpleString()
    sent = chunks.select("key", F.col("idx").cast("long").alias("idx"), "data", F.coalesce("is_last", F.lit(False)).alias("is_last"), F.lit(False).alias("stop"))
    if stops is not None:
        notice = [F.lit(-1).cast("long").alias("idx"), F.lit(None).cast("binary").alias("data"), F.lit(False).alias("is_last"), F.lit(True).alias("stop")]
        sent = sent.unionByName(stops.select("key", *notice))
    return sent.groupBy("key").transformWithState(Windows(config.overlap, idle_ms), f"key {key}, idx long, is_last boolean, window binary", "append", _mode(idle_ms))


def inspected(chunks: DataFrame, config: Config = Config(), idle_ms: int | None = None, stops: DataFrame | None = None, location: str = "body") -> DataFrame:
    """What a stream of chunks (key, idx, data, is_last) shows: `hits` and `finalized` tell it apart.

    Rules are matched between two stateful steps, as expressions. Where stops names a body, the
    first step keeps its chunks from the rules; the second one ignores what comes after the stop anyway."""
    rules, key = load(config), chunks.schema["key"].dataType.simpleString()
    seen = windows(chunks, config, idle_ms, stops)
    hit = lambda d: F.struct(d["rule_id"].alias("rule_id"), F.to_json(d).alias("detection"), scoring.detection_score(d, (), config).alias("score"))
    found = seen.select("key", "idx", "is_last", F.transform(detect(as_text(F.col("window")), location, rules), hit).alias("found"))
    out = f"key {key}, idx long, detection string, score int, running long, stopped boolean, detections array<string>"
    events = found.groupBy("key").transformWithState(FirstOfEachRule(config.early_threshold, idle_ms), out, "append", _mode(idle_ms))
    parsed = lambda c: F.from_json(c, DETECTION)
    return events.withColumn("detection", parsed(F.col("detection"))).withColumn("detections", F.transform("detections", parsed))


def hits(events: DataFrame) -> DataFrame:
    """bodies.inspected: the first detection of each rule in a body."""
    return events.where("detection is not null").drop("detections")


def finalized(events: DataFrame, config: Config = Config()) -> DataFrame:
    """bodies.finalized: bodies that have ended and had detections."""
    rules, ended = load(config), events.where("detections is not null")
    scored = ended.select("key", "detections", F.col("running").alias("stream_score"), "stopped").withColumn("score", scoring.total(F.col("detections"), rules, config))
    return scored.withColumn("decision", scoring.decide(F.col("detections"), F.col("score"), config))


def stop_notices(spark: SparkSession, folder: str, key: str = "string") -> DataFrame:
    """The stream of keys of bodies that have stopped, as stopping_sink writes them to a shared folder."""
    return spark.readStream.schema(f"key {key}").parquet(folder)


def stopping_sink(folder: str, sink):
    """For foreachBatch of a stream of `inspected`: gives sink(events, batch) its rows and tells
    stop_notices of the bodies that have stopped. A batch that is run again only tells them again."""

    def write(events: DataFrame, batch: int) -> None:
        events.persist()
        events.where("stopped and detection is not null").select("key").distinct().write.mode("append").parquet(folder)
        sink(events, batch)
        events.unpersist()

    return write


class InTime(StatefulProcessor):
    """Takes the rows (ts, id, ...) of a key in the order of their time, once the watermark has
    passed it: what comes in between out of order is in order by then. A key whose last row the
    watermark has left behind by `keep_ms` is forgotten."""

    #: DDL of what a waiting row has besides its time (at, in milliseconds); names as in the stream.
    waiting: str
    keep_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.waiting.split(",")]
        self.rows = handle.getListState("rows", f"at long, ts timestamp, {self.waiting}")
        self.last = handle.getValueState("last", "at long")
        self.states()

    def handleInputRows(self, key, rows, timerValues):
        new = [(row["at"], row["ts"], *(row[n] for n in self.names)) for row in rows]
        self.rows.appendList(new)
        # A timer an instant; those that are due fire together at the end of a batch.
        self.handle.registerTimer(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, rows = timerValues.getCurrentWatermarkInMs(), list(self.rows.get())
        due = sorted((r for r in rows if r[0] <= now), key=lambda r: (r[0], r[2]))
        if due:
            later = [r for r in rows if r[0] > now]
            self.rows.clear()
            if later:
                self.rows.put(later)
                self.handle.registerTimer(min(r[0] for r in later))
            self.last.update((due[-1][0],))
            self.handle.registerTimer(due[-1][0] + self.keep_ms)
            yield from self.take(key, due)
        elif not rows and self.last.exists() and self.last.get()[0] + self.keep_ms <= now:
            self.last.clear()
            self.forget()

    def close(self) -> None:
        pass


class Timing(InTime):
    """The last bots.KEPT times of a source."""

    waiting, keep_ms = "id long", 2 * bots.WINDOW_MS

    def states(self) -> None:
        self.ring = self.handle.getValueState("ring", "times array<long>")

    def take(self, key, rows):
        ring = list(self.ring.get()[0]) if self.ring.exists() else []
        for at, ts, order in rows:
            gap = at - ring[-1] if ring else None
            ring = [*ring, at][-bots.KEPT :]
            kind, score = bots.timing_of(gap, [t for t in ring if t > at - bots.WINDOW_MS])
            yield Row(key=key[0], ts=ts, id=order, gap_ms=gap, timing_kind=kind, timing_score=score)
        self.ring.update((ring,))

    def forget(self) -> None:
        self.ring.clear()


class Failures(InTime):
    """The failures of a key by millisecond, of one window back: no more than it has milliseconds."""

    waiting = "id long, success boolean"

    def __init__(self, limits: dict[str, int], seconds: int):
        self.limits, self.window = limits, seconds * 1000
        self.keep_ms = self.window

    def states(self) -> None:
        self.failed = self.handle.getValueState("failed", "times array<long>, counts array<long>")

    def take(self, key, rows):
        found = deque(zip(*self.failed.get())) if self.failed.exists() else deque()
        total = sum(n for _, n in found)
        for at, ts, order, success in rows:
            if success is False:
                before = found.pop()[1] if found and found[-1][0] == at else 0
                found.append((at, before + 1))
                total += 1
            while found and found[0][0] <= at - self.window:
                total -= found.popleft()[1]
            yield Row(kind=key[0], key=key[1], ts=ts, id=order, failures=total, exceeded=total >= self.limits[key[0]])
        self.failed.update(([t for t, _ in found], [n for _, n in found]))

    def forget(self) -> None:
        self.failed.clear()


def _in_time(rows: DataFrame, late: str) -> DataFrame:
    """The time in milliseconds beside the time itself, with a watermark. Rows without a time have no order: they are left out."""
    timed = rows.where(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)


def timed(requests: DataFrame, late: str = "10 seconds") -> DataFrame:
    """bots.timed of a stream of requests (key, ts, id): key, ts, id, gap_ms, timing_kind, timing_score."""
    key = requests.schema["key"].dataType.simpleString()
    out = f"key {key}, ts timestamp, id long, gap_ms long, timing_kind string, timing_score int"
    sent = _in_time(requests.select("key", "ts", F.col("id").cast("long").alias("id")), late)
    return sent.groupBy("key").transformWithState(Timing(), out, "append", "EventTime")


def credential_attempts(attempts: DataFrame, paths: tuple[str, ...] = bots.LOGIN_PATHS, late: str = "10 seconds") -> DataFrame:
    """Of a stream of attempts (ip, user, ts, id, path, success) those on a login path, twice: by what counts
    (kind ip or user, and key, as text), ts, id, failures and whether they are too many. bots.credential_attempts
    has both in one row."""
    tried = attempts.where(bots.on_login_path(F.col("path"), paths))
    counted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in ("ip", "user")])).alias("by")
    rows = tried.select(counted, "ts", F.col("id").cast("long").alias("id"), F.coalesce("success", F.lit(True)).alias("success"))
    sent = _in_time(rows.select("by.*", "ts", "id", "success"), late)
    limits = {"ip": bots.IP_FAILURES, "user": bots.USER_FAILURES}
    out = "kind string, key string, ts timestamp, id long, failures long, exceeded boolean"
    return sent.groupBy("kind", "key").transformWithState(Failures(limits, bots.FAILURE_SECONDS), out, "append", "EventTime")
