"""State of streams against the same operators over finished data."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from palisade.config import Config
from palisade.operators import bots
from palisade.streaming import bodies, stateful

CHUNKS = "key string, idx long, data binary, is_last boolean"


class Stream:
    """A file stream whose batches are the files of a folder, one a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = stateful.state_store(spark), folder, schema, 0
        (folder / "in").mkdir()
        self.rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self, made, name, **options):
        """All there is, from where the last run ended; the rows of this run."""
        self.n += 1
        folder, parts = str(self.folder / f"out-{name}"), []
        query = made.writeStream.option("checkpointLocation", str(self.folder / name)).outputMode("append").trigger(availableNow=True)
        query.foreachBatch(lambda df, _: parts.extend(df.collect())).start(**options).awaitTermination()
        return parts


@pytest.fixture()
def stream(spark, tmp_path):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda schema: Stream(spark, tmp_path, schema)
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def dealt(rows, batches, seed=0, key=0):
    """rows in any order over batches."""
    place = np.random.default_rng(seed).permutation(len(rows))
    return [[rows[i] for i in place[k::batches]] for k in range(batches)]


def body_rows():
    rng, rows = np.random.default_rng(1), []
    for key in ("a", "b", "c", None):
        for idx in range(12):
            data = None if idx == 3 else bytes(rng.integers(97, 123, rng.integers(0, 60), dtype=np.uint8))
            rows.append((key, idx, data, bool(rng.random() < 0.25)))
    return rows


def shown(rows, *names):
    return sorted((tuple(repr(bytes(r[n]) if isinstance(r[n], bytearray) else r[n]) for n in names) for r in rows))


def test_buffered_bodies_over_shuffled_batches(spark, stream):
    """Overflows, null chunks, a null key; repeats and chunks that come again after their turn."""
    config, names = Config(max_body=100), ("key", "buffer", "first", "last", "size", "too_large", "body")
    rows, chunks = body_rows(), stream(CHUNKS)
    want = bodies.buffered(spark.createDataFrame(rows, CHUNKS), "key", "idx", "data", "is_last", config).collect()
    assert any(r["too_large"] for r in want) and len(want) > 8
    made, got = stateful.buffered(chunks.rows, config), []
    for batch in dealt(rows, 3):
        chunks.add(batch + batch[:2])
        got += chunks.run(made, "buffered")
    chunks.add(rows[:5])
    assert chunks.run(made, "buffered") == []
    assert shown(got, *names) == shown(want, *names)


def test_a_chunk_ahead_of_its_turn_waits(stream):
    chunks = stream(CHUNKS)
    made, turns = stateful.buffered(chunks.rows), []
    for batch in ([("a", 2, b"3", True)], [("a", 0, b"1", False)], [("a", 0, b"x", False), ("a", 1, b"2", False)], [("a", 3, b"4", True)]):
        chunks.add(batch)
        turns.append([(r["first"], r["last"], bytes(r["body"])) for r in chunks.run(made, "waits")])
    assert turns == [[], [], [(0, 2, b"123")], [(3, 3, b"4")]]


def test_silent_bodies_are_forgotten(stream, tmp_path):
    """With a timer Spark runs batches with or without data, so the test waits for what they show."""
    chunks, got = stream(CHUNKS), []
    made = stateful.buffered(chunks.rows, idle_ms=2000).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds")
    query = made.foreachBatch(lambda df, _: got.extend((r["key"], bytes(r["body"])) for r in df.collect())).start()

    def until(test):
        end = time.time() + 60
        while not test() and time.time() < end and query.isActive:
            time.sleep(0.2)
        assert test(), query.exception()

    try:
        chunks.add([("a", 0, b"1", False), ("b", 0, b"1", True)])
        until(lambda: got == [("b", b"1")])
        # State rows go when the timer of "a" has fired.
        until(lambda: sum(x["numRowsTotal"] for x in query.lastProgress["stateOperators"]) == 0)
        # "a" begins anew: its chunk 0 is forgotten.
        chunks.add([("a", 0, b"7", True)])
        until(lambda: got[1:] == [("a", b"7")])
    finally:
        query.stop()


FRAMES = "key string, idx long, opcode string, data binary, c2s boolean, fin boolean"


def frame_rows():
    rng, rows = np.random.default_rng(2), []
    attack = [b"1 UNION SEL", b"ECT password FROM users--"]
    for key in ("x", "y", "z"):
        for idx in range(16):
            opcode = ["text", "continuation", "ping", "binary", None][rng.choice(5, p=[0.4, 0.4, 0.1, 0.05, 0.05])]
            data = None if idx == 5 else attack[idx % 2] if key == "y" else bytes(rng.integers(97, 123, rng.integers(0, 40), dtype=np.uint8))
            rows.append((key, idx, opcode, data, bool(rng.random() < 0.6), bool(rng.random() < 0.3)))
    return rows


@pytest.mark.parametrize("block", [True, False])
def test_messages_and_their_decisions_over_shuffled_batches(spark, stream, block):
    config = Config(max_message=60, websocket_block_mode=block)
    rows, frames = frame_rows(), stream(FRAMES)
    known = bodies.frames(spark.createDataFrame(rows, FRAMES), "opcode", "data", config)
    want = bodies.decide_messages(bodies.messages(known, ["key", "c2s"], "idx", "fin", "data", "opcode", config), "c2s", config).collect()
    names = ("key", "c2s", "message", "opcode", "first", "last", "n_frames", "overflow", "body", "score", "decision", "action")
    assert {r["action"] for r in want} == ({"allow", "close:1008"} if block else {"allow", "drop"}) and any(r["overflow"] for r in want)
    made, got = stateful.decided_messages(frames.rows, config), []
    for batch in dealt(rows, 3):
        frames.add(batch)
        got += frames.run(made, "messages")
    assert shown(got, *names) == shown(want, *names)


def test_a_close_comes_with_the_fragment_that_ends_the_message(stream):
    frames = stream(FRAMES)
    made, actions = stateful.decided_messages(frames.rows), []
    for idx, (data, fin) in enumerate([(b"1 UNION SEL", False), (b"ECT password FROM users--", True)]):
        frames.add([("k", idx, "text", data, True, fin)])
        actions.append([r["action"] for r in frames.run(made, "close")])
    assert actions == [[], ["close:1008"]]


def attacked_rows():
    attacks = [b"plain text ", b"1 UNION SELECT password FROM users-- ", b"<script>alert(1)</script>", b"; cat /etc/pass", b"wd | id", None]
    rng, rows = np.random.default_rng(3), []
    for key in "abcd":
        rows += [(key, idx, attacks[rng.integers(6)], idx == 9) for idx in range(10)]
    return rows + [("quiet", 0, b"nothing", True)]


CONFIG = Config(paranoia=2, early_threshold=45, overlap=16)


def test_first_of_each_rule_and_early_stop_over_shuffled_batches(spark, stream):
    rows, chunks = attacked_rows(), stream(CHUNKS)
    known = bodies.inspected(spark.createDataFrame(rows, CHUNKS), "key", "idx", "data", CONFIG)
    events, got = stateful.inspected(chunks.rows, CONFIG), []
    for batch in dealt(rows, 3):
        chunks.add(batch)
        got += chunks.run(events, "inspected")
    names, found = ("key", "idx", "detection", "score", "running", "stopped"), [r for r in got if r["detection"]]
    assert shown(found, *names) == shown(known.collect(), *names) and any(r["stopped"] for r in found)
    ended = spark.createDataFrame([r for r in got if r["detections"]], events.schema)
    names = ("key", "detections", "stream_score", "stopped", "score", "decision")
    assert shown(stateful.finalized(ended, CONFIG).collect(), *names) == shown(bodies.finalized(known, "key", "idx", CONFIG).collect(), *names)


def test_stopped_bodies_are_kept_from_the_rules(spark, stream, tmp_path):
    """A notice of a stop reaches the first step with the next batch; results stay the same."""
    rows, chunks = attacked_rows(), stream(CHUNKS)
    notices, got, looked = str(tmp_path / "stops"), [], []
    spark.createDataFrame([], "key string").write.parquet(notices)
    stops = stateful.stop_notices(spark, notices)
    events, seen = stateful.inspected(chunks.rows, CONFIG, stops=stops), stateful.windows(chunks.rows, CONFIG, stops=stops)
    sink = stateful.stopping_sink(notices, lambda df, _: got.extend(df.collect()))
    for k in range(5):
        chunks.add([r for r in rows if r[1] // 2 == k])
        looked += [(r["key"], r["idx"]) for r in chunks.run(seen, "windows") if r["window"] is not None]
        query = events.writeStream.option("checkpointLocation", str(tmp_path / "stopping")).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    want = bodies.inspected(spark.createDataFrame(rows, CHUNKS), "key", "idx", "data", CONFIG).collect()
    names = ("key", "idx", "detection", "score", "running", "stopped")
    assert shown([r for r in got if r["detection"]], *names) == shown(want, *names)
    at = {r["key"]: r["idx"] for r in want if r["stopped"]}
    assert at and all(idx // 2 <= at[key] // 2 for key, idx in looked if key in at)


REQUESTS = "key string, ts timestamp, id long"
T0 = datetime(2024, 1, 1)


def request_rows():
    """A flood, a regular client, a slow one, equal times, and a last request long after all others."""
    rng, rows, n = np.random.default_rng(5), [], 0
    for key, gaps in (("flood", rng.integers(0, 900, 260)), ("regular", rng.integers(1990, 2010, 30)), ("slow", rng.integers(20_000, 90_000, 12)), ("same", [0] * 4 + [7])):
        at = 0
        for gap in gaps:
            at, n = at + int(gap), n + 1
            rows.append((key, T0 + timedelta(milliseconds=at), n))
    return rows, ("end", T0 + timedelta(days=2), 10_000)


def test_timing_over_shuffled_batches(spark, stream):
    rows, end = request_rows()
    requests = stream(REQUESTS)
    made, got = stateful.timed(requests.rows, "1 day"), []
    for batch in [*dealt(rows, 2), [end], [("end", end[1] + timedelta(days=1), 10_001)]]:
        requests.add(batch)
        got += requests.run(made, "timing")
    want = bots.timed(spark.createDataFrame(rows, REQUESTS), "key", "ts", "id").collect()
    names = ("key", "ts", "id", "gap_ms", "timing_kind", "timing_score")
    assert {r["timing_kind"] for r in want} == {None, "too-fast", "regular", "burst"}
    assert shown([r for r in got if r["key"] != "end"], *names) == shown(want, *names)


ATTEMPTS = "ip string, user string, ts timestamp, id long, path string, success boolean"


def test_failed_logins_over_shuffled_batches(spark, stream):
    rng, rows = np.random.default_rng(6), []
    for n in range(400):
        at = T0 + timedelta(milliseconds=int(rng.integers(0, 1_500_000)) // 1000 * 1000)
        rows.append((f"10.0.0.{n % 3}", f"u{rng.integers(9)}", at, n, ["/login", "/API/auth/x", "/else"][rng.choice(3, p=[0.5, 0.4, 0.1])], [True, False, None][rng.choice(3, p=[0.2, 0.75, 0.05])]))
    attempts = stream(ATTEMPTS)
    made, got = stateful.credential_attempts(attempts.rows, late="1 day"), []
    for batch in [*dealt(rows, 2), [("end", "end", T0 + timedelta(days=2), 9999, "/login", True)]]:
        attempts.add(batch)
        got += attempts.run(made, "failures")
    want = bots.credential_attempts(spark.createDataFrame(rows, ATTEMPTS).fillna(True, ["success"]), "ts", "path", "ip", "user", "id").collect()
    both = {(kind, r["id"]): r[f"{kind}_failures"] for r in want for kind in ("ip", "user")}
    assert {(r["kind"], r["id"]): r["failures"] for r in got} == both and len(got) == len(both)
    stuffing = {r["id"] for r in got if r["exceeded"]}
    assert stuffing == {r["id"] for r in want if r["stuffing"]} and stuffing


def test_null_times_have_no_gaps(spark):
    rows = [("a", None, 1), ("a", None, 2), ("a", T0, 3), ("a", T0 + timedelta(milliseconds=5), 4)]
    got = bots.timed(spark.createDataFrame(rows, REQUESTS), "key", "ts", "id").orderBy("id").collect()
    assert [(r["gap_ms"], r["timing_score"]) for r in got] == [(None, 0), (None, 0), (None, 0), (5, 60)]


def test_null_chunks_and_odd_names_over_finished_data(spark):
    """A null chunk is empty; a key may be named like a column of the operator's own."""
    rows = [("a", 0, b"1", False), ("a", 1, None, False), ("a", 2, b"2", None), ("a", 3, None, True), ("b", 0, None, True)]
    df = spark.createDataFrame(rows, CHUNKS).selectExpr("key as i", "idx as d", "data as n", "is_last as e")
    got = bodies.buffered(df, "i", "d", "n", "e").orderBy("i").collect()
    assert [(r["i"], r["first"], r["last"], r["size"], bytes(r["body"])) for r in got] == [("a", 0, 3, 2, b"12"), ("b", 0, 0, 0, b"")]


def test_large_chunks_are_joined_in_slices(spark, monkeypatch):
    monkeypatch.setattr(bodies, "SLICE", 64)
    rows = body_rows()
    got = bodies.buffered(spark.createDataFrame(rows, CHUNKS), "key", "idx", "data", "is_last", Config(max_body=100)).collect()
    monkeypatch.undo()
    want = bodies.buffered(spark.createDataFrame(rows, CHUNKS), "key", "idx", "data", "is_last", Config(max_body=100)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
