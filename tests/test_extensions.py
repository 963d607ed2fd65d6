"""Feeds that refresh, and detectors as table functions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palisade.operators import intel
from palisade.plugins import Found, detected, table_function
from palisade.sources import feeds

NOW = datetime(2024, 5, 1, 12)


def keys(spark, folder, *kinds):
    return sorted((r["name"], r["key"]) for r in feeds.current(spark, folder, *kinds).collect())


def test_feeds_refresh_when_due_and_keep_what_has_not_expired(spark, tmp_path):
    folder, source = str(tmp_path / "kept"), tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("# list\n10.0.0.1\n10.0.0.2\n10.0.0.2\n\n")
    own = [feeds.Feed("a", str(source / "a.txt"), "ip"), feeds.Feed("gone", str(source / "none.txt"), "url"), feeds.Feed("off", str(source / "a.txt"), "ip", enabled=False)]
    assert keys(spark, folder) == []
    assert feeds.refresh(spark, own, folder, NOW) == ["a", "gone"]
    assert keys(spark, folder) == [("a", "10.0.0.1"), ("a", "10.0.0.2")] and keys(spark, folder, "url") == []
    status = {r["name"]: r for r in feeds.feed_status(spark, folder).collect()}
    assert status["a"]["n"] == 2 and status["a"]["error"] is None and status["gone"]["error"] and status["gone"]["read_at"] is None
    (source / "a.txt").write_text("10.0.0.2\n10.0.0.3\n")
    # Not due before its hour is over; the one that failed is tried again.
    assert feeds.refresh(spark, own, folder, NOW + timedelta(minutes=30)) == ["gone"]
    assert feeds.refresh(spark, own, folder, NOW + timedelta(hours=1), expire=timedelta(hours=2)) == ["a", "gone"]
    assert [k for _, k in keys(spark, folder)] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
    seen = {r["key"]: (r["first_seen"], r["last_seen"]) for r in feeds.current(spark, folder).collect()}
    assert seen["10.0.0.2"] == (NOW, NOW + timedelta(hours=1)) and seen["10.0.0.1"][1] == NOW
    (source / "a.txt").unlink()  # a feed that fails keeps its last snapshot
    assert feeds.refresh(spark, own[:1], folder, NOW + timedelta(hours=2)) == ["a"] and len(keys(spark, folder)) == 3
    (source / "a.txt").write_text("10.0.0.3\n")
    feeds.refresh(spark, own[:1], folder, NOW + timedelta(hours=4), expire=timedelta(hours=2))
    assert [k for _, k in keys(spark, folder)] == ["10.0.0.3"]


def test_known_feeds_are_mirrored():
    assert len(feeds.KNOWN) == 6 and [f.name for f in feeds.DEFAULT] == ["Feodo Tracker", "SSL Blacklist", "URLhaus", "Tor Exit Nodes"]
    assert feeds.mirrored(feeds.DEFAULT, "/m/")[3].path == "/m/tor-exit-nodes.txt"


def test_the_next_batch_sees_an_entry_that_was_added(spark, tmp_path):
    folder, source, arrivals, got = str(tmp_path / "kept"), tmp_path / "urls.txt", tmp_path / "arrivals", []
    arrivals.mkdir()
    feed = feeds.Feed("urls", str(source), "url", timedelta(0))
    rows = spark.readStream.schema("id long, url string").parquet(str(arrivals))
    check = lambda batch, entries: intel.check_indicators(batch, "url", "url", entries)
    sink = feeds.current_sink(folder, check, lambda df, _: got.append({r["id"]: len(r["detections"]) for r in df.collect()}), "url")
    made = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(sink)
    for number, text in enumerate(["http://bad/1\n", "http://bad/1\nhttp://bad/2\n"]):
        source.write_text(text)
        feeds.refresh(spark, [feed], folder, NOW + timedelta(hours=number))
        spark.createDataFrame([(1, "http://bad/1"), (2, "http://bad/2"), (3, None)], "id long, url string").coalesce(1).write.mode("append").parquet(str(arrivals))
        made.start().awaitTermination()
    assert got == [{1: 1, 2: 0, 3: 0}, {1: 1, 2: 1, 3: 0}]


def repeats():
    """A detector that counts words said three times in a row."""

    def detect(value, location):
        words = value.split()
        for a, b, c in zip(words, words[1:], words[2:]):
            if a == b == c:
                yield Found({"rule_id": 96001, "rule_name": "Repeats", "attack_type": "Protocol Attack", "matched_value": a, "base_score": 4}, 3, ("repeat", location), {"word": a})

    return detect


def shouting():
    def detect(value, location):
        if value.isupper():
            yield Found({"rule_id": 96002, "rule_name": "Shouts", "attack_type": "Protocol Attack", "matched_value": value, "base_score": 1, "tags": ["loud"]}, metadata={"word": "-"})
        elif value:
            yield Found(adjustment=-1)

    return detect


def test_detectors_as_table_functions(spark):
    rows = spark.createDataFrame([(1, "a a a b", "X"), (2, "NO NO NO", None), (3, None, None), (4, "", "fine"), (4, "", "fine")], "detections int, body string, query string")
    both = [table_function(repeats), table_function(shouting)]
    values = {"body": F.col("body"), "query": F.col("query")}
    found = detected(rows, values, *both)
    assert found.columns == ["detections", "body", "query", "plugin_detections", "plugin_adjustment", "plugin_tags", "plugin_metadata"]
    got = sorted((r["detections"], [(d["rule_id"], d["location"], d["tags"]) for d in r["plugin_detections"]], r["plugin_adjustment"], r["plugin_tags"], r["plugin_metadata"]) for r in found.collect())
    assert got == [
        (1, [(96001, "body", []), (96002, "query", ["loud"])], 2, ["body", "repeat"], {"word": "-"}), (2, [(96001, "body", []), (96002, "body", ["loud"])], 3, ["body", "repeat"], {"word": "-"}),
        (3, [], 0, [], {}), (4, [], -1, [], {}), (4, [], -1, [], {}),
    ]
    skipped = detected(rows, values, *both, skip_remaining=True)
    assert {r["detections"]: len(r["plugin_detections"]) for r in skipped.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert detected(rows.where("false"), values, *both).count() == 0 and detected(rows, values).count() == 5
