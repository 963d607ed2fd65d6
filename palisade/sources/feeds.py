"""Feeds of indicators and schema documents, as files that Spark reads.

A feed is kept as snapshots in a shared folder: a refresh writes the entries that were read, with
those of the snapshot before that have not expired, to a table of their own, and then a line of a
log that says so. Readers go by the log, so they never see a table that is half written;
a feed that can't be read leaves an error there, and its last snapshot in use. Streams look each
micro-batch up in what is newest then (`current_sink`)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.intel import parse_feed


@dataclass(frozen=True)
class Feed:
    """Lines of one kind of indicator (ip, domain, url or hash) at a path that Spark can read."""

    name: str
    path: str
    kind: str
    refresh: timedelta = timedelta(hours=1)
    enabled: bool = True

    def due(self, read_at: datetime | None, now: datetime) -> bool:
        return self.enabled and (read_at is None or now - read_at >= self.refresh)

    def read(self, spark: SparkSession) -> DataFrame:
        """key of each entry."""
        return parse_feed(spark.read.text(self.path), self.kind)


# Public feeds by name, address, kind and hours between reads; the first four are used if none is named.
# Their files are fetched to a folder that Spark reads: `mirrored` gives a descriptor that address.
KNOWN = (
    Feed("Feodo Tracker", "https://feodotracker.abuse.ch/downloads/ipblocklist.txt", "ip", timedelta(hours=1)),
    Feed("SSL Blacklist", "https://sslbl.abuse.ch/blacklist/sslipblacklist.txt", "ip", timedelta(hours=1)),
    Feed("URLhaus", "https://urlhaus.abuse.ch/downloads/text/", "url", timedelta(hours=1)),
    Feed("Tor Exit Nodes", "https://www.dan.me.uk/torlist/?exit", "ip", timedelta(hours=1)),
    Feed("Emerging Threats Compromised", "https://rules.emergingthreats.net/blockrules/compromised-ips.txt", "ip", timedelta(days=1)),
    Feed("OpenPhish", "https://openphish.com/feed.txt", "url", timedelta(hours=1)),
)
DEFAULT = KNOWN[:4]

LOG = "name string, kind string, at timestamp, place string, n long, error string"
ENTRIES = "key string, first_seen timestamp, last_seen timestamp"


def mirrored(feeds: Iterable[Feed], folder: str) -> list[Feed]:
    """The feeds as files of a folder, each by its name in lower case with dashes."""
    return [replace(f, path=f"{folder.rstrip('/')}/{f.name.lower().replace(' ', '-')}.txt") for f in feeds]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{folder}/log")
    except PySparkException:  # nothing has been read yet
        return spark.createDataFrame([], LOG)


def feed_status(spark: SparkSession, folder: str) -> DataFrame:
    """name, kind, read_at, place and n of the last good snapshot of each feed, tried_at and error of the last try."""
    good, last = F.col("error").isNull(), F.struct("at", "error")
    rows = _log(spark, folder).groupBy("name").agg(
        F.max_by("kind", "at").alias("kind"), F.max(F.when(good, F.col("at"))).alias("read_at"),
        F.max_by("place", F.when(good, F.col("at"))).alias("place"), F.max_by("n", F.when(good, F.col("at"))).alias("n"), F.max(last).alias("last"),
    )
    return rows.select("name", "kind", "read_at", "place", "n", F.col("last.at").alias("tried_at"), F.col("last.error").alias("error"))


def refresh(spark: SparkSession, feeds: Iterable[Feed], folder: str, now: datetime, expire: timedelta | None = None) -> list[str]:
    """Reads the feeds that are due; their names. An entry that a feed no longer has stays for expire (by
    default it goes at once); an entry without a key, or twice in a feed, is none, or one."""
    known, done = {r["name"]: r for r in feed_status(spark, folder).collect()}, []  # a row a feed
    for feed in feeds:
        before = known.get(feed.name)
        if not feed.due(before["read_at"] if before else None, now):
            continue
        place = f"{folder}/snapshots/{uuid.uuid4().hex}"
        try:
            read = feed.read(spark).where("key is not null").select("key", F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"))
            if before and before["place"]:
                kept = spark.read.schema(ENTRIES).parquet(f"{folder}/{before['place']}")
                read = read.unionByName(kept)
            merged = read.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
            merged.where(F.col("last_seen") >= F.lit(now - (expire or timedelta()))).write.parquet(place)
            n, error = spark.read.schema(ENTRIES).parquet(place).count(), None
        except PySparkException as e:
            n, error = None, str(e).splitlines()[0][:500]
        line = (feed.name, feed.kind, now, None if error else place[len(folder) + 1 :], n, error)
        spark.createDataFrame([line], LOG).coalesce(1).write.mode("append").json(f"{folder}/log")
        done.append(feed.name)
    return done


def current(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """name, kind, key, first_seen, last_seen of the last good snapshots of all feeds (of these kinds)."""
    status = feed_status(spark, folder).where("place is not null")
    parts = [
        spark.read.schema(ENTRIES).parquet(f"{folder}/{r['place']}").select(F.lit(r["name"]).alias("name"), F.lit(r["kind"]).alias("kind"), "key", "first_seen", "last_seen")
        for r in (status.where(F.col("kind").isin(*kinds)) if kinds else status).collect()
    ]
    empty = spark.createDataFrame([], f"name string, kind string, {ENTRIES}")
    for part in parts:
        empty = empty.unionByName(part)
    return empty


def current_sink(folder: str, check: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], *kinds: str):
    """For foreachBatch: gives sink what check(batch, entries) makes of each micro-batch and the newest snapshots, so
    that an entry counts from the batch after its refresh on."""

    def write(batch: DataFrame, number: int) -> None:
        sink(check(batch, current(batch.sparkSession, folder, *kinds)), number)

    return write


def schema_text(spark: SparkSession, path: str | None = None, inline: str | None = None) -> str:
    """A schema document (one small file, or given as text), for palisade.operators.schema."""
    if (path is None) == (inline is None):
        raise ValueError("give a path or a text")
    if inline is not None:
        return inline
    return spark.read.text(path, wholetext=True).first()["value"]
