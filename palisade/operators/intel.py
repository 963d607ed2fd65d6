"""Threat intelligence: reputation and indicator lookups as joins, feeds, patches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.binding import fresh
from palisade.model import DETECTIONS, detection, only
from palisade.rules import java_pattern

LOG_THRESHOLD = 50

# Rule id, name, base score and tags of each membership list.
IP_LISTS = {
    "tor": (94001, "Tor Exit Node", 4, ("intel", "tor", "anonymizer")),
    "proxy": (94002, "Known Proxy IP", 3, ("intel", "proxy")),
    "vpn": (94003, "VPN Endpoint", 2, ("intel", "vpn")),
}
DOMAIN_LISTS = {
    "phishing": (94101, "Known Phishing Domain", 9, ("intel", "phishing")),
    "c2": (94102, "Known C2 Domain", 10, ("intel", "c2", "malware")),
    "new": (94103, "Newly Registered Domain", 3, ("intel", "new-domain")),
}
INDICATORS = {
    "url": (94200, "Known Malicious URL", 9, ("intel", "ioc", "malicious-url"), "url"),
    "hash": (94201, "Known Malicious File Hash", 10, ("intel", "ioc", "malware"), "file_hash"),
}
SEVERITY_BASE = {"Critical": 10, "High": 8, "Medium": 5, "Low": 3, "Info": 1}


def _listed(rows: DataFrame, key: str, lists: DataFrame, into: str) -> DataFrame:
    """rows with, as column `into`, the names of the lists (key, list) that hold the key. Spark
    picks the join; dimension tables are as large as their feeds."""
    (at,) = fresh(rows, "__listed")
    by_key = lists.groupBy(F.col("key").alias(at)).agg(F.collect_set("list").alias(into))
    return rows.join(by_key, F.col(key) == F.col(at), "left").drop(at)


def _check(rows: DataFrame, key: str, reputation: DataFrame, lists: DataFrame, table: dict, first: tuple, location: str, lower: bool) -> DataFrame:
    """reputation: key, score, category; lists: key, list. A key is in reputation once."""
    lookup, at, score, category, listed = fresh(rows, "__lookup", "__key", "__score", "__category", "__lists")
    rows = rows.withColumn(lookup, F.lower(key) if lower else F.col(key))
    known = reputation.select(F.col("key").alias(at), F.col("score").alias(score), F.col("category").alias(category))
    rows = _listed(rows.join(known, F.col(lookup) == F.col(at), "left"), lookup, lists, listed)
    rule_id, name, tags = first
    bad = detection(rule_id, F.concat(F.lit(name), F.col(category)), "Reconnaissance", F.col(key), location, F.floor(F.col(score) / 10), tags)
    member = [
        F.when(F.array_contains(listed, which), detection(i, n, "Reconnaissance", F.col(key), location, base, t))
        for which, (i, n, base, t) in table.items()
    ]
    found = only(F.when(F.col(score) >= LOG_THRESHOLD, bad), *member)
    return rows.withColumn("detections", found).drop(lookup, at, score, category, listed)


def check_ips(rows: DataFrame, key: str, reputation: DataFrame, lists: DataFrame) -> DataFrame:
    return _check(rows, key, reputation, lists, IP_LISTS, (94000, "Malicious IP: ", ("intel", "ip-reputation")), "source_ip", False)


def check_domains(rows: DataFrame, key: str, reputation: DataFrame, lists: DataFrame) -> DataFrame:
    return _check(rows, key, reputation, lists, DOMAIN_LISTS, (94100, "Malicious Domain: ", ("intel", "domain-reputation")), "domain", True)


def check_indicators(rows: DataFrame, key: str, kind: str, indicators: DataFrame) -> DataFrame:
    """kind: url or hash; exact and case-sensitive."""
    rule_id, name, base, tags, location = INDICATORS[kind]
    (at,) = fresh(rows, "__key")
    known = indicators.select(F.col("key").alias(at)).distinct()
    found = only(F.when(F.col(at).isNotNull(), detection(rule_id, name, "Reconnaissance", F.col(key), location, base, tags)))
    return rows.join(known, F.col(key) == F.col(at), "left").withColumn("detections", found).drop(at)


def composite_reputation(ip: Column, domain: Column, behaviour: Column) -> Column:
    return F.floor((40 * ip + 30 * domain + 30 * behaviour) / 100).cast("int")


def risk_band(score: Column, high: int = 70, medium: int = 40) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


@dataclass(frozen=True)
class Patch:
    id: str
    cve: str
    name: str
    patterns: tuple[str, ...]
    cvss: float
    severity: str
    expires: datetime | None = None
    active: bool = True

    @property
    def rule_id(self) -> int:
        number = self.id.removeprefix("VP-")
        return int(number) if self.id.startswith("VP-") and number.isdecimal() else 93000


# The built-in patches.
PATCHES = (
    Patch("VP-93700", "CVE-2021-44228", "Log4Shell RCE", (
        r"(?i)\$\{jndi:",
        r"(?i)\$\{j\$\{[^\}]*\}ndi:",
        r"(?i)\$\{\$\{[^\}]*\}j\$\{[^\}]*\}n\$\{[^\}]*\}d\$\{[^\}]*\}i:",
        r"(?i)\$\{(\$\{[^\}]*\}|[jJ]|\$\{[^\}]*\})+ndi:",
        r"(?i)\$\{\$\{[^\}]*j\}\$\{[^\}]*n\}\$\{[^\}]*d\}\$\{[^\}]*i\}:",
    ), 10.0, "Critical"),
    Patch("VP-93701", "CVE-2022-22965", "Spring4Shell RCE", (r"(?i)class\.module\.classLoader", r"(?i)class\["), 9.8, "Critical"),
    Patch("VP-93702", "CVE-2022-42889", "Text4Shell RCE", (r"(?i)\$\{script:", r"(?i)\$\{dns:", r"(?i)\$\{url:"), 9.8, "Critical"),
    Patch("VP-93703", "CVE-2017-5638", "Apache Struts RCE", (r"(?i)%\{[^}]*\}", r"(?i)\$\{[^}]*getRuntime[^}]*\}"), 10.0, "Critical"),
    Patch("VP-93704", "CVE-2014-6271", "Shellshock", (r"\(\s*\)\s*\{", r"(?i)%28%29%20%7B"), 9.8, "Critical"),
    Patch("VP-93500", "CVE-2013-0235", "WordPress XML-RPC Abuse", (
        r"(?i)<methodName>pingback\.ping</methodName>",
        r"(?i)<methodName>system\.multicall</methodName>",
    ), 5.0, "Medium"),
)


def patch_detections(value: Column, location: str, patches=PATCHES, now: datetime | None = None) -> Column:
    """One detection for each active patch of which any pattern matches."""
    live = [p for p in patches if p.active and (p.expires is None or now is None or p.expires > now)]
    if not live:
        return F.expr(f"cast(array() as {DETECTIONS})")

    def of(patch: Patch) -> Column:
        hit = reduce(Column.__or__, [value.rlike(java_pattern(x)) for x in patch.patterns])
        tags = ("vpatching", patch.cve, patch.severity.lower())
        matched = f"Virtual patch match: {patch.id}"
        return F.when(hit, detection(patch.rule_id, f"{patch.cve}: {patch.name}", "RemoteCodeExecution", matched, location, SEVERITY_BASE[patch.severity], tags))

    return only(*[of(p) for p in live])


def patches_by_cve(patches, cve: str) -> list[Patch]:
    return [p for p in patches if p.cve == cve]


def added(table: DataFrame, *more: DataFrame) -> DataFrame:
    """A reputation table (key, score, category) or a list (key, list) with more entries; of equal keys (and lists) the last counts."""
    parts = [t.withColumn("__age", F.lit(-i)) for i, t in enumerate((table, *more))]
    same = ["key", *(["list"] if "list" in table.columns else [])]
    others = [c for c in table.columns if c not in same]
    rows = reduce(DataFrame.unionByName, parts).groupBy(*same)
    if not others:
        return rows.agg(F.first("__age")).select(*same)
    return rows.agg(F.min_by(F.struct(*others), "__age").alias("x")).select(*same, *[f"x.{c}" for c in others]).select(*table.columns)


def entry_counts(**tables: DataFrame) -> DataFrame:
    """name and n of each table, and of each list in it."""
    rows = [t.select(F.concat_ws(":", F.lit(name), *(["list"] if "list" in t.columns else [])).alias("name")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.count("*").alias("n"))


#: Valid lengths of hexadecimal digests in a feed.
HASH_LENGTHS = (32, 40, 64)


def parse_feed(lines: DataFrame, kind: str) -> DataFrame:
    """key of each entry of a feed (column value): kind ip, domain, url or hash."""
    key = F.trim("value")
    rows = lines.select(key.alias("key")).where((F.col("key") != "") & ~F.startswith("key", F.lit("#")))
    if kind == "domain":
        return rows.select(F.lower("key").alias("key"))
    if kind == "url":
        return rows.where(F.startswith("key", F.lit("http://")) | F.startswith("key", F.lit("https://")))
    if kind == "hash":
        return rows.where(F.octet_length("key").isin(*HASH_LENGTHS)).select(F.lower("key").alias("key"))
    if kind == "ip":
        return rows
    raise ValueError(f"unknown feed: {kind}")
