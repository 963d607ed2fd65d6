"""Bots: user agents, headers, TLS fingerprints and request timing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.binding import fresh

from palisade.model import detection, only, truncated

# Patterns in the order in which they are tried, names and scores.
GOOD_BOTS = (
    ("googlebot", "Googlebot"), ("bingbot", "Bingbot"), ("slurp", "Yahoo Slurp"), ("duckduckbot", "DuckDuckBot"),
    ("baiduspider", "Baidu Spider"), ("yandexbot", "YandexBot"), ("facebookexternalhit", "Facebook Crawler"),
    ("twitterbot", "Twitter Bot"), ("linkedinbot", "LinkedIn Bot"), ("applebot", "Apple Bot"), ("pingdom", "Pingdom Monitor"),
    ("uptimerobot", "UptimeRobot"), ("statuspage", "StatusPage"), ("site24x7", "Site24x7"), ("newrelic", "New Relic"), ("datadog", "Datadog"),
)
BAD_BOTS = (
    ("nikto", "Nikto Scanner", 80), ("sqlmap", "SQLMap", 90), ("nmap", "Nmap", 70), ("masscan", "Masscan", 75),
    ("nuclei", "Nuclei Scanner", 70), ("wpscan", "WPScan", 70), ("acunetix", "Acunetix", 75), ("nessus", "Nessus", 70),
    ("openvas", "OpenVAS", 70), ("burp", "Burp Suite", 60), ("zap/", "OWASP ZAP", 60), ("dirbuster", "DirBuster", 70),
    ("gobuster", "Gobuster", 70), ("ffuf", "FFUF", 70), ("wfuzz", "WFuzz", 70), ("hydra", "Hydra", 85), ("metasploit", "Metasploit", 90),
    ("scrapy", "Scrapy", 60), ("httrack", "HTTrack", 65), ("hacker", "Hacker UA", 70), ("attack", "Attack UA", 80),
    ("exploit", "Exploit UA", 85), ("inject", "Inject UA", 75),
)
SUSPICIOUS = (
    ("(?i)wget/", "Wget", 25), ("(?i)curl/", "Curl", 20), ("(?i)python-requests", "Python Requests", 25),
    ("(?i)python-urllib", "Python urllib", 30), ("(?i)libwww-perl", "Perl LWP", 35), ("(?i)java/", "Java HTTP Client", 25),
    ("(?i)go-http-client", "Go HTTP Client", 25), ("(?i)headless", "Headless Browser", 30), ("(?i)phantom", "PhantomJS", 40),
    ("(?i)selenium", "Selenium", 35), ("(?i)puppeteer", "Puppeteer", 35), ("(?i)playwright", "Playwright", 35),
    (r"Chrome/[0-3]\.", "Very Old Chrome", 50), (r"Firefox/[0-3]\.", "Very Old Firefox", 50), (r"MSIE [0-6]\.", "Ancient IE", 60),
    (r"^[A-Za-z]+\z", "Single Word UA", 40), (r"^Mozilla/5\.0\z", "Bare Mozilla UA", 45), ("(?i)bot|spider|crawl", "Generic Bot Pattern", 25),
)
BAD_TLS = (
    ("9e10692f1b7f78228b2d4e424db3a98c", "Python Requests"),
    ("555f387c53527b55cf46b75bb1a7d78a", "Curl"),
    ("e7d705a3286e19ea42f587b344ee6865", "Go HTTP"),
    ("6734f37431670b3ab4292b8f60f29984", "Nmap"),
    ("a0e9f5d64349fb13f0ab94cc128e78f5", "Metasploit"),
)
BROWSERS = ("mozilla", "chrome", "safari", "firefox", "edge")
#: Timing, in milliseconds and requests.
TOO_FAST_MS, VERY_FAST_MS, WINDOW_MS, KEPT = 100, 10, 60_000, 100
LEAST_INTERVALS, REGULAR_STDDEV_MS, REGULAR_MEAN_MS, BURST = 5, 50, 5000, 50


def user_agent_class(agent: Column) -> Column:
    """struct(kind, name, score): good, bad, suspicious or unknown; the first pattern that fits."""
    made = lambda kind, name, score: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(score).alias("score"))
    low = F.lower(agent)
    tried = [F.when(F.contains(low, F.lit(p)), made("good", name, 0)) for p, name in GOOD_BOTS]
    tried += [F.when(F.contains(low, F.lit(p)), made("bad", name, score)) for p, name, score in BAD_BOTS]
    tried += [F.when(agent.rlike(p), made("suspicious", name, score)) for p, name, score in SUSPICIOUS]
    return F.coalesce(*tried, made("unknown", None, 0))


def header_anomalies(headers: Column, agent: Column) -> Column:
    """array<struct(reason, score)>; a name counts as given or in lower case."""
    lacks = lambda name: ~F.map_contains_key(headers, name) & ~F.map_contains_key(headers, name.lower())
    low = F.lower(F.coalesce(agent, F.lit("")))
    browser = low.rlike("|".join(BROWSERS))
    made = lambda reason, score: F.struct(F.lit(reason).alias("reason"), F.lit(score).alias("score"))
    return only(
        F.when(lacks("Accept"), made("Missing Accept header", 15)),
        F.when(lacks("Accept-Language"), made("Missing Accept-Language header", 10)),
        F.when(browser & lacks("Accept-Encoding"), made("Browser UA without Accept-Encoding", 20)),
        F.when(browser & lacks("Connection"), made("Browser UA without Connection header", 10)),
    )


def timed(requests: DataFrame, source: str, ts: str, order: str) -> DataFrame:
    """requests with gap_ms, timing_kind and timing_score.

    One shuffle by source; of the KEPT latest requests those of the last minute count, so
    that a flood of requests costs no more than KEPT each."""
    by_source = Window.partitionBy(source).orderBy(F.col(ts), F.col(order))
    at, kept, steps, mean = fresh(requests, "__at", "__kept", "__steps", "__mean")
    rows = requests.withColumn(at, F.unix_millis(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("gap_ms", F.col(at) - F.lag(at).over(by_source))
    latest = F.collect_list(at).over(by_source.rowsBetween(-KEPT + 1, 0))
    rows = rows.withColumn(kept, latest).withColumn(kept, F.filter(kept, lambda x: x > F.col(at) - WINDOW_MS))
    # Without a time a request has no gaps, and counts for none.
    between = F.zip_with(F.slice(kept, 2, KEPT), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), lambda x, y: x - y)
    rows = rows.withColumn(steps, between)
    n, size = F.size(steps), F.size(kept)
    rows = rows.withColumn(mean, F.expr(f"aggregate({steps}, 0L, (a, x) -> a + x) div greatest(size({steps}), 1)"))
    variance = F.expr(f"aggregate({steps}, 0L, (a, x) -> a + (x - {mean}) * (x - {mean})) div greatest(size({steps}), 1)")
    stddev = F.floor(F.sqrt(variance.cast("double")))
    regular = (n >= LEAST_INTERVALS) & (stddev < REGULAR_STDDEV_MS) & (F.col(mean) < REGULAR_MEAN_MS)
    fast = F.col("gap_ms") < TOO_FAST_MS
    kind = F.when(fast, "too-fast").when(regular, "regular").when(size >= BURST, "burst")
    score = F.when(F.col("gap_ms") < VERY_FAST_MS, 60).when(fast, 40).when(regular, 45).when(size >= BURST, 50).otherwise(0)
    return rows.withColumn("timing_kind", kind).withColumn("timing_score", score).drop(at, kept, steps, mean)


def timing_of(gap: int | None, kept: list[int]) -> tuple[str | None, int]:
    """timing_kind and timing_score of one request: the time since the one before, and the times of the
    last minute, this one included. For streams, which have them as state."""
    if gap is not None and gap < TOO_FAST_MS:
        return "too-fast", 60 if gap < VERY_FAST_MS else 40
    steps = [b - a for a, b in zip(kept, kept[1:])]
    if len(steps) >= LEAST_INTERVALS:
        mean = sum(steps) // len(steps)
        variance = sum((x - mean) ** 2 for x in steps) // len(steps)
        if math.isqrt(variance) < REGULAR_STDDEV_MS and mean < REGULAR_MEAN_MS:
            return "regular", 45
    return ("burst", 50) if len(kept) >= BURST else (None, 0)


def classify(requests: DataFrame, agent: str = "user_agent", headers: str = "headers", tls: str = "tls_fingerprint") -> DataFrame:
    """requests with bot_class, confidence and detections. Good bots are let through unseen.

    With a column timing_score (of timed()) timing counts, too."""
    kind, odd = fresh(requests, "__kind", "__odd")
    ua, known = F.col(agent), F.col(kind)
    rows = requests.withColumn(kind, user_agent_class(ua)).withColumn(odd, header_anomalies(F.col(headers), ua))
    tool = F.coalesce(*[F.when(F.col(tls) == print_, name) for print_, name in BAD_TLS])
    timing = F.col("timing_score") if "timing_score" in requests.columns else F.lit(0)
    ua_score = (
        F.when(ua.isNull(), 40).when(F.trim(ua) == "", 30).otherwise(known["score"])
    )
    odd_score = F.aggregate(odd, F.lit(0), lambda a, x: a + x["score"])
    confidence = F.least(F.lit(255), ua_score + odd_score + timing + F.when(tool.isNotNull(), 50).otherwise(0))
    shown = truncated(F.coalesce(ua, F.lit("")), 100)
    found = F.concat(
        only(
            F.when(ua.isNull(), detection(97004, "Missing User-Agent", "ScannerDetection", "", "header:User-Agent", 6, ("bot", "missing-ua"))),
            F.when(F.trim(ua) == "", detection(97003, "Empty User-Agent", "ScannerDetection", "", "header:User-Agent", 5, ("bot", "empty-ua"))),
            F.when(known["kind"] == "bad", detection(97001, F.concat(F.lit("Bad Bot Signature: "), known["name"]), "ScannerDetection", shown, "header:User-Agent", 6, ("bot", "signature"))),
            F.when(known["kind"] == "suspicious", detection(97002, F.concat(F.lit("Suspicious Bot: "), known["name"]), "ScannerDetection", shown, "header:User-Agent", 4, ("bot", "suspicious"))),
        ),
        F.transform(odd, lambda x: detection(97100, F.concat(F.lit("Header Anomaly: "), x["reason"]), "ScannerDetection", x["reason"], "headers", 4, ("bot", "header-anomaly"))),
        only(
            F.when(timing > 0, detection(97101, "Request Timing Anomaly", "ScannerDetection", timing.cast("string"), "timing", 5, ("bot", "timing"))),
            F.when(tool.isNotNull(), detection(97102, "TLS Fingerprint Anomaly", "ScannerDetection", F.col(tls), "tls", 5, ("bot", "tls-fingerprint"))),
        ),
    )
    good = F.coalesce(known["kind"] == "good", F.lit(False))
    verdict = F.when(good, "good-bot").when(confidence >= 70, "bad-bot").when(confidence >= 30, "unknown").otherwise("human")
    rows = rows.withColumn("bot_class", verdict).withColumn("confidence", F.when(good, 0).otherwise(confidence))
    return rows.withColumn("detections", F.when(good, F.slice(found, 1, 0)).otherwise(found)).drop(kind, odd)


def failure_velocity(attempts: DataFrame, ts: str, key: str, order: str, limit: int, seconds: int = 300) -> DataFrame:
    """attempts with failures (of this key within the window, this one included) and velocity_exceeded.

    Attempts of the same millisecond count in their order. A failure is a row twice: when it comes, and when it
    no longer counts, in the span of `seconds` after its own. What counts is a running sum within a key's span,
    so that a hot key is as many groups as it has spans, and none is looked through again for each attempt."""
    at, kind, span = fresh(attempts, "__at", "__kind", "__span")
    width = seconds * 1000
    failed = ~F.col("success")
    # 1 comes and counts, 0 comes and does not, -1 (first at its time) no longer counts.
    rows = attempts.withColumn(kind, F.explode(F.when(failed & F.col(ts).isNotNull(), F.array(F.lit(1), F.lit(-1))).when(failed, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))))
    ends = F.col(kind) < 0
    rows = rows.withColumn(at, F.unix_millis(F.col(ts).cast("timestamp")) + F.when(ends, width).otherwise(0)).withColumn(span, F.floor(F.col(at) / width))
    whole = Window.partitionBy(key, span)
    sofar = whole.orderBy(at, ~ends, order).rowsBetween(Window.unboundedPreceding, 0)
    # All that end within a span still count at its beginning.
    rows = rows.withColumn("failures", F.sum(kind).over(sofar) + F.count_if(ends).over(whole)).where(~ends)
    return rows.withColumn("velocity_exceeded", F.col("failures") >= limit).drop(at, kind, span)


#: Where logins are tried, and the failures that a source and a user may have within the window.
LOGIN_PATHS = ("/login", "/signin", "/auth", "/api/login", "/api/auth", "/oauth/token")
IP_FAILURES, USER_FAILURES, FAILURE_SECONDS = 10, 5, 300


def on_login_path(path: Column, paths: tuple[str, ...] = LOGIN_PATHS) -> Column:
    return reduce(Column.__or__, [F.startswith(F.lower(path), F.lit(p)) for p in paths])


def credential_attempts(attempts: DataFrame, ts: str, path: str, ip: str, user: str, order: str, paths: tuple[str, ...] = LOGIN_PATHS) -> DataFrame:
    """Attempts (with a column success) on a login path, with ip_failures, user_failures, stuffing
    and the reason: too many failures of one source, or for one user, within the window."""
    tried = attempts.where(on_login_path(F.col(path), paths))
    of_ip = failure_velocity(tried, ts, ip, order, IP_FAILURES, FAILURE_SECONDS).drop("velocity_exceeded").withColumnRenamed("failures", "ip_failures")
    both = failure_velocity(of_ip, ts, user, order, USER_FAILURES, FAILURE_SECONDS).drop("velocity_exceeded").withColumnRenamed("failures", "user_failures")
    reason = F.when(F.col("ip_failures") >= IP_FAILURES, "ip").when(F.col("user_failures") >= USER_FAILURES, "user")
    return both.withColumn("stuffing", reason.isNotNull()).withColumn("reason", reason)
