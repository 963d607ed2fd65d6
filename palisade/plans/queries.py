"""The registered queries: each applies operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.detect import detect
from palisade.operators import anomaly, api, bots, classifier, federated, intel, metrics, schema, scoring, sensitive, supply_chain, text_ml
from palisade.operators.attack_payloads import PAYLOADS
from palisade.plans.requests import decide_requests, is_excluded, split_uri
from palisade.rules import CATALOGUE, load
from palisade.rules.examples import example
from palisade.streaming import bodies


SELECTION = Config(paranoia=4, enabled=("933*", "@sqli-union", "920100-920199", 934104), disabled=(933104, "942113"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core that work on rows is dealt out to.
DEALT = 4


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly where the files make few tasks for the cores there are, as one small file does, or
    one of much repeated text; a table of more splits than that is not shuffled."""
    tasks = DEALT * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def waf_decisions_pages(spark, sf_dir):
    """Block, warn or allow for each page as a request: path, query and body."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = decide_requests(pages, Config(), uri="url", body="html")
    ids = F.array_join(F.transform("detections", lambda d: d["rule_id"].cast("string")), ",")
    return rows.select("page_id", "decision", "score", ids.alias("rule_ids"), F.size("detections").alias("n_detections"))


def header_decisions(spark, sf_dir):
    """Pages as requests with a known payload in one of three headers: decision and response."""
    payloads = list(enumerate(x for texts in PAYLOADS.values() for x in texts))
    # The payloads: a fixed few.
    known = F.broadcast(spark.createDataFrame(payloads, "k int, attack string"))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url").join(known, F.col("page_id") % len(payloads) == F.col("k")))
    headers = F.create_map(F.lit("User-Agent"), F.array("attack", F.lit("curl/8")), F.lit("Cookie"), F.array("url"), F.lit("accept"), F.array(F.lit("*/*")))
    rows = decide_requests(pages.withColumn("headers", headers), Config(paranoia=2), uri="url", headers="headers")
    response = F.col("response")
    return rows.select(
        "page_id", "decision", "score", F.coalesce(response["status"], F.lit(0)).alias("status"),
        F.coalesce(F.try_element_at(response["headers"], F.lit("X-WAF-Rule")), F.try_element_at(response["headers"], F.lit("X-WAF-Detected")), F.lit("")).alias("rules_header"),
        F.coalesce(F.try_element_at(response["headers"], F.lit("X-WAF-Score")), F.lit("")).alias("score_header"),
    )


def rule_hits_by_family(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select(F.explode(detect(F.col("text"), "body", CATALOGUE)).alias("d"))
    return found.groupBy(F.col("d.attack_type").alias("attack_type"), F.col("d.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def score_by_attack_type(spark, sf_dir):
    config = Config(paranoia=2)
    rules = load(config)
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "text"))
    found = rows.select("conv_id", F.explode(detect(F.col("text"), "body", rules)).alias("detection"))
    return scoring.by_category(found, ["conv_id"], rules, config)


def rule_selector_filter(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    found = pages.select(F.explode(detect(F.col("html"), "body", load(SELECTION))).alias("d"))
    return found.groupBy(F.col("d.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def rule_evidence(spark, sf_dir):
    """How often each rule fires on texts written from the rules' own patterns, two for each page."""
    examples = [(k, example(r.pattern)) for k, r in enumerate(CATALOGUE)]
    # One row for each rule.
    known = F.broadcast(spark.createDataFrame(examples, "k int, example string"))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    half = (len(examples) + 1) // 2
    two = pages.select("page_id", "url", F.explode(F.array(F.col("page_id") % half, F.col("page_id") % half + half)).alias("k")).join(known, "k")
    value = F.when(F.col("page_id") % 2 == 0, F.concat("example", F.lit(" "), "url")).otherwise(F.col("example"))
    found = two.select(F.explode(detect(value, "query", CATALOGUE)).alias("d"))
    return found.groupBy(F.col("d.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def exclusion_antijoin(spark, sf_dir):
    config = Config(exclude_paths=("https://m.", "http://m."))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path, query = split_uri(F.col("url"))
    return pages.where(~is_excluded(F.col("url"), config)).select("page_id", path.alias("path"), F.coalesce(query, F.lit("")).alias("query"))


def card_luhn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(sensitive.matches(F.col("text"), sensitive.CARD)).alias("number"))
    return found.where(sensitive.luhn(F.col("number"))).groupBy("doc_id").agg(F.count("*").alias("n_cards"))


def card_brand_mask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(sensitive.matches(F.col("text"), r"\b[0-9]{13,19}\b")).alias("number"))
    n = F.col("number")
    return found.where(sensitive.luhn(n)).select("doc_id", sensitive.card_brand(n).alias("brand"), sensitive.mask_card(n).alias("masked"))


def email_bulk(spark, sf_dir):
    """With a threshold of one address, as documents hold few."""
    docs = table(spark, sf_dir, "documents")
    n = F.size(sensitive.matches(F.col("text"), sensitive.EMAIL))
    return docs.select("doc_id", n.alias("n_emails")).where("n_emails >= 1")


def sensitive_scan(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select(F.explode(sensitive.scan(F.col("text"), bulk=1)).alias("d"))
    return found.groupBy(F.col("d.rule_id").alias("rule_id"), F.col("d.rule_name").alias("rule_name")).agg(F.count("*").alias("n"))


#: A text for each kind of sensitive data, from the patterns themselves where those say it all.
SENSITIVE = (
    "4111111111111111", "5500000000000004", "340000000000009", "6011000000000004", "3530111333300000", "30000000000004", "4111-1111-1111-1111", "5500 0000 0000 0004",
    "4111111111111112", "078-05-1120", "000-12-3456", "123 45 6789",
    *(example(pattern) for _, pattern in sensitive.API_KEYS), *(header for _, header in sensitive.PRIVATE_KEYS), "one@example.org, two@example.org",
)


def _with_examples(spark, sf_dir, examples):
    """doc_id, text: a page's address between two of the examples."""
    known = [(k, x) for k, x in enumerate(examples)]
    # A fixed few.
    left, right = (F.broadcast(spark.createDataFrame(known, f"{k} int, {x} string")) for k, x in (("a", "first"), ("b", "second")))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    both = pages.join(left, F.col("page_id") % len(known) == F.col("a")).join(right, (F.col("page_id") * 7 + 3) % len(known) == F.col("b"))
    return spread(both.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "first", "url", "second").alias("text")))


def sensitive_evidence(spark, sf_dir):
    """Every kind of sensitive data, on texts that hold two of them."""
    found = _with_examples(spark, sf_dir, SENSITIVE).select(F.explode(sensitive.scan(F.col("text"), bulk=2)).alias("d"))
    return found.groupBy(F.col("d.rule_id").alias("rule_id"), F.col("d.rule_name").alias("rule_name")).agg(F.count("*").alias("n"))


def sensitive_detailed(spark, sf_dir):
    rows = _with_examples(spark, sf_dir, SENSITIVE)
    return rows.select("doc_id", F.explode(sensitive.scan_detailed(F.col("text"))).alias("m")).select("doc_id", "m.data_type", F.coalesce("m.detail", F.lit("")).alias("detail"), "m.position")


PATCHED = tuple(example(pattern) for patch in intel.PATCHES for pattern in patch.patterns)


def patch_evidence(spark, sf_dir):
    """Every pattern of every patch, on texts written from them."""
    found = _with_examples(spark, sf_dir, PATCHED).select("doc_id", F.explode(intel.patch_detections(F.col("text"), "query")).alias("d"))
    return found.select("doc_id", F.col("d.rule_id").alias("rule_id"), F.col("d.base_score").alias("base_score"))


def _decided(spark, sf_dir):
    """Events as decided requests."""
    kind = F.col("event_type")
    decision = F.when(kind == "error", "block").when(kind == "signup", "warn").otherwise("allow")
    found = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(t).alias("attack_type")) for i, t in ((942100, "SQL Injection"), (941100, "Cross-Site Scripting"))])
    hits = F.when(kind == "error", found).when(kind == "signup", F.slice(found, 1, 1)).otherwise(F.slice(found, 1, 0))
    return table(spark, sf_dir, "events").select("event_id", "user_id", decision.alias("decision"), hits.alias("detections"), F.floor("value").cast("long").alias("ms"))


def metrics_report(spark, sf_dir):
    """The nested metrics document, section by section."""
    one = metrics.report(_decided(spark, sf_dir), "decision", "ms", "detections", "user_id")
    part = lambda section, rows: F.transform(rows, lambda x: F.struct(F.lit(section).alias("section"), x["name"].alias("name"), x["n"].alias("n")))
    totals = F.array(*[F.struct(F.lit("totals").alias("section"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("requests", "allowed", "warned", "blocked", "detections")])
    listed = [part(c, F.col(c)) for c in ("by_attack_type", "by_rule", "top_offenders")]
    return one.select(F.explode(F.concat(totals, *listed)).alias("r")).select("r.*")


def protocol_report(spark, sf_dir):
    rows = metrics.protocol_report(_decided(spark, sf_dir), "decision", "ms")
    return rows.withColumn("value", F.round("value", 6))


def credential_attempts(spark, sf_dir):
    """Events as logins: their time runs a hundred times faster, some go elsewhere."""
    events = table(spark, sf_dir, "events")
    path = F.when(F.col("event_type") == "view", "/index").when(F.col("event_type") == "click", "/Login/form").otherwise("/api/auth")
    rows = events.select(
        "event_id", F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000).cast("long")).alias("ts"), path.alias("path"),
        (F.col("user_id") % 7).alias("ip"), "user_id", (F.col("event_type") == "purchase").alias("success"),
    )
    found = bots.credential_attempts(rows, "ts", "path", "ip", "user_id", "event_id")
    return found.select("event_id", "ip_failures", "user_failures", F.coalesce("reason", F.lit("none")).alias("reason"))


def script_hashes(spark, sf_dir):
    """Pages as scripts: those from safe addresses are allowed, French ones are known."""
    pages = table(spark, sf_dir, "pages")
    hashed = pages.select("url", supply_chain.integrity(F.col("html"), 256).alias("hash"))
    known = hashed.where(F.contains("url", F.lit("/fr/"))).select("hash", F.col("url").alias("name"))
    found = supply_chain.script_hashes(pages.select("page_id", "html"), "html", hashed.where(F.startswith("url", F.lit("https://"))), known)
    return found.select("page_id", "script_hash", "script_status", F.coalesce("script_name", F.lit("")).alias("script_name"))


def federated_features(spark, sf_dir):
    """The 256 features of every page as a request: its address, two headers and its text."""
    path, query = split_uri(F.col("url"))
    headers = F.array(F.struct(F.lit("Host").alias("name"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("value")), F.struct(F.lit("X-Long-Name").alias("name"), F.substring("url", 1, 20).alias("value")))
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = pages.select("page_id", F.posexplode(federated.request_features(path, query, headers, F.encode("html", "UTF-8"))).alias("i", "value"))
    return rows.select("page_id", "i", F.round(F.col("value").cast("double"), 5).alias("value")).where("value <> 0")


def renyi_epsilon(spark, sf_dir):
    rounds = table(spark, sf_dir, "events").select("event_type", (F.col("value") + 20).alias("sigma"), F.lit(1.0).alias("sensitivity"))
    return federated.renyi_epsilon(rounds, "sigma", "sensitivity", 1e-5, "event_type").withColumn("epsilon", F.round("epsilon", 6))


def latency_histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ms", F.floor("value").cast("long"))
    rows = metrics.histogram(events, "ms", "event_type")
    return rows


def percentile_nearest_rank(spark, sf_dir):
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", "event_id", "event_type")


def top_offenders(spark, sf_dir):
    return metrics.top_offenders(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id")


def counters(spark, sf_dir):
    return metrics.counts(table(spark, sf_dir, "events"), "event_type", "user_id")


def prometheus_export(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ms", F.floor("value").cast("long"))
    rows = metrics.histogram(events, "ms", "event_type").withColumnRenamed("event_type", "type")
    return metrics.prometheus(rows, "waf_latency_ms", "type")


def timing(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    # Events are minutes apart: an hour here stands for a second of traffic.
    shrunk = events.withColumn("ts", F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long")))
    return bots.timed(shrunk, "user_id", "ts", "event_id").select(
        "event_id", F.coalesce("gap_ms", F.lit(-1).cast("long")).alias("gap_ms"), F.coalesce("timing_kind", F.lit("none")).alias("timing_kind"), "timing_score"
    )


def bot_timing(spark, sf_dir):
    """Requests of one browser, told from bots by their timing alone."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    shrunk = events.withColumn("ts", F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000).cast("long")))
    sent = F.create_map(*[F.lit(x) for name in ("Accept", "Accept-Language", "Accept-Encoding", "Connection") for x in (name, "x")])
    rows = bots.timed(shrunk, "user_id", "ts", "event_id").withColumns({"user_agent": F.lit("Mozilla/5.0 (X11) Chrome/120.0 Safari"), "headers": sent, "tls_fingerprint": F.lit(None).cast("string")})
    found = bots.classify(rows)
    ids = F.array_join(F.transform("detections", lambda d: F.concat_ws(":", d["rule_id"], d["matched_value"])), ",")
    return found.select("event_id", "bot_class", "confidence", ids.alias("detections"))


def failure_velocity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"))
    rows = bots.failure_velocity(events, "ts", "user_id", "event_id", limit=3, seconds=86_400)
    return rows.select("event_id", "failures", "velocity_exceeded")


def intel_ip_join(spark, sf_dir):
    """Customers probe the suppliers' reputation: poor suppliers are listed."""
    suppliers = table(spark, sf_dir, "supplier")
    key = lambda c: F.concat_ws(".", F.lit("10"), F.floor(F.col(c) / 65536) % 256, F.floor(F.col(c) / 256) % 256, F.col(c) % 256)
    reputation = suppliers.select(key("s_suppkey").alias("key"), (F.floor(F.abs("s_acctbal")) % 101).cast("int").alias("score"), F.lit("botnet").alias("category"))
    lists = suppliers.where("s_nationkey % 2 = 0").select(key("s_suppkey").alias("key"), F.when(F.col("s_nationkey") % 4 == 0, "tor").otherwise("proxy").alias("list"))
    found = intel.check_ips(table(spark, sf_dir, "customer").select("c_custkey", key("c_custkey").alias("ip")), "ip", reputation, lists)
    rows = found.select("c_custkey", F.explode("detections").alias("d"))
    return rows.select("c_custkey", F.col("d.rule_id").alias("rule_id"), F.col("d.base_score").alias("base_score"))


def intel_domain_join(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain"))
    known = hosts.select("domain").distinct()
    reputation = known.select(F.lower("domain").alias("key"), (F.char_length("domain") * 4).cast("int").alias("score"), F.lit("spam").alias("category"))
    lists = known.where(F.startswith("domain", F.lit("www."))).select(F.lower("domain").alias("key"), F.lit("phishing").alias("list"))
    rows = intel.check_domains(hosts, "domain", reputation, lists).select("page_id", F.explode("detections").alias("d"))
    return rows.select("page_id", F.col("d.rule_id").alias("rule_id"), F.col("d.base_score").alias("base_score"))


def reputation_composite(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    best = suppliers.groupBy(F.col("s_nationkey").alias("nation")).agg(F.max(F.floor(F.abs("s_acctbal")) % 101).cast("int").alias("domain_score"))
    rows = customers.join(best, F.col("c_nationkey") == F.col("nation"), "left")
    ip, behaviour = (F.floor(F.abs("c_acctbal")) % 101).cast("int"), (F.col("c_custkey") % 101).cast("int")
    score = intel.composite_reputation(ip, F.coalesce("domain_score", F.lit(0)), behaviour)
    return rows.select("c_custkey", score.alias("reputation"), intel.risk_band(score).alias("band"))


def virtual_patches(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    # The generated pages hold none of these; the page's script stands in for one payload.
    value = F.concat(F.col("html"), F.when(F.col("page_id") % 7 == 0, F.lit(" ${jndi:ldap://x} () { :;}")).otherwise(F.lit("")))
    found = pages.select("page_id", F.explode(intel.patch_detections(value, "body")).alias("d"))
    return found.select("page_id", F.col("d.rule_id").alias("rule_id"), F.col("d.base_score").alias("base_score"))


def script_patterns(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    body = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", r"track\([0-9]+\);", "eval(atob('eA=='));window.location='http://x';")).otherwise(F.col("html"))
    found = pages.select("page_id", F.explode(supply_chain.response_detections(F.lit("text/html"), body)).alias("d"))
    return found.groupBy("page_id", F.col("d.rule_name").alias("rule_name")).agg(F.count("*").alias("n"))


def sri_sha(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", supply_chain.integrity(F.col("html"), 256).alias("sha256"))


POLICIES = (
    "script-src *", "default-src 'self'; script-src 'unsafe-inline' 'unsafe-eval'", "img-src *", "default-src *", "script-src 'self' *; default-src *",
    "default-src 'none'", "style-src 'unsafe-inline'", "script-src 'self' 'unsafe-eval'", "",
)


def _one_of(texts, n):
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (n % len(texts) + 1).cast("int"))


def csp_issues(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(supply_chain.policy_issues(_one_of(POLICIES, F.col("page_id")))).alias("x"))
    return found.select("page_id", F.col("x.directive").alias("directive"), F.col("x.issue").alias("issue"), F.col("x.severity").alias("severity"))


def ngram_counts(spark, sf_dir):
    rows = text_ml.ngram_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows


#: Prose of one language is about this alike.
ALIKE = 0.3


def jaccard_similarity(spark, sf_dir):
    """Every turn of every conversation against every benchmark item."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    pairs = text_ml.similar_texts(turns, table(spark, sf_dir, "benchmark"), "turn_id", "item_id", "text", ALIKE)
    return pairs.select("turn_id", "item_id", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"))


def _with_payloads(spark, sf_dir):
    """Pages whose query has a known payload in it, changed by the page's number: value."""
    payloads = [(i, x) for i, x in enumerate(x for texts in PAYLOADS.values() for x in texts)]
    # The payloads: a fixed few.
    known = F.broadcast(spark.createDataFrame(payloads, "payload int, attack string"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    joined = pages.join(known, F.col("page_id") % len(payloads) == F.col("payload"))
    own = F.replace("attack", F.lit("1"), F.col("page_id").cast("string"))
    return joined.select("page_id", F.concat(F.col("url"), F.lit("?q="), own, F.when(F.col("page_id") % 3 == 0, F.regexp_extract("url", "^https?://([^/?#]+)", 1)).otherwise(F.lit(""))).alias("uri"))


def ml_similarity(spark, sf_dir):
    rows = _with_payloads(spark, sf_dir)
    value = F.regexp_extract("uri", r"(?s)\?q=(.*)", 1)
    return classifier.closest_payload(rows.select("page_id", value.alias("value")), "page_id", "value").withColumn("similarity", F.round("similarity", 6))


def ml_detections(spark, sf_dir):
    """Detections of the classifier and of known payloads within whole decisions."""
    config = Config(ml_classifier=True, ml_similarity=True)
    rows = decide_requests(_with_payloads(spark, sf_dir), config, uri="uri", key="page_id")
    found = rows.select("page_id", F.explode("detections").alias("d")).where("d.rule_id between 99000 and 99199")
    return found.select("page_id", F.col("d.rule_id").alias("rule_id"), F.col("d.location").alias("location"), F.col("d.base_score").alias("base_score"))


def entropy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(text_ml.entropy(F.col("url")), 6).alias("entropy"))


def _requests(spark, sf_dir):
    """Events as requests: the session's number decides what headers a client sends, the value how long its query is."""
    user, n = F.col("user_id"), F.floor("value").cast("int")
    client = user % 23
    headers = F.map_filter(
        F.create_map(
            F.lit("Host"), F.array(F.lit("h")), F.lit("Accept"), F.array(F.lit("*/*")), F.lit("User-Agent"), F.array(F.lit("u")), F.lit("Cookie"), F.array("props"),
            F.lit("Content-Type"), F.array(F.concat(F.element_at(F.split(F.lit("text/html,application/json,text/plain,image/png"), ","), (client % 4 + 1).cast("int")), F.lit("; q=1"))),
        ),
        lambda name, _: (name == "Host") | (F.pmod(F.crc32(F.encode(F.concat(name, client.cast("string")), "UTF-8")), F.lit(3)) > 0),
    )
    method = F.when(F.col("event_type") == "view", "get").when(user % 29 == 3, "PROPFIND").when(user % 31 == 5, "DELETE").otherwise("POST")
    query = F.concat(F.repeat(F.lit("a=1&"), n), F.when(n % 13 == 7, F.md5("props")).otherwise(F.lit("")), F.lit("b"))
    page = F.when(user % 10 == 0, F.concat(F.lit("/u/"), (user * 7 % 1000).cast("string"), F.lit("/"), (F.col("event_id") % 900).cast("string"))).otherwise(F.concat(F.lit("/"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", page.alias("path"), method.alias("method"), query.alias("query"), headers.alias("headers"))


def fingerprint_anomaly(spark, sf_dir):
    marked = anomaly.fingerprint(_requests(spark, sf_dir), "method", "query", "headers")
    scored = anomaly.scores(marked, "path", "event_id")
    found = anomaly.detections(F.col("anomaly"), threshold=0.3)
    return scored.select("event_id", "samples", F.array_join("factors", ",").alias("factors"), F.round("anomaly", 6).alias("anomaly"), F.coalesce(found["base_score"], F.lit(-1)).alias("base_score"))


def fingerprint_model(spark, sf_dir):
    """A baseline of the first half of all requests, brought up to date with some of the rest, judges all of them."""
    marked = anomaly.fingerprint(_requests(spark, sf_dir), "method", "query", "headers")
    first, later = marked.where("event_id % 4 < 2"), marked.where("event_id % 4 = 2")
    model = anomaly.merged(anomaly.learned(first, "path", "event_id"), anomaly.learned(later, "path", "event_id"))
    found = anomaly.judged(marked, "path", model)
    return found.select("event_id", "samples", F.array_join("factors", ",").alias("factors"), F.round("anomaly", 6).alias("anomaly"))


def long_words():
    """A detector of a user's own: words of twelve letters and more."""
    import re

    from palisade.plugins import Found

    word = re.compile("[a-z]{12,}")

    def detect(value, location):
        found = word.findall(value)
        if found:
            what = {"rule_id": 96100, "rule_name": "Long words", "attack_type": "Protocol Attack", "matched_value": found[0], "base_score": 5}
            yield Found(what, min(20, len(found)), ("long", location), {"last": found[-1]})

    return detect


def plugin_decisions(spark, sf_dir):
    """Turns as bodies, decided on by a table function's detections and what it adds to their score."""
    from palisade.plugins import detected, table_function

    found = detected(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), {"body": F.col("text"), "query": F.col("role")}, table_function(long_words))
    config = Config(block_threshold=20, log_threshold=9)
    score = scoring.total(F.col("plugin_detections"), (), config) + F.col("plugin_adjustment")
    rows = found.withColumn("score", score)
    return rows.select(
        "conv_id", "turn", "score", scoring.decide(F.col("plugin_detections"), F.col("score"), config).alias("decision"),
        F.array_join("plugin_tags", ",").alias("tags"), F.coalesce(F.try_element_at("plugin_metadata", F.lit("last")), F.lit("")).alias("last"),
    )


def _frames(spark, sf_dir):
    """Turns as frames: a conversation's last turn of each run of three is final. A turn without a text is an empty frame."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.encode("text", "UTF-8").alias("data"), F.lit("text").alias("opcode"), (F.col("turn") % 3 == 2).alias("fin"), (F.col("role") == "user").alias("c2s"))


def ws_reassembly(spark, sf_dir):
    found = bodies.messages(_frames(spark, sf_dir), ["conv_id"], "turn", "fin", "data", "opcode")
    return found.select("conv_id", "message", "first", "last", "n_frames", F.octet_length("body").alias("n_bytes"), F.md5("body").alias("body_md5"))


def _attacked(spark, sf_dir):
    """Frames with attacks in some turns, so that bodies have something to find."""
    of = F.col("conv_id") + F.col("turn")
    attack = F.when(of % 5 == 1, " 1 UNION SELECT password FROM users-- <script>alert(1)</script>").when(of % 7 == 2, "; cat /etc/passwd").otherwise("")
    return _frames(spark, sf_dir).withColumn("data", F.concat(F.coalesce("data", F.lit(b"")), F.encode(attack, "UTF-8")))


#: So little that some bodies are too large.
SMALL = Config(paranoia=2, max_body=1500)


def buffered_bodies(spark, sf_dir):
    found = bodies.buffered(_attacked(spark, sf_dir), "conv_id", "turn", "data", "fin", SMALL)
    return found.select("conv_id", "buffer", "first", "last", "size", "too_large", F.md5("body").alias("body_md5"))


def body_decisions(spark, sf_dir):
    """From base64 chunks to decisions."""
    chunks = _attacked(spark, sf_dir).withColumn("data", F.base64("data"))
    found = bodies.decide_bodies(chunks, "conv_id", "turn", "data", "fin", SMALL)
    ids = F.array_join(F.transform("detections", lambda d: d["rule_id"].cast("string")), ",")
    return found.select("conv_id", "last", "score", ids.alias("rule_ids"), "decision")


def response_detections(spark, sf_dir):
    """Pages as response bodies of one chunk: what is found is logged, in a header."""
    chunks = spread(table(spark, sf_dir, "pages").select("page_id", F.base64(F.encode("html", "UTF-8")).alias("data")))
    found = bodies.log_responses(chunks.withColumns({"index": F.lit(0), "fin": F.lit(True)}), "page_id", "index", "data", "fin", Config(paranoia=2, response_inspection=True))
    return found.where("header is not null").select("page_id", "header", F.size("detections").alias("n_detections"))


def stream_overlap_dedup(spark, sf_dir):
    windows = bodies.overlapped(_frames(spark, sf_dir), "conv_id", "turn", "data", 256)
    return windows.select("conv_id", "turn", F.octet_length("window").alias("n_bytes"), F.md5("window").alias("window_md5"))


def early_termination(spark, sf_dir):
    config = Config(paranoia=2, early_threshold=12)
    rows = bodies.inspected(_attacked(spark, sf_dir), "conv_id", "turn", "data", config)
    return rows.select("conv_id", "turn", F.col("detection.rule_id").alias("rule_id"), "score", "running", "stopped")


def gradient_mean(spark, sf_dir):
    return federated.mean(table(spark, sf_dir, "embeddings"), "embedding").withColumn("value", F.round("value", 6))


def gradient_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("w", F.col("label") + 1)
    return federated.weighted_mean(rows, "embedding", "w").withColumn("value", F.round("value", 6))


def gradient_median(spark, sf_dir):
    return federated.median(table(spark, sf_dir, "embeddings"), "embedding").withColumn("value", F.round("value", 6))


def gradient_trimmed(spark, sf_dir):
    return federated.trimmed_mean(table(spark, sf_dir, "embeddings"), "embedding").withColumn("value", F.round("value", 6))


#: So little that most customers are refused an order in between.
BUDGET = (300_000.0, 60.0)


def privacy_budget(spark, sf_dir):
    """Orders spend a budget of their customer: money for epsilon, days for delta."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("double").alias("epsilon"), (F.col("o_orderkey") % 30).cast("double").alias("delta"))
    found = federated.within_budget(rows, "o_orderkey", *BUDGET, by="o_custkey")
    return found.select("o_custkey", "o_orderkey", "within", "epsilon_spent", "delta_spent")


def model_average(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    shared = federated.as_array(federated.mean(rows, "embedding")).select(F.col("values").alias("shared_"))
    by_label = rows.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("local_"))
    # One row on the right: a model's length, however many nodes there are.
    joined = by_label.join(F.broadcast(shared))
    mixed = joined.select("label", F.posexplode(federated.averaged(F.col("local_"), F.col("shared_"))).alias("i", "value"))
    return mixed.withColumn("value", F.round("value", 6))


def gradient_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(federated.sparse(F.col("embedding"), 8)).alias("x"))
    return rows.select("vec_id", F.col("x.i").alias("i"))


def json_depth(spark, sf_dir):
    """Event properties wrapped as deep as their id says."""
    body = F.concat(F.repeat(F.lit('{"a]{":['), (F.col("event_id") % 14).cast("int")), F.col("props"), F.repeat(F.lit("]}"), (F.col("event_id") % 14).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", api.json_depth(body).alias("depth"))


#: Every key that JSON inspection knows, and some that it does not.
KEYS = (
    *(f"${x}" for x in api.NOSQL_OPERATORS), "__proto__", "constructor", "prototype", "isAdmin", "is_admin", "admin", "role", "permissions", "privileges", "password",
    "password_hash", "api_key", "secret", "internal", "_id", "id", "name", "admins", "$", "$Where",
)
JSON_VALUES = ("true", '"admin"', '{"x": "$ne"}', "1", "[[[[[[[[[[[[[[[[[[[[[0]]]]]]]]]]]]]]]]]]]]]")


def json_inspection(spark, sf_dir):
    """Event properties beside a key and a value by the event's number."""
    n = F.col("event_id")
    body = F.concat(F.lit('{"'), _one_of(KEYS, n), F.lit('": '), _one_of(JSON_VALUES, n * 3 + F.col("user_id")), F.lit(', "k2" : '), F.col("props"), F.lit("}"))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(api.json_detections(body)).alias("d"))
    return found.select("event_id", F.col("d.rule_id").alias("rule_id"), F.col("d.base_score").alias("base_score"), F.col("d.matched_value").alias("matched"))


GRAPHQL_PARTS = (
    "name", "__typename", "__schema { types }", "@include @include @INCLUDE @include @include @include @include", "@skip(if: $a) name", '" ; DROP TABLE', '"x<script"', "${{ 1 }}", "$where : 1", "$regex: 1",
    "query a { b } " * 12, '{"query": 1}, ' * 11, "f1 " * 95, 'f2 "quoted words" ' * 60,
)


def graphql_inspection(spark, sf_dir):
    """Nested queries, as deep as an event's user and with a part by its number."""
    n, part = (F.col("user_id") % 13).cast("int"), _one_of(GRAPHQL_PARTS, F.col("event_id"))
    body = F.concat(F.when(F.col("event_type") == "view", "[").otherwise("query q "), F.repeat(F.lit("{ user "), n), part, F.repeat(F.lit(" }"), n))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(api.graphql_detections(body)).alias("d"))
    return found.select("event_id", F.col("d.rule_id").alias("rule_id"), F.col("d.matched_value").alias("matched"))


#: A document with fixed segments beside parameters, and a method that only the latter have.
OPENAPI = {
    "paths": {
        "/users/{id}": {
            "get": {"parameters": [{"in": "path", "name": "id", "required": True, "schema": {"type": "integer"}}, {"in": "query", "name": "full", "schema": {"type": "boolean"}}]},
            "delete": {"parameters": [{"in": "path", "name": "id", "required": True, "schema": {"type": "integer"}}]},
        },
        "/users/me": {"get": {"parameters": [{"in": "header", "name": "X-Token", "required": True, "schema": {"type": "string"}}]}},
        "/orders": {
            "parameters": [{"in": "query", "name": "page", "required": True, "schema": {"type": "integer"}}],
            "get": {"parameters": [{"in": "query", "name": "price", "schema": {"type": "number"}}]},
            "post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Order"}}}}},
        },
    }
}


def openapi_validation(spark, sf_dir):
    """Events as calls: their type is where they go, their number how."""
    k = F.get_json_object("props", "$.k").cast("int")
    value, user = F.round("value", 1).cast("string"), F.col("user_id").cast("string")
    path = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("/users/"), F.when(k % 5 == 0, F.concat(F.lit("u"), user)).otherwise(user)))
        .when(F.col("event_type") == "click", "/users/me").when(F.col("event_type") == "purchase", "/orders").when(F.col("event_type") == "signup", "//orders/")
        .otherwise(F.concat(F.lit("/orders/"), user))
    )
    method = F.element_at(F.array(*map(F.lit, ("get", "POST", "Delete", "GET"))), k % 4 + 1)
    pairs = F.array(
        F.struct(F.lit("full").alias("name"), F.when(k % 3 == 0, "true").when(k % 3 == 1, "yes").alias("value")),
        F.struct(F.lit("page").alias("name"), F.when(k % 7 < 5, F.when(k % 7 == 2, value).otherwise(user)).alias("value")),
        F.struct(F.lit("price").alias("name"), F.when(k % 11 == 3, F.concat(value, F.lit("x"))).otherwise(value).alias("value")),
    )
    query = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), lambda p: F.struct(p["name"], F.array(p["value"]))))
    headers = F.when(k % 2 == 0, F.create_map(F.lit("x-token"), F.array(F.lit("t")))).otherwise(F.expr("cast(map() as map<string,array<string>>)"))
    body = F.when(k % 13 < 4, "").when(k % 13 < 9, F.col("props")).otherwise(F.concat("props", F.lit("}")))
    kind = F.when(k % 17 < 9, "application/json; charset=utf-8").when(k % 17 < 14, "text/plain")
    found = schema.openapi_violations(schema.compile_openapi(OPENAPI), path, method, query, headers, kind, body)
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(schema.enforced(found, {"invalid-content-type": "ignore"})).alias("d"))
    return rows.select("event_id", F.col("d.rule_id").alias("rule_id"), F.col("d.location").alias("location"), F.col("d.matched_value").alias("matched"))


GRAPHQL = """
type Query { view(id: ID!): Item click(id: ID!, at: Int = 1): Item purchase: [Order!]! @deprecated(reason: "old") signup(name: String): Boolean }
type Item { id: ID! name: String! price: Float @deprecated }
type Order { id: ID! item: Item! total(currency: String!): Float }
"""


def graphql_validation(spark, sf_dir):
    """Events as queries of two levels: the type is the field, the number what is asked of it."""
    k = F.get_json_object("props", "$.k").cast("int")
    given = F.when(k % 3 == 0, F.concat(F.lit("(id: "), F.col("user_id").cast("string"), F.lit(")"))).when(k % 3 == 1, '(nme: "x { y }")').otherwise("")
    inner = F.element_at(F.array(*map(F.lit, ("id", "name", "price", "total", 'total(currency: "EUR")', "__typename"))), k % 6 + 1)
    other = F.element_at(F.array(*map(F.lit, ("id", "item", "nope"))), k % 5 % 3 + 1)
    text = F.concat(F.lit("query q { a: "), "event_type", given, F.lit(" { "), inner, F.lit(" , "), other, F.lit(" } # }\n}"))
    body = F.when(k % 10 == 0, F.to_json(F.struct(text.alias("query")))).when(k % 10 == 1, F.concat(text, F.lit(" {"))).otherwise(text)
    rows = spread(table(spark, sf_dir, "events").select("event_id", body.alias("body"))).select("event_id", F.explode(schema.graphql_violations(GRAPHQL, F.col("body"))).alias("d"))
    return rows.select("event_id", F.col("d.rule_id").alias("rule_id"), F.col("d.location").alias("location"), F.col("d.matched_value").alias("matched"))


JWT_HEADS = ('{"alg":"none"}', '{"alg":"HS256"}', '{"typ":"JWT","alg": "HS512"}', '{"alg":"RS256"}', '{"alg": "none"}', '{"alg":"None"}', '{"alg":"nOnE"}', "{é")
JWT_CLAIMS = ("", '"admin":true,', '"role": "admin",', '"is_admin":true,"isAdmin":true,', '"n":"<Script>",', """"n":"' OR 1",""", '"n":"; drop x",', '"admin":false,')


def jwt_inspection(spark, sf_dir):
    """Tokens by the event's number and user; some are cut, or no tokens."""
    n = F.col("event_id")
    url64 = lambda c: F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), "=", "")
    claims = F.concat(F.lit('{"sub":"'), F.col("user_id").cast("string"), F.lit('",'), _one_of(JWT_CLAIMS, F.col("user_id") + n), F.when(n % 2 == 0, '"exp":').otherwise('"exp": '), (n + 1_700_000_000).cast("string"), F.lit("}"))
    token = F.concat(url64(_one_of(JWT_HEADS, n)), F.lit("."), url64(claims), F.when(n % 11 == 4, "").otherwise(".c2ln"))
    header = F.when(n % 5 == 3, F.concat(F.lit(" "), token)).when(n % 5 == 4, F.concat(F.lit("Basic "), "props")).otherwise(F.concat(F.lit("Bearer "), token))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(api.jwt_detections(header, now=1_700_000_500, weak=True, allowed=("RS256", "HS256"))).alias("d"))
    return found.select("event_id", F.col("d.rule_id").alias("rule_id"))


AGENTS = (
    *(f"Some {p.title()}/2.1" for p, _ in bots.GOOD_BOTS), *(f"x {p.upper()} 1.0" for p, *_ in bots.BAD_BOTS), "curl/8.0", "Mozilla/5.0 (X11) Chrome/120.0 Safari", "Mozilla/5.0", "", "  ", None,
    "Wget/1.2", "python-requests/2.0", "my-spider", "Firefox",
)


def bot_classes(spark, sf_dir):
    """Every signature as a user agent, with more and fewer headers and some TLS fingerprints."""
    n, user = F.col("event_id"), F.col("user_id")
    headers = F.map_filter(
        F.create_map(*[x for name in ("Accept", "accept-language", "Accept-Encoding", "Connection") for x in (F.lit(name), F.array(F.lit("x")))]),
        lambda name, _: ((name == "Accept") & (user % 2 == 0)) | ((name == "accept-language") & (user % 3 > 0)) | ((name == "Accept-Encoding") & (user % 5 > 1)) | ((name == "Connection") & (user % 7 > 3)),
    )
    tls = F.when(n % 4 == 0, _one_of([p for p, _ in bots.BAD_TLS], user)).when(n % 4 == 1, F.md5("props"))
    rows = table(spark, sf_dir, "events").select("event_id", _one_of(AGENTS, n).alias("user_agent"), headers.alias("headers"), tls.alias("tls_fingerprint"))
    found = bots.classify(rows)
    ids = F.array_join(F.transform("detections", lambda d: d["rule_id"].cast("string")), ",")
    return found.select("event_id", "bot_class", "confidence", ids.alias("rule_ids"))


def ml_classify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", split_uri(F.col("url"))[1].alias("query")).where("query is not null")
    return classifier.classify(pages, "page_id", "query").withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        waf_decisions_pages, header_decisions, rule_hits_by_family, score_by_attack_type, rule_selector_filter, rule_evidence, exclusion_antijoin, card_luhn, card_brand_mask,
        email_bulk, sensitive_scan, sensitive_evidence, sensitive_detailed, patch_evidence, metrics_report, protocol_report, credential_attempts, script_hashes, federated_features, renyi_epsilon, latency_histogram, percentile_nearest_rank, top_offenders, counters, prometheus_export, timing, bot_timing,
        failure_velocity, intel_ip_join, intel_domain_join, reputation_composite, virtual_patches, script_patterns, sri_sha, csp_issues,
        ngram_counts, jaccard_similarity, ml_similarity, ml_detections, entropy, fingerprint_anomaly, fingerprint_model, plugin_decisions, ws_reassembly, buffered_bodies, body_decisions, response_detections, stream_overlap_dedup,
        early_termination, gradient_mean, gradient_weighted, gradient_median, gradient_trimmed, privacy_budget, model_average, gradient_topk, json_depth, json_inspection,
        graphql_inspection, openapi_validation, graphql_validation, jwt_inspection, bot_classes, ml_classify,
    )
}
