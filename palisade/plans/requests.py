"""From requests to decisions: locate, detect, score, decide, respond."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions.binding import fresh
from palisade.functions.detect import detect
from palisade.model import DETECTIONS, only
from palisade.operators import anomaly, classifier, scoring
from palisade.rules import Rule, excluded_ids, load


def split_uri(uri: Column) -> tuple[Column, Column]:
    """The path, and the query after the first question mark (null without one)."""
    at = F.locate("?", uri)
    return F.when(at > 0, F.left(uri, at - 1)).otherwise(uri), F.when(at > 0, F.substring(uri, at + 1, F.char_length(uri)))


def is_excluded(uri: Column, config: Config) -> Column:
    """A prefix of the whole URI, query included."""
    return reduce(Column.__or__, [F.startswith(uri, F.lit(p)) for p in config.exclude_paths], F.lit(False))


def request_detections(uri: Column, headers: Column | None, rules: tuple[Rule, ...], body: Column | None = None) -> Column:
    """Detections of path, query, each header value by lower-cased name, then body."""
    path, query = split_uri(uri)
    found = [detect(path, "path", rules), detect(query, "query", rules)]
    if headers is not None:
        pairs = F.array_sort(F.map_entries(headers), lambda a, b: F.when(F.lower(a["key"]) < F.lower(b["key"]), -1).when(F.lower(a["key"]) > F.lower(b["key"]), 1).otherwise(0))
        of_one = lambda pair: F.flatten(F.transform(pair["value"], lambda v: detect(v, F.concat(F.lit("header:"), pair["key"]), rules)))
        found.append(F.coalesce(F.flatten(F.transform(pairs, of_one)), F.expr(f"cast(array() as {DETECTIONS})")))
    if body is not None:
        found.append(detect(body, "body", rules))
    return F.concat(*found)


def without_excluded(detections: Column, path: Column, rules: tuple[Rule, ...], config: Config) -> Column:
    """Detections less those that an exclusion lifts for the path."""
    for exclusion in config.exclusions:
        ids = excluded_ids(rules, exclusion)
        if ids and exclusion.paths:
            here = reduce(Column.__or__, [F.startswith(path, F.lit(p)) for p in exclusion.paths])
            detections = _lifted(detections, ids, here)
    return detections


def _lifted(detections: Column, ids: list[int], here: Column) -> Column:
    return F.filter(detections, lambda d: ~(d["rule_id"].isin(ids) & here))


def responded(decision: Column, detections: Column, score: Column) -> Column:
    """The response: status, and headers for the client (block) or the upstream (warn)."""
    ids = F.array_join(F.transform(detections, lambda d: d["rule_id"].cast("string")), ",")
    return F.struct(
        F.when(decision == "block", 403).alias("status"),
        F.when(decision == "block", F.create_map(F.lit("X-WAF-Blocked"), F.lit("true"), F.lit("X-WAF-Rule"), ids, F.lit("X-WAF-Score"), score.cast("string")))
        .when(decision == "warn", F.create_map(F.lit("X-WAF-Detected"), ids, F.lit("X-WAF-Score"), score.cast("string")))
        .alias("headers"),
    )


def _learned(requests: DataFrame, key: str, uri: str, headers: str | None, body: str | None, config: Config) -> DataFrame:
    """key, learned: what the classifier and known payloads say of a request's values, in their order."""
    path, query = split_uri(F.col(uri))
    part = lambda place, value: F.struct(F.lit(place).alias("location"), value.alias("value"))
    parts = [F.array(part("path", path), part("query", query))]
    if headers:
        pairs = F.array_sort(F.map_entries(headers))
        of_one = lambda pair: F.transform(pair["value"], lambda v: F.struct(F.concat(F.lit("header:"), pair["key"]).alias("location"), v.alias("value")))
        parts.append(F.coalesce(F.flatten(F.transform(pairs, of_one)), F.expr("cast(array() as array<struct<location:string,value:string>>)")))
    if body:
        parts.append(F.array(part("body", F.col(body))))
    values = requests.where(~is_excluded(F.col(uri), config)).select(F.col(key).alias("of"), F.posexplode(F.concat(*parts)).alias("place", "x")).where("x.value <> ''")
    values = values.select(F.struct("of", "place").alias("id"), "x.location", "x.value")
    found = classifier.ml_detections(values, "id", "value", "location", config).where(F.size("detections") > 0)
    listed = F.array_sort(F.collect_list(F.struct(F.col("id.place").alias("place"), "detections")))
    return found.groupBy(F.col("id.of").alias("of")).agg(F.flatten(F.transform(listed, lambda x: x["detections"])).alias("learned"))


def _unusual(requests: DataFrame, uri: str, headers: str | None, method: str, baseline: DataFrame, config: Config) -> DataFrame:
    """requests with __unusual: the detection of one that is unlike what the baseline has learned of its path."""
    path_, query_, headers_ = fresh(requests, "__path", "__query", "__headers")
    path, query = split_uri(F.col(uri))
    given = F.col(headers) if headers else F.expr("cast(map() as map<string,array<string>>)")
    # A fingerprint's columns are named by the operator: those of requests wait in a struct.
    packed = requests.select(F.struct("*").alias("own_"), F.col(method).alias("method_"), path.alias(path_), query.alias(query_), given.alias(headers_))
    judged = anomaly.judged(anomaly.fingerprint(packed, "method_", query_, headers_), path_, baseline)
    found = anomaly.detections(F.col("anomaly"), config.anomaly_threshold, config.ml_score_weight)
    return judged.select("own_.*", F.when(~is_excluded(F.col(f"own_.{uri}"), config), found).alias("__unusual"))


def decide_requests(
    requests: DataFrame, config: Config = Config(), uri: str = "uri", headers: str | None = None, body: str | None = None, extra: tuple[Rule, ...] = (), key: str | None = None,
    method: str | None = None, baseline: DataFrame | None = None,
) -> DataFrame:
    """requests with detections, score, decision and response; nothing is shuffled.

    Where config asks for the classifier or known payloads, key names a unique column by which
    their detections are joined; they follow those of the rules. Where it asks for fingerprints, method names
    the column of the request's method, and baseline is what was learned before (anomaly.learned)."""
    rules = load(config, extra)
    found = request_detections(F.col(uri), F.col(headers) if headers else None, rules, F.col(body) if body else None)
    found = F.when(is_excluded(F.col(uri), config), F.expr(f"cast(array() as {DETECTIONS})")).otherwise(found)
    if config.ml_classifier or config.ml_similarity:
        if key is None:
            raise ValueError("the classifier and known payloads need a key")
        learned = _learned(requests, key, uri, headers, body, config).withColumnsRenamed({"of": "__of", "learned": "__learned"})
        requests = requests.join(learned, F.col(key) == F.col("__of"), "left")
        found = F.concat(found, F.coalesce("__learned", F.expr(f"cast(array() as {DETECTIONS})")))
    if config.fingerprinting:
        if method is None or baseline is None:
            raise ValueError("fingerprints need a method and a baseline")
        requests = _unusual(requests, uri, headers, method, baseline, config)
        found = F.concat(found, only(F.col("__unusual")))
    path, _ = split_uri(F.col(uri))
    rows = requests.withColumn("detections", without_excluded(found, path, rules, config))
    rows = rows.drop("__of", "__learned", "__unusual").withColumn("score", scoring.total(F.col("detections"), rules, config))
    rows = rows.withColumn("decision", scoring.decide(F.col("detections"), F.col("score"), config))
    return rows.withColumn("response", responded(F.col("decision"), F.col("detections"), F.col("score")))
