"""Weighted anomaly scores and decisions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.model import SEVERITY_WEIGHTS
from palisade.rules import Rule


def location_weight(location: Column, config: Config = Config()) -> Column:
    w = config.location_weights
    return (
        F.when(location == "path", w["path"])
        .when(location == "query", w["query"])
        .when(location.startswith("header:"), w["header"])
        .when(location.startswith("cookie:"), w["cookie"])
        .when(location.isin("body", "response_body"), w["body"])
        .when(location.startswith("websocket"), w["websocket"])
        .otherwise(1.0)
    )


def severity_weight(rule_id: Column, rules: tuple[Rule, ...]) -> Column:
    """1 for any id that is not among the active rules."""
    if not rules:
        return F.lit(1.0)
    table = F.create_map(*chain.from_iterable((F.lit(r.id), F.lit(SEVERITY_WEIGHTS[r.severity])) for r in rules))
    return F.coalesce(F.try_element_at(table, rule_id), F.lit(1.0))


def category_weight(attack_type: Column, config: Config) -> Column:
    if not config.category_weights:
        return F.lit(1.0)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in config.category_weights.items()))
    return F.coalesce(F.try_element_at(table, attack_type), F.lit(1.0))


def detection_score(detection: Column, rules: tuple[Rule, ...], config: Config = Config()) -> Column:
    """Rounded half away from zero, for each detection on its own."""
    weight = severity_weight(detection["rule_id"], rules) * category_weight(detection["attack_type"], config)
    return F.round(detection["base_score"] * location_weight(detection["location"], config) * weight).cast("int")


def scores(detections: Column, rules: tuple[Rule, ...], config: Config = Config()) -> Column:
    return F.transform(detections, lambda d: detection_score(d, rules, config))


def total(detections: Column, rules: tuple[Rule, ...], config: Config = Config()) -> Column:
    """The same rule in two locations counts twice."""
    return F.aggregate(scores(detections, rules, config), F.lit(0), lambda done, x: done + x)


def by_category(detections: DataFrame, keys: list[str], rules: tuple[Rule, ...], config: Config = Config()) -> DataFrame:
    """keys, attack_type, score and n of exploded detections (column detection)."""
    d = F.col("detection")
    return (
        detections.select(*keys, d["attack_type"].alias("attack_type"), detection_score(d, rules, config).alias("s"))
        .groupBy(*keys, "attack_type")
        .agg(F.sum("s").alias("score"), F.count("*").alias("n"))
    )


def top_category(categories: DataFrame, keys: list[str]) -> DataFrame:
    """The attack type with the largest score; ties go to the first name."""
    best = F.min_by("attack_type", F.struct(-F.col("score"), F.col("attack_type")))
    return categories.groupBy(*keys).agg(best.alias("top_category"), F.sum("score").alias("total"))


def decide(detections: Column, score: Column, config: Config = Config(), block_mode: bool | None = None) -> Column:
    block_mode = config.block_mode if block_mode is None else block_mode
    if not config.scoring:
        return F.when(F.size(detections) == 0, "allow").otherwise("block" if block_mode else "warn")
    blocks = score >= config.block_threshold if block_mode else F.lit(False)
    return (
        F.when(F.size(detections) == 0, "allow").when(blocks, "block").when(score >= config.log_threshold, "warn").otherwise("allow")
    )


def gap_to_block(score: Column, config: Config = Config()) -> Column:
    return F.greatest(F.lit(config.block_threshold) - score, F.lit(0))


def described(score: Column, config: Config = Config()) -> Column:
    share = F.floor(score * 100 / config.block_threshold)
    return F.format_string("%d/%d (%d%%)", score, F.lit(config.block_threshold), share)
