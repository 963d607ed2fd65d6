"""Counters, histograms, percentiles, top offenders, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.binding import fresh

# Upper bounds in milliseconds.
BUCKETS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
#: Percentiles look at so many of the latest values.
LATEST = 10_000
PARTS = 64


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, *by: str, bounds=BUCKETS) -> DataFrame:
    """Cumulative counts le_<bound>, with le_inf, sum and n."""
    v = F.col(value)
    return rows.groupBy(*by).agg(
        *[F.count_if(v <= b).alias(f"le_{b:g}") for b in bounds],
        F.count(v).alias("le_inf"),
        F.sum(v).alias("total"),
        F.count(v).alias("n"),
    )


def nearest_rank(values: Column, percent: float) -> Column:
    """Of sorted values, the one at round(percent / 100 * (n - 1)); 0 if there is none."""
    place = F.round(F.lit(percent / 100) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(values, place))


def percentiles(rows: DataFrame, value: str, order: str, *by: str, percents=(50, 90, 99), latest: int = LATEST) -> DataFrame:
    """p<percent> of the latest values of each group; the sorted array never holds more than `latest`.

    The latest are found among those of PARTS parts of a group first: a common group is not one task."""
    part, rank, found = fresh(rows, "__part", "__rank", "__values")
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    parted = rows.where(F.col(value).isNotNull()).select(*by, value, order).withColumn(part, F.pmod(F.xxhash64(order), F.lit(PARTS)))
    limited = parted.withColumn(rank, newest(*by, part)).where(F.col(rank) <= latest)
    limited = limited.withColumn(rank, newest(*by)).where(F.col(rank) <= latest)
    grouped = limited.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(found))
    return grouped.select(*by, *[nearest_rank(F.col(found), p).alias(f"p{p:g}") for p in percents])


def top_offenders(rows: DataFrame, source: str, n: int = 10) -> DataFrame:
    return counts(rows, source).orderBy(F.col("n").desc(), source).limit(n)


def prometheus(histograms: DataFrame, name: str, label: str, bounds=BUCKETS) -> DataFrame:
    """Text exposition lines of histogram(rows, value, label)."""
    line = lambda suffix, le, value: F.format_string(f'{name}{suffix}{{{label}="%s"{le}}} %s', F.col(label), value.cast("string"))
    lines = [line("_bucket", f',le="{b:g}"', F.col(f"le_{b:g}")) for b in bounds]
    lines += [line("_bucket", ',le="+Inf"', F.col("le_inf")), line("_sum", "", F.col("total")), line("_count", "", F.col("n"))]
    return histograms.select(label, F.posexplode(F.array(*lines)).alias("place", "value")).orderBy(label, "place").select("value")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def report(requests: DataFrame, decision: str, latency_ms: str, detections: str, source: str, n: int = 10) -> DataFrame:
    """One row: counters by decision, detections by attack type and rule, latency percentiles
    and histogram, and the sources with most detections, nested as a metrics document."""
    found = requests.select(source, F.explode(detections).alias("d"))
    listed = lambda rows, key: rows.agg(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("name"), "n"))).alias("x"))
    total = requests.agg(
        F.count("*").alias("requests"),
        *[F.count_if(F.col(decision) == k).alias(name) for k, name in (("allow", "allowed"), ("warn", "warned"), ("block", "blocked"))],
        F.coalesce(F.sum(F.size(detections)), F.lit(0)).alias("detections"),
        F.coalesce(F.avg(latency_ms), F.lit(0.0)).alias("latency_mean_ms"),
    )
    by_type = listed(counts(found.select(F.col("d.attack_type").alias("attack_type")), "attack_type"), "attack_type")
    by_rule = listed(counts(found.select(F.col("d.rule_id").alias("rule_id")), "rule_id"), "rule_id")
    worst = top_offenders(found, source, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(source).cast("string").alias("name"), "n"))).alias("x"))
    buckets = histogram(requests, latency_ms).select(F.struct(*[f"le_{b:g}" for b in BUCKETS], "le_inf").alias("x"))
    # Each part is one row: a handful of types, rules and sources, and nine buckets.
    rows = total
    for name, part in (("by_attack_type", by_type), ("by_rule", by_rule), ("top_offenders", worst), ("latency_histogram", buckets)):
        rows = rows.join(F.broadcast(part.withColumnRenamed("x", name)))
    return rows.withColumn("top_offenders", F.transform("top_offenders", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))))


def protocol_report(requests: DataFrame, decision: str, latency_ms: str) -> DataFrame:
    """name, kind and value of the counters, and of the gauges in their units, that a proxy asks its agents for."""
    total = requests.agg(
        F.count("*").cast("double").alias("requests_total"),
        *[F.count_if(F.col(decision) == k).cast("double").alias(f"requests_{name}_total") for k, name in (("allow", "allowed"), ("warn", "warned"), ("block", "blocked"))],
        F.coalesce(F.avg(latency_ms), F.lit(0.0)).alias("latency_mean_ms"),
        F.coalesce(F.max(latency_ms).cast("double"), F.lit(0.0)).alias("latency_max_ms"),
    )
    rows = F.array(*[F.struct(F.lit(f"waf_{c}").alias("name"), F.lit("counter" if c.endswith("total") else "gauge").alias("kind"), F.col(c).alias("value")) for c in total.columns])
    return total.select(F.explode(rows).alias("r")).select("r.*")
