"""Federated learning: gradients as arrays, combined index by index over nodes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palisade.functions.binding import fresh
from palisade.operators import text_ml


def exploded(updates: DataFrame, gradients: str, *keep: str) -> DataFrame:
    return updates.select(*keep, F.posexplode(gradients).alias("i", "g"))


def mean(updates: DataFrame, gradients: str) -> DataFrame:
    return exploded(updates, gradients).groupBy("i").agg(F.avg(F.col("g").cast("double")).alias("value"))


def weighted_mean(updates: DataFrame, gradients: str, weight: str) -> DataFrame:
    w, g = F.col("weight_").cast("double"), F.col("g").cast("double")
    return exploded(updates.select(F.col(weight).alias("weight_"), gradients), gradients, "weight_").groupBy("i").agg((F.sum(w * g) / F.sum(w)).alias("value"))


#: Ranges of values that an index is cut into before anything is ranked, where it has more values than one task may rank.
RANGES, RANKED = 64, 100_000


def _mean_of_ranks(updates: DataFrame, gradients: str, low, high) -> DataFrame:
    """i, value: the mean of the values of ranks low(n) < rank <= high(n) of each index.

    Values of up to RANKED nodes are ranked as they are. Those of more are counted within ranges of about
    n / RANGES; only ranges on a border are looked into, value by value, so that no task ranks all nodes of an index."""
    rows = exploded(updates, gradients).where("g is not null").select("i", F.col("g").cast("double").alias("g"))
    if updates.count() <= RANKED:
        of_index = Window.partitionBy("i")
        ranked = rows.withColumn("at", F.row_number().over(of_index.orderBy("g"))).withColumn("all", F.count("*").over(of_index))
        return ranked.where((F.col("at") > low(F.col("all"))) & (F.col("at") <= high(F.col("all")))).groupBy("i").agg(F.avg("g").alias("value"))
    points = rows.groupBy("i").agg(F.percentile_approx("g", [k / RANGES for k in range(1, RANGES)], 1000).alias("points"))
    ranged = rows.join(points, "i").select("i", "g", F.size(F.filter("points", lambda p: p < F.col("g"))).alias("range"))
    counted = ranged.groupBy("i", "range", "g").agg(F.count("*").alias("n"))
    ranges = counted.groupBy("i", "range").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("sum"))
    of_index = Window.partitionBy("i")
    upto = of_index.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # RANGES rows an index.
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(of_index))
    ranges = ranges.withColumn("low", low(F.col("all"))).withColumn("high", high(F.col("all")))
    inside = (F.col("before") >= F.col("low")) & (F.col("before") + F.col("n") <= F.col("high"))
    apart = (F.col("before") + F.col("n") <= F.col("low")) | (F.col("before") >= F.col("high"))
    borders = ranges.where(~inside & ~apart).select("i", "range", "before", "low", "high")
    within = Window.partitionBy("i", "range").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    looked = counted.join(borders, ["i", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    taken = F.greatest(F.least(F.col("at") + F.col("n"), F.col("high")) - F.greatest("at", "low"), F.lit(0))
    parts = ranges.where(inside).select("i", "sum", "n").unionByName(looked.select("i", (taken * F.col("g")).alias("sum"), taken.alias("n")))
    return parts.groupBy("i").agg((F.sum("sum") / F.sum("n")).alias("value"))


def median(updates: DataFrame, gradients: str) -> DataFrame:
    return _mean_of_ranks(updates, gradients, lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2) + 1)


def trimmed_mean(updates: DataFrame, gradients: str, share: float = 0.1) -> DataFrame:
    """Without the floor(share * nodes) smallest and largest of each index."""
    return _mean_of_ranks(updates, gradients, lambda n: F.floor(n * share), lambda n: n - F.floor(n * share))


def as_array(values: DataFrame) -> DataFrame:
    """One row: the values of i, value in order. As long as the model, whatever the nodes."""
    return values.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("values"))


def norm(gradients: Column) -> Column:
    return F.sqrt(F.aggregate(gradients, F.lit(0.0), lambda a, x: a + x * x))


def clipped(gradients: Column, limit: float) -> Column:
    size = norm(gradients)
    return F.when(size > limit, F.transform(gradients, lambda x: x * limit / size)).otherwise(F.transform(gradients, lambda x: x.cast("double")))


def sparse(gradients: Column, k: int) -> Column:
    """array<struct(i, g)>: the k largest by size, by index; ties go to the smaller index."""
    pairs = F.transform(gradients, lambda g, i: F.struct((-F.abs(g)).alias("size"), i.alias("i"), g.alias("g")))
    kept = F.slice(F.array_sort(pairs), 1, k)
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"))))


def dense(pairs: Column, n: int) -> Column:
    found = F.map_from_entries(pairs)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0).cast("float")))


def averaged(local: Column, shared: Column, share: float = 0.3) -> Column:
    return F.zip_with(local, shared, lambda a, b: share * a + (1 - share) * b)


def local_gradient(samples: DataFrame, weights: list[float], features: str, label: str, confidence: str) -> DataFrame:
    """i, value: the mean over samples of (sigmoid(w.x) - label / 255) * x * confidence."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(w, F.col(features), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    error = (1 / (1 + F.exp(-dot)) - F.col(label) / 255) * F.col(confidence)
    return samples.select(error.alias("error"), F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg(F.col("error") * F.col("x")).alias("value"))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def noisy(values: DataFrame, sensitivity: float, epsilon: float, delta: float | None, seed: int) -> DataFrame:
    """Gaussian noise, or Laplace noise if delta is None, from a seed."""
    if delta is not None:
        return values.withColumn("value", F.col("value") + gaussian_sigma(sensitivity, epsilon, delta) * F.randn(seed))
    u = F.rand(seed) - 0.5
    return values.withColumn("value", F.col("value") - sensitivity / epsilon * F.signum(u) * F.log(1 - 2 * F.abs(u)))


def within_budget(requests: DataFrame, order: str, epsilon: float, delta: float, by: str) -> DataFrame:
    """requests with within: whether each may still be spent, and epsilon_spent and delta_spent after it.

    What one is refused is not spent, so that smaller ones after it may still fit: an ordered fold,
    for which a running sum will not do. Requests are sorted within their partition and folded a batch
    at a time; two sums of one key are held. A null amount is nothing, a null key is a key; of equal
    places in the order the smaller amount comes first."""
    place, eps, dlt, begins = fresh(requests, "__place", "__epsilon", "__delta", "__begins")
    amount = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    rows = requests.withColumns({eps: amount("epsilon"), dlt: amount("delta"), place: F.col(order)})
    results = {"within": "boolean", "epsilon_spent": "double", "delta_spent": "double"}
    kept = [f for f in requests.schema.fields if f.name.lower() not in results]
    schema = T.StructType([*kept, *(T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, t in results.items())])
    names = [f.name for f in kept]

    def fold(batches):
        spent = (0.0, 0.0)
        for batch in batches:
            out = []
            for start, e, d in zip(*(batch.column(n).to_pylist() for n in (begins, eps, dlt))):
                if start:
                    spent = (0.0, 0.0)
                fits = spent[0] + e <= epsilon and spent[1] + d <= delta
                if fits:
                    spent = (spent[0] + e, spent[1] + d)
                out.append((fits, *spent))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], schema=to_arrow_schema(schema))

    first = Window.partitionBy(by).orderBy(place, eps, dlt)
    marked = rows.withColumn(begins, F.row_number().over(first) == 1)
    return marked.mapInArrow(fold, schema)


def shares(values: DataFrame, n: int, seed: int) -> DataFrame:
    """values as n additive shares: all but the last are random."""
    drawn = [F.rand(seed + k) * 2 - 1 for k in range(n - 1)]
    rows = values.select("i", "value", *[x.alias(f"s{k}") for k, x in enumerate(drawn)])
    last = F.col("value") - reduce(Column.__add__, [F.col(f"s{k}") for k in range(n - 1)], F.lit(0.0))
    return rows.select("i", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(n - 1)], last)).alias("share", "value"))


def from_shares(held: DataFrame, n: int) -> DataFrame:
    """The sums, of indexes with more than half of the n shares."""
    return held.groupBy("i").agg(F.sum("value").alias("value"), F.count("*").alias("held")).where(F.col("held") >= n // 2 + 1).drop("held")


#: The length of a feature vector, headers that count, orders of the accountant, and the gates.
FEATURES, HEADERS = 256, 10
ORDERS = tuple(1.0 + k / 10 for k in range(1, 65))
BATCH, LEAST_SAMPLES = 32, 1000


@F.arrow_udf(T.DoubleType())
def _byte_bits(data: pa.Array) -> pa.Array:
    return text_ml.by_portion(data, lambda part: text_ml.entropies(part, np.array(list(map(len, part)), float)), pa.float64())


def byte_entropy(data: Column) -> Column:
    """Shannon entropy of the bytes, as a share of 8 bits."""
    return _byte_bits(data) / 8


@F.arrow_udf(T.LongType())
def _printable(data: pa.Array) -> pa.Array:
    def counted(part: list[bytes]) -> np.ndarray:
        owner, chars = text_ml.spelled(part)
        return np.bincount(owner[(chars >= 0x20) & (chars <= 0x7E)], minlength=len(part))

    return text_ml.by_portion(data, counted, pa.int64())


def printable_share(data: Column) -> Column:
    n = F.octet_length(data)
    return F.when(n == 0, 1.0).otherwise(_printable(data) / n)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _rests(texts: pa.Array) -> pa.Array:
    """How many characters' numbers leave each rest of 16."""

    def counted(part: list[str]) -> np.ndarray:
        owner, chars = text_ml.spelled(part)
        return np.bincount(owner * 16 + chars % 16, minlength=16 * len(part)).reshape(-1, 16)

    return text_ml.by_portion(texts, counted, pa.list_(pa.int64()))


def request_features(path: Column, query: Column, headers: Column, body: Column) -> Column:
    """array<float> of FEATURES numbers; headers: array<struct(name, value)>; query and body (binary) may be null."""
    has = lambda text: F.contains(path, F.lit(text)).cast("double")
    count = lambda text, mark: F.regexp_count(text, F.lit(mark))
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    size = F.octet_length
    of_path = F.array(size(path) / 1000, count(path, "/") / 10, has(".."), has("'"), has("<"))
    of_query = F.when(query.isNull(), zeros(4)).otherwise(
        F.array(size(query) / 1000, count(query, "=") / 10, count(query, "&") / 10, byte_entropy(F.encode(query, "UTF-8")))
    )
    pairs = F.flatten(F.transform(F.slice(headers, 1, HEADERS), lambda h: F.array(size(h["name"]) / 100, size(h["value"]) / 1000)))
    of_headers = F.slice(F.concat(F.array(F.size(headers) / 20), pairs, zeros(2 * HEADERS)), 1, 2 * HEADERS + 1)
    of_body = F.when(body.isNull(), zeros(3)).otherwise(F.array(size(body) / 10_000, byte_entropy(body), printable_share(body)))
    text = F.concat(path, F.lit(" "), F.coalesce(query, F.lit("")), F.lit(" "), F.coalesce(F.make_valid_utf8(body.cast("string")), F.lit("")))
    rests = _rests(text)
    buckets = F.array(*[F.get(rests, F.lit(k)) / F.greatest(size(text), F.lit(1)) for k in range(16)])
    used = 5 + 4 + 1 + 2 * HEADERS + 3 + 16
    return F.concat(of_path, of_query, of_headers, of_body, buckets, zeros(FEATURES - used)).cast("array<float>")


def renyi_epsilon(rounds: DataFrame, sigma: str, sensitivity: str, delta: float, *by: str) -> DataFrame:
    """by, epsilon: what Gaussian noise of so many rounds has spent, the least over ORDERS."""
    spent = rounds.groupBy(*by).agg(F.sum(F.pow(F.col(sensitivity) / F.col(sigma), 2)).alias("moment"))
    of = lambda order: order * F.col("moment") / 2 + math.log(order - 1) / order - math.log(order * delta) / order
    return spent.select(*by, F.array_min(F.array(*map(of, ORDERS))).alias("epsilon"))


def gates(nodes: DataFrame, samples: str, since_sync: str, interval: int = 3600, batch: int = BATCH, least: int = LEAST_SAMPLES) -> DataFrame:
    """nodes with batches (full ones have been trained on), contributes and syncs (seconds since the last one reach interval)."""
    batches = F.floor(F.col(samples) / batch)
    return nodes.withColumn("batches", batches).withColumn("contributes", (F.col(samples) >= least) & (batches > 0)).withColumn("syncs", F.col(since_sync).isNull() | (F.col(since_sync) >= interval))
