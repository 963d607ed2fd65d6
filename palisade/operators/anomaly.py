"""Request fingerprints, and how far they are from what was learned of earlier requests.

Every request is scored before it is learned from. An endpoint's own baseline counts from
LEAST_SAMPLES requests on; until then that of all requests does. Both are summed within
ranges of the order first, then over ranges, so that no task sees all requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.binding import fresh, let
from palisade.model import detection
from palisade.operators.text_ml import LEAST_SAMPLES, entropy

# Methods and content types, what a baseline expects before it has seen any, and the factors' weights.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
CONTENT_TYPES = (
    ("form", ("application/x-www-form-urlencoded",)), ("multipart", ("multipart/form-data",)), ("json", ("application/json", "+json")),
    ("xml", ("application/xml", "+xml", "text/xml")), ("html", ("text/html",)), ("text", ("text/",)), ("binary", ("application/octet-stream",)),
)
EXPECTED_METHODS, EXPECTED_TYPES = ("GET", "POST"), ("none", "form", "json")
MOST_HEADERS, MOST_PARAMETERS, MOST_ENTROPY = 50, 20, 5.0
WEIGHTS = {"header_count": 0.1, "header_order": 0.15, "method": 0.2, "content_type": 0.15, "parameters": 0.1, "entropy": 0.2, "missing_headers": 0.1}
PARAMETER_SLACK, ENTROPY_SLACK, MOST_MISSING = 5, 1.0, 2
#: Different header orders that a baseline keeps; occurrences after which 1 - 0.9 ** n exceeds 0.8.
KEPT_ORDERS, EXPECTED_AFTER = 100, 16
#: Ranges of the order that baselines are summed in.
RANGES = 64
AMOUNTS = ("header_count", "parameters", "query_entropy")


def content_type(value: Column) -> Column:
    low = F.lower(value)
    kinds = [F.when(sum((F.contains(low, F.lit(t)).cast("int") for t in texts), F.lit(0)) > 0, kind) for kind, texts in CONTENT_TYPES]
    return F.coalesce(F.when(value.isNull(), "none"), *kinds, F.lit("other"))


def fingerprint(requests: DataFrame, method: str, query: str, headers: str) -> DataFrame:
    """requests with method_class, content_class, header_count, header_names (lower-case, sorted), parameters and query_entropy.

    headers maps a name to its values."""
    upper, text = F.upper(method), F.coalesce(F.col(query), F.lit(""))
    given = F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.try_element_at(headers, F.lit("Content-Type")))
    return requests.select(
        "*",
        F.when(upper.isin(*METHODS), upper).otherwise("OTHER").alias("method_class"),
        content_type(F.get(given, 0)).alias("content_class"),
        F.least(F.coalesce(F.size(headers), F.lit(0)), F.lit(255)).alias("header_count"),
        F.coalesce(F.transform(F.sort_array(F.map_keys(headers)), lambda n: F.lower(n)), F.expr("cast(array() as array<string>)")).alias("header_names"),
        F.when(text == "", 0).otherwise(F.least(F.regexp_count(text, F.lit("&")) + 1, F.lit(255))).alias("parameters"),
        F.round(entropy(text), 9).alias("query_entropy"),
    )


def _firsts(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Each value of the common baseline with the request that brought it."""
    return rows.groupBy(value).agg(F.min(order).alias("first_"))


def _common(names: DataFrame) -> DataFrame:
    """name and o of the request with which a header, of all requests, becomes an expected one."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("o"))
    some = names.withColumn("k", nth("name", "from_o")).where(F.col("k") <= EXPECTED_AFTER)
    return some.withColumn("k", nth("name")).where(F.col("k") == EXPECTED_AFTER).select("name", "o")


def _ranges(orders: DataFrame) -> DataFrame:
    """from_o and to_o of RANGES ranges of o with about as many rows each. Fixed here, as Spark samples anew for each use."""
    least = orders.repartitionByRange(RANGES, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("from_o")).select("from_o")
    # RANGES values.
    fixed = orders.sparkSession.createDataFrame(least.collect(), least.schema)
    return fixed.select("from_o", F.lead("from_o").over(Window.orderBy("from_o")).alias("to_o"))


def _joined(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows with table's columns, null being a key like any other."""
    renamed = table.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return rows.join(renamed, same, "left").drop(*[f"k_{k}" for k in keys])


def scores(requests: DataFrame, endpoint: str, order: str) -> DataFrame:
    """requests (a fingerprint each, order unique) with samples of the endpoint, the factors that count, and anomaly.

    An endpoint may have a third of all requests: what it learns is summed within ranges of the order first, then over
    ranges, so that no task sees all requests of an endpoint."""
    feature = "header_count method_class content_class parameters query_entropy".split()
    rows = requests.select(F.col(endpoint).alias("e"), F.col(order).alias("o"), *feature, F.xxhash64(F.concat_ws("\n", "header_names")).alias("h"), "header_names")
    bounds = _ranges(requests.select(F.col(order).alias("o")))
    rows = rows.join(F.broadcast(bounds), (F.col("o") >= F.col("from_o")) & (F.col("to_o").isNull() | (F.col("o") < F.col("to_o")))).drop("to_o")
    # The endpoint's own baseline. Shapes of requests of a range: few, where there are many requests.
    seen = ("h", "method_class", "content_class")
    shapes = rows.groupBy("e", "from_o", *seen).agg(F.count("*").alias("n"), *[F.max(a).alias(a) for a in AMOUNTS], F.min("o").alias("least"))
    for name in seen:
        shapes = shapes.withColumn(f"own_first_{name}", F.min("least").over(Window.partitionBy("e", name)))
    # Of an endpoint's header orders the first KEPT_ORDERS count.
    shapes = shapes.withColumn("place", F.dense_rank().over(Window.partitionBy("e").orderBy("own_first_h")))
    before = Window.partitionBy("e").orderBy("from_o").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shapes.groupBy("e", "from_o").agg(F.sum("n").alias("n"), *[F.max(a).alias(a) for a in AMOUNTS])
    ranges = ranges.select("e", "from_o", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_n"), *[F.max(a).over(before).alias(f"before_{a}") for a in AMOUNTS])
    # The request that makes a header an expected one.
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("o"))
    names = rows.select("e", "from_o", "o", F.explode(F.array_distinct("header_names")).alias("name"))
    some = names.withColumn("k", nth("e", "name", "from_o")).where(F.col("k") <= EXPECTED_AFTER)
    reached = some.withColumn("k", nth("e", "name")).where(F.col("k") == EXPECTED_AFTER)
    listed = F.collect_list(F.struct("name", F.col("o").alias("since")))
    ranges = _joined(ranges, reached.groupBy("e").agg(listed.alias("own_expected")), "e")
    rows = _joined(rows, ranges, "e", "from_o")
    rows = _joined(rows, shapes.select("e", "from_o", *seen, "place", *[f"own_first_{name}" for name in seen]), "e", "from_o", *seen)
    earlier = Window.partitionBy("e", "from_o").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own_n", F.col("before_n") + F.count("*").over(earlier))
    for name in AMOUNTS:
        rows = rows.withColumn(f"own_{name}", F.greatest(f"before_{name}", F.max(name).over(earlier)))
    for name in seen:
        rows = rows.withColumn(f"own_{name}", F.col(f"own_first_{name}") < F.col("o"))
    rows = rows.withColumn("own_h", F.col("own_h") & (F.col("place") <= KEPT_ORDERS))

    # The common one: when each value came first, and the largest amounts by ranges of the order.
    for name in ("method_class", "content_class"):
        # A handful of classes.
        rows = rows.join(F.broadcast(_firsts(rows.select(name, "o"), name, "o").withColumnRenamed("first_", f"first_{name}")), name)
    kept = _firsts(requests.select(F.xxhash64(F.concat_ws("\n", "header_names")).alias("h"), F.col(order).alias("o")), "h", "o").orderBy("first_").limit(KEPT_ORDERS)
    rows = rows.join(F.broadcast(kept.withColumnRenamed("first_", "first_h")), "h", "left")
    # One row.
    rows = rows.crossJoin(F.broadcast(_common(names).agg(listed.alias("all_expected"))))
    before = Window.orderBy("from_o").rowsBetween(Window.unboundedPreceding, -1)
    # RANGES rows.
    all_ranges = shapes.groupBy("from_o").agg(*[F.max(a).alias(a) for a in AMOUNTS])
    rows = rows.join(F.broadcast(all_ranges.select("from_o", *[F.max(a).over(before).alias(f"b_{a}") for a in AMOUNTS])), "from_o")
    within = Window.partitionBy("from_o").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    for name in AMOUNTS:
        rows = rows.withColumn(f"max_{name}", F.greatest(f"b_{name}", F.max(name).over(within)))

    known = F.col("own_n") >= LEAST_SAMPLES
    of = lambda own, common: F.when(known, own).otherwise(common)
    most = lambda name, least: F.greatest(F.lit(least), F.coalesce(of(F.col(f"own_{name}"), F.col(f"max_{name}")), F.lit(least)))
    seen = lambda name: of(F.col(f"own_{name}"), F.coalesce(F.col(f"first_{name}") < F.col("o"), F.lit(False)))
    first = F.col("o") == F.col("first_o")
    rows = rows.join(F.broadcast(requests.agg(F.min(order).alias("first_o"))))
    lacking = lambda expected: F.size(F.filter(expected, lambda x: (x["since"] < F.col("o")) & ~F.array_contains(F.col("header_names"), x["name"])))
    missing = of(F.when(F.col("own_expected").isNotNull(), lacking(F.col("own_expected"))).otherwise(0), lacking(F.col("all_expected")))
    factors = {
        "header_count": F.col("header_count") > most("header_count", MOST_HEADERS),
        "header_order": ~first & ~seen("h"),
        "method": ~F.col("method_class").isin(*EXPECTED_METHODS) & ~seen("method_class"),
        "content_type": ~F.col("content_class").isin(*EXPECTED_TYPES) & ~seen("content_class"),
        "parameters": F.col("parameters") > most("parameters", MOST_PARAMETERS) + PARAMETER_SLACK,
        "entropy": F.col("query_entropy") > most("query_entropy", MOST_ENTROPY) + ENTROPY_SLACK,
        "missing_headers": missing > MOST_MISSING,
    }
    total = sum((F.when(x, WEIGHTS[name]).otherwise(0.0) for name, x in factors.items()), F.lit(0.0))
    result = rows.select(
        F.col("o").alias("o_"), F.col("own_n").alias("samples"),
        F.array_compact(F.array(*[F.when(x, name) for name, x in factors.items()])).alias("factors"), F.least(total, F.lit(1.0)).alias("anomaly"),
    )
    (key,) = fresh(requests, "__order")
    return requests.join(result.withColumnRenamed("o_", key), F.col(order) == F.col(key)).drop(key)


#: A learned baseline: rows of (endpoint, kind, value) with how often it came, its largest amount and the
#: order of the request that brought it. The baseline of all requests has common set, and no endpoint.
MODEL = ("common", "endpoint", "kind", "value", "n", "amount", "first")


def learned(requests: DataFrame, endpoint: str, order: str) -> DataFrame:
    """The MODEL of requests (a fingerprint each), of each endpoint and of all requests.

    Every shape of requests gives a few rows, which Spark sums within each task before it shuffles: an endpoint
    may have a third of all requests. Models of parts of the requests give that of all of them (merged)."""
    text = lambda c: F.col(c).cast("string")
    # Named so that the names outlive a lambda.
    seen = lambda kind, value, amount=F.lit(None): F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), value, F.lit("amount"), amount.cast("double"))
    none = F.lit("")
    # Requests of one shape are summed before they are taken apart.
    shape = [F.col(endpoint).alias("endpoint"), "header_names", "method_class", "content_class"]
    shapes = requests.groupBy(*shape).agg(F.count("*").alias("n"), *[F.max(a).alias(a) for a in AMOUNTS], F.min(order).alias("first"))
    fixed = F.array(
        seen("requests", none), *[seen(name, none, F.col(name)) for name in AMOUNTS],
        seen("order", F.xxhash64(F.concat_ws("\n", "header_names")).cast("string")), seen("method", text("method_class")), seen("type", text("content_class")),
    )
    headers = F.transform(F.array_distinct("header_names"), lambda n: seen("header", n))
    rows = shapes.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("common"), "endpoint", "n", "first", F.concat(fixed, headers).alias("seen"))
    rows = rows.select("common", F.when(~F.col("common"), F.col("endpoint")).alias("endpoint"), F.explode("seen").alias("seen"), "n", "first")
    return merged(rows.select("common", "endpoint", "seen.kind", "seen.value", "n", "seen.amount", "first"))


def merged(*models: DataFrame) -> DataFrame:
    """One MODEL of several, of requests that no two of them have in common: the same as if all had
    been learned from at once. Of the header orders of a baseline the first KEPT_ORDERS stay."""
    rows = models[0].select(*MODEL)
    for other in models[1:]:
        rows = rows.unionByName(other.select(*MODEL))
    summed = rows.groupBy("common", "endpoint", "kind", "value").agg(F.sum("n").alias("n"), F.max("amount").alias("amount"), F.min("first").alias("first"))
    orders = summed.where("kind = 'order'").withColumn("place", F.row_number().over(Window.partitionBy("common", "endpoint").orderBy("first", "value")))
    return summed.where("kind <> 'order'").unionByName(orders.where(F.col("place") <= KEPT_ORDERS).drop("place")).select(*MODEL)


def _baselines(model: DataFrame) -> DataFrame:
    """A row of each baseline: what `judged` asks of it."""
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    some = lambda kind, more=F.lit(True): F.collect_set(F.when((F.col("kind") == kind) & more, F.col("value")))
    return model.groupBy("common", "endpoint").agg(
        F.max(of("requests", F.col("n"))).alias("samples"), *[F.max(of(a, F.col("amount"))).alias(f"most_{a}") for a in AMOUNTS],
        some("order").alias("orders"), some("method").alias("methods"), some("type").alias("types"), some("header", F.col("n") >= EXPECTED_AFTER).alias("expected"),
    )


def judged(requests: DataFrame, endpoint: str, model: DataFrame) -> DataFrame:
    """requests (a fingerprint each) with samples of the endpoint, the factors that count, and anomaly,
    by a MODEL that they do not change: yesterday's, for example. scores() learns as it goes."""
    baselines = _baselines(model).drop("common")
    own, common, known_as = fresh(requests, "__own", "__common", "__endpoint")
    packed = baselines.where(F.col("endpoint").isNotNull()).select(F.col("endpoint").alias(known_as), F.struct(*[c for c in baselines.columns if c != "endpoint"]).alias(own))
    empty = F.struct(
        F.lit(0).cast("long").alias("samples"), *[F.lit(None).cast("double").alias(f"most_{a}") for a in AMOUNTS],
        *[F.expr("cast(array() as array<string>)").alias(c) for c in ("orders", "methods", "types", "expected")],
    )
    # One row, and one even of an empty model.
    everyone = _baselines(model.where("common")).agg(F.first(F.struct(*[c for c in baselines.columns if c != "endpoint"])).alias(common))
    rows = requests.join(packed, F.col(endpoint) == F.col(known_as), "left").crossJoin(F.broadcast(everyone))

    def factors(x: Column) -> Column:
        b, most = x["b"], lambda name, least: F.greatest(F.lit(least), F.coalesce(x["b"][f"most_{name}"], F.lit(least)))
        header_order = F.xxhash64(F.concat_ws("\n", "header_names")).cast("string")
        found = {
            "header_count": F.col("header_count") > most("header_count", float(MOST_HEADERS)),
            "header_order": (F.size(b["orders"]) > 0) & ~F.array_contains(b["orders"], header_order),
            "method": ~F.col("method_class").isin(*EXPECTED_METHODS) & ~F.array_contains(b["methods"], F.col("method_class")),
            "content_type": ~F.col("content_class").isin(*EXPECTED_TYPES) & ~F.array_contains(b["types"], F.col("content_class")),
            "parameters": F.col("parameters") > most("parameters", float(MOST_PARAMETERS)) + PARAMETER_SLACK,
            "entropy": F.col("query_entropy") > most("query_entropy", MOST_ENTROPY) + ENTROPY_SLACK,
            "missing_headers": F.size(F.array_except(b["expected"], F.col("header_names"))) > MOST_MISSING,
        }
        return F.array_compact(F.array(*[F.when(test, name) for name, test in found.items()]))

    whole = F.coalesce(F.when(F.col(own)["samples"] >= LEAST_SAMPLES, F.col(own)), F.col(common), empty)
    weights = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])
    total = F.aggregate("factors", F.lit(0.0), lambda a, name: a + F.element_at(weights, name), lambda a: F.least(a, F.lit(1.0)))
    marked = rows.withColumn("samples", F.coalesce(F.col(own)["samples"], F.lit(0).cast("long"))).withColumn("factors", let(factors, b=whole))
    return marked.withColumn("anomaly", total).drop(own, common, known_as)


def detections(anomaly: Column, threshold: float = 0.5, weight: float = 1.0) -> Column:
    """The detection of an anomalous request, null for any other."""
    value = F.format_string("anomaly_score=%.2f", anomaly)
    found = detection(99200, "ML-Fingerprint-Anomaly", "ProtocolAttack", value, "request", F.floor(anomaly * 5.0 * weight), ("ml-fingerprint",))
    return F.when(anomaly >= threshold, found)
