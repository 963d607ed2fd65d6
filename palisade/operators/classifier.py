"""Attack classification by weighted character n-grams, and likeness to known payloads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.model import ATTACK_TYPES, DETECTIONS, detection, only, truncated
from palisade.operators.attack_payloads import PAYLOADS
from palisade.operators.attack_phrases import PHRASES
from palisade.operators.text_ml import SIMILAR, SIZES, ngram_counts, ngrams

FREQUENCY, PRESENCE, COVERAGE = 0.6, 0.4, 0.5
LEAST_TYPED = 0.3
#: Place among the detection ids from 99001 on.
PLACES = {"SqlInjection": 1, "Xss": 2, "CommandInjection": 3, "PathTraversal": 4}


def ngram_weights(phrases) -> dict[str, float]:
    """The weight of each n-gram of a class: summed over its phrases, the largest is 1."""
    weights: dict[str, float] = {}
    for phrase in phrases:
        low = phrase.lower()
        for n in SIZES:
            for i in range(len(low) - n + 1):
                weights[low[i : i + n]] = weights.get(low[i : i + n], 0.0) + 1 / math.sqrt(len(phrases))
    most = max(weights.values(), default=1.0)
    return {gram: w / most for gram, w in weights.items()}


def weight_table(spark: SparkSession, phrases=PHRASES) -> DataFrame:
    """kind, ngram, weight, kind_ngrams: as many rows as the phrases have n-grams."""
    rows = [(kind, gram, w, len(found)) for kind, texts in phrases.items() for found in [ngram_weights(texts)] for gram, w in found.items()]
    return spark.createDataFrame(rows, "kind string, ngram string, weight double, kind_ngrams int")


def classify(rows: DataFrame, key: str, text: str, phrases=PHRASES) -> DataFrame:
    """key, kind, score of every kind that shares an n-gram with the text."""
    counts = ngram_counts(rows, key, text)
    sizes = counts.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("different"))
    # A few thousand rows, fixed by the phrases.
    weights = F.broadcast(weight_table(rows.sparkSession, phrases))
    shared = (
        counts.join(weights, "ngram")
        .groupBy(key, "kind", "kind_ngrams")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("frequency"), F.sum("weight").alias("presence"), F.count("*").alias("matched"))
        .join(sizes, key)
    )
    raw = FREQUENCY * F.col("frequency") / F.col("total") + PRESENCE * F.col("presence") / F.col("kind_ngrams")
    score = raw * (1 + COVERAGE * F.col("matched") / F.col("different"))
    return shared.select(key, "kind", F.least(score, F.lit(1.0)).alias("score"))


def _typed(kind: Column, of) -> Column:
    return F.coalesce(*[F.when(kind == k, of(k)) for k in PLACES])


def predicted(scores: DataFrame, key: str) -> DataFrame:
    """key, confidence, and kind (null below LEAST_TYPED): of equal scores the last kind counts."""
    place = _typed(F.col("kind"), lambda k: F.lit(PLACES[k]))
    best = scores.groupBy(key).agg(F.max_by("kind", F.struct("score", place.alias("place"))).alias("kind"), F.max("score").alias("confidence"))
    return best.select(key, "confidence", F.when(F.col("confidence") >= LEAST_TYPED, F.col("kind")).alias("kind"))


def payload_table(spark: SparkSession, payloads=PAYLOADS) -> DataFrame:
    """payload (its number), kind, ngram, payload_ngrams: the different n-grams of each payload."""
    rows = []
    for number, (kind, text) in enumerate((kind, text) for kind, texts in payloads.items() for text in texts):
        low = text.lower()
        grams = {low[i : i + n] for n in SIZES for i in range(len(low) - n + 1)}
        rows += [(number, kind, gram, len(grams)) for gram in sorted(grams)]
    return spark.createDataFrame(rows, "payload int, kind string, ngram string, payload_ngrams int")


def closest_payload(rows: DataFrame, key: str, text: str, threshold: float = SIMILAR, payloads=PAYLOADS) -> DataFrame:
    """key, payload, kind, similarity: the payload whose n-gram set is most like the text's, the
    first of equals, where the Jaccard similarity reaches threshold.

    Sets whose sizes differ by more than that allows are left out before any join."""
    known = payload_table(rows.sparkSession, payloads)
    sizes = known.agg(F.min("payload_ngrams"), F.max("payload_ngrams")).first()
    grams = rows.select(key, F.array_distinct(ngrams(F.col(text))).alias("grams")).withColumn("n", F.size("grams"))
    near = grams.where(F.col("n").between(threshold * sizes[0], sizes[1] / threshold)).select(key, "n", F.explode("grams").alias("ngram"))
    # A few thousand rows, fixed by the payloads.
    both = near.join(F.broadcast(known), "ngram").groupBy(key, "n", "payload", "kind", "payload_ngrams").agg(F.count("*").alias("both"))
    like = both.withColumn("similarity", F.col("both") / (F.col("n") + F.col("payload_ngrams") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = like.groupBy(key).agg(F.min_by(F.struct("payload", "kind", "similarity"), F.struct(-F.col("similarity"), F.col("payload"))).alias("x"))
    return best.select(key, "x.*")


def ml_detections(values: DataFrame, key: str, text: str, location: str, config: Config = Config()) -> DataFrame:
    """key, detections: of values (key unique), what the classifier and the payloads say, as config asks for."""
    shown = truncated(F.col(text), 100)

    def made(first: int, name: str, kind: Column, base: Column, tag: str) -> Column:
        of = lambda k: detection(first + PLACES[k], name + ATTACK_TYPES[k], k, shown, F.col(location), base, (tag,))
        return _typed(kind, of)

    rows, found = values.select(key, text, location), []
    if config.ml_classifier:
        said = predicted(classify(values, key, text), key).withColumnRenamed("kind", "ml_kind")
        rows = rows.join(said.where(F.col("confidence") >= config.ml_min_confidence), key, "left")
        found.append(made(99000, "ML-", F.col("ml_kind"), F.floor(F.col("confidence") * 10 * config.ml_score_weight), "ml-classifier"))
    if config.ml_similarity:
        like = closest_payload(values, key, text).select(key, F.col("kind").alias("like_kind"), "similarity")
        rows = rows.join(like, key, "left")
        found.append(made(99100, "ML-Similarity-", F.col("like_kind"), F.floor(F.col("similarity") * 8 * config.ml_score_weight), "ml-similarity"))
    return rows.select(key, (only(*found) if found else F.expr(f"cast(array() as {DETECTIONS})")).alias("detections"))
