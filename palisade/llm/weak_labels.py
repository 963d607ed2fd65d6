"""Quality and toxicity classifiers trained on weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes
are counted by pattern over all documents (there are at most 3 to the power of the
labellers), and expectation-maximisation on those counts estimates how accurate each
labeller is and how likely each pattern is good. A linear scorer over hashed words
and document traits is then trained on a bounded sample of documents with those
posterior labels, and scores every document. Given labels serve one labeller alone:
the words that a bounded sample of labelled documents ties to toxic ones.

Defined results: a null text is empty and gets a score like any text; repeated rows
get equal scores; other columns pass through, those named like a result column are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import bounded_sample, fresh, text_of, without, written

GOOD, BAD, NOTHING = 1, 0, 2
#: Buckets of the hashed scorer, and the training documents of either class.
BUCKETS = 1 << 16
TRAIN_PER_CLASS = 3000
ROUNDS, LEARNING_RATE, DECAY = 80, 0.5, 1e-4
EM_ROUNDS = 100
KEPT_WORDS = 300_000
#: Labelled documents that words are mined from, at most, and what a mined word needs.
LABELLED_DOCS, MINED_DOCS, MINED_SHARE = 20_000, 4, 0.95
RESULTS = ("quality_score", "toxic_score", "kept")

_SYMBOLS = re.compile(r"[#*$%&<>^~=_{}\[\]\\/@+`|]")
_SHOUT = re.compile(r"(?<![!?])[!?]{2,}(?=\s|$)")
_LINE_END = re.compile(r"[.!?:;\"')]\s*$", re.M)
_MARKS = "#*$%&|<>.,!?;:'\"()[]{}-_=+@/\\`~^"
#: Common function words of four languages, and common insults.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as by this are was at from or an be not "
    "de la le les des et un une du en que qui dans est pour "
    "der die das und den von zu mit sich ein eine ist im auf nicht "
    "el los las y por con una del se es".split()
)
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown dumb imbecile fool scumbag jerk "
    "filth garbage vermin bastard bastards bitch cretin dimwit shithead asshole fuck fucking".split()
)


def traits(text: str, words: list[str], mined: frozenset = frozenset()) -> dict[str, float]:
    """What the labellers look at in text, which is words; mined: words that labelled documents tie to toxic ones."""
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    lowered = text.lower().split()
    plain = [w.strip(_MARKS) for w in lowered]
    insults = [w for w in plain if w in INSULTS]
    upper = sum(map(str.isupper, words))
    return {
        "words": len(words),
        "symbols": len(_SYMBOLS.findall(text)) / n,
        "bars": text.count("|") / n,
        "shouts": len(_SHOUT.findall(text)) / n,
        "upper": upper / n,
        "same lines": 1 - len(set(lines)) / max(len(lines), 1),
        "different words": len(set(words)) / n,
        "function words": sum(map(FUNCTION_WORDS.__contains__, lowered)) / n,
        "word length": sum(map(len, words)) / n,
        "ended lines": len(_LINE_END.findall(text)) / max(len(lines), 1),
        "insults": len(insults),
        "different insults": len(set(insults)),
        "mined": sum(map(mined.__contains__, plain)),
    }


def _above(value: float, good: float, bad: float) -> int:
    return GOOD if value >= good else BAD if value < bad else NOTHING


def _below(value: float, good: float, bad: float) -> int:
    return GOOD if value <= good else BAD if value > bad else NOTHING


QUALITY = (
    lambda t: _above(t["words"], 50, 30),
    lambda t: _below(t["symbols"], 0.1, 0.3),
    lambda t: _below(t["bars"], 0.02, 0.1),
    lambda t: _below(t["shouts"], 0.02, 0.1),
    lambda t: _below(t["upper"], 0.1, 0.3),
    lambda t: _below(t["same lines"], 0.1, 0.3),
    lambda t: NOTHING if t["words"] < 100 else _above(t["different words"] * math.log(t["words"]), 1.2, 0.8),
    lambda t: _above(t["function words"], 0.1, 0.05),
    lambda t: GOOD if 3 <= t["word length"] <= 12 else BAD,
    lambda t: _above(t["ended lines"], 0.6, 0.3),
)
#: Here good is free of insults.
CIVIL = (
    lambda t: BAD if t["insults"] else NOTHING,
    lambda t: BAD if t["different insults"] > 1 else NOTHING,
    lambda t: BAD if t["mined"] else GOOD,
    lambda t: NOTHING if t["mined"] or t["insults"] else GOOD,
)
TASKS = {"quality": QUALITY, "civil": CIVIL}


def votes(found: dict[str, float]) -> str:
    return ",".join("".join(str(labeller(found)) for labeller in labellers) for labellers in TASKS.values())


def fit_label_model(counts: dict[str, int], labellers: int, rounds: int = EM_ROUNDS) -> tuple[dict[str, float], np.ndarray]:
    """(posterior of good by pattern, accuracy of each labeller where it votes)."""
    if not counts:
        return {}, np.full(labellers, 0.5)
    patterns = np.array([[int(c) for c in p] for p in counts])
    weight = np.array([counts[p] for p in counts], float)
    good_votes, bad_votes = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    # One strong objection is how junk is seen; the majority would call it good.
    posterior = np.where(bad_votes > 0, 0.2, 0.9) * np.ones(len(patterns))
    posterior[good_votes == 0] = 0.1
    for _ in range(rounds):
        prior = (weight @ posterior + 1) / (weight.sum() + 2)
        log_odds = np.full(len(patterns), math.log(prior / (1 - prior)))
        accuracy = np.empty(labellers)
        for k in range(labellers):
            table = np.array(
                [[(weight * p)[patterns[:, k] == v].sum() + (2.0 if v == y else 1.0) for v in (BAD, GOOD)] for y, p in ((BAD, 1 - posterior), (GOOD, posterior))]
            )
            table /= table.sum(1, keepdims=True)
            accuracy[k] = (1 - prior) * table[0, 0] + prior * table[1, 1]
            for v in (BAD, GOOD):
                log_odds[patterns[:, k] == v] += math.log(table[1, v] / table[0, v])
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return dict(zip(counts, posterior.tolist())), accuracy


#: Traits that are not shares.
COUNTED = ("words", "word length", "insults", "different insults", "mined")


def word_features(word: str) -> tuple[int, int, int]:
    """Buckets of a word: itself without marks, its last three characters, and its shape."""
    core = word.strip(_MARKS)
    shape = b"%d %d %d" % (core.isalpha(), word.isupper(), min(len(word) - len(core), 4))
    return (
        zlib.crc32(core.lower().encode(), 1) % BUCKETS,
        zlib.crc32(word[-3:].encode(), 2) % BUCKETS,
        zlib.crc32(shape, 3) % BUCKETS,
    )


def trait_features(found: dict[str, float]) -> list[int]:
    """Buckets of the document's traits, each cut into a few ranges."""
    out = []
    for name, x in found.items():
        level = int(math.log2(x + 1)) if name in COUNTED else int(min(20, x * 20))
        out.append(zlib.crc32(f"{name} {level}".encode(), 4) % BUCKETS)
    return out


TRAINING = "votes string, buckets array<int>, shares array<float>"


def _training_rows(mined: frozenset):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = text.split()
                found = traits(text, words, mined)
                counts: dict[int, float] = {}
                for word in words:
                    for b in word_features(word):
                        counts[b] = counts.get(b, 0.0) + 1 / len(words)
                for b in trait_features(found):
                    counts[b] = counts.get(b, 0.0) + 1.0
                rows.append((votes(found), list(counts), list(counts.values())))
            yield pd.DataFrame(rows, columns=["votes", "buckets", "shares"])

    return run


def mine_words(docs: DataFrame, labels: DataFrame) -> frozenset:
    """Words that at least MINED_DOCS toxic ones of at most LABELLED_DOCS labelled documents
    hold, MINED_SHARE or more of those that hold them: all of them, so that their number is
    bounded by that of the labelled documents alone."""

    def count(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for word in {w.strip(_MARKS) for w in text.lower().split()}:
                    pair = counts.setdefault(word, [0, 0])
                    pair[0] += int(toxic)
                    pair[1] += 1
            yield pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["word", "toxic", "n"])

    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id")).limit(LABELLED_DOCS)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    words = (
        texts.mapInPandas(count, "word string, toxic long, n long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .where((F.col("toxic") >= MINED_DOCS) & (F.col("toxic") >= MINED_SHARE * F.col("n")) & (F.char_length("word") > 2))
    )
    return frozenset(r["word"] for r in words.select("word").collect())


def fit_scorer(rows: list[tuple[float, list[int], list[float]]]) -> np.ndarray:
    """Weights by logistic regression on posterior labels; the last one is the bias."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    doc = np.repeat(np.arange(len(rows)), [len(b) for _, b, _ in rows])
    bucket, share = np.concatenate([b for _, b, _ in rows]).astype(int), np.concatenate([s for _, _, s in rows])
    label = np.array([p for p, _, _ in rows])
    # Either class weighs the same.
    balance = np.where(label >= 0.5, 0.5 / max((label >= 0.5).sum(), 1), 0.5 / max((label < 0.5).sum(), 1))
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(ROUNDS):
        raw = np.bincount(doc, share * weights[bucket], len(rows)) + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label)
        slope = np.append(np.bincount(bucket, share * error[doc], BUCKETS), error.sum()) + DECAY * weights
        squares += slope**2
        weights -= LEARNING_RATE * slope / np.sqrt(squares)
    return weights


def fit(docs: DataFrame, mined: frozenset = frozenset()) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(scorer weights, labeller accuracies) of each task."""
    texts = docs.select(text_of().alias("text"))

    @F.pandas_udf(T.StringType())
    def vote(column: pd.Series) -> pd.Series:
        return pd.Series([votes(traits(t, t.split(), mined)) for t in column], dtype=object)

    # By pattern: a bounded table, counted over all documents.
    voted = written(texts.select(F.xxhash64("text").alias("order"), vote("text").alias("votes")))
    patterns = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    models, accuracies = {}, {}
    for k, (task, labellers) in enumerate(TASKS.items()):
        counts: dict[str, int] = {}
        for pattern, n in patterns.items():
            part = pattern.split(",")[k]
            counts[part] = counts.get(part, 0) + n
        posterior, accuracies[task] = fit_label_model(counts, len(labellers))
        rows = []
        for side in (True, False):
            wanted = [p for p, x in posterior.items() if (x >= 0.5) == side]
            chosen = bounded_sample(voted.where(F.split("votes", ",")[k].isin(wanted)), "order", TRAIN_PER_CLASS).select("order")
            # At most TRAIN_PER_CLASS hashes; copies of a text are one.
            sample = texts.withColumn("order", F.xxhash64("text")).join(F.broadcast(chosen), "order", "left_semi").dropDuplicates(["order"])
            sample = sample.select("text").mapInPandas(_training_rows(mined), TRAINING)
            rows += [(posterior[r["votes"].split(",")[k]], r["buckets"], r["shares"]) for r in sample.collect()]
        models[task] = fit_scorer(rows).astype(np.float32)
    return models, accuracies


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs with quality_score and toxic_score from 0 to 1, and kept: good and not toxic.

    labels (doc_id, toxic) are those of some of docs."""
    rows = without(docs, *RESULTS)
    mined = mine_words(rows, labels) if labels is not None else frozenset()
    models, _ = fit(rows, mined)
    # Two arrays of BUCKETS floats.
    shared = rows.sparkSession.sparkContext.broadcast([models[task] for task in TASKS])
    (scores,) = fresh(rows, "__scores")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = [w.tolist() for w in shared.value]

        class Known(dict):
            """The sum of each task's weights by word."""

            def __missing__(self, word: str) -> tuple[float, float]:
                a, b, c = word_features(word)
                self[word] = value = tuple(w[a] + w[b] + w[c] for w in weights)
                return value

        known = Known()
        for column in batches:
            out = []
            for text in column:
                if len(known) > KEPT_WORDS:
                    known.clear()
                words = text.split()
                raw = [sum(x) / len(words) for x in zip(*map(known.__getitem__, words))] or [0.0, 0.0]
                buckets = trait_features(traits(text, words, mined))
                raw = [r + w[-1] + sum(w[b] for b in buckets) for r, w in zip(raw, weights)]
                out.append([1 / (1 + math.exp(-min(30.0, max(-30.0, r)))) for r in raw])
            yield pd.Series(out)

    scored = rows.withColumn(scores, score(text_of()))
    return scored.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col(scores)[0].alias("quality_score"),
        (1 - F.col(scores)[1]).alias("toxic_score"),
        ((F.col(scores)[0] >= 0.5) & (F.col(scores)[1] >= 0.5)).alias("kept"),
    )
