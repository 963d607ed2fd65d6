"""The label model on votes of known accuracy, and the classifiers on held-out labels."""

import math
import time

import numpy as np
import pytest

from palisade.llm import queries, weak_labels


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth, right = rng.random(20_000) < 0.7, np.array([0.95, 0.85, 0.75, 0.9])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20_000, 4)) < 0.2] = weak_labels.NOTHING
    counts: dict[str, int] = {}
    patterns = ["".join(map(str, v)) for v in votes]
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    posterior, accuracy = weak_labels.fit_label_model(counts, 4)
    assert np.abs(accuracy - right).max() < 0.03
    assert ((np.array([posterior[p] for p in patterns]) >= 0.5) == truth).mean() > 0.93


def brute_label_model(votes, rounds):
    """The same expectation-maximisation, document by document."""
    k = len(votes[0])
    good = [0.1 if all(v != 1 for v in one) else 0.2 if 0 in one else 0.9 for one in votes]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(votes) + 2)
        odds = [math.log(prior / (1 - prior))] * len(votes)
        for j in range(k):
            chance = {}
            for y in (0, 1):
                mass = {v: sum(p if y else 1 - p for p, one in zip(good, votes) if one[j] == v) + (2 if v == y else 1) for v in (0, 1)}
                chance |= {(y, v): mass[v] / (mass[0] + mass[1]) for v in (0, 1)}
            for i, one in enumerate(votes):
                if one[j] < 2:
                    odds[i] += math.log(chance[1, one[j]] / chance[0, one[j]])
        good = [1 / (1 + math.exp(-min(30, max(-30, x)))) for x in odds]
    return good


def test_label_model_over_patterns_is_that_over_documents():
    votes = np.random.default_rng(2).choice([0, 1, 2], (300, 4), p=[0.2, 0.5, 0.3]).tolist()
    counts: dict[str, int] = {}
    patterns = ["".join(map(str, v)) for v in votes]
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    posterior, _ = weak_labels.fit_label_model(counts, 4, rounds=25)
    assert np.allclose([posterior[p] for p in patterns], brute_label_model(votes, 25))


def test_scorer_separates():
    rows = [(1.0, [1, 2], [1.0, 0.5]), (0.0, [3, 2], [1.0, 0.5])] * 20
    weights = weak_labels.fit_scorer(rows)
    assert weights[1] > 0 > weights[3]
    assert not weak_labels.fit_scorer([]).any()


def test_op2_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_labels.classify(docs.select("doc_id", "text"), labels.where("doc_id % 2 = 0")).join(labels, "doc_id").collect()
    assert np.mean([(r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95
    held_out = [r for r in rows if r["doc_id"] % 2]
    clean = [r["toxic_score"] < 0.5 for r in held_out if not r["toxic"]]
    assert np.mean(clean) > 0.97
    full = queries.op2_weak_labels(spark, folder).join(labels, "doc_id").collect()
    assert np.mean([(r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in full]) > 0.95


def test_odd_rows(odd, empty):
    rows = weak_labels.classify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["quality_score"] <= 1 and r["kept"] is not None for r in rows)
    scores = {}
    for r in rows:
        scores.setdefault(r["text"], set()).add((r["quality_score"], r["toxic_score"], r["kept"]))
    assert all(len(x) == 1 for x in scores.values()) and {r["lang"] for r in rows} == {"en"}
    assert weak_labels.classify(empty).count() == 0


@pytest.mark.parametrize("text", ["!" * 500_000 + "x", " " * 500_000, "a\n" * 250_000, "\"' " * 150_000])
def test_long_texts_take_linear_time(text):
    begun = time.process_time()
    weak_labels.traits(text, text.split())
    assert time.process_time() - begun < 10
