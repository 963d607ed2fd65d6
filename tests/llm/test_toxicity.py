"""The recurrent network: its slopes, its scores against a word-by-word version, held-out labels."""

from zlib import crc32

import numpy as np
import pytest

from palisade.llm import queries, toxicity as t

WORDS = ["ab", "abc", "zebra", "q" * 9, "x"]


@pytest.fixture(scope="module")
def net():
    return {k: v.astype(np.float64) for k, v in t.new_network(1).items()}


def test_slopes_are_those_of_the_loss(net):
    rng, words = np.random.default_rng(0), t.Words(WORDS)
    ids = rng.integers(0, 5, (6, t.WINDOW))
    ids[0, 20:], ids[3, 1:] = -1, -1
    label = np.array([1, 0, 1, 0, 1, 0], np.float32)
    found = t.slopes(net, words, ids, label)[1]
    for name, value in net.items():
        for _ in range(4):
            if isinstance(found[name], tuple):
                rows, slope = found[name]
                i, j = rng.integers(len(rows)), rng.integers(value.shape[1])
                at, got = (rows[i], j), slope[i, j]
            else:
                at = tuple(rng.integers(n) for n in value.shape)
                got = found[name][at]
            before, losses = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = before + step
                losses.append(t.slopes(net, words, ids, label)[0])
            value[at] = before
            assert got == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2, abs=3e-5), name


def buckets(word):
    """The bucket of a word and of each of its n-grams, number by number."""
    mixed = lambda h: ((h ^ (h >> 15)) * 2654435761 % 2**32) >> 17
    marked, whole, grams = f"<{word}>", 0, []
    for k, c in enumerate(marked):
        whole = (whole + ord(c) * pow(16777619, k + 1, 2**32)) % 2**32
    for n in t.GRAMS:
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = (h ^ ord(c)) * 16777619 % 2**32
            grams.append(mixed(h))
    return mixed(whole), grams


def test_features_of_many_words():
    some = ["a", "é", "ab", "zebra", "😀x", "Q" * 5000, "abc", "ſtraße"]
    words = t.Words(some)
    for k, w in enumerate(some):
        assert (words.word[k], words.grams(np.array([k]))[0].tolist()) == buckets(w)
    assert len(t.Words([]).word) == 0


def brute_score(net, text):
    """Each window, word by word."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words, best, s = t.words_of(text), -np.inf, t.STATES
    inputs = []
    for w in words:
        word, grams = buckets(w)
        x = np.concatenate([net["word"][word], np.mean([net["gram"][b] for b in grams], axis=0)])
        inputs.append(x @ net["in"] + net["in_bias"])
    starts = {k for k in range(0, len(words), t.STRIDE) if k + t.WINDOW < len(words)} | {max(0, len(words) - t.WINDOW)}
    for k in starts if words else ():
        window, states = inputs[k : k + t.WINDOW], []
        for side in (0, 1):
            h, own = np.zeros(s), []
            for x in window if side == 0 else window[::-1]:
                x, g = x[3 * s * side : 3 * s * side + 3 * s], h @ net["turn"][side]
                z, r = sigmoid(x[:s] + g[:s]), sigmoid(x[s : 2 * s] + g[s : 2 * s])
                h = (1 - z) * np.tanh(x[2 * s :] + r * g[2 * s :]) + z * h
                own.append(h)
            states.append(own if side == 0 else own[::-1])
        both = np.concatenate([np.array(states[0]), np.array(states[1])], axis=1)
        weight = np.exp(np.tanh(both @ net["look"] + net["look_bias"]) @ net["seek"])
        best = max(best, (weight / weight.sum()) @ both @ net["out"] + net["bias"][0])
    return sigmoid(best) if words else 0.0


@pytest.mark.parametrize("together,kept", [(2048, 150_000), (3, 20)])
def test_scores_are_those_of_all_windows(net, monkeypatch, texts, together, kept):
    """Also in small portions with a cache that is emptied often, where long texts come in parts."""
    monkeypatch.setattr(t, "TOGETHER", together)
    monkeypatch.setattr(t, "KEPT_WORDS", kept)
    some = [x or "" for _, x in sorted(texts.items())][:25] + ["", " .,!", "a", "é " * 32, "w " * 33, "Q" * 20000, " ".join(f"w{k % 97}" for k in range(999))]
    some = [x[:6000] if x[:1] != "Q" else x for x in some]
    net32 = {k: v.astype(np.float32) for k, v in net.items()}
    assert np.allclose(t.Scorer(net32).scores(some), [brute_score(net, x) for x in some], atol=1e-4)


def test_threshold_parts_the_labels():
    assert 1 < t._threshold(np.array([0.0, 1, 3, 4]), np.array([0, 0, 1, 1])) < 3
    assert -1 < t._threshold(np.array([-1.0, 5, 0.5, 4]), np.array([0, 0, 1, 1])) < 0.5


LABELS = "doc_id long, quality int, toxic int"


def insulting(spark, n=400):
    """Neutral words; one text in four holds one of three insults, or a compound of one."""
    rng = np.random.default_rng(7)
    neutral, bad = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ana", "elo", "iru", "ondo", "ulf")], ["grobnik", "schnurzel", "vatefolk"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(neutral, rng.integers(20, 120)))
        toxic = i % 4 == 0
        if toxic:
            for place in rng.integers(0, len(words), 3):
                words[place] = bad[rng.integers(3)] + rng.choice(["", "s", "ig"])
        rows.append((i, " ".join(words), "mine"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, LABELS), {r[0]: r[2] for r in labels}


def test_learns_and_handles_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(t, "STEP", 32)
    docs, labels, truth = insulting(spark)
    rows = docs.unionByName(odd.selectExpr("doc_id + 100000 as doc_id", "text", "kept as score"))
    got = t.score(rows, labels)
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == rows.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not t.words_of(r["text"] or ""):
            assert r["score"] == 0
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(max(s) - min(s) < 1e-5 for s in by_text.values())


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(3, 1, None), (None, 1, 1)], 0.0), ([(k, 1, 1) for k in (4, 6, 9, 11)], 1.0), ([(2, 1, 0)], 0.0)])
def test_labels_of_one_kind(spark, odd, labels, score):
    got = t.score(odd.select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    assert {r["score"] for r in got.collect()} == {score}


def test_empty_table(spark, empty):
    assert t.score(empty.select("doc_id", "text"), spark.createDataFrame([(1, 1, 1)], LABELS)).collect() == []


def test_held_out_labels_do_not_matter(spark, monkeypatch):
    """Labels of held-out rows, whatever they say, change no score."""
    monkeypatch.setattr(t, "PASSES", 1)
    docs, labels, _ = insulting(spark, 120)
    wrong = labels.withColumn("toxic", t.F.when(t.remainder() == 0, 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    first, second = ({r["doc_id"]: r["score"] for r in t.score(docs, x).collect()} for x in (labels, wrong))
    assert first == second


def test_held_out_accuracy(spark):
    """Of the labelled texts; one toxic text in twelve or so holds no toxic word."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    found = [(r["score"], truth[r["doc_id"]]) for r in t.score(docs, labels).where("held_out").collect()]
    toxic, clean = np.array([s for s, y in found if y]), np.array([s for s, y in found if not y])
    assert np.mean([(toxic > c).mean() for c in clean]) >= 0.9
    assert (toxic >= 0.5).mean() >= 0.75 and (clean < 0.5).mean() >= 0.9


def test_query(spark, small):
    got = queries.op13_attentive_gru(spark, small)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
