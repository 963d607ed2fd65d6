"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is the sum of what its own hash and the hashes of its character n-grams stand for, so
that forms never seen resemble those that were. A text is read in overlapping windows of
words; two gated recurrent passes, one from either end, run over each window, attention pools
their states, and a text is as toxic as its most toxic window. The network is trained in numpy in one
Spark task, on a bounded sample of windows of labelled texts: a toxic text teaches through the
window that looks most toxic so far, a clean one through that and through a random window.
Rows kept from training set the threshold. Scoring sends one small model to all tasks.

Defined results: a null text is empty; a text without words scores 0; a null doc_id is neither
held out nor learned from; of several labels of one doc_id the larger counts, null labels do
not; without labels of both kinds (of texts with words) all texts score 0, or 1 if all labels are 1. Repeated rows get equal scores, up to rounding; extra
columns stay, those named like a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fresh, text_of, without

#: Words of a window and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Buckets of words and of n-grams, and the lengths of n-grams.
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
#: Numbers that a word, and its n-grams, stand for; states of one direction; of attention.
WORD, CHARS, STATES, ATTENTION = 12, 12, 12, 12
#: Bounds of the sample that the network is fitted on: labelled rows a class, windows of a
#: row (spread over its whole text), of a row that sets the threshold, characters of a word.
TRAIN_PER_CLASS, TRAIN_WINDOWS, CHECK_WINDOWS, LONG_WORD = 3_000, 48, 400, 1_000
#: Passes over all windows with their text's label, passes by the most toxic window, windows
#: of a step, the step size, and the share of words and n-grams hidden in training.
WARM_PASSES, PASSES, STEP, RATE, HIDDEN = 2, 8, 128, 4e-3, 0.25
#: Training texts that a word or n-gram must be in to stand for anything: rarer ones would
#: only say which text they are from.
LEAST_TEXTS = 4
#: Words that a scoring task keeps and windows that it scores together.
KEPT_WORDS, TOGETHER = 100_000, 1024
#: Words, or training texts, whose n-grams are looked up at a time.
PORTION = 8192

RESULTS = ("held_out", "score", "predicted")
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def window_starts(n: int) -> list[int]:
    """Where windows begin; the last one ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), max(0, n - WINDOW)] if n else []


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    return ((hashes ^ (hashes >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Words:
    """Feature buckets of different words, in flat arrays: of the word, and of the n-grams of "<word>".

    Hashes are sums of characters times powers, so that all words' are found together."""

    def __init__(self, words: list[str]):
        parts = [self._features(words[k : k + PORTION]) for k in range(0, len(words), PORTION)] or [self._features([])]
        self.word, self.size, self.gram = (np.concatenate(x) for x in zip(*parts))
        self.begin = np.cumsum(self.size) - self.size

    @staticmethod
    def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, how many n-grams it has, their buckets word by word)."""
        marked = "".join(f"<{w}>" for w in words)
        chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(length)
        place = np.arange(len(chars)) - np.repeat(end - length, length)
        powers = np.multiply.accumulate(np.full(int(length.max(initial=1)), 16777619, np.uint32))
        whole = np.add.reduceat(chars * powers[place], end - length, dtype=np.uint32) if len(words) else np.zeros(0, np.uint32)
        counts = [np.maximum(length - n + 1, 0) for n in GRAMS]
        size = sum(counts)
        at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.int32)
        left = np.repeat(end, length) - np.arange(len(chars))  # characters from here to the word's end
        for n, count in zip(GRAMS, counts):
            starts = np.flatnonzero(left >= n)
            h = np.full(len(starts), n, np.uint32)
            for k in range(n):
                h = (h ^ chars[starts + k]) * np.uint32(16777619)
            out[np.repeat(at, length)[starts] + place[starts]] = _mixed(h)
            at = at + count
        return _mixed(whole).astype(np.int64), size, out

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram buckets of rows one after the other, where each row begins)."""
        size = self.size[rows]
        begin = np.cumsum(size) - size
        return self.gram[np.arange(size.sum()) - np.repeat(begin - self.begin[rows], size)], begin


def new_network(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD + CHARS
    shapes = {"word": (BUCKETS, WORD), "gram": (BUCKETS, CHARS), "in": (size, 6 * STATES), "turn": (2, STATES, 3 * STATES)}
    shapes |= {"look": (2 * STATES, ATTENTION), "seek": (ATTENTION,), "out": (2 * STATES,)}
    scale = {"word": 0.2, "gram": 0.5, "in": size**-0.5, "turn": STATES**-0.5, "look": (2 * STATES) ** -0.5, "seek": 0.5, "out": (2 * STATES) ** -0.5}
    net = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shapes.items()}
    return net | {"in_bias": np.zeros(6 * STATES, np.float32), "look_bias": np.zeros(ATTENTION, np.float32), "bias": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def embed(net: dict[str, np.ndarray], words: Words, rows: np.ndarray) -> np.ndarray:
    grams, begin = words.grams(rows)
    return np.concatenate([net["word"][words.word[rows]], np.add.reduceat(net["gram"][grams], begin) / words.size[rows, None].astype(np.float32)], axis=1)


def gate_inputs(net: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """What each of words gives all gates."""
    out = np.zeros((len(words.word), 6 * STATES), np.float32)
    for k in range(0, len(out), PORTION):
        rows = np.arange(k, min(k + PORTION, len(out)))
        out[rows] = embed(net, words, rows) @ net["in"] + net["in_bias"]
    return out


def read(net: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, keep: bool = False):
    """The logit of each window. ids (windows, WINDOW) are rows of table, the words' inputs of
    all gates; -1 is no word. With keep also what the way back needs."""
    n, steps, s = len(ids), ids.shape[1], STATES
    there, short = ids >= 0, bool((ids < 0).any())
    states, kept, half = np.zeros((steps, n, 2 * s), table.dtype), [], table.dtype.type(0.5)
    x, h = np.empty((2, n, 3 * s), table.dtype), np.zeros((2, n, s), table.dtype)
    sides = table.reshape(len(table), 2, 3 * s)
    for t in range(steps):
        at, back = t, steps - 1 - t
        x[0], x[1] = sides[ids[:, at], 0], sides[ids[:, back], 1]
        g = h @ net["turn"]
        gates = x[:, :, : 2 * s] + g[:, :, : 2 * s]
        gates *= half
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        z, r, rest = gates[:, :, :s], gates[:, :, s:], g[:, :, 2 * s :]
        new = r * rest
        new += x[:, :, 2 * s :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        m = None
        if short:
            m = np.stack([there[:, at], there[:, back]])[:, :, None]
            after = np.where(m, after, h)
        if keep:
            kept.append((h, z, r, new, rest, m))
        h = after
        states[at, :, :s], states[back, :, s:] = h[0], h[1]
    seen = states.reshape(-1, 2 * s) @ net["look"]
    seen += net["look_bias"]
    np.tanh(seen, out=seen)
    seen = seen.reshape(steps, n, -1)
    weight = seen @ net["seek"]
    if short:
        weight = np.where(there.T, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tns->ns", weight, states)
    logit = pooled @ net["out"] + net["bias"][0]
    return (logit, (states, seen, weight, pooled, kept)) if keep else logit


def slopes(net: dict[str, np.ndarray], words: Words, ids: np.ndarray, label: np.ndarray, hide=None):
    """(loss, slope of each parameter; of embeddings (rows, slope of these rows)) for windows of
    rows of words. hide(n) are the (factor of word, factor of n-grams) of n words."""
    s, (rows, local) = STATES, np.unique(ids, return_inverse=True)
    local = local.reshape(ids.shape)
    if rows[0] < 0:
        rows, local = rows[1:], local - 1
    shown = np.repeat(hide(len(rows)), (WORD, CHARS), axis=1) if hide else np.float32(1)
    x = embed(net, words, rows) * shown
    logit, (states, seen, weight, pooled, kept) = read(net, x @ net["in"] + net["in_bias"], local, keep=True)
    share = _sigmoid(logit)
    loss = float(np.mean(np.maximum(logit, 0) - logit * label + np.log1p(np.exp(-np.abs(logit)))))
    d = ((share - label) / len(label)).astype(np.float32)
    out = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * net["out"]
    d_weight = np.einsum("ns,tns->tn", d_pooled, states)
    d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
    out["seek"] = np.einsum("tn,tna->a", d_weight, seen)
    d_seen = d_weight[:, :, None] * net["seek"] * (1 - seen**2)
    out["look"], out["look_bias"] = np.einsum("tns,tna->sa", states, d_seen), d_seen.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pooled + d_seen @ net["look"].T
    d_turn, d_h, steps = np.zeros_like(net["turn"]), np.zeros((2, len(ids), s), np.float32), ids.shape[1]
    d_inputs = np.zeros((steps, len(ids), 6 * s), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, new, g, m = kept[t]
        at, back = t, steps - 1 - t
        d_h = d_h + np.stack([d_states[at, :, :s], d_states[back, :, s:]])
        d_after, d_before = (d_h, 0.0) if m is None else (np.where(m, d_h, 0), np.where(m, 0, d_h))
        d_new = d_after * (1 - z) * (1 - new**2)
        d_z, d_r = d_after * (h - new) * z * (1 - z), d_new * g * r * (1 - r)
        d_x, d_g = np.concatenate([d_z, d_r, d_new], axis=2), np.concatenate([d_z, d_r, d_new * r], axis=2)
        d_turn += np.swapaxes(h, 1, 2) @ d_g
        d_h = d_after * z + d_before + d_g @ np.swapaxes(net["turn"], 1, 2)
        d_inputs[at, :, : 3 * s], d_inputs[back, :, 3 * s :] = d_x[0], d_x[1]
    flat = local.T.ravel()
    order = np.argsort(flat, kind="stable")[(flat < 0).sum() :]
    d_table = np.add.reduceat(d_inputs.reshape(-1, 6 * s)[order], np.searchsorted(flat[order], np.arange(len(rows))))
    out["turn"], out["in"], out["in_bias"] = d_turn, x.T @ d_table, d_table.sum(axis=0)
    d_words = d_table @ net["in"].T * shown
    grams, _ = words.grams(rows)
    each = np.repeat(d_words[:, WORD:] / words.size[rows, None], words.size[rows], axis=0)
    for name, bucket, change in (("word", words.word[rows], d_words[:, :WORD]), ("gram", grams, each)):
        found, place = np.unique(bucket, return_inverse=True)
        total = np.stack([np.bincount(place, c, len(found)) for c in change.T], axis=1).astype(np.float32)
        out[name] = (found, total)
    return loss, out


class Adam:
    """Adam; of embeddings only the rows that a step touches."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net, self.first, self.second, self.step = net, {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0

    def apply(self, change: dict) -> None:
        self.step += 1
        rate = RATE * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for name, found in change.items():
            rows, slope = found if isinstance(found, tuple) else (slice(None), found)
            first, second = self.first[name], self.second[name]
            first[rows] = 0.9 * first[rows] + 0.1 * slope
            second[rows] = 0.999 * second[rows] + 0.001 * slope**2
            self.net[name][rows] -= rate * first[rows] / (np.sqrt(second[rows]) + 1e-6)


def _logits(net: dict[str, np.ndarray], words: Words, ids: np.ndarray) -> np.ndarray:
    table = gate_inputs(net, words)
    return np.concatenate([read(net, table, ids[k : k + TOGETHER]) for k in range(0, len(ids), TOGETHER)])


def _known(doc: np.ndarray, ids: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """Which buckets of words and of n-grams are in LEAST_TEXTS documents."""
    counts = {"word": np.zeros(BUCKETS, np.int64), "gram": np.zeros(BUCKETS, np.int64)}
    order = np.argsort(doc, kind="stable")
    for one in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
        rows = np.unique(ids[one])
        rows = rows[rows >= 0]
        counts["word"][np.unique(words.word[rows])] += 1
        counts["gram"][np.unique(words.grams(rows)[0])] += 1
    return {name: n >= LEAST_TEXTS for name, n in counts.items()}


def train(doc: np.ndarray, label: np.ndarray, check: np.ndarray, windows: Iterable[str], seed: int = 0) -> dict[str, np.ndarray]:
    """A network from windows of words (joined by blanks), their documents (numbers from 0 on), and each document's label and
    whether it is kept to set the threshold (which ends up in the bias)."""
    rng, net = np.random.default_rng(seed), new_network(seed)
    place: dict[str, int] = {}
    ids = np.full((len(doc), WINDOW), -1, np.int32)
    for row, window in zip(ids, windows):
        found = window.split(" ")
        row[: len(found)] = [place.setdefault(w, len(place)) for w in found]
    words, adam = Words(list(place)), Adam(net)
    learned = np.flatnonzero(~check[doc])
    known = _known(doc[learned], ids[learned], words)
    for name in known:
        net[name][~known[name]] = 0

    def hide(n: int) -> np.ndarray:
        return (rng.random((n, 2)) >= HIDDEN).astype(np.float32) / np.float32(1 - HIDDEN)

    def most_toxic(logits: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The window with the largest logit of each document."""
        order = of[np.lexsort((logits[of], doc[of]))]
        return order[np.append(doc[order][1:] != doc[order][:-1], True)]

    for turn in range(WARM_PASSES + PASSES):
        if turn < WARM_PASSES:
            # As many windows of either label, each text with the same weight.
            chance = 1 / np.bincount(doc)[doc[learned]]
            chosen = []
            for y in (0, 1):
                own = label[doc[learned]] == y
                chosen.append(rng.choice(learned[own], min(int(own.sum()), 2 * TRAIN_PER_CLASS), p=chance[own] / chance[own].sum()))
        else:
            best = most_toxic(_logits(net, words, ids), learned)
            toxic, clean = best[label[doc[best]] == 1], best[label[doc[best]] == 0]
            others = rng.permutation(learned[label[doc[learned]] == 0])[: len(clean)]
            clean = np.concatenate([clean, others])
            chosen = [toxic, clean, np.repeat(toxic, max(0, round(len(clean) / len(toxic)) - 1))]
        order = rng.permutation(np.concatenate(chosen))
        for k in range(0, len(order), STEP):
            part = order[k : k + STEP]
            change = slopes(net, words, ids[part], label[doc[part]].astype(np.float32), hide)[1]
            for name in known:
                change[name] = tuple(x[known[name][change[name][0]]] for x in change[name])
            adam.apply(change)
    held = np.flatnonzero(check[doc]) if len(set(label[np.unique(doc[check[doc]])])) == 2 else np.arange(len(doc))
    logits = _logits(net, words, ids)
    best = most_toxic(logits, held)
    net["bias"] -= _threshold(logits[best], label[doc[best]])
    return net


def _threshold(logits: np.ndarray, label: np.ndarray) -> np.float32:
    """Between the logits where the shares of wrong clean and wrong toxic texts add up to least."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], label[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum()) + ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])) / max(1, (y == 0).sum())
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = int(best[len(best) // 2])
    return np.float32((x[max(0, k - 1)] + x[min(k, len(x) - 1)]) / 2)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows, spread over the text, that a labelled text takes part with; words joined by blanks."""
    for batch in batches:
        out = []
        for key, toxic, check, text in zip(*[c.to_pylist() for c in batch.columns]):
            words = words_of(text)
            starts, most = window_starts(len(words)), CHECK_WINDOWS if check else TRAIN_WINDOWS
            if len(starts) > most:
                starts = [starts[int(k)] for k in np.linspace(0, len(starts) - 1, most)]
            joined = [" ".join(w for w in words[k : k + WINDOW] if len(w) <= LONG_WORD) for k in starts]
            out += [(key, toxic, check, w) for w in joined if w]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "toxic", "check", "words"])


def _train_task(sample: pa.Table) -> pa.Table:
    rows = sample.sort_by([("key", "ascending"), ("words", "ascending")])
    keys, doc = np.unique(np.asarray(rows["key"]), return_inverse=True)
    label, check = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    label[doc], check[doc] = np.asarray(rows["toxic"]), np.asarray(rows["check"])
    if len(set(label[~check])) < 2:
        check[:] = False
    file = io.BytesIO()
    if len(set(label)) == 2:
        np.savez(file, **train(doc, label, check, (w.as_py() for w in rows["words"])))
    else:
        np.savez(file, constant=np.array([float(label.max())]))
    return pa.table({"model": pa.array([file.getvalue()], pa.binary())})


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 5; 0 is never learned from, 1 sets the threshold."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The network, or {'constant': the only label}, from labelled rows that are not held out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    known = keyed.select("doc_id", "key").join(own, "doc_id").select("key", "toxic")
    # At most TRAIN_PER_CLASS hashes a class, the smallest.
    chosen = [known.where(F.col("toxic") == y).distinct().orderBy("key").limit(TRAIN_PER_CLASS) for y in (0, 1)]
    sample = keyed.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").dropDuplicates(["key"])
    windows = sample.select("key", "toxic", (remainder() == 1).alias("check"), "text").mapInArrow(_sample_windows, "key long, toxic int, check boolean, words string")
    row = windows.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _train_task(t.drop_columns(["all"]) if "all" in t.column_names else t), "model binary").first()
    if row is None:
        return {"constant": np.array([0.0])}
    return dict(np.load(io.BytesIO(row["model"])))


class Scorer:
    """Scores texts; keeps the gate inputs of the words of earlier ones."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net, self.place, self.table = net, {}, np.zeros((0, 6 * STATES), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the table of gate inputs, for at most KEPT_WORDS words."""
        place = self.place
        new = list({w for w in words if w not in place})
        if new:
            used = len(place)
            gates = gate_inputs(self.net, Words(new))
            if used + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:used], np.zeros((max(len(new), used, 1024), 6 * STATES), np.float32)])
            self.table[used : used + len(new)] = gates
            place.update(zip(new, range(used, used + len(new))))
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The largest share of any window of each text, 0 without words."""
        best, ids, owner, held = np.full(len(texts), -np.inf), [], [], 0

        def flush():
            nonlocal held
            if held:
                np.maximum.at(best, np.concatenate(owner), read(self.net, self.table, np.concatenate(ids)))
                ids.clear(), owner.clear()
                held = 0
            if len(self.place) > KEPT_WORDS:
                self.place, self.table = {}, self.table[:0]

        for k, text in enumerate(texts):
            words = words_of(text)
            # Long texts in parts that overlap as windows do.
            part = STRIDE * TOGETHER
            for begin in range(0, max(1, len(words) - WINDOW + STRIDE), part):
                piece = words[begin : begin + part + WINDOW - STRIDE] if len(words) > part else words
                if not piece:
                    continue
                rows, starts = self.rows(piece), np.array(window_starts(len(piece)))
                found = rows[starts[:, None] + np.arange(WINDOW)] if len(piece) >= WINDOW else np.append(rows, np.full(WINDOW - len(rows), -1))[None]
                ids.append(found)
                owner.append(np.full(len(found), k))
                held += len(found)
                if held >= TOGETHER or len(self.place) > KEPT_WORDS:
                    flush()
        flush()
        return _sigmoid(np.maximum(best, -1e4)) * (best > -np.inf)


def score(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    rows = without(df, *RESULTS)
    net = fit(rows, labels)
    shared = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None if "constant" in shared.value else Scorer(shared.value)
        for texts in batches:
            if scorer is None:
                yield pa.array(np.full(len(texts), shared.value["constant"][0]))
            else:
                yield pa.array(scorer.scores(texts.to_pylist()).astype(float))

    (out,) = fresh(rows, "__score")
    scored = rows.withColumn(out, scores(text_of()))
    return scored.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"),
        F.col(out).alias("score"),
        (F.col(out) >= 0.5).cast("int").alias("predicted"),
    )
