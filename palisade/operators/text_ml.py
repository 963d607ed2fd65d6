"""n-grams, similarity, entropy and endpoint baselines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZES = (2, 3, 4)
SIMILAR = 0.5
#: An endpoint's own baseline counts from so many requests on.
LEAST_SAMPLES = 10
#: Texts and characters of a left and of a right portion (about), and common n-grams that a task looks at together.
LEFT_TEXTS, RIGHT_TEXTS, PORTION_CHARS, TOGETHER = 512, 256, 1 << 20, 1 << 21
MOST_TASKS = 10_000


def ngrams(text: Column, sizes=SIZES) -> Column:
    """Character n-grams of the lower-cased text, with repeats, by size and place."""
    low = F.lower(text)
    of_size = lambda n: F.when(
        F.char_length(low) >= n, F.transform(F.sequence(F.lit(1), F.char_length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return F.flatten(F.array(*[of_size(n) for n in sizes]))


def ngram_counts(rows: DataFrame, key: str, text: str, sizes=SIZES) -> DataFrame:
    """key, ngram, n. Spark sums within each task before it shuffles."""
    return rows.select(key, F.explode(ngrams(F.col(text), sizes)).alias("ngram")).groupBy(key, "ngram").agg(F.count("*").alias("n"))


def by_frequency(counts: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """counts (key, ngram, n) with place: the commonest n-gram of each key first, of equals the first by text."""
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "ngram")))
    return placed if n is None else placed.where(F.col("place") <= n)


def similarity(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = SIMILAR) -> DataFrame:
    """Multiset Jaccard and cosine of the n-gram counts of left and right (key, ngram, n), for
    every pair whose Jaccard similarity reaches threshold.

    Candidates come from the rarer n-grams of each side (_candidates); only theirs are counted in full."""
    sizes = lambda df, key, name: df.groupBy(key).agg(F.sum("n").alias(f"{name}_n"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias(f"{name}_norm"))
    l_sizes, r_sizes = sizes(left, left_key, "l"), sizes(right, right_key, "r")
    pairs = _candidates(left, right, left_key, right_key, l_sizes, r_sizes, threshold)
    both = pairs.join(left, left_key).join(right.withColumnRenamed("n", "m"), [right_key, "ngram"])
    shared = both.groupBy(left_key, right_key).agg(F.sum(F.least("n", "m")).alias("both"), F.sum(F.col("n") * F.col("m")).alias("dot"))
    rows = shared.join(l_sizes, left_key).join(r_sizes, right_key)
    return rows.select(
        left_key, right_key,
        (F.col("both") / (F.col("l_n") + F.col("r_n") - F.col("both"))).alias("jaccard"),
        (F.col("dot") / (F.col("l_norm") * F.col("r_norm"))).alias("cosine"),
    ).where(F.col("jaccard") >= threshold)


def _candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, l_sizes: DataFrame, r_sizes: DataFrame, threshold: float) -> DataFrame:
    """left_key, right_key of pairs that can reach threshold.

    All n-grams have one order, rarest first. A side's prefix is what the least overlap leaves out, and one
    n-gram: a similar pair shares some of it, so that no commonest n-gram is a join key. Beyond the prefix
    that ends first (its last n-gram is in front of the other's) a pair can share no more than what that side
    has left there; what it shares before is counted, and pairs whose sum is too small go."""
    rarity = left.select("ngram", "n").unionByName(right.select("ngram", "n")).groupBy("ngram").agg(F.sum("n").alias("common"))

    def rarest(df: DataFrame, key: str, sized: DataFrame, side: str) -> DataFrame:
        """key, order, n, size, rest (occurrences beyond the prefix) and end (its last n-gram) of a side's prefixes."""
        size, order = f"{side}_n", F.struct("common", F.xxhash64("ngram").alias("h"), "ngram")
        rows = df.join(rarity, "ngram").join(sized.select(key, size), key).withColumn("order", order)
        # Each occurrence counts: an n-gram is in if those that are rarer do not fill the prefix.
        upto = Window.partitionBy(key).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") - F.col("n") <= F.col(size) - F.ceil(F.col(size) * threshold))
        whole = Window.partitionBy(key)
        rest, end = F.col(size) - F.max("upto").over(whole), F.max("order").over(whole)
        end = F.struct(end["common"].alias("common"), end["h"].alias("h"))
        return rows.select(key, "ngram", F.col("n").alias(f"{side}_here"), size, rest.alias(f"{side}_rest"), end.alias(f"{side}_end"))

    met = rarest(left, left_key, l_sizes, "l").join(rarest(right, right_key, r_sizes, "r"), "ngram")
    met = met.where((F.col("l_n") >= F.col("r_n") * threshold) & (F.col("r_n") >= F.col("l_n") * threshold))
    # Equal ends (or, never seen, equal hashes of different ones) are either side's.
    rest = F.when(F.col("l_end") < F.col("r_end"), F.col("l_rest")).when(F.col("l_end") > F.col("r_end"), F.col("r_rest")).otherwise(F.greatest("l_rest", "r_rest"))
    least = (F.col("l_n") + F.col("r_n")) * threshold / (1 + threshold)
    found = met.groupBy(left_key, right_key).agg(F.sum(F.least("l_here", "r_here")).alias("before"), F.first(rest).alias("rest"), F.first(least).alias("least"))
    return found.where(F.col("before") + F.col("rest") >= F.col("least") - 1e-6).select(left_key, right_key)


def _owned_terms(texts: list[str], owner: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram as a number, n) of texts, by owner. An n-gram is numbered as the one without its last character, and that."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner, left = np.repeat(owner, length), np.repeat(np.cumsum(length), length) - np.arange(len(chars))
    number, known, found = np.zeros(len(chars), np.int64), 0, []
    for n in range(1, max(sizes) + 1):
        starts = np.flatnonzero(left >= n)
        values, number[starts] = np.unique(number[starts] << 21 | chars[starts + n - 1], return_inverse=True)
        if n in sizes:
            found.append((owner[starts], number[starts] + known))
            known += len(values)
    owners, terms = (np.concatenate(x) for x in zip(*found))
    pairs, n = np.unique(owners * max(known, 1) + terms, return_counts=True)
    return pairs // max(known, 1), pairs % max(known, 1), n


def _compared(left: pa.Table, right: pa.Table, threshold: float, sizes) -> pa.Table:
    """Keys, jaccard and cosine of the similar pairs of two tables (key, text)."""
    coded = [side.column(0).combine_chunks().dictionary_encode() for side in (left, right)]
    n_left, n_right = (len(c.dictionary) for c in coded)
    owner = np.concatenate([np.asarray(coded[0].indices, np.int64), np.asarray(coded[1].indices, np.int64) + n_left])
    owner, term, n = _owned_terms(left.column(1).to_pylist() + right.column(1).to_pylist(), owner, sizes)
    size = np.bincount(owner, n, n_left + n_right)
    norm = np.sqrt(np.bincount(owner, n * n, n_left + n_right))
    cut = int(np.searchsorted(owner, n_left))
    # The right side by n-gram; of each n-gram on the left, its place and how many texts there have it.
    order = cut + np.argsort(term[cut:], kind="stable")
    begin = np.searchsorted(term[order], term[:cut])
    holders = np.searchsorted(term[order], term[:cut], "right") - begin
    upto, both, dot, done = np.cumsum(holders), np.zeros(n_left * n_right), np.zeros(n_left * n_right), 0
    while done < cut:
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + TOGETHER, "right")))
        of = np.repeat(np.arange(done, end), holders[done:end])
        other = order[np.arange(len(of)) - np.repeat(np.cumsum(holders[done:end]) - holders[done:end] - begin[done:end], holders[done:end])]
        # The left side is sorted: only the rows of these texts.
        low, high = owner[done] * n_right, (owner[end - 1] + 1) * n_right
        pair = owner[of] * n_right + owner[other] - n_left - low
        both[low:high] += np.bincount(pair, np.minimum(n[of], n[other]), high - low)
        dot[low:high] += np.bincount(pair, n[of] * n[other], high - low)
        done = end
    met = np.flatnonzero(both)
    i, j = met // n_right, met % n_right
    share = both[met] / (size[i] + size[n_left + j] - both[met])
    met, i, j, share = (x[share >= threshold] for x in (met, i, j, share))
    columns = [coded[0].dictionary.take(pa.array(i)), coded[1].dictionary.take(pa.array(j)), pa.array(share), pa.array(dot[met] / (norm[i] * norm[n_left + j]))]
    return pa.table(columns, names=[left.column_names[0], right.column_names[0], "jaccard", "cosine"])


def similar_texts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, threshold: float = SIMILAR, sizes=SIZES) -> DataFrame:
    """What similarity() finds for the n-grams of text on both sides, from the texts themselves.

    For low thresholds, at which n-grams leave nearly no pair out: each pair of texts is compared, in as many
    tasks as there are pairs of portions of both sides. Texts are shuffled, once for each portion of the other side, n-grams never."""

    def sides(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
        rows = df.select(F.col(key), F.lower(text).alias("text_")).where(F.col(key).isNotNull() & F.col("text_").isNotNull())
        n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text_")), F.lit(0))).first()
        return rows, max(1, math.ceil(n / most), math.ceil(chars / PORTION_CHARS))

    (l_rows, l_parts), (r_rows, r_parts) = sides(left, left_key, LEFT_TEXTS), sides(right, right_key, RIGHT_TEXTS)
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l_dealt = l_rows.select(left_key, "text_", part(left_key, l_parts).alias("l_part"), every(r_parts).alias("r_part"))
    r_dealt = r_rows.select(right_key, "text_", every(l_parts).alias("l_part"), part(right_key, r_parts).alias("r_part"))
    kind = lambda rows, key: f"`{key}` {rows.schema[key].dataType.simpleString()}"
    schema = f"{kind(l_rows, left_key)}, {kind(r_rows, right_key)}, jaccard double, cosine double"
    compare = lambda a, b: _compared(a.select([left_key, "text_"]), b.select([right_key, "text_"]), threshold, sizes)
    # A number of tasks of its own: Spark would put portions of few bytes together, which are much work.
    tasks = min(l_parts * r_parts, MOST_TASKS)
    l_dealt, r_dealt = (rows.repartition(tasks, "l_part", "r_part").groupBy("l_part", "r_part") for rows in (l_dealt, r_dealt))
    return l_dealt.cogroup(r_dealt).applyInArrow(compare, schema)


def most_similar(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """The best partner of each key; ties go to the smallest."""
    return (
        pairs.groupBy(key)
        .agg(F.min_by(other, F.struct(-F.col("jaccard"), F.col(other))).alias(other), F.max("jaccard").alias("jaccard"))
    )


def portions(values: list, most: int = PORTION_CHARS):
    """values in runs of at most `most` characters or bytes, or of one value."""
    begin, held = 0, 0
    for k, value in enumerate(values):
        if held + len(value) > most and k > begin:
            yield values[begin:k]
            begin, held = k, 0
        held += len(value)
    if values:
        yield values[begin:]


def spelled(values: list) -> tuple[np.ndarray, np.ndarray]:
    """(the value that each character, or byte, is of; its number) of all values one after the other."""
    joined = b"".join(values) if values and isinstance(values[0], bytes) else "".join(values).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(joined, "u1" if values and isinstance(values[0], bytes) else "<u4")
    return np.repeat(np.arange(len(values)), np.fromiter(map(len, values), np.int64, len(values))), chars.astype(np.int64)


def entropies(values: list, size: np.ndarray) -> np.ndarray:
    """Bits of each value's characters (or bytes) as shares of its size, the smallest first."""
    owner, chars = spelled(values)
    pairs, n = np.unique(owner << 21 | chars, return_counts=True)
    share = n / size[pairs >> 21]
    return np.bincount(pairs >> 21, -share * np.log2(share), len(values))


def by_portion(values: pa.Array, made, kind: pa.DataType) -> pa.Array:
    """What made gives for the values of a portion (an array of them, or of lists), null for null."""
    null = np.asarray(values.is_null())
    known = values.drop_null().to_pylist()
    found = [x for part in portions(known) for x in made(part).tolist()]
    out = np.full(len(null), None, object)
    for place, x in zip(np.flatnonzero(~null), found):
        out[place] = x
    return pa.array(out, kind)


@F.arrow_udf(T.DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    return by_portion(texts, lambda part: entropies(part, np.array([len(t.encode()) for t in part], float)), pa.float64())


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, over the length in bytes."""
    return _entropy(text)
