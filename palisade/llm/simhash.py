"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Two nodes of the trie are visited together with the number of bits in which their
prefixes differ; a pair that has spent more than the error budget is pruned. Spark
deals out the pairs of nodes at one depth: every distinct fingerprint goes to the
pairs that its node can still reach. A pair that would hold too many fingerprints is
dealt again at a greater depth, as often as it takes, within what is left of its
budget; every other pair is traversed to the leaves in one group, which returns a
spanning forest of the links found, never all pairs.
Links are then joined to components on Spark. Copies share a fingerprint and are
one row from the first aggregation on.

Defined results: a null or empty text has fingerprint zero, which links like any
other; texts of one or two words have one shingle; a component's id is its smallest
doc_id, null if it has none; repeated rows are in one component; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import fresh, set_aside, text_of, written

SEED = 42
SHINGLE_WORDS = 3
MAX_DIFFERING = 2
#: Fingerprints that a node of the first dealt depth holds on average, that depth's limits,
#: how much deeper pairs go that hold more than PAIR, and the depth where none is split.
NODE, LEAST_DEPTH, MOST_DEPTH, STEP, PAIR, LAST_DEPTH = 1 << 17, 6, 24, 6, 1 << 20, 60
#: Nodes are compared directly when they make at most so many pairs; pairs of nodes
#: are visited in runs of at most FRONTIER.
LEAF_PAIRS, FRONTIER = 32, 1 << 18
#: Dropped rows (two numbers each) are broadcast if they are at most so many.
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    joined, k = b" ".join(words), min(SHINGLE_WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[k - 1 :].tolist())], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_hex(column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _halves(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the one-child of each node [low, high) at depth begins."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    keep = ~np.uint64((1 << (64 - depth)) - 1) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (values[low] & keep) | bit), low, high)


def _expand(low_a, high_a, low_b, high_b):
    """All index pairs of runs of node pairs."""
    wide, n = high_b - low_b, (high_a - low_a) * (high_b - low_b)
    run = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    return low_a[run] + k // wide[run], low_b[run] + k % wide[run]


def _join_up(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i[k] and j[k] for every k; parents never exceed their children."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def trie_forest(values: np.ndarray, split: int, depth: int = 0, errors: int = 0, budget: int = MAX_DIFFERING) -> np.ndarray:
    """The parents of a spanning forest of links in sorted distinct values: of one
    node with itself (split 0), or between nodes [0, split) and [split, n)."""
    n = len(values)
    parent = np.arange(n)
    ranges = (0, n, 0, n) if not split else (0, split, split, n)
    stack = [(depth, *(np.array([x]) for x in ranges), np.array([errors]))] if n > 1 else []
    while stack:
        depth, la, ha, lb, hb, e = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(depth, *(x[:half] for x in (la, ha, lb, hb, e))), (depth, *(x[half:] for x in (la, ha, lb, hb, e)))]
            continue
        small = ((ha - la) * (hb - lb) <= LEAF_PAIRS) | (depth == 64)
        if small.any():
            i, j = _expand(la[small], ha[small], lb[small], hb[small])
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            _join_up(parent, i[near], j[near])
        la, ha, lb, hb, e = (x[~small] for x in (la, ha, lb, hb, e))
        if not len(la):
            continue
        ma, mb = _halves(values, la, ha, depth), _halves(values, lb, hb, depth)
        same = la == lb
        children = [(la, ma, lb, mb, e), (ma, ha, mb, hb, e), (la, ma, mb, hb, e + 1)]
        mirrored = tuple(x[~same] for x in (ma, ha, lb, mb, e + 1))
        la, ha, lb, hb, e = (np.concatenate(x) for x in zip(*children, mirrored))
        alive = (e <= budget) & (la < ha) & (lb < hb)
        # A node with itself has no pair to give once it holds one value.
        alive &= (la != lb) | (ha - la > 1)
        if alive.any():
            stack.append((depth + 1, *(x[alive] for x in (la, ha, lb, hb, e))))
    return parent


def _reach(bits: int) -> list[int]:
    """Masks of at most MAX_DIFFERING of so many bits."""
    one = [1 << k for k in range(bits)]
    return [0, *one, *(a | b for k, a in enumerate(one) for b in one[:k])]


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _deal(rows: DataFrame, depth: int, step: int) -> DataFrame:
    """rows (fp, first, second and others), where first and second are the prefixes of a
    pair of nodes at depth, with those of every pair step bits deeper that fp can reach."""
    masks = F.array(*[F.lit(m).cast("long") for m in _reach(step)])
    others = [c for c in rows.columns if c not in ("first", "second")]
    own = _prefix(depth + step)
    other = F.when(F.col("first") == _prefix(depth), F.col("second")).otherwise(F.col("first"))
    facing = F.shiftleft(other, step).bitwiseOR(own.bitwiseAND(F.lit((1 << step) - 1).cast("long"))).bitwiseXOR(F.col("mask"))
    # Below a node and itself, a pair has its nodes in order; below two nodes the order stands.
    spent = F.bit_count(F.col("first").bitwiseXOR(F.col("second"))) + F.bit_count("mask")
    return (
        rows.withColumn("mask", F.explode(masks))
        .where(spent <= MAX_DIFFERING)
        .select(*others, F.least(own, facing).alias("first"), F.greatest(own, facing).alias("second"))
    )


def _traverse(dealt: DataFrame, depth: int) -> DataFrame:
    """The links (a, b) within each pair of nodes at depth."""

    def traverse(group: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(group["fp"].to_numpy().view(np.uint64))
        first, second = int(group["first"].iat[0]), int(group["second"].iat[0])
        if first == second:
            parent = trie_forest(values, 0, depth)
        else:
            split = int(np.searchsorted(values, np.uint64(second << (64 - depth))))
            if split in (0, len(values)):
                return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
            parent = trie_forest(values, split, depth, (first ^ second).bit_count())
        child = np.flatnonzero(parent != np.arange(len(values)))
        return pd.DataFrame({"a": values[child].view(np.int64), "b": values[parent[child]].view(np.int64)})

    return dealt.groupBy("first", "second").applyInPandas(traverse, "a long, b long")


def links(fingerprints: DataFrame, node: int = NODE, pair: int = PAIR) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints (fp) that are near, through others or not."""
    n = fingerprints.count()
    root = F.lit(0).cast("long")
    rows, depth = fingerprints.select("fp", root.alias("first"), root.alias("second")), 0
    step = min(MOST_DEPTH, max(LEAST_DEPTH, math.ceil(math.log2(max(n, 1) / node))))
    found = []
    while True:
        # How many fingerprints each deeper pair will hold, from the counts of nodes alone.
        nodes = rows.groupBy("first", "second", F.shiftleft(_prefix(depth + step), 64 - depth - step).alias("fp")).agg(F.count("*").alias("n"))
        held = _deal(nodes, depth, step).groupBy("first", "second").agg(F.sum("n").alias("n"))
        dealt, last = _deal(rows, depth, step), depth + step == LAST_DEPTH
        # Few pairs are left out at the first depth; deeper, most would hold one fingerprint.
        held = written(held.where(F.col("n") > (1 if depth else pair)))
        depth += step
        full = held.where(F.lit(not last) & (F.col("n") > pair))
        if last or full.isEmpty():
            found.append(_traverse(dealt.join(held, ["first", "second"], "left_semi") if depth > step else dealt, depth))
            break
        fits = dealt.join(full, ["first", "second"], "left_anti")
        if depth > step:
            fits = fits.join(held, ["first", "second"], "left_semi")
        found.append(_traverse(fits, depth))
        rows = written(dealt.join(full, ["first", "second"], "left_semi").select("fp", "first", "second"))
        step = min(STEP, LAST_DEPTH - depth)
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it reaches.

    Large-star and small-star in turn, until the edges are stars; each round ends in
    a table of the shared folder."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Tables of their own: a join with what a shuffle has just summed up could not split a hub.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select("b", "m", "a")
        edges = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def fingerprint_classes(stored: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the documents (doc_id, fp); root names the component."""
    distinct = written(stored.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = distinct.join(components(links(distinct)), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    stored = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(text_of()).alias("fp")))
    return stored.join(fingerprint_classes(stored), "fp").select("doc_id", fingerprint_hex("fp").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with the first row of each component: its smallest doc_id, nulls last."""
    renamed, own = set_aside(docs, ("fp",))
    identity, kept = fresh(renamed, "__identity", "__kept")
    text = F.xxhash64(text_of())
    stored = written(
        renamed.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text_id"), fingerprint_udf(text_of()).alias("fp"))
    )
    classed = stored.join(fingerprint_classes(stored).withColumnRenamed("component_id", "least"), "fp")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    chosen = classed.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("root").agg(F.min(place).alias("p"))
    chosen = written(chosen.select(F.col("p.doc_id").alias("keep_doc"), F.col("p.text_id").alias("keep_text")))
    of_chosen = lambda text_id: F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col(text_id) == F.col("keep_text"))
    # Few rows go, as a rule: then the texts are filtered where they lie, not shuffled.
    dropped = written(stored.join(chosen, of_chosen("text_id"), "left_anti").select(F.col("doc_id").alias("keep_doc"), F.col("text_id").alias("keep_text")))
    marked = renamed.withColumn(identity, text)
    if dropped.count() <= BROADCAST_ROWS:
        out = marked.join(F.broadcast(dropped), of_chosen(identity), "left_anti")
    else:
        out = marked.join(chosen, of_chosen(identity), "left_semi")
    # Rows repeated in full are told apart only where there are any.
    times = stored.join(chosen, of_chosen("text_id"), "left_semi").groupBy("doc_id", "text_id").agg(F.count("*").alias("n"))
    if not times.where("n > 1").isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id", identity).orderBy(identity)) == 1
        out = out.withColumn(kept, first).where(F.col(kept))
    return out.select(*own)
