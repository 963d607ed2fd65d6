"""Source divergence audit: how far the word use of the sources of a language lies apart.

The kept terms of a language get numbers and are cut into blocks. Within a block the counts
of a group (a source in a language) are the leaves of a segment tree whose nodes are
hash-consed: a node is the pair of its children, wherever it stands and in whichever group,
so equal count subtrees are one node. Two trees are traversed together from their roots;
a pair of nodes that turned up before is not priced again. Spark counts the terms, deals
out the blocks (and pairs of chunks of sources, where a language has many) and adds up
the blocks' prices; nothing larger than a block of a chunk's sources meets in one task.

Defined results: null text, lang and source are empty strings; a group without terms has
trees of zeros; a language without kept terms gives distances of 0 and no term rows; a
source alone in its language has no pair rows; repeated rows count as often as they occur;
other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import text_of, written

#: Documents of a language that a kept term occurs in, what is added to each count, the
#: unit of shares, and the ranks of terms that are reported.
LEAST_DOCS, ADDED, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Leaves of a block's trees (a power of two), sources that meet in one task (on average,
#: twice), and counters that a counting task holds before it sends them on.
BLOCK, CHUNK, COUNTERS = 4096, 32, 400_000

COUNTS = "lang string, source string, term string, n long, docs long"
PRICES = "lang string, a string, b string, value long"

#: A-Z become a-z, all other ASCII but a-z blanks: what is left between blanks are terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, in bounded portions."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def portions():
        for (lang, source), (n, docs) in groups.items():
            found = list(n)
            columns = [pa.repeat(lang, len(found)), pa.repeat(source, len(found)), pa.array(found, pa.binary()).cast(pa.string())]
            columns += [pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs.__getitem__, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts):
            found = terms(text.as_py())
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(found)
            docs.update(set(found))
            held += len(n)
            if held > COUNTERS:
                yield from portions()
                held = 0
    yield from portions()


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, docs: of the language) of the terms that a language keeps."""
    counted = docs.select(*[text_of(c).alias(c) for c in ("lang", "source", "text")]).mapInArrow(_count, COUNTS)
    # One exchange serves the counts by source and the documents by language.
    by_source = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = by_source.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return written(everywhere.where(F.col("docs") >= least_docs))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.expr("1L") + F.call_function("div", wide(n + ADDED) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + ADDED * kept))


def hash_consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The trees over the rows of counts: different leaf values, per level (leaves' parents
    first) the children of each node, and each row's root."""
    values, nodes = np.unique(counts, return_inverse=True)
    nodes, levels = nodes.reshape(counts.shape), []
    while nodes.shape[1] > 1:
        left, right = nodes[:, ::2].astype(np.int64), nodes[:, 1::2].astype(np.int64)
        wide = int(nodes.max()) + 1
        keys, inverse = np.unique(left * wide + right, return_inverse=True)
        levels.append((keys // wide, keys % wide))
        nodes = inverse.reshape(left.shape)
    return values, levels, nodes[:, 0]


def traverse(levels: list[tuple[np.ndarray, np.ndarray]], root: int, others: np.ndarray, price) -> np.ndarray:
    """The price of one root against each of others. A pair of nodes is (k, node of the
    one tree, node of others[k]'s); each level visits its different pairs once.

    price(k, leaf, leaf of k) is that of pairs of leaves."""
    k, a, b = np.arange(len(others)), np.full(len(others), root, np.int64), others.astype(np.int64)
    ways = []
    for left, right in reversed(levels):
        k, a, b = np.concatenate([k, k]), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
        wide = max(int(a.max()), int(b.max())) + 1
        keys, way = np.unique((k * wide + a) * wide + b, return_inverse=True)
        ways.append(way)
        keys, b = np.divmod(keys, wide)
        k, a = np.divmod(keys, wide)
    total = price(k, a, b)
    for way in reversed(ways):
        both, half = total[way], len(way) // 2
        total = both[:half] + both[half:]
    return total


def shares(values: np.ndarray, total: int, kept: int) -> np.ndarray:
    """share() of each count; a leaf beyond the block's terms (-1) has none, 0."""
    return np.array([0 if v < 0 else 1 + UNIT * (v + ADDED) // (total + ADDED * kept) for v in values.tolist()], np.int64)


def _price_block(trees: pa.Table) -> pa.Table:
    """The distance of each pair of a block's sources: of one chunk, or of one with another."""
    rows = trees.sort_by("source").to_pydict()
    lang, size, own = rows["lang"][0], rows["size"][0], rows["low"][0] == rows["high"][0]
    names, chunks = rows["source"], np.array(rows["chunk"])
    counts = np.full((len(names), 1 << max(size - 1, 0).bit_length()), -1, np.int64)
    counts[:, :size] = 0
    for row, leaves, ns in zip(counts, rows["leaves"], rows["ns"]):
        row[leaves] = ns
    values, levels, roots = hash_consed(counts)
    p = np.stack([shares(values, t, v) for t, v in zip(rows["total"], rows["kept"])])
    a, b, value = [], [], []
    for i, name in enumerate(names):
        other = np.arange(len(names)) > i
        if not own:
            other &= chunks != chunks[i]
        others = np.flatnonzero(other)
        if len(others):
            prices = traverse(levels, int(roots[i]), roots[others], lambda k, a, b: np.abs(p[i, a] - p[others[k], b]))
            a += [name] * len(others)
            b += [names[j] for j in others]
            value += prices.tolist()
    columns = [pa.repeat(lang, len(a)), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())]
    return pa.Table.from_arrays(columns, ["lang", "a", "b", "value"])


def numbered(kept: DataFrame) -> DataFrame:
    """(lang, term, block, leaf): terms of like frequency stand together, which makes equal
    subtrees likely. As a table, so that every reader sees the same numbers."""
    vocabulary = kept.groupBy("lang", "term").agg(F.max("docs").alias("docs"))
    ordered = vocabulary.repartitionByRange("lang", F.desc("docs"), "term").sortWithinPartitions("lang", F.desc("docs"), "term")
    place = F.monotonically_increasing_id()
    placed = ordered.select("lang", "term", place.alias("place"))
    # Places count from a multiple of 2^33 in each partition.
    return written(placed.select("lang", "term", F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") % BLOCK).cast("int").alias("leaf")))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has every other source of the
    language by its distance, part 'term' the terms that the source overuses most."""
    kept = kept_counts(docs, least_docs)
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    size = kept.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    totals = (
        groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(size, "lang", "left")
        .join(groups.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "lang")
        .na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks"))
    )
    totals = written(totals)

    places = numbered(kept)
    # A block without terms in each language gives pairs where no term is kept.
    blocks = places.groupBy("lang", "block").agg((F.max("leaf") + 1).alias("size"), F.min("leaf").alias("first"))
    blocks = blocks.unionByName(groups.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("size"), F.lit(0).alias("first")))
    leaves = (
        kept.join(places, ["lang", "term"])
        .groupBy("lang", "source", "block")
        .agg(F.collect_list(F.struct("leaf", "n")).alias("found"))  # of at most BLOCK terms
    )
    trees = totals.join(blocks, "lang").join(leaves, ["lang", "source", "block"], "left")
    # A block that starts within a partition's block of another language begins at its first leaf.
    trees = trees.withColumn("found", F.coalesce("found", F.array().cast("array<struct<leaf:int,n:bigint>>"))).select(
        "lang", "source", "block", "chunk", "total", "kept", (F.col("size") - F.col("first")).alias("size"),
        F.expr("transform(found, x -> x.leaf - first)").alias("leaves"), F.col("found.n").alias("ns"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"),
    ).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    prices = trees.groupBy("lang", "block", "low", "high").applyInArrow(_price_block, PRICES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = prices.select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    overall = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    priced = kept.join(overall, ["lang", "term"]).join(totals, ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1])
