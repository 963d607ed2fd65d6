"""The source divergence audit against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palisade.llm import divergence

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, top=50):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        everywhere = Counter()
        for g in groups:
            if g[0] == lang:
                everywhere.update({t: n[g][t] for t in kept})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = share(n[lang, source]), share(everywhere)
        pairs = []
        for other in {s for g, s in groups if g == lang and s != source}:
            o = share(n[lang, other])
            pairs.append((sum(abs(p[t] - o[t]) for t in kept), other))
        over = [(p[t] - q[t], t) for t in kept if n[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", over, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


def result(df, **options):
    rows = [tuple(r) for r in divergence.source_divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block,chunk", [(4096, 32), (8, 1)])
def test_matches_brute_force(spark, small, monkeypatch, block, chunk):
    """Also with blocks of eight terms and a source a chunk."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert result(docs) == brute(rows, 30)
    if block == 8:
        docs = docs.where("source < 'src13'")
        assert result(docs, least_docs=3, top=7) == brute([r for r in rows if r[1] < "src13"], 3, 7)


def test_odd_rows(spark, odd):
    """Nulls, ties, repeated rows, groups without terms, languages without kept terms, odd letters."""
    rows = [(None, None, "B a a"), ("", "", "a b"), (None, "x", None), ("de", "x", ""), ("de", "y", "12 34"), ("fr", "only", "é É Z z"),
            ("en", "a", "Straße İ don't"), ("en", "b", "straße STRAßE don t"), ("en", "b", "straße STRAßE don t"), ("en", "c", "w" * 30000), (" en", "a", "x")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    for least in (1, 2, 50):
        assert result(df, least_docs=least) == brute(rows, least)
    assert result(odd.selectExpr("lang", "kept as source", "text"), least_docs=1) == brute([("en", "kept-by-user", r["text"]) for r in odd.collect()], 1)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "lang string, source string, text string")) == set()


def test_counts_beyond_long_arithmetic(spark):
    """10^9 times a count leaves 64 bits; shares stay exact."""
    big = 12_345_678_901_234
    assert divergence.shares(np.array([big, 0, -1]), 10**14, 3).tolist() == [1 + 10**9 * (big + 5) // (10**14 + 15), 1, 0]
    (got,) = spark.range(1).select(divergence.share(*map(lambda x: divergence.F.lit(x), (big, 10**14, 3))).alias("p")).first()
    assert got == 1 + 10**9 * (big + 5) // (10**14 + 15)


def test_equal_subtrees_are_one_node_and_pairs_are_priced_once():
    counts = np.array([[0, 1, 0, 1, 0, 1, 0, 1], [2, 2, 2, 2, 2, 2, 2, 2], [0, 1, 0, 1, 2, 2, 2, 2]])
    values, levels, roots = divergence.hash_consed(counts)
    assert [len(left) for left, _ in levels] == [2, 2, 3] and len(set(roots)) == 3
    asked = []

    def price(k, a, b):
        asked.extend(zip(k, values[a], values[b]))
        return np.abs(values[a] - values[b])

    assert divergence.traverse(levels, roots[0], roots[[1, 2]], price).tolist() == np.abs(counts[0] - counts[1:]).sum(1).tolist()
    assert sorted(asked) == [(0, 0, 2), (0, 1, 2), (1, 0, 0), (1, 0, 2), (1, 1, 1), (1, 1, 2)]
