"""Quality, deduplication and near-duplicates against brute force."""

import hashlib
import re
import time

import numpy as np
import xxhash

from palisade.llm import exact_dedup, line_quality, queries, sentence_spans, simhash


def lower(text):
    return (text or "").encode().lower().decode()


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = exact_dedup.mark_duplicates(odd).collect()
    assert len(rows) == odd.count()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r["text"]), []).append(r)
    for members in groups.values():
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        keep = max(ids) if ids else None
        assert {(r["keep_id"], r["group_size"]) for r in members} == {(keep, len(members))}
        kept = [r for r in members if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == keep
    stay = exact_dedup.exact_dedup(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)
    assert set(r["kept"] for r in stay.collect()) == {"kept-by-user"}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_quality_of_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in line_quality.quality(odd).collect()}
    assert not any(r["kept"] for r in rows.values())
    assert rows[7]["n_words"] == 0 and rows[11]["n_repeat_words"] == 1200 and rows[2]["word_chars"] == 20000
    assert line_quality.clean_documents(odd).columns == odd.columns
    assert line_quality.quality(empty).count() == 0


def test_lines_that_fail_are_removed(spark):
    prose = "\n".join(f"Line{i} has{i} several{i} plain{i} words in it, number {i * 7}." for i in range(20))
    noise = "home | about | contact | more\nBUY!! NOW!! OR!! NEVER!!\nto%%% the&&& end###\nAll rights reserved."
    docs = spark.createDataFrame([(1, f"{prose}\n{noise}", 0), (2, noise + "\n" + noise.upper() * 9 + "\n" + prose[:400], 0)], "doc_id long, text string, n_chars long")
    kept = line_quality.clean_documents(docs).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept] == [(1, prose, len(prose))]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(values):
    values, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= simhash.MAX_DIFFERING):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_op6_matches_brute_force(spark, small, texts):
    rows = sorted(queries.op6_simhash_trie(spark, small).collect(), key=lambda r: r["doc_id"])
    prints = [brute_fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    ids = [r["doc_id"] for r in rows]
    assert [r["component_id"] for r in rows] == [ids[k] for k in brute_components(prints)]


def test_trie_forest_matches_brute_force():
    rng = np.random.default_rng(7)
    one = np.uint64(1)
    for _ in range(10):
        centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
        flip = lambda v: v ^ (one << rng.integers(0, 64, len(v)).astype(np.uint64))
        near = [flip(flip(centres[rng.integers(0, 4, 80)])) for _ in range(3)]
        values = np.unique(np.concatenate([rng.integers(0, 2**64, 60, dtype=np.uint64), *near]))
        assert simhash.trie_forest(values, 0).tolist() == brute_components(values)


def test_links_over_all_node_pairs(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    values = {int(centre)} | {int(centre) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(64)}
    chain = int(rng.integers(0, 2**64, dtype=np.uint64))
    for k in range(0, 64, 2):
        chain ^= 3 << k
        values.add(chain)
    values |= {int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    classes = simhash.fingerprint_classes(spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long"))
    got = {r["fp"]: r["component_id"] for r in classes.collect()}
    assert [got[v] for v in signed] == brute_components(values)


def test_dense_nodes_are_dealt_deeper(spark):
    """A third of all fingerprints share their first 20 bits; pairs of at most 100 are traversed."""
    rng = np.random.default_rng(11)
    top = rng.integers(0, 2**64, dtype=np.uint64) & ~np.uint64(2**44 - 1)
    near = top | rng.integers(0, 2**10, 120, dtype=np.uint64) << np.uint64(30)
    cluster = [int(near[0]) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, a, 11)]
    values = sorted({*near.tolist(), *cluster, *rng.integers(0, 2**64, 60, dtype=np.uint64).tolist()})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fingerprints = spark.createDataFrame([(v,) for v in signed], "fp long")
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    place = {v: k for k, v in enumerate(signed)}
    for r in simhash.links(fingerprints, node=128, pair=100).collect():
        a, b = find(place[r["a"]]), find(place[r["b"]])
        root[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(values))] == brute_components(values)


def test_near_dedup_of_odd_rows(odd, empty, monkeypatch):
    rows = simhash.near_duplicates(odd).collect()
    prints = [brute_fingerprint(r["text"]) for r in odd.collect()]
    assert len(rows) == len(prints)
    for most in (200_000, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        stay = simhash.near_dedup(odd)
        assert stay.columns == odd.columns
        assert stay.count() == len(set(brute_components(prints)))
    assert simhash.near_dedup(empty).count() == 0


def brute_spans(docs):
    """docs: (doc_id, text) in order; texts without the sentences of repeated runs."""
    seen, out = set(), []
    for _, text in docs:
        parts = sentence_spans.sentences(text)
        words = [lower(p).split() for p in parts]
        gone = set()
        for i in range(len(parts)):
            j = i + sentence_spans.MIN_SENTENCES - 1
            while j < len(parts) and sum(map(len, words[i : j + 1])) < sentence_spans.MIN_WORDS:
                j += 1
            if j < len(parts):
                run = tuple(w for part in words[i : j + 1] for w in part)
                if run in seen:
                    gone |= set(range(i, j + 1))
                seen.add(run)
        out.append("".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_sentences_of_long_texts_take_linear_time():
    begun = time.process_time()
    for text in (" " * 1_000_000, "." * 1_000_000 + "x", "\n " * 500_000 + "x", "x. " * 300_000):
        assert "".join(sentence_spans.sentences(text)) == text
    assert time.process_time() - begun < 20


def test_op4_matches_brute_force(spark, small, texts):
    rows = sorted(queries.op4_sentence_spans(spark, small).collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == brute_spans(sorted(texts.items()))
    for r in rows:
        assert r["n_removed"] == len(texts[r["doc_id"]]) - len(r["text"])
        if r["removed"]:
            spans = [tuple(map(int, s.split(":"))) for s in r["removed"].split(",")]
            assert sum(b - a for a, b in spans) == r["n_removed"]


def test_spans_of_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in sentence_spans.dedup_spans(odd).collect()}
    assert rows[7]["text"] is None and rows[3]["text"] == "" and rows[2]["text"] == "q" * 20000
    assert rows[11]["text"] == "same text again. " and rows[12]["text"] == ""
    assert rows[9]["kept"] == "kept-by-user"
    assert sentence_spans.dedup_spans(empty).count() == 0


def test_text_sha256(spark, small, texts):
    rows = queries.op9_exact_dedup(spark, small).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in rows} == {i: hashlib.sha256(lower(t).encode()).hexdigest() for i, t in texts.items()}


def brute_passages(docs, size=51):
    """Places (doc, word) that a run of size words covers which some earlier place begins, too."""
    seen, gone = set(), set()
    for k, text in docs:
        words = lower(text).encode().split()
        for i in range(len(words) - size + 1):
            run = tuple(words[i : i + size])
            if run in seen:
                gone |= {(k, j) for j in range(i, i + size)}
            seen.add(run)
    return gone


def test_op4_passages_leave_no_repeated_run(spark, small, texts):
    rows = {r["doc_id"]: r for r in queries.op4_passage_spans(spark, small).collect()}
    gone = brute_passages(sorted(texts.items()))
    whole = dict(zip(sorted(texts), brute_spans(sorted(texts.items()))))
    assert len(rows) == len(texts) and any(rows[k]["n_removed"] > len(texts[k]) - len(whole[k]) for k in texts)
    for k, r in rows.items():
        spans = [tuple(map(int, s.split(":"))) for s in r["removed"].split(",") if s]
        begins = [len(texts[k].encode()[: m.start()].decode()) for m in re.finditer(rb"\S+", texts[k].encode())]
        removed = {i for i, at in enumerate(begins) if any(a <= at < b for a, b in spans)}
        assert {j for d, j in gone if d == k} <= removed
        assert r["n_removed"] == len(texts[k]) - len(r["text"]) == sum(b - a for a, b in spans)


def test_passages_cut_inside_sentences(spark):
    some = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    passage = f"{some('p', 25)}. {some('q', 20)}. {some('r', 25)}"
    one = some("long", 60)
    rows = [(1, f"Begin {some('a', 9)} {passage} {some('b', 9)}. End"), (2, f"Other {some('c', 9)} {passage} é {some('d', 9)}. End"),
            (3, f"{one}"), (4, f"x y {one} z"), (5, some("short", 50)), (6, some("short", 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in sentence_spans.dedup_spans(docs, passages=True).collect()}
    assert {k: got[k] for k in (1, 3, 5, 6)} == {k: dict(rows)[k] for k in (1, 3, 5, 6)}
    assert got[2] == f"Other {some('c', 9)} é {some('d', 9)}. End" and got[4] == "x y z"


def test_passages_of_odd_rows(odd, empty):
    rows = {r["doc_id"]: r for r in sentence_spans.dedup_spans(odd, passages=True).collect()}
    assert rows[7]["text"] is None and rows[3]["text"] == "" and rows[12]["text"] == ""
    assert rows[11]["text"] == "same text again. " and rows[9]["kept"] == "kept-by-user"
    assert sentence_spans.dedup_spans(empty, passages=True).count() == 0
