"""The pipeline, stage by stage, against plain Python over the same documents."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from palisade.llm import personal_data
from tests.llm.test_dedup import brute_components, brute_fingerprint, lower


def test_stages_work_on_all_that_their_predecessors_keep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, tables = [n for n, _ in corpus_pipeline.STAGES], []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        tables.append(spark.createDataFrame(out.collect(), out.schema))
        docs = tables[-1]
    assert names == ["quality rules", "exact dedup", "simhash near-dedup", "personal data", "packing"]
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    assert all(t.columns == columns for t in tables[:-1])
    kept, unique, apart, clean = ({r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:4])

    best = {}
    for i, text in kept.items():
        best[lower(text)] = max(i, best.get(lower(text), -1))
    assert set(unique) == set(best.values())

    ids = sorted(unique)
    roots = brute_components([brute_fingerprint(unique[i]) for i in ids])
    assert set(apart) == {ids[r] for r in roots}

    assert set(clean) == set(apart)
    again = personal_data.find_personal_data(tables[3].select("doc_id", "text")).collect()
    assert not any(r["base_spans"] for r in again)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in clean.values())
    pieces = tables[4].collect()
    assert sum(r["length"] for r in pieces) == total
    filled = {}
    for r in pieces:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert np.max(list(filled.values())) <= 4096
    final = corpus_pipeline.run(spark, small)
    assert final.columns == tables[4].columns and final.count() == len(pieces)


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, ties, repeated rows, empty and very long texts and extra columns go through every stage."""
    good = "\n".join(f"Line{k} has{k} several{k} plain{k} words in it, number {k * 7}." for k in range(60))
    # Near copies, with another number somewhere: one within two bits of the fingerprint, and one that is further away.
    changed = [good.replace(f"number {k * 7}.", f"number {k * 7 + 1}.") for k in range(60)] + [good.replace("plain", "dear")]
    apart = [(int(brute_fingerprint(good)) ^ int(brute_fingerprint(t))).bit_count() for t in changed]
    near, far = changed[next(k for k, n in enumerate(apart) if 0 < n <= 2)], changed[max(range(len(apart)), key=apart.__getitem__)]
    assert max(apart) > 4
    more = [(None, good, "en", "x"), (None, good, "en", "x"), (50, good, "en", "x"), (51, near, "en", "x"), (52, far, "en", "x")]
    for name, rows in (("odd", odd.unionByName(spark.createDataFrame(more, odd.schema))), ("empty", empty)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # Equal texts leave one, the one with a doc_id; its near copy goes, the other one stays.
        assert {r["doc_id"] for r in pieces} == ({50, 52} if name == "odd" else set())
        assert sum(r["length"] for r in pieces if r["start"] == 0) >= (100 if name == "odd" else 0)
