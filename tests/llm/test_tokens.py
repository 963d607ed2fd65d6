"""Token output, packing and SentencePiece against the libraries themselves."""

import hashlib
import os
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from tokenizers import Tokenizer

from palisade.llm import bitplane, packing, queries, sentencepieces
from palisade.llm.common import shared_folder
from palisade.llm.encode import UNIT_BYTES, UnitEncoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_are_encoded_as_the_library_encodes_texts(name, keeps_space):
    """Special strings, doubtful white space, accents, contractions and runs of spaces, in any order."""
    whole, encoder = library(name), UnitEncoder(Tokenizer.from_file(public_tokenizers.path(name)), keeps_space, kept=50)
    parts = ["a", "The", "é", "É", "e\u0301", "'s", "'LL", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\xa0", "\u2003", "\x1c", "\x1f", "1", "23", "¼", "ª"]
    parts += ["$$", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "中", "😀", "\u212a", "ß", "İ", "?!", "_", "'"]
    choose = np.random.default_rng(5)
    texts = ["hello <|endoftext|> there"] + ["".join(choose.choice(parts, choose.integers(0, 12))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert [*np.frombuffer(ids, "<u4").tolist(), 2] == whole(text), text


def test_a_full_cache_is_bounded():
    """Ever new units, each once: two generations and a run of texts stay, of UNIT_BYTES each at most."""
    import tracemalloc

    encoder = UnitEncoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), True, kept=20_000)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng, most, run = np.random.default_rng(1), 0, 2_000
    tracemalloc.start()
    for _ in range(60):
        encoder.encode([" ".join("".join(w) + "," for w in letters[rng.integers(0, 26, (run, 9))])])
        most = max(most, sum(len(m) + len(m.older) for m in (encoder.units, encoder.spaced)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Each word brings itself, its part before the comma, and the comma.
    assert 40_000 < most <= 2 * (20_000 + 2 * run + 1) and held < most * UNIT_BYTES


def test_words_and_marks_need_no_splitter(monkeypatch):
    """New words, with marks at their end or a line feed before them, are cut as the library cuts them, but without its splitter."""
    path, findall = public_tokenizers.path("byte_bpe_50k.json"), []
    encoder = UnitEncoder(Tokenizer.from_file(path), True)
    words = ["Zorblat", "ñezieó", "Éx", "don't", "it's", "'s", "x's,", "ÿ÷×", "ªº", "straße", "İx", "a1", "\u4e2d"]
    marks = ["", ",", ".", "$$$", ",!!", "'", "'.", "''", "_", "~`", "…"]
    texts = [f"{before}{word}{mark}{after}" for before in ("", "a ", "a\n", "\n", " ") for word in words for mark in marks for after in ("", " b", "\nb")]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    plain = [f"a {word}{mark}\n{word}{mark}" for word in ("qorblat", "qñezieó") for mark in ("", ",", "$$$")]
    monkeypatch.setattr("palisade.llm.encode._SPACED_PIECES", SimpleNamespace(findall=lambda unit: findall.append(unit) or [unit]))
    encoder.encode(plain)
    assert not [unit for unit in findall if unit not in ("a", "\n", ",", "$$$", "qñezieó")]


@pytest.mark.parametrize("kind", [bitplane.BYTES, bitplane.BITS])
@pytest.mark.parametrize("n", [0, 1, 999, 1000, 3501])
def test_shard_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    shard = bitplane.pack(ids, kind, 1000)
    assert np.array_equal(bitplane.unpack(shard), ids)
    assert np.array_equal(bitplane.unpack(shard, 900, 2100), ids[900:2100])


def test_op1_reads_back_what_the_library_encodes(spark, small, texts):
    encode, start = library("byte_bpe_50k.json"), 0
    want = {}
    for i in sorted(texts):
        ids = encode(texts[i])
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_bitplane_ids(spark, small).collect()}
    assert got == want


def test_ids_of_odd_rows(spark, odd, empty):
    encode = library("byte_bpe_50k.json")
    folder = shared_folder(spark)
    bitplane.write_ids(odd, folder, public_tokenizers.path("byte_bpe_50k.json"), 2, shard_ids=50)
    rows = sorted(bitplane.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    texts = sorted(((i is not None, i or 0, t or "") for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [encode(t) for _, _, t in texts]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    folder = shared_folder(spark)
    bitplane.write_ids(empty, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert bitplane.read_ids(spark, folder).count() == 0


def check_packed(rows, ids_of):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        ids, at = ids_of[i], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        total += at
    assert set(by_doc) == set(ids_of)
    return 1 - total / (packing.WINDOW * len(by_sequence))


def test_op7_packs_every_id_once(spark, small, texts):
    encode = library("word_bpe_49k.json")
    slack = check_packed(queries.op7_bin_slack(spark, small).collect(), {i: encode(t) for i, t in texts.items()})
    assert slack < 0.03


def test_packing_odd_rows(spark, odd, empty):
    path, encode = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    rows = packing.pack(odd, path, 2).collect()
    assert sum(r["length"] for r in rows) == sum(len(encode(r["text"])) for r in odd.collect())
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
    assert packing.pack(empty, path, 2).count() == 0
    pieces = packing.cut_pieces(odd, path, 2).drop("ids")
    for name in ("__bucket", "__n", "bucket_", "n_", "before_", "rank_", "offset"):
        pieces = pieces.withColumn(name, F.lit("own"))
    placed = packing.assign_sequences(pieces)
    assert sorted(placed.columns) == sorted({*pieces.columns, "sequence_id"}) and {r["rank_"] for r in placed.collect()} == {"own"}


def test_fill_is_the_closest():
    counts = {700: 3, 333: 2, 50: 4, 7: 1}
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    for capacity in range(0, 2600, 37):
        taken = packing.best_fill(counts, capacity)
        assert sum(a * b for a, b in taken.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[x] for x, n in taken.items())


def test_patterns_use_up_the_histogram():
    histogram = {4096: 3, 4000: 5, 96: 7, 1: 2, 1000: 10}
    used = {}
    for times, taken in packing.patterns(histogram):
        assert sum(a * b for a, b in taken.items()) <= packing.WINDOW
        for length, n in taken.items():
            used[length] = used.get(length, 0) + n * times
    assert used == histogram


def test_op10_matches_the_library(spark, small, texts):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.op10_offset_pieces(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def check_offsets(model, text, ids, begins, ends):
    """Every piece's span, given the library's own normaliser for what the span became."""
    assert ids == model.encode(text, add_bos=True, add_eos=True)
    assert len(ids) == len(begins) == len(ends)
    raw, at = text.encode(), 0
    for k, b, e in list(zip(ids, begins, ends))[1:-1]:
        piece = model.id_to_piece(k)
        if not piece.startswith("<0x"):
            assert model.normalize(raw[b:e].decode()).strip("▁") == piece.strip("▁")
        assert b <= at <= e or b == at
        at = max(at, e)
    assert at == len(raw)


def test_offsets_of_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    by_key = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    encoded = sentencepieces.decode(sentencepieces.encode(odd, path), path).collect()
    want = by_key([(r["doc_id"], model.decode(model.encode(r["text"] or ""))) for r in odd.collect()])
    assert by_key([(r["doc_id"], r["decoded"]) for r in encoded]) == want
    texts = {(r["doc_id"], model.decode(model.encode(r["text"] or ""))): r["text"] or "" for r in odd.collect()}
    for r in encoded:
        check_offsets(model, texts[r["doc_id"], r["decoded"]], *(np.frombuffer(r[k], "<u4").tolist() for k in ("ids", "begins", "ends")))
    assert sentencepieces.encode(empty, path).count() == 0


#: Full-width, circled, ligated, combined, half-width, invisible and unmapped characters, and spaces.
MAPPED = ["a", "Ｂ", "①", " ", "  ", "\u3000", "ﬁ", "é", "e\u0301", "中", "😀", "\n", "\t", "▁", "½", "㌀", "\x01", "ｶﾞ", "\u200b", "가", "\ufeff", "\ufffd", "ß", "xxxxx"]


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The public model with the library's own compiled character map, that of its NFKC rule."""
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    rule = SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        path.write_bytes(file.read() + rule)
    return str(path)


def mapped_texts():
    choose = np.random.default_rng(8)
    return ["", "ﬁ", " ①", *("".join(choose.choice(MAPPED, choose.integers(0, 10))) for _ in range(1500))]


def test_normalisation_through_the_character_map(mapped):
    model = sentencepieces.Model(mapped)
    assert model.map.units and not model.by_unit
    for text in mapped_texts():
        normal, begins, ends = model.normalise(text)
        assert normal == model.library.normalize(text).encode() and len(normal) == len(begins) == len(ends)
        data = text.encode()
        # A span is one longest mapped prefix, or one character that the map leaves alone.
        for b, e in {*zip(begins, ends)}:
            assert b == e or (found := model.map.longest(data, b)) is None and len(data[b:e].decode()) == 1 or found[1] == e - b


def test_encoding_with_a_character_map(spark, mapped):
    model = SentencePieceProcessor(model_file=mapped)
    texts = [None, "Ｂ①", "Ｂ①", "ﬁnd ｶﾞ " * 3000, *mapped_texts()[:300]]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in sentencepieces.decode(sentencepieces.encode(docs, mapped), mapped).collect():
        text = texts[r["doc_id"] or 0] or ""
        ids, begins, ends = (np.frombuffer(r[k], "<u4").tolist() for k in ("ids", "begins", "ends"))
        assert ids == model.encode(text, add_bos=True, add_eos=True) and r["decoded"] == model.decode(ids)
        assert len(ids) == len(begins) == len(ends)
        raw = text.encode()
        for k, b, e in list(zip(ids, begins, ends))[1:-1]:
            piece = model.id_to_piece(k)
            if not piece.startswith("<0x"):
                assert piece.strip("▁") in model.normalize(raw[b:e].decode()), (text, piece)


def test_character_map_longest_prefix():
    """A double array built by hand: a -> "x", ab -> "yz"."""
    units = np.zeros(1024, "<u4")
    set_unit = lambda at, label, offset, leaf: units.__setitem__(at, label | (offset << 10) | (leaf << 8))
    root = 256
    set_unit(0, 0, root, 0)
    node_a = root ^ ord("a")
    base_a = node_a ^ 512
    set_unit(node_a, ord("a"), 512, 1)
    units[base_a] = 0x80000000 | 0
    node_ab = base_a ^ ord("b")
    set_unit(node_ab, ord("b"), 128, 1)
    units[node_ab ^ 128] = 0x80000000 | 2
    blob = np.array([units.nbytes], "<u4").tobytes() + units.tobytes() + b"x\0yz\0"
    found = sentencepieces.CharacterMap(blob)
    assert found.longest(b"abc", 0) == (b"yz", 2)
    assert found.longest(b"ac", 0) == (b"x", 1)
    assert found.longest(b"b", 0) is None


def test_no_bucket_outgrows_its_bound(spark, monkeypatch):
    """Pieces of one length, repeated rows among them: places stay gapless, no rank is counted over many more than BUCKET."""
    monkeypatch.setattr(packing, "BUCKET", 500)
    rows = [(None if i % 3 else i, 0, 4096 if i % 5 else 1000) for i in range(9_000)]
    placed = packing.assign_sequences(spark.createDataFrame(rows, "doc_id long, start long, length long")).toPandas()
    assert len(placed) == 9_000 and set(placed[placed.length == 4096].offset) == {0}
    assert placed[placed.length == 4096].sequence_id.nunique() == 7_200
    for _, one in placed.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]] and one.length.sum() <= 4096
    assert placed.sequence_id.nunique() == 7_200 + 450
