"""Personal data against Python's regular expressions, and the corpus statistics against counting."""

import hashlib
import math
import re
import time

import pytest
import regex

from palisade.llm import personal_data, queries

# The contract's patterns, as they are written there.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if valid:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_op8_base_matches_python(spark, small, texts):
    rows = queries.op8_disclosure(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r["doc_id"]])
        joined = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def brute_added(texts):
    """The spans of revealing terms of each text, by counting over all of them one by one: terms count
    wherever they stand in a text, and go wherever they stand in any."""
    n_pair, n_entity, n_term, contexts = {}, {}, {}, {}
    standing, holding = [], []
    for text in texts:
        spans, terms = base(text), {t.lower() for t in regex.findall(r"\p{L}{4,}", text.lower())}
        for term in terms:
            n_term[term] = n_term.get(term, 0) + 1
        entities = {(rank, text[a:b].lower()) for a, rank, b in spans}
        for entity in entities:
            n_entity[entity] = n_entity.get(entity, 0) + 1
        standing.append(terms), holding.append(entities)
        for i, (start, rank, end) in enumerate(spans):
            before = spans[i - 1][2] if i else 0
            after = spans[i + 1][0] if i + 1 < len(spans) else len(text)
            sides = (max(min(before, start), start - 80), start), (end, min(max(after, end), end + 80))
            for a, b in sides:
                for m in regex.finditer(r"\p{L}{4,}", text[a:b]):
                    contexts.setdefault(((rank, text[start:end].lower()), m[0].lower()), set()).add(tuple(text[x:y] for x, y in sides))
    wanted = {pair for pair, found in contexts.items() if len(found) >= personal_data.MIN_CONTEXTS}
    for terms, entities in zip(standing, holding):
        for entity, term in wanted:
            if entity in entities and term in terms:
                n_pair[entity, term] = n_pair.get((entity, term), 0) + 1
    flagged, n = {}, len(texts)
    for (entity, term), both in n_pair.items():
        if n_entity[entity] < n:
            share = math.log(both * n / (n_term[term] * n_entity[entity])) / math.log(n / n_entity[entity])
            if share >= personal_data.GENERALISE:
                flagged[term] = max(flagged.get(term, 0), personal_data.KINDS.index("removed" if share >= personal_data.REMOVE else "generalised"))
    return flagged, [[(m.start(), flagged[m[0].lower()], m.end()) for m in regex.finditer(r"\p{L}{4,}", t) if m[0].lower() in flagged] for t in texts]


def test_op8_spans_match_counting(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    flagged, added = brute_added([r["text"] or "" for r in rows])
    assert any(added)
    got = {r["doc_id"]: r["spans"] for r in queries.op8_disclosure(spark, folder).collect()}
    for r, more in zip(rows, added):
        spans = sorted([*base(r["text"]), *more])
        assert got[r["doc_id"]] == ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)


    clean = personal_data.sanitise(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    left = {w.lower() for r in clean for w in regex.findall(r"\p{L}{4,}", r["text"] or "")} & set(flagged)
    assert len(flagged) >= 3 and not left


@pytest.mark.parametrize("word", [(), ("Zanzibar",)])
def test_long_texts_are_cut_in_linear_time(spark, word):
    """Sixteen thousand spans in one text, with and without terms to generalise."""
    told = [f"{w} from Zanzibar as ann@x.org today" for w in ("Maria", "Peter", "Laura")] * bool(word)
    took = []
    for n in (4_000, 16_000):
        text = "".join(f"{' '.join(word)} a{k % 7}@b.co, " for k in range(n)) + "end"
        docs = spark.createDataFrame([(t,) for t in [*told, *[f"report {k}" for k in range(60)], text]], "text string").coalesce(2)
        began = time.time()
        clean = max((r["text"] for r in personal_data.sanitise(docs).collect()), key=len)
        took.append(time.time() - began)
        assert clean.count("[EMAIL]") == n and "@" not in clean and clean.endswith(", end")
    assert took[1] < 4 * took[0] + 10


def test_repeated_rows_disclose_alike(spark, corpus):
    """Copies of every row change nothing but the counts, which all double."""
    once = {r["text"]: r["spans"] for r in personal_data.find_personal_data(spark.createDataFrame([(t,) for t in corpus], "text string")).collect()}
    twice = personal_data.find_personal_data(spark.createDataFrame([(t,) for t in corpus * 2], "text string")).collect()
    assert len(twice) == 2 * len(corpus) and all(r["spans"] == once[r["text"]] for r in twice)


def test_many_addresses_in_one_text(spark):
    """A million characters, an address every eight: no quadratic time."""
    text, begun = "a1@b.co " * 125_000, time.time()
    row = personal_data.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_email", "base_spans").first()
    assert row["n_email"] == 125_000 and [(s["start"], s["end"]) for s in row["base_spans"]] == [(8 * k, 8 * k + 7) for k in range(125_000)]
    assert time.time() - begun < 120


ODD = [
    "a@b.c_d@e.f x@y@z.com a@b..c", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1111-1 9" + "9" * 30,
    "+1 (017) 555-7713) +12 +1234567890123456", "x" * 30000 + "@", "1" * 50000, "1 " * 30000, "+1" * 20000, None, "",
    "é 4111111111111111😀 a@b.co", " 1-1-1-1" * 3 + " 4111111111111111 5", "12345678901237 2",
]


def test_odd_texts(spark, odd, empty):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in r["base_spans"]] for r in personal_data.find_personal_data(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(ODD)}
    clean = {r["doc_id"]: r for r in personal_data.sanitise(docs).collect()}
    assert clean[10]["text"] == "é [CARD]😀 [EMAIL]" and clean[8]["text"] is None and clean[10]["spans"] == "x"
    assert personal_data.find_personal_data(odd).count() == odd.count()
    assert personal_data.sanitise(empty).count() == 0


@pytest.fixture(scope="module")
def corpus():
    told = [f"{w} writes from Zanzibar as ann@x.org today about matter {w}" for w in ("Maria", "Peter", "Laura")]
    others = [f"report {k} today about matters writes nothing from anyone" for k in range(40)]
    return [*told, *others, "Zanzibar is far"]


def test_disclosing_terms_by_counting(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    n = len(corpus)
    near = {"maria": 1, "peter": 1, "laura": 1, "writes": 3, "from": 3, "zanzibar": 3, "today": 3, "about": 3, "matter": 3}
    expected = set()
    for term, pair in near.items():
        if pair < personal_data.MIN_CONTEXTS:
            continue
        n_term = sum(term in re.findall(r"\w{4,}", t.lower()) for t in corpus)
        share = math.log(pair * n / (n_term * 3)) / math.log(n / 3)
        if share >= personal_data.GENERALISE:
            expected.add((term, "removed" if share >= personal_data.REMOVE else "generalised"))
    got = set()
    for r in personal_data.find_personal_data(docs).collect():
        for s in r["spans"]:
            if s["rank"] >= len(personal_data.BASE):
                got.add((corpus[r["doc_id"]][s["start"] : s["end"]].lower(), personal_data.KINDS[s["rank"]]))
    assert got == expected and ("zanzibar", "generalised") in got
