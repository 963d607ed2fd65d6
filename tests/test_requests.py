"""Bodies, schemas, learned detections, anomalies and feeds on small inputs."""

import base64
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.operators import anomaly, classifier, federated, graphql_schema, intel, schema, text_ml
from palisade.plans.queries import OPENAPI
from palisade.plans.requests import decide_requests
from palisade.plugins import Plugin, Registry
from palisade.rules import CATALOGUE
from palisade.rules.examples import example
from palisade.sources.feeds import Feed, schema_text
from palisade.streaming import bodies

ATTACK = b"1 UNION SELECT password FROM users--"


def chunks(spark, *rows):
    made = [(k, i, base64.b64encode(d).decode() if isinstance(d, bytes) else d, last) for k, i, d, last in rows]
    return spark.createDataFrame(made, "corr string, i int, data string, last boolean")


def test_bodies_from_base64_to_decisions(spark):
    config = Config(max_body=100, block_threshold=10)
    rows = chunks(
        spark,
        ("split", 1, ATTACK[12:], True), ("split", 0, ATTACK[:12], False),
        # The chunk after one that is too much begins a fresh body.
        ("fresh", 0, b"x" * 60, False), ("fresh", 1, b"y" * 60, False), ("fresh", 2, ATTACK, True),
        ("large", 0, b"x" * 90 + ATTACK, True), ("open", 0, ATTACK, False), ("bad", 0, "no base64!", True), ("again", 0, ATTACK, True), ("again", 1, b"fine", True),
    )
    found = {(r["corr"], r["last"]): r for r in bodies.decide_bodies(rows, "corr", "i", "data", "last", config).collect()}
    assert {k: bool(r["detections"]) for k, r in found.items()} == {("split", 1): True, ("fresh", 1): False, ("fresh", 2): True, ("large", 0): False, ("again", 0): True, ("again", 1): False}
    assert found["split", 1]["decision"] == "block" and found["split", 1]["response"]["status"] == 403
    assert bodies.decide_bodies(rows, "corr", "i", "data", "last", Config(body_inspection=False)).count() == 0
    streamed = {r["corr"]: r["decision"] for r in bodies.decide_bodies(rows, "corr", "i", "data", "last", Config(streaming=True, block_threshold=10)).collect()}
    assert streamed["split"] == "block" and "open" not in streamed


def test_responses_are_logged_only(spark):
    rows = chunks(spark, ("a", 0, ATTACK, True), ("b", 0, b"fine", True))
    assert bodies.log_responses(rows, "corr", "i", "data", "last").count() == 0
    found = {r["corr"]: r["header"] for r in bodies.log_responses(rows, "corr", "i", "data", "last", Config(response_inspection=True)).collect()}
    assert found["b"] is None and "942100" in found["a"].split(",")


def test_a_filter_on_the_header_matches_no_rule_twice(spark, capsys):
    rows = chunks(spark, ("a", 0, ATTACK, True), ("b", 0, b"fine", True))
    found = bodies.log_responses(rows, "corr", "i", "data", "last", Config(response_inspection=True)).where("header is not null").select("corr", F.size("detections").alias("n"))
    found.explain()
    # Every rule looks at the one text made of the body.
    assert capsys.readouterr().out.count("makeValid") == 1
    assert [(r["corr"], r["n"] > 0) for r in found.collect()] == [("a", True)]


def test_openapi_paths(spark):
    compiled = schema.compile_openapi(OPENAPI)
    assert [t["segments"] for t in compiled] == [["orders"], ["users", "me"], ["users", None]]
    rows = [
        ("/users/me", "GET", {}, {"x-token": ["t"]}, None, None, []),
        # The fixed segment has no DELETE, the parameter has: "me" is then no integer.
        ("/users/me/", "delete", {}, {}, None, None, [(98303, "path.id")]),
        ("/users/7", "GET", {"full": ["no"]}, {}, None, None, [(98303, "query.full")]),
        ("/users", "GET", {}, {}, None, None, [(98300, "path")]),
        ("/orders", "PUT", {}, {}, None, None, [(98301, "method")]),
        ("/orders", "POST", {"page": ["1"]}, {}, "text/plain", "{}", [(98306, "header.content-type")]),
        ("/orders", "POST", {"page": ["9223372036854775808"]}, {}, "application/json", '{"a": 1}}', [(98303, "query.page"), (98305, "body")]),
        ("/orders", "GET", {"page": ["+1"], "price": ["1e-3"]}, {}, None, None, []),
        ("/orders", "GET", {"price": ["1,5"]}, {}, None, None, [(98302, "query.page"), (98303, "query.price")]),
    ]
    docs = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "n int, path string, method string, query map<string,array<string>>, headers map<string,array<string>>, kind string, body string")
    found = schema.openapi_violations(compiled, *[F.col(c) for c in ("path", "method", "query", "headers", "kind", "body")])
    got = {r["n"]: [(d["rule_id"], d["location"]) for d in r["d"]] for r in docs.select("n", found.alias("d")).collect()}
    assert got == {i: r[6] for i, r in enumerate(rows)}
    with pytest.raises(ValueError):
        schema.compile_openapi({"paths": {"/a": {"$ref": "#/x"}}})


SDL = """
schema { query: Query mutation: Change }
"Roots" type Query { user(id: ID!, n: Int = 3): User @auth users(first: Int!): [User!]! }
type Change { add(input: New!): User }
type User implements Node & Other { id: ID! name: String old: String @deprecated(reason: "no") posts(first: Int): [Post] }
type Post { title: String }
enum Kind { A B @deprecated }
input New { name: String! = "x" tags: [String!] }
union Any = User | Post
directive @auth(a: Int) repeatable on FIELD | QUERY
"""


@pytest.mark.parametrize(
    "body, found",
    [
        ("{ user(id: 1) { id name __typename } }", []),
        ("{ user(id: 1) { nope } }", [("unknown-field", "query.user.nope")]),
        ("query Q($a: ID! = 1) { u: user(id: $a, x: [1, {a: \"}\"}]) { old } }", [("invalid-argument", "Q.user.x"), ("deprecated-field-usage", "Q.user.old")]),
        ("{ users { posts { ... on Nope { a } ... { title } ...F } } } fragment F on Zip { a }", [("missing-required-argument", "query.users.first"), ("unknown-type", "query.users.posts"), ("unknown-type", "fragment.F")]),
        ("subscription { a }", [("unknown-type", "operation")]),
        ("mutation { add { id } }", [("missing-required-argument", "mutation.add.input")]),
        ("{ user(", [("invalid-argument", "query")]),
        ("{" * 100_000, [("invalid-argument", "query")]),
        ('{"query": "{ nope }"}', [("unknown-field", "query.nope")]),
        ('{"other": 1}', []), ("", [("invalid-argument", "query")]), (None, []),
    ],
)
def test_graphql_queries(body, found):
    compiled = graphql_schema.compile_schema(SDL)
    assert [v[:2] for v in graphql_schema.violations(compiled, body)] == found


def test_violations_can_be_ignored(spark):
    made = schema.graphql_violations(SDL, F.col("body"))
    rows = spark.createDataFrame([("{ user(id: 1) { nope old } }",)], "body string")
    both, one = rows.select(made.alias("a"), schema.enforced(made, {"unknown-field": "ignore"}).alias("b")).first()
    assert [d["rule_id"] for d in both] == [98351, 98356] and [d["rule_id"] for d in one] == [98356]
    assert [d["rule_id"] for d in rows.select(schema.enforced(made, {}, "ignore")).first()[0]] == []


def test_learned_detections_join_decisions(spark):
    rows = spark.createDataFrame([(1, "/a?q=' OR '1'='2", {"X": ["<svg onload=alert('XSS')>"]}), (2, "/plain", {})], "id int, uri string, headers map<string,array<string>>")
    config = Config(ml_classifier=True, ml_similarity=True)
    found = {r["id"]: [(d["rule_id"], d["location"]) for d in r["detections"]] for r in decide_requests(rows, config, headers="headers", key="id").collect()}
    assert (99101, "query") in found[1] and (99102, "header:X") in found[1] and not [x for x in found[2] if x[0] >= 99000]
    with pytest.raises(ValueError):
        decide_requests(rows, config)


def test_fingerprints_join_decisions(spark):
    """By a baseline that was learned before, from the threshold that the configuration gives."""
    usual = {"Host": ["h"], "Accept": ["a"]}
    docs = spark.createDataFrame([(i, "/a", "GET", "x=1", usual) for i in range(12)], "o int, path string, method string, query string, headers map<string,array<string>>")
    baseline = anomaly.learned(anomaly.fingerprint(docs, "method", "query", "headers"), "path", "o")
    rows = [(1, "/a?x=2", "GET", usual), (2, "/a?" + "&".join(["v"] * 40), "TRACE", {"Host": ["h"]}), (3, "/skip", "TRACE", {"Host": ["h"]})]
    requests = spark.createDataFrame(rows, "samples int, uri string, m string, headers map<string,array<string>>")
    found = lambda config: {r["samples"]: [d["rule_id"] for d in r["detections"]] for r in decide_requests(requests, config, headers="headers", method="m", baseline=baseline).collect()}
    # An order of headers, a method and more parameters than ever: 0.45.
    assert found(Config(fingerprinting=True, anomaly_threshold=0.4, exclude_paths=("/skip",))) == {1: [], 2: [99200], 3: []}
    assert found(Config(fingerprinting=True)) == found(Config()) == {1: [], 2: [], 3: []}
    with pytest.raises(ValueError):
        decide_requests(requests, Config(fingerprinting=True))


def test_first_of_equally_close_payloads(spark):
    rows = spark.createDataFrame([(1, "; ID"), (2, "nothing of the kind"), (3, "")], "id int, text string")
    assert [(r["id"], r["kind"], r["similarity"]) for r in classifier.closest_payload(rows, "id", "text").collect()] == [(1, "CommandInjection", 1.0)]


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_similar_pairs_match_brute_force(spark, threshold):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc "), rng.integers(3, 40))) for _ in range(40)]
    counts = text_ml.ngram_counts(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text")

    def grams(t):
        out = {}
        for n in text_ml.SIZES:
            for i in range(len(t) - n + 1):
                out[t[i : i + n]] = out.get(t[i : i + n], 0) + 1
        return out

    known, want = [grams(t) for t in texts], {}
    for i, a in enumerate(known):
        for j, b in enumerate(known):
            both = sum(min(n, b.get(g, 0)) for g, n in a.items())
            if both and (share := both / (sum(a.values()) + sum(b.values()) - both)) >= threshold:
                want[i, j] = round(share, 9)
    got = text_ml.similarity(counts, counts.withColumnRenamed("k", "k2"), "k", "k2", threshold).collect()
    assert {(r["k"], r["k2"]): round(r["jaccard"], 9) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_similar_texts_are_compared_portion_by_portion(spark, monkeypatch, threshold):
    for name, n in (("LEFT_TEXTS", 9), ("RIGHT_TEXTS", 6), ("TOGETHER", 50)):
        monkeypatch.setattr(text_ml, name, n)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aBc \U0001F600é"), rng.integers(0, 30))) for _ in range(40)] + [None, "", "a"]
    # Rows of one key are one text's n-grams together; a null key is none.
    rows = [(k % 35, t) for k, t in enumerate(texts)] + [(None, "abc abc")]
    left = spark.createDataFrame(rows, "k int, text string")
    right = left.withColumnRenamed("k", "k2")
    of = lambda df, key: text_ml.ngram_counts(df.where(f"{key} is not null"), key, "text")
    shown = lambda found: sorted((r["k"], r["k2"], round(r["jaccard"], 12), round(r["cosine"], 12)) for r in found.collect())
    want = shown(text_ml.similarity(of(left, "k"), of(right, "k2"), "k", "k2", threshold))
    assert shown(text_ml.similar_texts(left, right, "k", "k2", "text", threshold)) == want and len(want) > 30


def test_anomalies_of_a_new_endpoint_and_a_known_one(spark):
    usual = {"Host": ["h"], "Accept": ["a"]}
    rows = [(i, "/a", "GET", "x=1", usual) for i in range(12)] + [(12, "/a", "TRACE", "&".join("abcdefghij" * 3), {"Host": ["h"], "Content-Type": ["image/png"]}), (13, "/b", "TRACE", "", usual), (14, "/c", "put", None, None)]
    docs = spark.createDataFrame(rows, "o int, path string, method string, query string, headers map<string,array<string>>")
    found = anomaly.scores(anomaly.fingerprint(docs, "method", "query", "headers"), "path", "o").orderBy("o").collect()
    assert [r["factors"] for r in found[:12]] == [[]] * 12 and found[11]["samples"] == 11
    assert found[12]["factors"] == ["header_order", "method", "content_type", "parameters"] and abs(found[12]["anomaly"] - 0.6) < 1e-9
    # All requests have been learned from for a new endpoint; an unknown method is one class.
    assert found[13]["factors"] == [] and found[14]["factors"] == ["header_order", "method"]
    hit = docs.where("o = 0").select(anomaly.detections(F.lit(0.6)).alias("d")).first()["d"]
    assert (hit["rule_id"], hit["base_score"], hit["matched_value"]) == (99200, 3, "anomaly_score=0.60")


@pytest.mark.parametrize("ranked", [0, 100_000])
def test_ranks_without_sorting_an_index(spark, monkeypatch, ranked):
    monkeypatch.setattr(federated, "RANKED", ranked)
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=(301, 3)), 1)
    values[:120, 1] = 0.5
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "node int, g array<double>")
    middle = {r["i"]: r["value"] for r in federated.median(docs, "g").collect()}
    cut = {r["i"]: r["value"] for r in federated.trimmed_mean(docs, "g").collect()}
    for i in range(3):
        assert abs(middle[i] - np.median(values[:, i])) < 1e-9
        assert abs(cut[i] - np.sort(values[:, i])[30:-30].mean()) < 1e-9


def test_accountant_and_gates(spark):
    rounds = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 1.0)], "n string, sigma double, s double")
    moment = 1 / 4 + 1 / 16
    want = min(a * moment / 2 + np.log(a - 1) / a - np.log(a * 1e-5) / a for a in federated.ORDERS)
    assert abs(federated.renyi_epsilon(rounds, "sigma", "s", 1e-5, "n").first()["epsilon"] - want) < 1e-9
    nodes = spark.createDataFrame([(1, 999, None), (2, 1000, 10), (3, 40, 3600)], "node int, samples int, since int")
    assert [(r["batches"], r["contributes"], r["syncs"]) for r in federated.gates(nodes, "samples", "since").orderBy("node").collect()] == [(31, False, True), (31, True, False), (1, False, True)]


def test_tables_of_intelligence_grow(spark):
    table = lambda *rows: spark.createDataFrame(rows, "key string, score int, category string")
    grown = intel.added(table(("a", 10, "x"), ("b", 20, "y")), table(("a", 90, "z")))
    assert sorted(map(tuple, grown.collect())) == [("a", 90, "z"), ("b", 20, "y")]
    lists = spark.createDataFrame([("a", "tor"), ("a", "tor")], "key string, list string")
    assert sorted(map(tuple, intel.entry_counts(ip=grown, lists=intel.added(lists)).collect())) == [("ip", 2), ("lists:tor", 1)]


def test_feeds_and_schema_sources(spark, tmp_path):
    path = tmp_path / "feed.txt"
    path.write_text("# list\n10.0.0.1\n\n10.0.0.2\n")
    feed = Feed("mine", str(path), "ip", timedelta(minutes=5))
    assert sorted(r["key"] for r in feed.read(spark).collect()) == ["10.0.0.1", "10.0.0.2"]
    now = datetime(2024, 1, 1)
    assert feed.due(None, now) and feed.due(now - timedelta(minutes=5), now) and not feed.due(now, now)
    assert schema_text(spark, path=str(path)).startswith("# list") and schema_text(spark, inline="x") == "x"
    with pytest.raises(ValueError):
        schema_text(spark)


def test_plugins_take_part_in_their_phases(spark):
    found = lambda value, location: F.array(F.lit(1))
    registry = Registry()
    registry.register(Plugin("a", detect=found, phases=("scoring",)))
    registry.register(Plugin("b", adjust=lambda detections, score: F.lit(5), phases=("detection",)))
    assert [p.name for p in registry.in_phase("scoring")] == ["a"]
    assert spark.range(1).select(F.size(registry.detections(F.lit("x"), F.lit("body")))).first()[0] == 0
    assert spark.range(1).select(registry.adjustment(F.array(), F.lit(1)) + F.lit(0)).first()[0] == 0
    with pytest.raises(ValueError):
        Plugin("c", phases=("later",))


def test_examples_hold_what_rules_need():
    assert len({example(r.pattern) for r in CATALOGUE}) > 250


def test_a_refused_request_spends_nothing(spark):
    """One large refusal leaves room for the small ones after it; nulls, ties, odd names, empty tables."""
    rows = [("a", 1, 4.0, 0.1), ("a", 2, 9.0, 0.1), ("a", 3, 5.0, 0.1), ("a", 4, None, 0.9), ("a", 5, 1.0, None), ("a", 5, 1.0, None), (None, 1, 10.0, 0.0), (None, 2, 1.0, 0.0), ("b", None, 10.0, 0.4)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "k string, n int, epsilon double, delta double, `within` string")
    got = federated.within_budget(df, "n", 10.0, 0.5, "k")
    assert [(r["k"], r["n"], r["within"], r["epsilon_spent"], round(r["delta_spent"], 9)) for r in got.orderBy("k", "n", "epsilon_spent").collect()] == [
        (None, 1, True, 10.0, 0.0), (None, 2, False, 10.0, 0.0), ("a", 1, True, 4.0, 0.1), ("a", 2, False, 4.0, 0.1), ("a", 3, True, 9.0, 0.2),
        ("a", 4, False, 9.0, 0.2), ("a", 5, True, 10.0, 0.2), ("a", 5, False, 10.0, 0.2), ("b", None, True, 10.0, 0.4)]
    assert federated.within_budget(df.where("false"), "n", 1.0, 1.0, "k").count() == 0


def brute_fitting(compiled, path):
    parts = [x for x in path.split("/") if x]
    alike = lambda t: len(t["segments"]) == len(parts) and all(a is None or a == b for a, b in zip(t["segments"], parts))
    return [[o["method"] for o in t["operations"]] for t in compiled if alike(t)]


def test_a_trie_of_ten_thousand_templates(spark):
    """The same templates in the same order as when each is tried, in about the time that a few take."""
    import time

    def document(n):
        paths = {f"/v{i % 5}/s{i}/{{id}}/x{i % 7}": {"get": {}} for i in range(n)}
        paths |= {"/": {"head": {}}, "/v1/{any}/7/x1": {"put": {}}, "/v1/s1/7/{last}": {"post": {}}, "/{a}/{b}/{c}/{d}": {"delete": {}}, "/v1/s1/{id}": {"patch": {}}}
        return schema.compile_openapi({"paths": paths})

    small, large = document(10), document(10_000)
    paths = ["/", "", "/v1/s1/7/x1", "/v1/s1/8/x1", "/v1/s1/7/zz", "v1//s1/7/", "/a/b/c/d", "/a/b", "/v3/s9998/q/x2", "/v3/s9998/q/x3", "/v1/s1/7/x1/more"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    for compiled in (small, large):
        found = rows.select("path", F.transform(schema.fitting(compiled, segments), lambda t: t["operations"]["method"]).alias("m")).collect()
        assert {r["path"]: r["m"] for r in found} == {p: brute_fitting(compiled, p) for p in paths}
    assert spark.range(1).select(F.size(schema.fitting(small, F.lit(None).cast("array<string>")))).first()[0] == 0
    many = spark.range(200_000).select(F.concat(F.lit("/v"), F.col("id") % 5, F.lit("/s"), F.col("id") % 10_000, F.lit("/7/x"), F.col("id") % 7).alias("path")).coalesce(1)
    took = []
    for compiled in (small, large):
        made = many.select(F.size(schema.fitting(compiled, segments)).alias("n"))
        made.agg(F.sum("n")).collect()
        began = time.time()
        made.agg(F.sum("n")).collect()
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 2


def test_baselines_merge_and_persist(spark, tmp_path):
    """Day by day as all at once; judging by what came before as scores() does; more orders than are kept."""
    rng = np.random.default_rng(8)
    names = [f"H{i}" for i in range(9)]
    rows = []
    for i in range(240):
        some = {n: ["v"] for n in rng.permutation(names)[: rng.integers(1, 9)]} | ({"Content-Type": [["text/html", "image/png", "application/json"][i % 3]]} if i % 4 == 0 else {})
        rows.append((i, ["/a", "/b", f"/c{i}", None][rng.choice(4, p=[0.5, 0.3, 0.15, 0.05])], ["GET", "put", "TRACE"][i % 17 % 3], "&".join("ab" * int(rng.integers(0, 40))), some))
    docs = spark.createDataFrame(rows, "o int, path string, method string, query string, headers map<string,array<string>>")
    marked = anomaly.fingerprint(docs, "method", "query", "headers").withColumn("samples", F.lit("own"))
    folder = str(tmp_path / "day1")
    anomaly.learned(marked.where("o < 150"), "path", "o").write.parquet(folder)
    both = anomaly.merged(spark.read.parquet(folder), anomaly.learned(marked.where("o >= 150"), "path", "o"))
    once = anomaly.learned(marked, "path", "o")
    assert sorted(map(repr, both.collect())) == sorted(map(repr, once.collect()))
    assert once.where("common and kind = 'order'").count() == anomaly.KEPT_ORDERS
    learning = {r["o"]: (r["factors"], round(r["anomaly"], 9)) for r in anomaly.scores(marked.drop("samples"), "path", "o").collect()}
    for last in (0, 5, 60, 150, 239):
        one, model = marked.where(F.col("o") == last), anomaly.learned(marked.where(F.col("o") < last), "path", "o")
        got = anomaly.judged(one, "path", model).first()
        if rows[last][1] is not None:  # requests without a path have no baseline of their own here
            assert (got["factors"], round(got["anomaly"], 9)) == learning[last]
    assert anomaly.judged(marked.where("false"), "path", once).count() == 0


def test_what_an_endpoint_learns_is_summed_within_ranges(spark):
    """No window runs over all requests of an endpoint in their order; an endpoint without a name is one like any other."""
    import re

    from palisade.operators import anomaly

    rows = spark.range(400).select(
        F.col("id").alias("o"), F.lit("/busy").alias("path"), F.when(F.col("id") % 97 == 96, "PUT").otherwise("GET").alias("method"), F.repeat(F.lit("a=1&"), (F.col("id") % 50).cast("int")).alias("query"),
        F.map_filter(F.create_map(*[x for n in "abcd" for x in (F.lit(n), F.array(F.lit("1")))]), lambda n, _: (n == "a") | (F.col("id") % 40 != 39)).alias("headers"),
    )
    found = anomaly.scores(anomaly.fingerprint(rows, "method", "query", "headers"), "path", "o")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(" in plan and not re.search(r"windowspecdefinition\(e#\d+, o#\d+L? ASC", plan)
    named = {r["o"]: (r["samples"], r["factors"]) for r in found.collect()}
    assert [named[i][0] for i in (0, 9, 399)] == [0, 9, 399] and named[96][1] == ["method"] and named[193][1] == []
    assert named[39] == (39, ["header_order", "missing_headers"]) and named[79] == (79, ["missing_headers"])
    nameless = anomaly.scores(anomaly.fingerprint(rows.withColumn("path", F.lit(None).cast("string")), "method", "query", "headers"), "path", "o")
    assert {r["o"]: (r["samples"], r["factors"]) for r in nameless.collect()} == named
