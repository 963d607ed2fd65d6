"""Rule selection, matching and scoring: exact rule ids and totals."""

import pytest
from pyspark.sql import functions as F

from palisade import rules as R
from palisade.config import Config, Exclusion
from palisade.functions.detect import detect
from palisade.operators import scoring
from palisade.plans.requests import decide_requests

NUL = "\0"
GOLDEN = [
    ("id=' OR '1'='1", "query", 1, [942150, 934100], 38, "block"),
    ("q=1 UNION SELECT * FROM users", "query", 1, [942100, 933100], 45, "block"),
    ("<script>alert('xss')</script>", "body", 1, [941100, 941101, 933100], 50, "block"),
    ("q=SELECT", "query", 1, [], 0, "allow"),
    ("sqlmap/1.0", "header:User-Agent", 1, [913100], 12, "warn"),
    ("q='; WAITFOR DELAY '0:0:5'--", "query", 2, [942162, 942180], 36, "block"),
    ("search=laptop computer", "query", 1, [], 0, "allow"),
    ("/api/v1/users/123", "path", 1, [], 0, "allow"),
    ('{"items": [1, 2, 3], "total": 99.99}', "body", 1, [], 0, "allow"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36", "header:User-Agent", 1, [933100], 12, "warn"),
    ("file..txt", "query", 4, [930170, 934104], 20, "warn"),
    ("hello|world", "query", 4, [932170], 2, "allow"),
    ("<a", "query", 4, [941190, 932175], 4, "allow"),
    ("Hello {{ name }}", "query", 4, [935100, 935180, 935190], 26, "block"),
    ("${PATH}", "query", 2, [932130, 935101], 24, "warn"),
    ("cat$IFS/etc/passwd", "query", 3, [930110, 932152, 932155], 44, "block"),
    (f"scr{NUL}ipt", "query", 3, [941180, 930123, 920100, 920101, 933100, 933104], 100, "block"),
    ("UN/**/ION/**/SEL/**/ECT", "query", 1, [933100, 934104], 36, "block"),
    ("UNION/*comment*/SELECT", "query", 1, [942100, 933100, 934104], 63, "block"),
    ("UNION ALL SELECT", "query", 1, [942100, 942101], 54, "block"),
    ("1' OR '1'='1", "websocket:c2s:text", 1, [942150, 934100], 36, "block"),
    ("../../../etc/passwd", "path", 1, [930100, 930110, 934104], 52, "block"),
    ("; cat /etc/passwd", "query", 1, [930110, 932101], 60, "block"),
    ("abc'; DROP TABLE users;--", "cookie:n", 1, [942120, 942185], 42, "block"),
    ("", "query", 1, [], 0, "allow"),
    (f"secret.txt{NUL}.jpg", "query", 1, [930123, 920100, 920101, 933100, 933104], 92, "block"),
    ("nmap", "header:User-Agent", 1, [913110], 6, "allow"),
]


def test_catalogue_counts():
    assert len({r.id for r in R.CATALOGUE}) == len(R.CATALOGUE) == 284
    assert [sum(r.paranoia == p for r in R.CATALOGUE) for p in (1, 2, 3, 4)] == [146, 50, 48, 40]
    assert len(R.load(Config(paranoia=4))) == 284
    assert not R.by_attack(R.load(Config(sqli=False)), "SqlInjection")
    assert not any(r.attack == "ScannerDetection" for r in R.load(Config(protocol=False)))


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_golden_payloads(spark, level):
    cases = [g for g in GOLDEN if g[2] == level]
    config = Config(paranoia=level)
    rules = R.load(config)
    rows = (
        spark.createDataFrame([(i, v, w) for i, (v, w, *_) in enumerate(cases)], "i int, value string, location string")
        .withColumn("d", detect(F.col("value"), F.col("location"), rules))
        .withColumn("total", scoring.total(F.col("d"), rules, config))
        .withColumn("decision", scoring.decide(F.col("d"), F.col("total"), config))
        .orderBy("i")
        .collect()
    )
    got = [([d["rule_id"] for d in r["d"]], r["total"], r["decision"]) for r in rows]
    assert got == [tuple(g[3:]) for g in cases]


def test_guards_never_hide_a_match(spark):
    """Each rule with and without its needed texts, on every golden value and its variants."""
    values = [v for g in GOLDEN for v in (g[0], g[0].upper(), g[0].swapcase())] + ["eval(base64_decode($x))", "http://169.254.169.254/", "rO0ABXNy"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    guarded = df.select("value", F.transform(detect(F.col("value"), "query", R.CATALOGUE), lambda d: d["rule_id"]).alias("ids")).collect()
    plain = F.array_compact(F.array(*[F.when(F.col("value").rlike(R.java_pattern(r.pattern)), r.id) for r in R.CATALOGUE]))
    want = {r["value"]: r["ids"] for r in df.select("value", plain.alias("ids")).collect()}
    assert {r["value"]: r["ids"] for r in guarded} == want


def test_guards_on_examples_of_every_rule(spark):
    """As above, on a text from each pattern, within words, among others and in upper case, and on odd neighbours of whole words."""
    from palisade.rules.examples import example

    found = [example(r.pattern) for r in R.CATALOGUE]
    values = sorted({v for x in found for v in (x, f"a {x} b", f"k{x}k", f"\u212a{x}\u0130", x.upper())} | {"\u212aid sh\u0130", "éCat\n", "since she is", "id\u0301", "uNiOn", "｛", "a..\\b"})
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(8)
    guarded = df.select("value", F.transform(detect(F.col("value"), "body", R.CATALOGUE), lambda d: d["rule_id"]).alias("ids")).collect()
    plain = F.array_compact(F.array(*[F.when(F.col("value").rlike(R.java_pattern(r.pattern)), r.id) for r in R.CATALOGUE]))
    want = {r["value"]: r["ids"] for r in df.select("value", plain.alias("ids")).collect()}
    assert {r["value"]: r["ids"] for r in guarded} == want and len({i for ids in want.values() for i in ids}) == len(R.CATALOGUE)


def test_first_characters(spark):
    want = {r"(?i)\bUnion\b": "Uu", r"(?i)(cn|uid)\s*=": "CUcu", r"\(\||\[&": "([", r"a?[0-2]": "012Aa", r"\s*x|\dy": "\t\n\v\f\r 0123456789Xx", r"a*": "", r".a": "", r"[^a]": "", r"(?iu)k": "", "[\u0430-\u0432]": "", "\u0430|b": "", r"\v": "", r"\p{L}": ""}
    assert {p: R.first_characters(p) for p in want} == {p: "".join(sorted(c)) for p, c in want.items()}
    # Marks that stand apart in the value are no text of it; a choice is tried as a whole; what stands before a place counts.
    rules = tuple(R.Rule(i, str(i), "Xss", pattern=p) for i, p in enumerate((r"''|\.\.", r"\(\||\[&", r"(?<=a)b|c$", r"(?i)\bkid", r"[\u0430-\u0432]|x", r"(?iu)k")))
    values = ["'a' .b.", "x''", "..", "(|", "[&", "( |", "ab", "b", "cc", "ca", "a KID", "akid", "\u212aid", "\u0431", "x", None]
    got = spark.createDataFrame([(v,) for v in values], "value string").select("value", F.transform(detect(F.col("value"), "body", rules), lambda d: d["rule_id"]).alias("ids")).collect()
    found = {"x''": [0, 4], "..": [0], "(|": [1], "[&": [1], "ab": [2], "cc": [2], "a KID": [3, 5], "akid": [5], "\u212aid": [5], "\u0431": [4], "x": [4]}
    assert {r["value"]: r["ids"] for r in got} == {v: found.get(v, []) for v in values}


def test_needed_marks_and_words():
    assert R.needed_marks(r"(?i)(cn|uid|dc|ou|objectclass)\s*=") == {frozenset("=")}
    assert R.needed_marks(r"(?i)['\"]\s*OR\s*['\"]?1['\"]?\s*=\s*1") == {frozenset("'\""), frozenset("=")}
    assert R.needed_marks(r"(%00|\x00)") == {frozenset("%\x00")} and R.needed_marks(r"a|;") == R.needed_marks(r"[^;]-*") == frozenset()
    assert R.whole_words(r"(?i)\b(nc|SSH)\b") == ("nc", "ssh") and R.whole_words(r"(?i)\b(nc|ssh)") == R.whole_words(r"(?i)\b(nc|)\b") == ()
    assert R.cased_texts("(?-i)(uNiOn|FrOm)") == ("uNiOn", "FrOm") and R.cased_texts("(?i)(uNiOn)") == R.cased_texts("(union)") == ()


def test_selectors():
    rule = R.by_id(R.CATALOGUE, 942100)
    for selector in (942100, "942100", "942*", "942000-942199", "@sqli-union"):
        assert R.matches(selector, rule)
    for selector in (1, "1", "943*", "1-2", "@nope", "a-b"):
        assert not R.matches(selector, rule)
    assert not any(r.id // 1000 == 942 for r in R.load(Config(disabled=("942*",))))
    assert [r.id for r in R.load(Config(enabled=(942100, 942101), disabled=(942101,)))] == [942100]


def test_requests_with_headers_and_exclusions(spark):
    rows = spark.createDataFrame(
        [
            ("/a?id=1 UNION SELECT 2", {"User-Agent": ["sqlmap/1.0"], "Accept": ["*"]}),
            ("/health?id=1 UNION SELECT 2", {}),
            ("/lift?id=1 UNION SELECT 2", {}),
            ("/plain", None),
        ],
        "uri string, headers map<string,array<string>>",
    )
    config = Config(exclude_paths=("/health",), exclusions=(Exclusion(("942*",), ("/lift",)),))
    got = {r["uri"].split("?")[0]: r for r in decide_requests(rows, config, headers="headers").collect()}
    assert [d["location"] for d in got["/a"]["detections"]] == ["query", "header:Accept", "header:User-Agent"]
    assert got["/a"]["response"]["status"] == 403 and got["/a"]["response"]["headers"]["X-WAF-Rule"] == "942100,933100,913100"
    assert [got[p]["decision"] for p in ("/health", "/lift", "/plain")] == ["allow"] * 3


def test_needed_texts():
    assert R.needed_texts(r"(?i)\bUNION\b.{0,100}\bSELECT\b") == ("select",)
    assert R.needed_texts(r"(abc|de)x*") == ("abc", "de")
    assert R.needed_texts(r"[ab]+") == ()


def test_config_from_json():
    config = Config.from_json('{"paranoia-level": 9, "sqli": false, "exclude-paths": ["/x"], "unknown": 1}')
    assert (config.paranoia, config.clamped().paranoia, config.sqli, config.exclude_paths) == (9, 4, False, ("/x",))


def test_config_sections():
    config = Config.from_json(
        '{"max-body-size": 9, "response-inspection-enabled": true, "scoring": {"block-threshold": 7, "location-weights": {"query": 2.0}}, "streaming": {"enabled": true, "window-overlap": 5},'
        ' "ml": {"classifier-enabled": true, "score-weight": 0.5}, "websocket": {"block-mode": false, "inspect-binary-frames": true}, "rules": {"disabled": [942100]}}'
    )
    assert (config.max_body, config.response_inspection, config.block_threshold, config.streaming, config.overlap) == (9, True, 7, True, 5)
    assert (config.ml_classifier, config.ml_score_weight, config.websocket_block_mode, config.websocket_binary, config.disabled) == (True, 0.5, False, True, (942100,))
    assert config.location_weights["query"] == 2.0 and config.location_weights["path"] == 1.2
