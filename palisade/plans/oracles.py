"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import re
import zlib

from palisade.config import Config
from palisade.model import ATTACK_TYPES, LOCATION_WEIGHTS, SEVERITY_WEIGHTS
from palisade.operators import api, bots, intel, sensitive, supply_chain
from palisade.operators.attack_payloads import PAYLOADS
from palisade.operators.attack_phrases import PHRASES
from palisade.operators.metrics import BUCKETS
from palisade.plans.queries import AGENTS, ALIKE, BUDGET, GRAPHQL_PARTS, JSON_VALUES, JWT_CLAIMS, JWT_HEADS, KEYS, PATCHED, POLICIES, SELECTION, SENSITIVE
from palisade.rules import CATALOGUE, Rule, load, re2_pattern
from palisade.rules.examples import example


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matched(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {quoted(re2_pattern(pattern))})"


def hits(source: str, key: str, value: str, rules: tuple[Rule, ...], location: str = "body") -> str:
    """SQL of key, ord, rule_id, attack_type, score for each rule that matches."""
    parts = []
    for ordinal, r in enumerate(rules):
        score = f"round({r.base} * {LOCATION_WEIGHTS[location]} * {SEVERITY_WEIGHTS[r.severity]})::INT"
        parts.append(f"SELECT {key}, {ordinal} AS ord, {r.id} AS rule_id, {quoted(ATTACK_TYPES[r.attack])} AS attack_type, {score} AS score FROM {source} WHERE {matched(value, r.pattern)}")
    return " UNION ALL ".join(parts)


PL1, PL2 = load(Config()), load(Config(paranoia=2))
SELECTED = load(SELECTION)

WAF_DECISIONS = f"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN position('?' IN url) > 0 THEN left(url, position('?' IN url) - 1) ELSE url END AS path,
    CASE WHEN position('?' IN url) > 0 THEN substr(url, position('?' IN url) + 1) END AS query FROM pages
), found AS (
  SELECT 0 AS place, * FROM ({hits("parts", "page_id", "path", PL1, "path")})
  UNION ALL SELECT 1, * FROM ({hits("parts", "page_id", "query", PL1, "query")})
  UNION ALL SELECT 2, * FROM ({hits("parts", "page_id", "html", PL1, "body")})
), summed AS (
  SELECT page_id, sum(score)::INT AS score, string_agg(rule_id::VARCHAR, ',' ORDER BY place, ord) AS rule_ids, count(*)::INT AS n_detections
  FROM found GROUP BY page_id
)
SELECT page_id, CASE WHEN n_detections IS NULL THEN 'allow' WHEN score >= 25 THEN 'block' WHEN score >= 10 THEN 'warn' ELSE 'allow' END AS decision,
  coalesce(score, 0) AS score, coalesce(rule_ids, '') AS rule_ids, coalesce(n_detections, 0) AS n_detections
FROM pages LEFT JOIN summed USING (page_id)
"""

LONG_NUMBER = r"\b[0-9]{13,19}\b"
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = (
    "(length({0}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({0}) + 1), lambda i: "
    "CASE WHEN i % 2 = 0 THEN 2 * substr({0}, length({0}) - i + 1, 1)::INT - CASE WHEN substr({0}, length({0}) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END "
    "ELSE substr({0}, length({0}) - i + 1, 1)::INT END)) % 10 = 0)"
)
_BRAND = (
    "CASE WHEN regexp_matches({0}, '^4') THEN 'Visa' WHEN regexp_matches({0}, '^5[1-5]') THEN 'Mastercard' WHEN regexp_matches({0}, '^3[47]') THEN 'American Express' "
    "WHEN regexp_matches({0}, '^(6011|65)') THEN 'Discover' WHEN regexp_matches({0}, '^35') THEN 'JCB' WHEN regexp_matches({0}, '^3[068]') THEN 'Diners Club' ELSE 'Unknown' END"
)


def _every(pattern: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(re2_pattern(pattern))})) AS found FROM documents"


def _cards(rule_id: int, name: str, pattern: str) -> str:
    digits = f"SELECT {_DIGITS.format('found')} AS d FROM ({_every(pattern)})"
    return f"SELECT {rule_id} AS rule_id, '{name} Detected: ' || {_BRAND.format('d')} AS rule_name FROM ({digits}) WHERE {_LUHN.format('d')}"


_SSN = f"""SELECT 95100, 'Social Security Number Detected' FROM (SELECT {_DIGITS.format("found")} AS d FROM ({_every(sensitive.SSN)}))
  WHERE length(d) = 9 AND left(d, 3)::INT NOT IN (0, 666) AND left(d, 3)::INT < 900 AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000'"""
_KEYS = " UNION ALL ".join(f"SELECT 95200, 'API Key Detected: {name}' FROM ({_every(pattern)})" for name, pattern in sensitive.API_KEYS)
_PRIVATE = " UNION ALL ".join(f"SELECT 95300, 'Private Key Detected: {kind}' FROM documents WHERE contains(text, '{header}')" for kind, header in sensitive.PRIVATE_KEYS)
_MAIL = f"SELECT 95101, 'Bulk Email Exposure' FROM documents WHERE regexp_matches(text, {quoted(sensitive.EMAIL)})"

TIMING = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 3600000 AS t FROM events),
w AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap_ms,
    list(t) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS earlier
  FROM e
),
r AS (SELECT *, list_filter(earlier, lambda x: x > t - 60000) AS recent FROM w),
k AS (SELECT *, recent[greatest(len(recent) - 99, 1):] AS kept FROM r),
s AS (SELECT *, list_transform(range(2, len(kept) + 1), lambda i: kept[i] - kept[i - 1]) AS steps FROM k),
m AS (SELECT *, len(steps) AS n, coalesce(list_sum(steps), 0)::BIGINT // greatest(len(steps), 1) AS mean FROM s),
v AS (SELECT *, floor(sqrt((coalesce(list_sum(list_transform(steps, lambda x: (x - mean) * (x - mean))), 0)::BIGINT // greatest(n, 1))::DOUBLE)) AS sd FROM m)
SELECT event_id, coalesce(gap_ms, -1) AS gap_ms,
  CASE WHEN gap_ms < 100 THEN 'too-fast' WHEN n >= 5 AND sd < 50 AND mean < 5000 THEN 'regular' WHEN len(kept) >= 50 THEN 'burst' ELSE 'none' END AS timing_kind,
  CASE WHEN gap_ms < 10 THEN 60 WHEN gap_ms < 100 THEN 40 WHEN n >= 5 AND sd < 50 AND mean < 5000 THEN 45 WHEN len(kept) >= 50 THEN 50 ELSE 0 END AS timing_score
FROM v
"""

_NAMES = ("Host", "Accept", "User-Agent", "Cookie", "Content-Type")
#: The header names that each of 23 clients sends, by the checksum that the query builds its requests with.
_SENT = ", ".join(f"({c}, '{n}')" for c in range(23) for n in _NAMES if n == "Host" or zlib.crc32(f"{n}{c}".encode()) % 3)
_FEATURES = f"""WITH sent AS (SELECT * FROM (VALUES {_SENT}) AS v(c, name)),
lists AS (SELECT c, list(name ORDER BY name) AS names FROM sent GROUP BY c),
r AS (
  SELECT event_id AS o, CASE WHEN user_id % 10 = 0 THEN '/u/' || (user_id * 7 % 1000) || '/' || (event_id % 900) ELSE '/' || event_type END AS e,
    CASE WHEN event_type = 'view' THEN 'GET' WHEN user_id % 29 = 3 THEN 'OTHER' WHEN user_id % 31 = 5 THEN 'DELETE' ELSE 'POST' END AS m,
    repeat('a=1&', floor(value)::INT) || CASE WHEN floor(value)::INT % 13 = 7 THEN md5(props) ELSE '' END || 'b' AS q,
    names, array_to_string(names, ',') AS h, len(names) AS nh,
    CASE WHEN list_contains(names, 'Content-Type') THEN (['html', 'json', 'text', 'other'])[user_id % 23 % 4 + 1] ELSE 'none' END AS t
  FROM events JOIN lists ON user_id % 23 = c
), letters AS (SELECT o, unnest(string_split(q, '')) AS ch, strlen(q) AS n FROM r),
ent AS (SELECT o, round(sum(-(k / n) * log2(k / n)), 9) AS x FROM (SELECT o, n, ch, count(*) AS k FROM letters WHERE ch <> '' GROUP BY ALL) GROUP BY o),
f AS (SELECT r.*, x, least(len(regexp_extract_all(q, '&')) + 1, 255) AS np FROM r JOIN ent USING (o)),
n AS (SELECT o, e, unnest(names) AS name FROM f)"""
_FACTORS = """array_to_string(list_filter([CASE WHEN f1 THEN 'header_count' END, CASE WHEN f2 THEN 'header_order' END, CASE WHEN f3 THEN 'method' END,
    CASE WHEN f4 THEN 'content_type' END, CASE WHEN f5 THEN 'parameters' END, CASE WHEN f6 THEN 'entropy' END, CASE WHEN f7 THEN 'missing_headers' END], lambda y: y IS NOT NULL), ',') AS factors"""
_ANOMALY = "least(0.1 * f1::INT + 0.15 * f2::INT + 0.2 * f3::INT + 0.15 * f4::INT + 0.1 * f5::INT + 0.2 * f6::INT + 0.1 * f7::INT, 1.0)::DOUBLE AS a"

FINGERPRINT = f"""
{_FEATURES},
-- How often a name was sent before, to the endpoint and at all.
k AS (SELECT *, row_number() OVER (PARTITION BY e, name ORDER BY o) - 1 AS ke, row_number() OVER (PARTITION BY name ORDER BY o) - 1 AS ka FROM n),
kk AS (SELECT o, count(*) FILTER (ke >= 16) AS he, count(*) FILTER (ke = 15) AS ne, count(*) FILTER (ka >= 16) AS ha, count(*) FILTER (ka = 15) AS na FROM k GROUP BY o),
w AS (
  SELECT f.*, he, ha, count(*) OVER pe AS samples, row_number() OVER (ORDER BY o) AS nth,
    max(nh) OVER pe AS nhe, max(nh) OVER pa AS nha, max(np) OVER pe AS npe, max(np) OVER pa AS npa, max(x) OVER pe AS xe, max(x) OVER pa AS xa,
    coalesce(sum(ne) OVER pe, 0) AS re, coalesce(sum(na) OVER pa, 0) AS ra,
    row_number() OVER (PARTITION BY e, m ORDER BY o) > 1 AS me, row_number() OVER (PARTITION BY m ORDER BY o) > 1 AS ma,
    row_number() OVER (PARTITION BY e, t ORDER BY o) > 1 AS te, row_number() OVER (PARTITION BY t ORDER BY o) > 1 AS ta,
    row_number() OVER (PARTITION BY e, h ORDER BY o) > 1 AS se, row_number() OVER (PARTITION BY h ORDER BY o) > 1 AS sa
  FROM f JOIN kk USING (o)
  WINDOW pe AS (PARTITION BY e ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pa AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b AS (
  SELECT *, nh > greatest(50, coalesce(CASE WHEN samples >= 10 THEN nhe ELSE nha END, 0)) AS f1,
    nth > 1 AND NOT CASE WHEN samples >= 10 THEN se ELSE sa END AS f2,
    m NOT IN ('GET', 'POST') AND NOT CASE WHEN samples >= 10 THEN me ELSE ma END AS f3,
    t NOT IN ('none', 'form', 'json') AND NOT CASE WHEN samples >= 10 THEN te ELSE ta END AS f4,
    np > greatest(20, coalesce(CASE WHEN samples >= 10 THEN npe ELSE npa END, 0)) + 5 AS f5,
    x > greatest(5.0, coalesce(CASE WHEN samples >= 10 THEN xe ELSE xa END, 0)) + 1.0 AS f6,
    CASE WHEN samples >= 10 THEN re - he ELSE ra - ha END > 2 AS f7 FROM w
), s AS (SELECT *, {_ANOMALY} FROM b)
SELECT o AS event_id, samples, {_FACTORS},
  round(a, 6) AS anomaly, CASE WHEN a >= 0.3 THEN floor(a * 5)::INT ELSE -1 END AS base_score FROM s
"""

#: What a baseline knows after it has learned from some requests; an endpoint of few asks that of all.
_KNOWN = "count(*) AS samples, max(nh) AS nh, max(np) AS np, max(x) AS x, list(DISTINCT h) AS hs, list(DISTINCT m) AS ms, list(DISTINCT t) AS ts"
FINGERPRINT_MODEL = f"""
{_FEATURES}, l AS (SELECT * FROM f WHERE o % 4 < 3), own AS (SELECT e, {_KNOWN} FROM l GROUP BY e), everyone AS (SELECT {_KNOWN} FROM l),
often AS (SELECT e, list(name) AS names FROM (SELECT e, name FROM n WHERE o % 4 < 3 GROUP BY ALL HAVING count(*) >= 16) GROUP BY e),
always AS (SELECT list(name) AS names FROM (SELECT name FROM n WHERE o % 4 < 3 GROUP BY ALL HAVING count(*) >= 16)),
j AS (
  SELECT f.*, coalesce(own.samples, 0) AS samples, own.samples >= 10 AS known, CASE WHEN known THEN own.nh ELSE a.nh END AS mh, CASE WHEN known THEN own.np ELSE a.np END AS mp,
    CASE WHEN known THEN own.x ELSE a.x END AS mx, CASE WHEN known THEN own.hs ELSE a.hs END AS hs, CASE WHEN known THEN own.ms ELSE a.ms END AS ms,
    CASE WHEN known THEN own.ts ELSE a.ts END AS ts, coalesce(CASE WHEN known THEN often.names ELSE always.names END, []) AS wanted
  FROM f LEFT JOIN own USING (e) LEFT JOIN often USING (e), everyone a, always
), b AS (
  SELECT *, nh > greatest(50, mh) AS f1, NOT list_contains(hs, h) AS f2, m NOT IN ('GET', 'POST') AND NOT list_contains(ms, m) AS f3,
    t NOT IN ('none', 'form', 'json') AND NOT list_contains(ts, t) AS f4, np > greatest(20, mp) + 5 AS f5, x > greatest(5.0, mx) + 1.0 AS f6,
    len(list_filter(wanted, lambda y: NOT list_contains(names, y))) > 2 AS f7 FROM j
), s AS (SELECT *, {_ANOMALY} FROM b)
SELECT o AS event_id, samples, {_FACTORS}, round(a, 6) AS anomaly FROM s
"""

_LE = ", ".join(f"count(*) FILTER (ms <= {b}) AS le_{b:g}" for b in BUCKETS)
_HISTOGRAM = f"""SELECT event_type, {_LE}, count(*) AS le_inf, sum(ms)::BIGINT AS total, count(*) AS n
  FROM (SELECT event_type, floor(value)::BIGINT AS ms FROM events) GROUP BY event_type"""
_LINES = " UNION ALL ".join(
    [f"""SELECT 'waf_latency_ms_bucket{{type="' || event_type || '",le="{b:g}"}} ' || le_{b:g} AS value FROM h""" for b in BUCKETS]
    + ["""SELECT 'waf_latency_ms_bucket{type="' || event_type || '",le="+Inf"} ' || le_inf FROM h"""]
    + [f"""SELECT 'waf_latency_ms{suffix}{{type="' || event_type || '"}} ' || {column} FROM h""" for suffix, column in (("_sum", "total"), ("_count", "n"))]
)

#: Attacks that some turns have in them, so that bodies have something to find.
_ATTACKED = "coalesce(text, '') || CASE WHEN (conv_id + turn) % 5 = 1 THEN ' 1 UNION SELECT password FROM users-- <script>alert(1)</script>' WHEN (conv_id + turn) % 7 = 2 THEN '; cat /etc/passwd' ELSE '' END"
_FRAMES_WITH_ATTACKS = f"SELECT conv_id, turn, {_ATTACKED} AS text, turn % 3 = 2 AS fin FROM conversations"
#: ended: buffers of chunks as they end, by the last chunk of a body or by one that is too much.
_BUFFERS = f"""f AS (SELECT conv_id, turn, text, fin, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM ({_FRAMES_WITH_ATTACKS})),
  b AS (
    SELECT conv_id, k, turn, turn AS first, n AS size, text AS body, n > 1500 AS too_large, fin OR n > 1500 AS ends, 0::BIGINT AS buffer FROM f WHERE k = 1
    UNION ALL
    SELECT f.conv_id, f.k, f.turn, CASE WHEN b.ends THEN f.turn ELSE b.first END, CASE WHEN b.ends THEN f.n ELSE b.size + f.n END,
      CASE WHEN b.ends THEN f.text ELSE b.body || f.text END, CASE WHEN b.ends THEN f.n ELSE b.size + f.n END > 1500,
      fin OR CASE WHEN b.ends THEN f.n ELSE b.size + f.n END > 1500, b.buffer + b.ends::BIGINT FROM b JOIN f ON f.conv_id = b.conv_id AND f.k = b.k + 1
  ), ended AS (SELECT conv_id, buffer, first, turn AS last, size::BIGINT AS size, too_large, body FROM b WHERE ends)"""
#: Rules whose patterns both engines read alike on chunks cut at any byte.
BODY_RULES = load(Config(paranoia=2))
_FRAMES = "SELECT conv_id, turn, coalesce(text, '') AS text, turn % 3 = 2 AS fin FROM conversations"


def _grams(name: str, key: str, source: str) -> str:
    texts = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(range(1, length(lower(text)) - {n - 2}), lambda i: substr(lower(text), i, {n}))) AS ngram FROM {source} WHERE length(text) >= {n}" for n in (2, 3, 4)
    )
    return f"{name} AS (SELECT {key}, ngram, count(*) AS n FROM ({texts}) GROUP BY {key}, ngram)"


_PATCH_VALUE = "html || CASE WHEN page_id % 7 = 0 THEN ' ${jndi:ldap://x} () { :;}' ELSE '' END"
_PATCHES = " UNION ALL ".join(
    f"SELECT page_id, {p.rule_id} AS rule_id, {intel.SEVERITY_BASE[p.severity]} AS base_score FROM v WHERE {' OR '.join(matched('value', x) for x in p.patterns)}" for p in intel.PATCHES
)
_SCRIPT_BODY = r"""CASE WHEN page_id % 5 = 0 THEN regexp_replace(html, 'track\([0-9]+\);', 'eval(atob(''eA==''));window.location=''http://x'';') ELSE html END"""
_SCRIPTS = " UNION ALL ".join(
    f"SELECT page_id, {quoted('Suspicious Script: ' + name)} AS rule_name FROM part WHERE {matched('value', pattern)}" for pattern, name, _ in supply_chain.SCRIPT_PATTERNS
)
_EMBEDDED = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS g, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"

def _chars(text: str) -> str:
    """A literal; control characters by number."""
    return " || ".join(quoted(part) if ord(part[0]) >= 32 else f"chr({ord(part[0])})" for part in re.findall(r"[\x20-\U0010ffff]+|[\x00-\x1f]", text))


_PHRASES = ", ".join(f"('{kind}', {len(texts)}, {_chars(text)})" for kind, texts in PHRASES.items() for text in texts)
_PHRASE_GRAMS = " UNION ALL ".join(f"SELECT kind, m, unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) AS ngram FROM p WHERE length(t) >= {n}" for n in (2, 3, 4))
_CLASSIFY = f"""WITH p AS (SELECT kind, m, lower(t) AS t FROM (VALUES {_PHRASES}) AS v(kind, m, t)),
  w AS (SELECT kind, ngram, count(*) / sqrt(any_value(m)) AS x FROM ({_PHRASE_GRAMS}) GROUP BY kind, ngram),
  z AS (SELECT kind, ngram, x / max(x) OVER (PARTITION BY kind) AS weight, count(*) OVER (PARTITION BY kind) AS k FROM w),
  {_grams("g", "page_id", "(SELECT page_id, substr(url, position('?' IN url) + 1) AS text FROM pages WHERE position('?' IN url) > 0)")},
  s AS (SELECT page_id, sum(n) AS total, count(*) AS d FROM g GROUP BY page_id),
  j AS (SELECT page_id, kind, any_value(k) AS k, sum(n * weight) AS f, sum(weight) AS pr, count(*) AS c FROM g JOIN z USING (ngram) GROUP BY page_id, kind)
  SELECT page_id, kind, round(least((0.6 * f / total + 0.4 * pr / k) * (1 + 0.5 * c / d), 1.0), 6) AS score FROM j JOIN s USING (page_id)"""

OPENAPI_VALIDATION = r"""
WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, round(value, 1)::VARCHAR AS v FROM events),
r AS (
  SELECT event_id, k, user_id::VARCHAR AS u,
    CASE event_type WHEN 'view' THEN '/users/' || CASE WHEN k % 5 = 0 THEN 'u' ELSE '' END || user_id WHEN 'click' THEN '/users/me'
      WHEN 'purchase' THEN '/orders' WHEN 'signup' THEN '//orders/' ELSE '/orders/' || user_id END AS path,
    upper((['get', 'POST', 'Delete', 'GET'])[k % 4 + 1]) AS method,
    CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' END AS q_full, CASE WHEN k % 7 < 5 THEN CASE WHEN k % 7 = 2 THEN v ELSE user_id::VARCHAR END END AS q_page,
    CASE WHEN k % 11 = 3 THEN v || 'x' ELSE v END AS q_price, CASE WHEN k % 2 = 0 THEN 't' END AS h_token,
    CASE WHEN k % 13 < 4 THEN '' WHEN k % 13 < 9 THEN props ELSE props || '}' END AS body,
    CASE WHEN k % 17 < 9 THEN 'application/json' WHEN k % 17 < 14 THEN 'text/plain' END AS kind
  FROM e
), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM r),
templates(t, place, n, s1, s2) AS (VALUES ('me', 1, 2, 'users', 'me'), ('id', 2, 2, 'users', NULL), ('orders', 1, 1, 'orders', NULL)),
operations(t, method) AS (VALUES ('me', 'GET'), ('id', 'GET'), ('id', 'DELETE'), ('orders', 'GET'), ('orders', 'POST')),
parameters(t, method, loc, name, needed, kind) AS (VALUES ('me', 'GET', 'header', 'X-Token', true, 'string'), ('id', 'GET', 'path', 'id', true, 'integer'), ('id', 'GET', 'query', 'full', false, 'boolean'),
  ('id', 'DELETE', 'path', 'id', true, 'integer'), ('orders', 'GET', 'query', 'page', true, 'integer'), ('orders', 'GET', 'query', 'price', false, 'number'), ('orders', 'POST', 'query', 'page', true, 'integer')),
f AS (SELECT s.*, t, place FROM s JOIN templates ON n = len(seg) AND s1 = seg[1] AND (s2 IS NULL OR s2 = seg[2])),
o AS (SELECT f.* FROM f JOIN operations USING (t, method) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) = 1),
g AS (SELECT o.*, p.loc, p.name, p.needed, p.kind AS type, CASE WHEN p.loc = 'path' THEN seg[2] WHEN p.name = 'X-Token' THEN h_token WHEN p.name = 'full' THEN q_full WHEN p.name = 'page' THEN q_page ELSE q_price END AS value
  FROM o JOIN parameters p ON p.t = o.t AND p.method = o.method)
SELECT event_id, 98300 AS rule_id, 'path' AS location, path AS matched FROM s WHERE event_id NOT IN (SELECT event_id FROM f)
UNION ALL SELECT event_id, 98301, 'method', method || '; allowed: ' || (SELECT string_agg(x.method, ', ' ORDER BY x.method) FROM operations x WHERE x.t = a.t)
  FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY place) = 1) a WHERE event_id NOT IN (SELECT event_id FROM o)
UNION ALL SELECT event_id, 98302, loc || '.' || name, 'missing' FROM g WHERE needed AND value IS NULL
UNION ALL SELECT event_id, 98303, loc || '.' || name, value FROM g WHERE type = 'integer' AND NOT regexp_full_match(value, '[+-]?[0-9]+') OR type = 'number' AND try_cast(value AS DOUBLE) IS NULL AND value IS NOT NULL OR type = 'boolean' AND value NOT IN ('true', 'false')
UNION ALL SELECT event_id, 98305, 'body', 'parse error' FROM o WHERE body <> '' AND kind = 'application/json' AND NOT json_valid(body)
"""

GRAPHQL_VALIDATION = r"""
WITH e AS (SELECT event_id, event_type AS f, user_id, json_extract_string(props, '$.k')::INT AS k FROM events),
roots(f, type, id_needed, deprecated) AS (VALUES ('view', 'Item', true, false), ('click', 'Item', true, false), ('purchase', 'Order', false, true), ('signup', 'Boolean', false, false)),
members(type, name, deprecated, currency_needed) AS (VALUES ('Item', 'id', false, false), ('Item', 'name', false, false), ('Item', 'price', true, false), ('Order', 'id', false, false), ('Order', 'item', false, false), ('Order', 'total', false, true)),
known_args(f, a) AS (VALUES ('view', 'id'), ('click', 'id'), ('click', 'at'), ('signup', 'name')),
q AS (SELECT e.*, CASE k % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'nme' END AS a, roots.* EXCLUDE (f), roots.f IS NOT NULL AS found FROM e LEFT JOIN roots USING (f) WHERE k % 10 <> 1),
m AS (SELECT q.event_id, q.f, q.type, unnest([struct_pack(name := (['id', 'name', 'price', 'total', 'total', '__typename'])[k % 6 + 1], currency := k % 6 = 4), struct_pack(name := (['id', 'item', 'nope'])[k % 5 % 3 + 1], currency := false)], recursive := true)
  FROM q WHERE found),
j AS (SELECT m.*, members.name IS NOT NULL AS found, deprecated, currency_needed FROM m LEFT JOIN members USING (type, name) WHERE m.name <> '__typename')
SELECT event_id, 98352 AS rule_id, 'query' AS location, 'parse error' AS matched FROM e WHERE k % 10 = 1
UNION ALL SELECT event_id, 98351, 'q.' || f, f FROM q WHERE NOT found
UNION ALL SELECT event_id, 98356, 'q.' || f, f FROM q WHERE deprecated
UNION ALL SELECT event_id, 98352, 'q.' || f || '.' || a, a FROM q WHERE found AND a IS NOT NULL AND (f, a) NOT IN (SELECT (f, a) FROM known_args)
UNION ALL SELECT event_id, 98353, 'q.' || f || '.id', 'missing' FROM q WHERE id_needed AND a IS DISTINCT FROM 'id'
UNION ALL SELECT event_id, 98351, 'q.' || f || '.' || name, name FROM j WHERE NOT found
UNION ALL SELECT event_id, 98356, 'q.' || f || '.' || name, name FROM j WHERE deprecated
UNION ALL SELECT event_id, 98353, 'q.' || f || '.' || name || '.currency', 'missing' FROM j WHERE currency_needed AND NOT currency
UNION ALL SELECT event_id, 98352, 'q.' || f || '.' || name || '.currency', 'currency' FROM j WHERE found AND currency AND NOT currency_needed
"""

def _examples(texts) -> str:
    """v: (doc_id, text), a page's address between two of texts."""
    values = ", ".join(f"({k}, {_chars(x)})" for k, x in enumerate(texts))
    return f"""x AS (SELECT * FROM (VALUES {values}) AS y(k, example)),
      v AS (SELECT page_id AS doc_id, a.example || ' ' || url || ' ' || b.example AS text FROM pages JOIN x a ON page_id % {len(texts)} = a.k JOIN x b ON (page_id * 7 + 3) % {len(texts)} = b.k)"""


_SCANNED = f"{_cards(95001, 'Credit Card', sensitive.CARD)} UNION ALL {_cards(95002, 'Credit Card (Formatted)', sensitive.CARD_SEPARATED)} UNION ALL {_SSN} UNION ALL {_KEYS} UNION ALL {_PRIVATE}"
_MAILS = f"SELECT 95101, 'Bulk Email Exposure' FROM documents WHERE len(regexp_extract_all(text, {quoted(sensitive.EMAIL)})) >= 2"


def _at(pattern: str) -> str:
    """doc_id, found and the byte where it begins: what lies before is what is left when it and all behind it go."""
    p = quoted(re2_pattern(pattern))
    return f"""SELECT doc_id, unnest(m) AS found, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[:i], lambda y: strlen(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: strlen(y))), 0))) AS position
      FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split(regexp_replace(text, {p}, chr(1), 'g'), chr(1)) AS g FROM v)"""


_DETAILED = " UNION ALL ".join(
    [
        f"SELECT doc_id, 'credit card' AS data_type, {_BRAND.format('found')} AS detail, position FROM ({_at(sensitive.CARD)}) WHERE {_LUHN.format('found')}",
        f"""SELECT doc_id, 'social security number', '', position FROM (SELECT *, {_DIGITS.format("found")} AS d FROM ({_at(sensitive.SSN)}))
          WHERE length(d) = 9 AND left(d, 3)::INT NOT IN (0, 666) AND left(d, 3)::INT < 900 AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000'""",
        *(f"SELECT doc_id, 'api key', {quoted(name)}, position FROM ({_at(pattern)})" for name, pattern in sensitive.API_KEYS),
        *(f"SELECT doc_id, 'private key', '{kind}', strlen(left(text, position('{header}' IN text) - 1)) FROM v WHERE contains(text, '{header}')" for kind, header in sensitive.PRIVATE_KEYS),
    ]
)
_BYTES = "list_transform(range(1, strlen({0}) + 1), lambda i: substr(hex(encode({0})), 2 * i - 1, 2))"
_FEATURES = f"""
WITH r AS (SELECT page_id, url, html, string_split(url, '?')[1] AS path, CASE WHEN position('?' IN url) > 0 THEN substr(url, position('?' IN url) + 1) END AS q, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
b AS (SELECT page_id, 'q' AS part, unnest({_BYTES.format("q")}) AS x FROM r WHERE q IS NOT NULL UNION ALL SELECT page_id, 'b', unnest({_BYTES.format("html")}) FROM r),
n AS (SELECT page_id, part, x, count(*) AS k, sum(count(*)) OVER (PARTITION BY page_id, part) AS n FROM b GROUP BY page_id, part, x),
h AS (SELECT page_id, part, sum(-(k / n) * log2(k / n)) / 8 AS entropy, sum(k) FILTER (x BETWEEN '20' AND '7E') / any_value(n) AS printable FROM n GROUP BY page_id, part),
t AS (SELECT page_id, path || ' ' || coalesce(q, '') || ' ' || html AS whole FROM r),
c AS (SELECT page_id, ord(ch) % 16 AS bucket, count(*) AS k FROM (SELECT page_id, unnest(string_split(whole, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL),
f AS (
  SELECT page_id, 0 AS i, strlen(path) / 1000 AS value FROM r
  UNION ALL SELECT page_id, 1, (length(path) - length(replace(path, '/', ''))) / 10 FROM r
  UNION ALL SELECT page_id, 2, contains(path, '..')::INT FROM r UNION ALL SELECT page_id, 3, contains(path, chr(39))::INT FROM r UNION ALL SELECT page_id, 4, contains(path, '<')::INT FROM r
  UNION ALL SELECT page_id, 5, strlen(q) / 1000 FROM r WHERE q IS NOT NULL
  UNION ALL SELECT page_id, 6, (length(q) - length(replace(q, '=', ''))) / 10 FROM r WHERE q IS NOT NULL
  UNION ALL SELECT page_id, 7, (length(q) - length(replace(q, '&', ''))) / 10 FROM r WHERE q IS NOT NULL
  UNION ALL SELECT page_id, 8, entropy FROM h WHERE part = 'q'
  UNION ALL SELECT page_id, 9, 2 / 20 FROM r UNION ALL SELECT page_id, 10, 4 / 100 FROM r UNION ALL SELECT page_id, 11, strlen(host) / 1000 FROM r
  UNION ALL SELECT page_id, 12, 11 / 100 FROM r UNION ALL SELECT page_id, 13, strlen(left(url, 20)) / 1000 FROM r
  UNION ALL SELECT page_id, 30, strlen(html) / 10000 FROM r UNION ALL SELECT page_id, 31, entropy FROM h WHERE part = 'b' UNION ALL SELECT page_id, 32, printable FROM h WHERE part = 'b'
  UNION ALL SELECT c.page_id, 33 + bucket, k / strlen(whole) FROM c JOIN t USING (page_id)
)
SELECT page_id, i::INT AS i, round(value::FLOAT::DOUBLE, 5) AS value FROM f WHERE round(value::FLOAT::DOUBLE, 5) <> 0
"""
_ORDER_VALUES = ", ".join(f"({1 + k / 10})" for k in range(1, 65))
_DECISION = "CASE event_type WHEN 'error' THEN 'block' WHEN 'signup' THEN 'warn' ELSE 'allow' END"
_HIT = "SELECT user_id, 942100 AS rule_id, 'SQL Injection' AS attack_type FROM events WHERE event_type IN ('error', 'signup') UNION ALL SELECT user_id, 941100, 'Cross-Site Scripting' FROM events WHERE event_type = 'error'"

def _picked(texts, n: str) -> str:
    return f"(CASE ({n}) % {len(texts)} {' '.join(f'WHEN {k} THEN ' + ('NULL' if x is None else _chars(x) or quoted('')) for k, x in enumerate(texts))} END)"


_JSON_BODY = f"""'{{"' || {_picked(KEYS, 'event_id')} || '": ' || {_picked(JSON_VALUES, 'event_id * 3 + user_id')} || ', "k2" : ' || props || '}}'"""
_DEPTH_STEPS = r"""list_transform(regexp_extract_all(regexp_replace(t, '"[^"]*"', '', 'g'), '[{}\[\]]'), lambda c: CASE WHEN c IN ('{', '[') THEN 1 ELSE -1 END)"""


def _json_hit(pattern: str, rule_id: int, base: int) -> str:
    p = quoted(re2_pattern(pattern))
    return f"SELECT event_id, {rule_id} AS rule_id, {base} AS base_score, regexp_extract(t, {p}) AS matched FROM b WHERE regexp_matches(t, {p})"


_GRAPHQL = (
    f"""WITH b AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '[' ELSE 'query q ' END || repeat('{{ user ', (user_id % 13)::INT) || {_picked(GRAPHQL_PARTS, 'event_id')} || repeat(' }}', (user_id % 13)::INT) AS t FROM events),
  s AS (SELECT event_id, list_transform(regexp_extract_all(t, '[{{}}]'), lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END) AS s FROM b),
  d AS (SELECT event_id, coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))), 0)::INT AS depth FROM s),
  w AS (SELECT event_id, len(list_filter(regexp_extract_all(regexp_replace(t, '"[^"]*("|$)', '', 'g') || chr(1), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x NOT IN ({", ".join(map(quoted, api.KEYWORDS))})))
    - regexp_matches(regexp_replace(t, '"[^"]*("|$)', '', 'g'), '[\\p{{L}}\\p{{N}}_]$')::INT AS n FROM b),
  o AS (SELECT event_id, CASE WHEN starts_with(trim(t), '[') THEN len(regexp_extract_all(t, '"query"')) ELSE 0 END AS batch, len(regexp_extract_all(t, {quoted(api.OPERATION)})) AS ops FROM b),
  a AS (SELECT event_id, t, unnest(regexp_extract_all(t, '@\\w+')) AS x FROM b)
  SELECT event_id, 98001 AS rule_id, regexp_extract(t, {quoted(api.INTROSPECTION)}) AS matched FROM b WHERE regexp_matches(t, {quoted(api.INTROSPECTION)})
  UNION ALL SELECT event_id, 98002, 'depth=' || depth || ' (max=10)' FROM d WHERE depth > 10
  UNION ALL SELECT event_id, 98003, 'fields=' || n || ' (max=100)' FROM w WHERE n > 100
  UNION ALL SELECT event_id, 98004, CASE WHEN batch > 10 THEN 'batch_size=' || batch ELSE 'operations=' || ops END || ' (max=10)' FROM o WHERE batch > 10 OR ops > 10
  UNION ALL SELECT event_id, 98005, x || ' (count=' || k || ')' FROM (SELECT *, (length(t) - length(replace(t, x, ''))) // length(x) AS k FROM a WHERE lower(x) IN ({", ".join(quoted(x.lower()) for x in api.DIRECTIVES)})) WHERE k > 5"""
    + "".join(f" UNION ALL SELECT event_id, 98010, regexp_extract(t, {quoted(p)}) FROM b WHERE regexp_matches(t, {quoted(p)})" for p, _ in api.GRAPHQL_INJECTIONS)
)


def _url64(text: str) -> str:
    return f"replace(translate(to_base64(encode({text})), '+/', '-_'), '=', '')"


def _part(place: int) -> str:
    part = f"translate(string_split(token, '.')[{place}], '-_', '+/')"
    return f"try(decode(from_base64({part} || repeat('=', ((4 - length({part}) % 4) % 4)::INT))))"


def _holds(value: str, texts) -> str:
    return "(" + " OR ".join(f"contains({value}, {quoted(t)})" for t in texts) + ")"


_spelled = lambda *names: [x for n in names for x in (f'"alg":"{n}"', f'"alg": "{n}"')]
_CLAIMS = f"""'{{"sub":"' || user_id || '",' || {_picked(JWT_CLAIMS, 'user_id + event_id')} || CASE WHEN event_id % 2 = 0 THEN '"exp":' ELSE '"exp": ' END || (event_id + 1700000000) || '}}'"""
_JWT = f"""WITH t AS (SELECT event_id, props, {_url64(_picked(JWT_HEADS, 'event_id'))} || '.' || {_url64(_CLAIMS)} || CASE WHEN event_id % 11 = 4 THEN '' ELSE '.c2ln' END AS token FROM events),
  h AS (SELECT event_id, CASE event_id % 5 WHEN 3 THEN ' ' || token WHEN 4 THEN 'Basic ' || props ELSE 'Bearer ' || token END AS header FROM t),
  k AS (SELECT event_id, CASE WHEN starts_with(header, 'Bearer ') THEN trim(substr(header, 8)) WHEN regexp_matches(header, {quoted(api.TOKEN)}) THEN trim(header) END AS token FROM h),
  d AS (SELECT event_id, {_part(1)} AS head, {_part(2)} AS claims FROM k WHERE len(string_split(token, '.')) = 3)
  SELECT event_id, 98200 AS rule_id FROM d WHERE {_holds("head", api.NO_ALGORITHM)}
  UNION ALL SELECT event_id, 98201 FROM d WHERE {_holds("head", _spelled(*api.WEAK_ALGORITHMS))}
  UNION ALL SELECT event_id, 98202 FROM d WHERE NOT {_holds("head", _spelled("RS256", "HS256"))}
  {"".join(f"UNION ALL SELECT event_id, 98203 FROM d WHERE contains(claims, {quoted(t)}) " for t, _ in api.SUSPICIOUS_CLAIMS)}
  UNION ALL SELECT event_id, 98204 FROM d WHERE regexp_extract(claims, '"exp": ?([0-9]+)', 1)::BIGINT < 1700000500
  UNION ALL SELECT event_id, 98205 FROM d WHERE {_holds("lower(claims)", api.CLAIM_INJECTIONS)}"""

_BOTS = f"""WITH a AS (SELECT event_id, user_id AS u, {_picked(AGENTS, 'event_id')} AS ua,
    CASE event_id % 4 WHEN 0 THEN {_picked([p for p, _ in bots.BAD_TLS], 'user_id')} WHEN 1 THEN md5(props) END AS tls FROM events),
  k AS (SELECT *, CASE {" ".join(f"WHEN contains(lower(ua), '{p}') THEN 'good:0'" for p, _ in bots.GOOD_BOTS)} {" ".join(f"WHEN contains(lower(ua), '{p}') THEN 'bad:{n}'" for p, _, n in bots.BAD_BOTS)}
    {" ".join("WHEN " + matched("ua", p.replace(chr(92) + "z", "$")) + f" THEN 'suspicious:{n}'" for p, _, n in bots.SUSPICIOUS)} ELSE 'unknown:0' END AS c FROM a),
  m AS (SELECT *, regexp_matches(lower(coalesce(ua, '')), '{"|".join(bots.BROWSERS)}') AS browser, tls IN ({", ".join(quoted(p) for p, _ in bots.BAD_TLS)}) AS tool FROM k),
  s AS (SELECT *, [CASE WHEN u % 2 <> 0 THEN 15 END, CASE WHEN u % 3 = 0 THEN 10 END, CASE WHEN browser AND u % 5 <= 1 THEN 20 END, CASE WHEN browser AND u % 7 <= 3 THEN 10 END] AS odd FROM m),
  f AS (SELECT *, list_filter(odd, lambda x: x IS NOT NULL) AS o, CASE WHEN ua IS NULL THEN 40 WHEN trim(ua) = '' THEN 30 ELSE split_part(c, ':', 2)::INT END AS base FROM s),
  r AS (SELECT *, starts_with(c, 'good') AS good, least(255, base + coalesce(list_sum(o), 0) + CASE WHEN coalesce(tool, false) THEN 50 ELSE 0 END)::INT AS conf,
    array_to_string(list_filter([CASE WHEN ua IS NULL THEN '97004' END, CASE WHEN trim(ua) = '' THEN '97003' END, CASE WHEN starts_with(c, 'bad') THEN '97001' END, CASE WHEN starts_with(c, 'suspicious') THEN '97002' END]
      || list_transform(o, lambda x: '97100') || [CASE WHEN tool THEN '97102' END], lambda x: x IS NOT NULL), ',') AS ids FROM f)
  SELECT event_id, CASE WHEN good THEN 'good-bot' WHEN conf >= 70 THEN 'bad-bot' WHEN conf >= 30 THEN 'unknown' ELSE 'human' END AS bot_class, CASE WHEN good THEN 0 ELSE conf END AS confidence, CASE WHEN good THEN '' ELSE ids END AS rule_ids FROM r"""

_HALF = (len(CATALOGUE) + 1) // 2
_PAYLOADS = ", ".join(f"({k}, '{kind}', {_chars(text)})" for k, (kind, text) in enumerate((kind, text) for kind, texts in PAYLOADS.items() for text in texts))
_VALUES = f"""a AS (SELECT * FROM (VALUES {_PAYLOADS}) AS x(k, kind, attack)),
  u AS (SELECT page_id, url || '?q=' || replace(attack, '1', page_id::VARCHAR) || CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^https?://([^/?#]+)', 1) ELSE '' END AS uri
    FROM pages JOIN a ON page_id % (SELECT count(*) FROM a) = k)"""
_AFTER_Q = "(SELECT page_id AS id, substr(uri, position('?q=' IN uri) + 3) AS t FROM u)"
_BOTH_PARTS = "(SELECT 2 * page_id AS id, left(uri, position('?' IN uri) - 1) AS t FROM u UNION ALL SELECT 2 * page_id + 1, substr(uri, position('?' IN uri) + 1) FROM u)"
_CUT = "list_transform(range(1, length(t) - {0}), lambda i: substr(t, i, {1}))"
_ALL_CUTS = " || ".join(_CUT.format(n - 2, n) for n in (2, 3, 4))


def _likeness(source: str) -> str:
    """best: (id, payload, kind, similarity) of source (id, t)."""
    return f"""pg AS (SELECT k, kind, unnest(list_distinct({_ALL_CUTS})) AS ngram FROM (SELECT k, kind, lower(attack) AS t FROM a)),
  vg AS (SELECT id, unnest(list_distinct({_ALL_CUTS})) AS ngram FROM (SELECT id, lower(t) AS t FROM {source})),
  ps AS (SELECT k, kind, count(*) AS m FROM pg GROUP BY ALL), vs AS (SELECT id, count(*) AS n FROM vg GROUP BY id),
  like_ AS (SELECT id, k, count(*) AS b FROM vg JOIN pg USING (ngram) GROUP BY ALL),
  sim AS (SELECT id, k AS payload, kind, b / (n + m - b) AS similarity FROM like_ JOIN vs USING (id) JOIN ps USING (k)),
  best AS (SELECT * FROM sim WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, payload) = 1)"""


_TOLD = f"""p AS (SELECT kind, m, lower(t) AS t FROM (VALUES {_PHRASES}) AS v(kind, m, t)),
  w AS (SELECT kind, ngram, count(*) / sqrt(any_value(m)) AS x FROM ({_PHRASE_GRAMS}) GROUP BY kind, ngram),
  z AS (SELECT kind, ngram, x / max(x) OVER (PARTITION BY kind) AS weight, count(*) OVER (PARTITION BY kind) AS k FROM w),
  g AS (SELECT id, ngram, count(*) AS n FROM (SELECT id, unnest({_ALL_CUTS}) AS ngram FROM (SELECT id, lower(t) AS t FROM {_BOTH_PARTS})) GROUP BY ALL),
  s AS (SELECT id, sum(n) AS total, count(*) AS d FROM g GROUP BY id),
  j AS (SELECT id, kind, any_value(k) AS k, sum(n * weight) AS f, sum(weight) AS pr, count(*) AS c FROM g JOIN z USING (ngram) GROUP BY id, kind),
  scored AS (SELECT id, kind, least((0.6 * f / total + 0.4 * pr / k) * (1 + 0.5 * c / d), 1.0) AS score FROM j JOIN s USING (id)),
  kinds AS (SELECT * FROM (VALUES ('SqlInjection', 1), ('Xss', 2), ('CommandInjection', 3), ('PathTraversal', 4)) AS x(kind, place)),
  told AS (SELECT id, place, score FROM scored JOIN kinds USING (kind) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, place DESC) = 1)"""

ORACLES = {
    "waf_decisions_pages": WAF_DECISIONS,
    "header_decisions": f"""WITH x AS (SELECT * FROM (VALUES {_PAYLOADS}) AS x(k, kind, attack)),
      r AS (SELECT page_id, attack, url, '*/*' AS accept, 'curl/8' AS tool, string_split(url, '?')[1] AS path, CASE WHEN position('?' IN url) > 0 THEN substr(url, position('?' IN url) + 1) END AS query
        FROM pages JOIN x ON page_id % (SELECT count(*) FROM x) = k),
      found AS (SELECT 0 AS place, * FROM ({hits("r", "page_id", "path", PL2, "path")}) UNION ALL SELECT 1, * FROM ({hits("r", "page_id", "query", PL2, "query")})
        UNION ALL SELECT 2, * FROM ({hits("r", "page_id", "accept", PL2, "header")}) UNION ALL SELECT 3, * FROM ({hits("r", "page_id", "url", PL2, "header")})
        UNION ALL SELECT 4, * FROM ({hits("r", "page_id", "attack", PL2, "header")}) UNION ALL SELECT 5, * FROM ({hits("r", "page_id", "tool", PL2, "header")})),
      s AS (SELECT page_id, sum(score)::INT AS score, string_agg(rule_id::VARCHAR, ',' ORDER BY place, ord) AS ids FROM found GROUP BY page_id),
      d AS (SELECT page_id, coalesce(score, 0) AS score, ids, CASE WHEN score >= 25 THEN 'block' WHEN score >= 10 THEN 'warn' ELSE 'allow' END AS decision FROM pages LEFT JOIN s USING (page_id))
      SELECT page_id, decision, score, CASE WHEN decision = 'block' THEN 403 ELSE 0 END AS status, CASE WHEN decision <> 'allow' THEN ids ELSE '' END AS rules_header, CASE WHEN decision <> 'allow' THEN score::VARCHAR ELSE '' END AS score_header FROM d""",
    "rule_hits_by_family": f"SELECT attack_type, rule_id, count(*) AS n FROM ({hits('documents', 'doc_id', 'text', CATALOGUE)}) GROUP BY ALL",
    "score_by_attack_type": f"SELECT conv_id, attack_type, sum(score)::BIGINT AS score, count(*) AS n FROM ({hits('conversations', 'conv_id', 'text', PL2)}) GROUP BY conv_id, attack_type",
    "rule_selector_filter": f"SELECT rule_id, count(*) AS n FROM ({hits('pages', 'page_id', 'html', SELECTED)}) GROUP BY rule_id",
    "rule_evidence": f"""WITH x AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_chars(example(r.pattern))})" for k, r in enumerate(CATALOGUE))}) AS v(k, example)),
      p AS (SELECT page_id, url, unnest([page_id % {_HALF}, page_id % {_HALF} + {_HALF}]) AS k FROM pages),
      v AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN example || ' ' || url ELSE example END AS t FROM p JOIN x USING (k))
      SELECT rule_id, count(*) AS n FROM ({hits("v", "page_id", "t", CATALOGUE, "query")}) GROUP BY rule_id""",
    "exclusion_antijoin": """SELECT page_id, CASE WHEN position('?' IN url) > 0 THEN left(url, position('?' IN url) - 1) ELSE url END AS path,
      CASE WHEN position('?' IN url) > 0 THEN substr(url, position('?' IN url) + 1) ELSE '' END AS query
      FROM pages WHERE NOT starts_with(url, 'https://m.') AND NOT starts_with(url, 'http://m.')""",
    "card_luhn": f"SELECT doc_id, count(*) AS n_cards FROM ({_every(sensitive.CARD)}) WHERE {_LUHN.format('found')} GROUP BY doc_id",
    "card_brand_mask": f"SELECT doc_id, {_BRAND.format('found')} AS brand, '****-****-****-' || right(found, 4) AS masked FROM ({_every(LONG_NUMBER)}) WHERE {_LUHN.format('found')}",
    "email_bulk": f"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, {quoted(sensitive.EMAIL)}))::INT AS n_emails FROM documents) WHERE n_emails >= 1",
    "sensitive_scan": f"SELECT rule_id, rule_name, count(*) AS n FROM ({_cards(95001, 'Credit Card', sensitive.CARD)} UNION ALL {_cards(95002, 'Credit Card (Formatted)', sensitive.CARD_SEPARATED)} UNION ALL {_SSN} UNION ALL {_KEYS} UNION ALL {_PRIVATE} UNION ALL {_MAIL}) GROUP BY ALL",
    "sensitive_evidence": f"WITH {_examples(SENSITIVE)} SELECT rule_id, rule_name, count(*) AS n FROM ({_SCANNED} UNION ALL {_MAILS}) GROUP BY ALL".replace("FROM documents", "FROM v"),
    "sensitive_detailed": f"WITH {_examples(SENSITIVE)} SELECT doc_id, data_type, detail, position::INT AS position FROM ({_DETAILED})",
    "patch_evidence": f"WITH {_examples(PATCHED)} " + " UNION ALL ".join(
        f"SELECT doc_id, {p.rule_id} AS rule_id, {intel.SEVERITY_BASE[p.severity]} AS base_score FROM v WHERE {' OR '.join(matched('text', x) for x in p.patterns)}" for p in intel.PATCHES
    ),
    "metrics_report": f"""WITH d AS ({_HIT}), e AS (SELECT {_DECISION} AS decision FROM events)
      SELECT 'totals' AS section, 'requests' AS name, count(*) AS n FROM e UNION ALL SELECT 'totals', 'allowed', count(*) FROM e WHERE decision = 'allow'
      UNION ALL SELECT 'totals', 'warned', count(*) FROM e WHERE decision = 'warn' UNION ALL SELECT 'totals', 'blocked', count(*) FROM e WHERE decision = 'block' UNION ALL SELECT 'totals', 'detections', count(*) FROM d
      UNION ALL SELECT 'by_attack_type', attack_type, count(*) FROM d GROUP BY attack_type UNION ALL SELECT 'by_rule', rule_id::VARCHAR, count(*) FROM d GROUP BY rule_id
      UNION ALL SELECT * FROM (SELECT 'top_offenders', user_id::VARCHAR, count(*) FROM d GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)""",
    "protocol_report": f"""WITH e AS (SELECT {_DECISION} AS decision, floor(value)::BIGINT AS ms FROM events)
      SELECT 'waf_requests_total' AS name, 'counter' AS kind, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'waf_requests_allowed_total', 'counter', count(*) FROM e WHERE decision = 'allow'
      UNION ALL SELECT 'waf_requests_warned_total', 'counter', count(*) FROM e WHERE decision = 'warn' UNION ALL SELECT 'waf_requests_blocked_total', 'counter', count(*) FROM e WHERE decision = 'block'
      UNION ALL SELECT 'waf_latency_mean_ms', 'gauge', round(avg(ms), 6) FROM e UNION ALL SELECT 'waf_latency_max_ms', 'gauge', max(ms) FROM e""",
    "credential_attempts": """WITH e AS (SELECT event_id AS o, user_id AS u, user_id % 7 AS ip, epoch_us(ts) // 100000 AS t, event_type <> 'purchase' AS failed FROM events WHERE event_type <> 'view'),
      j AS (SELECT a.o, count(*) FILTER (b.ip = a.ip AND b.failed) AS i, count(*) FILTER (b.u = a.u AND b.failed) AS n
        FROM e a JOIN e b ON a.ip = b.ip AND b.t > a.t - 300000 AND (b.t, b.o) <= (a.t, a.o) GROUP BY a.o)
      SELECT o AS event_id, i AS ip_failures, n AS user_failures, CASE WHEN i >= 10 THEN 'ip' WHEN n >= 5 THEN 'user' ELSE 'none' END AS reason FROM j""",
    "script_hashes": """WITH h AS (SELECT page_id, url, 'sha256-' || to_base64(unhex(sha256(html))) AS hash FROM pages),
      k AS (SELECT hash, min(url) AS name FROM h WHERE contains(url, '/fr/') GROUP BY hash)
      SELECT page_id, h.hash AS script_hash, CASE WHEN h.hash IN (SELECT hash FROM h WHERE starts_with(url, 'https://')) THEN 'allowed' WHEN k.hash IS NOT NULL THEN 'known good' ELSE 'unknown' END AS script_status,
        CASE WHEN h.hash NOT IN (SELECT hash FROM h WHERE starts_with(url, 'https://')) THEN coalesce(name, '') ELSE '' END AS script_name FROM h LEFT JOIN k ON h.hash = k.hash""",
    "federated_features": _FEATURES,
    "renyi_epsilon": f"""WITH m AS (SELECT event_type, sum(power(1.0 / (value + 20), 2)) AS moment FROM events GROUP BY event_type), o(a) AS (VALUES {_ORDER_VALUES})
      SELECT event_type, round(min(a * moment / 2 + ln(a - 1) / a - ln(a * 0.00001) / a), 6) AS epsilon FROM m, o GROUP BY event_type""",
    "latency_histogram": _HISTOGRAM,
    "prometheus_export": f"WITH h AS ({_HISTOGRAM}) {_LINES}",
    "percentile_nearest_rank": """WITH l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL),
      s AS (SELECT event_type, list(value ORDER BY value) AS v FROM l WHERE k <= 10000 GROUP BY event_type)
      SELECT event_type, v[round(0.5 * (len(v) - 1))::INT + 1] AS p50, v[round(0.9 * (len(v) - 1))::INT + 1] AS p90, v[round(0.99 * (len(v) - 1))::INT + 1] AS p99 FROM s""",
    "top_offenders": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "counters": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id",
    "timing": TIMING,
    "bot_timing": f"""SELECT event_id, CASE WHEN timing_score >= 70 THEN 'bad-bot' WHEN timing_score >= 30 THEN 'unknown' ELSE 'human' END AS bot_class, timing_score AS confidence,
      CASE WHEN timing_score > 0 THEN '97101:' || timing_score ELSE '' END AS detections FROM ({TIMING})""",
    "failure_velocity": """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS t FROM events),
      j AS (SELECT a.event_id, count(*) FILTER (b.event_type = 'error') AS failures FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t - 86400000 AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY a.event_id)
      SELECT event_id, failures, failures >= 3 AS velocity_exceeded FROM j""",
    "intel_ip_join": """WITH s AS (SELECT s_suppkey AS k, floor(abs(s_acctbal))::BIGINT % 101 AS score, s_nationkey AS nation FROM supplier)
      SELECT c_custkey, 94000 AS rule_id, (score // 10)::INT AS base_score FROM customer JOIN s ON c_custkey = k WHERE score >= 50
      UNION ALL SELECT c_custkey, CASE WHEN nation % 4 = 0 THEN 94001 ELSE 94002 END, CASE WHEN nation % 4 = 0 THEN 4 ELSE 3 END
      FROM customer JOIN s ON c_custkey = k WHERE nation % 2 = 0""",
    "intel_domain_join": """WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS d FROM pages)
      SELECT page_id, 94100 AS rule_id, (length(d) * 4 // 10)::INT AS base_score FROM h WHERE length(d) * 4 >= 50
      UNION ALL SELECT page_id, 94101, 9 FROM h WHERE starts_with(d, 'www.')""",
    "reputation_composite": """WITH b AS (SELECT s_nationkey AS nation, max(floor(abs(s_acctbal))::BIGINT % 101) AS d FROM supplier GROUP BY s_nationkey),
      r AS (SELECT c_custkey, floor((40 * (floor(abs(c_acctbal))::BIGINT % 101) + 30 * coalesce(d, 0) + 30 * (c_custkey % 101)) / 100)::INT AS reputation
        FROM customer LEFT JOIN b ON c_nationkey = nation)
      SELECT c_custkey, reputation, CASE WHEN reputation >= 70 THEN 'high' WHEN reputation >= 40 THEN 'medium' ELSE 'low' END AS band FROM r""",
    "virtual_patches": f"WITH v AS (SELECT page_id, {_PATCH_VALUE} AS value FROM pages) {_PATCHES}",
    "script_patterns": f"""WITH b AS (SELECT page_id, {_SCRIPT_BODY} AS body FROM pages),
      part AS (SELECT page_id, body AS value FROM b WHERE contains(body, '<script')
        UNION ALL SELECT page_id, unnest(regexp_extract_all(body, {quoted(supply_chain.INLINE_SCRIPT)}, 1)) FROM b)
      SELECT page_id, rule_name, count(*) AS n FROM ({_SCRIPTS}) GROUP BY page_id, rule_name""",
    "sri_sha": "SELECT page_id, 'sha256-' || to_base64(unhex(sha256(html))) AS sha256 FROM pages",
    "csp_issues": f"""WITH p AS (SELECT page_id, {_picked(POLICIES, "page_id")} AS t FROM pages)
      SELECT page_id, 'script-src' AS directive, 'Contains ''unsafe-inline'' which allows inline scripts' AS issue, 'Medium' AS severity FROM p WHERE contains(t, {quoted("'unsafe-inline'")})
      UNION ALL SELECT page_id, 'script-src', 'Contains ''unsafe-eval'' which allows eval()', 'High' FROM p WHERE contains(t, {quoted("'unsafe-eval'")})
      UNION ALL SELECT page_id, 'script-src', 'Allows scripts from any source', 'Critical' FROM p WHERE contains(t, 'script-src *') OR contains(t, 'script-src ''self'' *')
      UNION ALL SELECT page_id, 'default-src', 'Allows resources from any source', 'High' FROM p WHERE contains(t, 'default-src *')
      UNION ALL SELECT page_id, 'script-src', 'Missing script-src directive', 'Medium' FROM p WHERE NOT contains(t, 'script-src') AND NOT contains(t, 'default-src')""",
    "ngram_counts": f"WITH {_grams('g', 'item_id', 'benchmark')} SELECT item_id, ngram, n FROM g",
    "jaccard_similarity": f"""WITH {_grams('r', 'item_id', 'benchmark')}, {_grams('l', 'turn_id', "(SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)")},
      ls AS (SELECT turn_id, sum(n)::BIGINT AS s, sqrt(sum(n * n)::DOUBLE) AS z FROM l GROUP BY turn_id),
      rs AS (SELECT item_id, sum(n)::BIGINT AS s, sqrt(sum(n * n)::DOUBLE) AS z FROM r GROUP BY item_id),
      b AS (SELECT turn_id, item_id, sum(least(l.n, r.n))::BIGINT AS both_n, sum(l.n * r.n)::BIGINT AS dot FROM l JOIN r USING (ngram) GROUP BY turn_id, item_id)
      SELECT turn_id, item_id, round(both_n / (ls.s + rs.s - both_n), 6) AS jaccard, round(dot / (ls.z * rs.z), 6) AS cosine FROM b JOIN ls USING (turn_id) JOIN rs USING (item_id)
      WHERE both_n / (ls.s + rs.s - both_n) >= {ALIKE}""",
    "ml_similarity": f"WITH {_VALUES}, {_likeness(_AFTER_Q)} SELECT id AS page_id, payload, kind, round(similarity, 6) AS similarity FROM best",
    "ml_detections": f"""WITH {_VALUES}, {_likeness(_BOTH_PARTS)}, {_TOLD},
      d AS (SELECT id, 99000 + place AS rule_id, floor(score * 10)::INT AS base_score FROM told WHERE score >= 0.4
        UNION ALL SELECT id, 99100 + place, floor(similarity * 8)::INT FROM best JOIN kinds USING (kind))
      SELECT id // 2 AS page_id, rule_id, CASE WHEN id % 2 = 0 THEN 'path' ELSE 'query' END AS location, base_score FROM d""",
    "entropy": """WITH c AS (SELECT page_id, strlen(url) AS n, unnest(string_split(url, '')) AS ch FROM pages),
      k AS (SELECT page_id, n, ch, count(*) AS m FROM c WHERE ch <> '' GROUP BY ALL)
      SELECT page_id, round(sum(-(m / n) * log2(m / n)), 6) AS entropy FROM k GROUP BY page_id""",
    "fingerprint_anomaly": FINGERPRINT,
    "fingerprint_model": FINGERPRINT_MODEL,
    "plugin_decisions": """WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[a-z]{12,}') AS w FROM conversations),
      s AS (SELECT *, CASE WHEN len(w) > 0 THEN 6 + least(20, len(w)) ELSE 0 END::INT AS score FROM w)
      SELECT conv_id, turn, score, CASE WHEN len(w) = 0 OR score < 9 THEN 'allow' WHEN score >= 20 THEN 'block' ELSE 'warn' END AS decision,
        CASE WHEN len(w) > 0 THEN 'body,long' ELSE '' END AS tags, coalesce(w[-1], '') AS last FROM s""",
    "ws_reassembly": f"""WITH f AS ({_FRAMES}), m AS (
      SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS message FROM f)
      SELECT conv_id, message, min(turn) AS first, max(turn) AS last, count(*) AS n_frames, sum(strlen(text))::INT AS n_bytes, md5(string_agg(text, '' ORDER BY turn)) AS body_md5
      FROM m GROUP BY conv_id, message HAVING bool_or(fin)""",
    "buffered_bodies": f"""WITH RECURSIVE {_BUFFERS}
      SELECT conv_id, buffer, first, last, size, too_large, CASE WHEN NOT too_large THEN md5(body) END AS body_md5 FROM ended""",
    "body_decisions": f"""WITH RECURSIVE {_BUFFERS}, hit AS ({hits("(SELECT * FROM ended WHERE NOT too_large)", "conv_id, last", "body", BODY_RULES)}),
      d AS (SELECT conv_id, last, sum(score)::INT AS score, string_agg(rule_id::VARCHAR, ',' ORDER BY ord) AS rule_ids FROM hit GROUP BY ALL)
      SELECT conv_id, last, coalesce(score, 0) AS score, coalesce(rule_ids, '') AS rule_ids,
        CASE WHEN score >= 25 THEN 'block' WHEN score >= 10 THEN 'warn' ELSE 'allow' END AS decision FROM ended LEFT JOIN d USING (conv_id, last)""",
    "response_detections": f"""WITH hit AS ({hits("pages", "page_id", "html", PL2)})
      SELECT page_id, string_agg(rule_id::VARCHAR, ',' ORDER BY ord) AS header, count(*)::INT AS n_detections FROM hit GROUP BY page_id""",
    "privacy_budget": f"""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::DOUBLE AS e, (o_orderkey % 30)::DOUBLE AS d,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, floor(o_totalprice), o_orderkey % 30) AS n FROM orders),
      f AS (SELECT o_custkey, 0::BIGINT AS n, NULL::BIGINT AS o_orderkey, false AS within, 0::DOUBLE AS es, 0::DOUBLE AS ds FROM (SELECT DISTINCT o_custkey FROM orders)
        UNION ALL SELECT o.o_custkey, o.n, o.o_orderkey::BIGINT, es + e <= {BUDGET[0]} AND ds + d <= {BUDGET[1]},
          CASE WHEN es + e <= {BUDGET[0]} AND ds + d <= {BUDGET[1]} THEN es + e ELSE es END, CASE WHEN es + e <= {BUDGET[0]} AND ds + d <= {BUDGET[1]} THEN ds + d ELSE ds END
        FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
      SELECT o_custkey, o_orderkey, within, es AS epsilon_spent, ds AS delta_spent FROM f WHERE n > 0""",
    "early_termination": f"""WITH f AS (SELECT conv_id, turn, text FROM ({_FRAMES_WITH_ATTACKS})),
      w AS (SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 256), '') || text AS t FROM f),
      h AS ({hits("w", "conv_id, turn", "t", BODY_RULES)}),
      k AS (SELECT conv_id, turn, rule_id, min(ord) AS ord FROM h GROUP BY conv_id, turn, rule_id QUALIFY row_number() OVER (PARTITION BY conv_id, rule_id ORDER BY turn) = 1),
      sc AS (SELECT k.*, round(base * {LOCATION_WEIGHTS["body"]})::INT AS score FROM k JOIN (VALUES {", ".join(f"({r.id}, {r.base})" for r in BODY_RULES)}) AS b(rule_id, base) USING (rule_id)),
      r AS (SELECT *, sum(score) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running,
        coalesce(sum(score) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc)
      SELECT conv_id, turn, rule_id, score, running, running >= 12 AS stopped FROM r WHERE before < 12""",
    "stream_overlap_dedup": f"""WITH f AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM ({_FRAMES})),
      w AS (SELECT conv_id, turn, coalesce(right(lag(h) OVER (PARTITION BY conv_id ORDER BY turn), 512), '') || h AS h FROM f)
      SELECT conv_id, turn, (length(h) // 2)::INT AS n_bytes, md5(unhex(h)) AS window_md5 FROM w""",
    "gradient_mean": f"SELECT i::INT AS i, round(avg(g), 6) AS value FROM ({_EMBEDDED}) GROUP BY i",
    "gradient_weighted": f"SELECT i::INT AS i, round(sum((label + 1) * g) / sum(label + 1), 6) AS value FROM ({_EMBEDDED}) GROUP BY i",
    "gradient_median": f"SELECT i::INT AS i, round(median(g), 6) AS value FROM ({_EMBEDDED}) GROUP BY i",
    "gradient_trimmed": f"""WITH r AS (SELECT i, g, row_number() OVER (PARTITION BY i ORDER BY g, vec_id) AS k, count(*) OVER (PARTITION BY i) AS n FROM ({_EMBEDDED}))
      SELECT i::INT AS i, round(avg(g), 6) AS value FROM r WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY i""",
    "model_average": f"""WITH e AS ({_EMBEDDED}), m AS (SELECT i, avg(g) AS s FROM e GROUP BY i), t AS (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label)
      SELECT e.label, i::INT AS i, round(0.3 * g + 0.7 * s, 6) AS value FROM t JOIN e USING (vec_id) JOIN m USING (i)""",
    "gradient_topk": f"SELECT vec_id, i::INT AS i FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(g) DESC, i) AS k FROM ({_EMBEDDED})) WHERE k <= 8",
    "json_depth": """WITH b AS (SELECT event_id, regexp_replace(repeat('{"a]{":[', (event_id % 14)::INT) || props || repeat(']}', (event_id % 14)::INT), '"[^"]*"', '', 'g') AS t FROM events),
      k AS (SELECT event_id, list_transform(regexp_extract_all(t, '[{}\\[\\]]'), lambda c: CASE WHEN c IN ('{', '[') THEN 1 ELSE -1 END) AS s FROM b)
      SELECT event_id, coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))), 0)::INT AS depth FROM k""",
    "json_inspection": f"WITH b AS (SELECT event_id, {_JSON_BODY} AS t FROM events), k AS (SELECT event_id, {_DEPTH_STEPS} AS s FROM b), " + "j AS (SELECT event_id, coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))), 0)::INT AS depth FROM k) "
    + " UNION ALL ".join(_json_hit(x, i, base) for x, i, base in [*((rf'"\${op}"\s*:', 98100, 8) for op in api.NOSQL_OPERATORS), *((x, 98101, 9) for x in api.PROTOTYPES), *((x, 98102, base) for x, _, base in api.SUSPICIOUS_KEYS)])
    + " UNION ALL SELECT event_id, 98103, 6, 'depth=' || depth || ' (max=20)' FROM j WHERE depth > 20",
    "graphql_inspection": _GRAPHQL,
    "openapi_validation": OPENAPI_VALIDATION,
    "graphql_validation": GRAPHQL_VALIDATION,
    "jwt_inspection": _JWT,
    "bot_classes": _BOTS,
    "ml_classify": _CLASSIFY,
}
