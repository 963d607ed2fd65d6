"""API traffic: GraphQL, JSON and JWT inspection, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import let
from palisade.model import DETECTIONS, detection, only, truncated
from palisade.rules import java_pattern

MAX_DEPTH, MAX_FIELDS, MAX_BATCH, MAX_DIRECTIVES, MAX_NESTING = 10, 100, 10, 5, 20

# Patterns, names and scores.
INTROSPECTION = r"(?i)(__schema|__type)\s*[\{\(]|__typename\b"
OPERATION = r"(?i)(query|mutation|subscription)\s*[\w]*\s*[\(\{]"
KEYWORDS = ("query", "mutation", "subscription", "fragment", "on", "true", "false", "null")
DIRECTIVES = ("@include", "@skip", "@deprecated", "@specifiedBy", "@defer", "@stream")
GRAPHQL_INJECTIONS = (
    (r'"\s*;\s*(DROP|DELETE|UPDATE|INSERT)', "sql-in-variable"),
    (r'"[^"]*<script', "script-in-variable"),
    (r"\$\{\{.*\}\}", "template-injection"),
    (r"\$where\s*:", "nosql-where"),
    (r"\$regex\s*:", "nosql-regex"),
)
NOSQL_OPERATORS = (
    "where", "regex", "gt", "gte", "lt", "lte", "ne", "in", "nin", "or", "and", "not", "exists", "type", "expr", "jsonSchema", "function", "accumulator",
)
PROTOTYPES = (r'"__proto__"\s*:', r'"constructor"\s*:\s*\{', r'"prototype"\s*:')
SUSPICIOUS_KEYS = (
    (r'"isAdmin"\s*:', "isAdmin", 7),
    (r'"is_admin"\s*:', "is_admin", 7),
    (r'"admin"\s*:\s*(true|1)', "admin", 7),
    (r'"role"\s*:\s*"admin', "role=admin", 7),
    (r'"permissions"\s*:', "permissions", 6),
    (r'"privileges"\s*:', "privileges", 6),
    (r'"password"\s*:', "password", 5),
    (r'"password_hash"\s*:', "password_hash", 5),
    (r'"api_key"\s*:', "api_key", 5),
    (r'"secret"\s*:', "secret", 5),
    (r'"internal"\s*:', "internal", 3),
    (r'"_id"\s*:', "_id", 3),
    (r'"id"\s*:', "id", 3),
)
TOKEN = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
NO_ALGORITHM = ('"alg":"none"', '"alg": "none"', '"alg":"None"', '"alg":"NONE"')
WEAK_ALGORITHMS = ("HS256", "HS384", "HS512")
SUSPICIOUS_CLAIMS = (
    ('"admin":true', "admin claim"),
    ('"admin": true', "admin claim"),
    ('"role":"admin"', "admin role"),
    ('"role": "admin"', "admin role"),
    ('"is_admin":true', "is_admin claim"),
    ('"isAdmin":true', "isAdmin claim"),
)
CLAIM_INJECTIONS = ("<script", "javascript:", "' or ", '" or ', "; drop ")


def _none() -> Column:
    return F.expr(f"cast(array() as {DETECTIONS})")


def _first(value: Column, pattern: str) -> Column:
    return F.regexp_substr(value, F.lit(java_pattern(pattern)))


def _hit(value: Column, pattern: str, rule_id: int, name: str, attack: str, base: int, tags: tuple[str, ...]) -> Column:
    matched = _first(value, pattern)
    return F.when(matched.isNotNull(), detection(rule_id, name, attack, matched, "body", base, tags))


def _deepest(brackets: Column, opening: tuple[str, ...]) -> Column:
    """The largest number of open brackets; closing more than were opened counts as none open."""

    def step(done: Column, bracket: Column) -> Column:
        now = F.when(bracket.isin(*opening), done["open"] + 1).otherwise(F.greatest(done["open"] - 1, F.lit(0)))
        return F.struct(now.alias("open"), F.greatest(done["most"], now).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")), step, lambda done: done["most"])


def brace_depth(body: Column) -> Column:
    """Of braces anywhere, strings included."""
    return _deepest(F.regexp_extract_all(body, F.lit("[{}]"), F.lit(0)), ("{",))


def json_depth(body: Column) -> Column:
    """Of objects and arrays, outside strings."""
    bare = F.regexp_replace(body, r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)', "")
    return _deepest(F.regexp_extract_all(bare, F.lit(r"[{}\[\]]"), F.lit(0)), ("{", "["))


def field_count(body: Column) -> Column:
    """Words outside quotes that are no keywords; a word at the very end is not counted."""
    bare = F.regexp_replace(body, r'(?s)"[^"]*(?:"|\z)', "")
    words = F.regexp_extract_all(bare, F.lit(r"(?s)[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"), F.lit(0))
    return F.size(F.filter(words, lambda w: ~w.isin(*KEYWORDS)))


def _limit(value: Column, most: int, rule_id: int, name: str, label: str, base: int, tags: tuple[str, ...]) -> Column:
    shown = F.concat(F.lit(f"{label}="), value.cast("string"), F.lit(f" (max={most})"))
    return F.when(value > most, detection(rule_id, name, "ProtocolAttack", shown, "body", base, tags))


def graphql_detections(body: Column) -> Column:
    batch = F.when(F.startswith(F.trim(body), F.lit("[")), F.regexp_count(body, F.lit('"query"'))).otherwise(0)
    operations = F.regexp_count(body, F.lit(java_pattern(OPERATION)))
    too_many = F.coalesce(
        _limit(batch, MAX_BATCH, 98004, "GraphQL Batch Query Abuse", "batch_size", 6, ("graphql", "dos", "batch")),
        _limit(operations, MAX_BATCH, 98004, "GraphQL Multiple Operations", "operations", 5, ("graphql", "batch")),
    )
    named = F.regexp_extract_all(body, F.lit(r"@\w+"), F.lit(0))
    listed = F.filter(named, lambda d: F.lower(d).isin(*[x.lower() for x in DIRECTIVES]))
    # One for each occurrence, as often as the text of the name occurs.
    often = lambda d: F.size(F.split(body, F.concat(F.lit(r"\Q"), d, F.lit(r"\E")), -1)) - 1
    abused = F.filter(listed, lambda d: often(d) > MAX_DIRECTIVES)
    shown = lambda d: F.concat(d, F.lit(" (count="), often(d).cast("string"), F.lit(")"))
    directives = F.transform(abused, lambda d: detection(98005, "GraphQL Directive Abuse", "ProtocolAttack", shown(d), "body", 5, ("graphql", "directive")))
    return F.concat(
        only(
            _hit(body, INTROSPECTION, 98001, "GraphQL Introspection Blocked", "ProtocolAttack", 5, ("graphql", "introspection")),
            _limit(brace_depth(body), MAX_DEPTH, 98002, "GraphQL Query Too Deep", "depth", 7, ("graphql", "dos", "depth")),
            _limit(field_count(body), MAX_FIELDS, 98003, "GraphQL Too Many Fields", "fields", 6, ("graphql", "dos", "fields")),
            too_many,
        ),
        directives,
        only(*[_hit(body, p, 98010, f"GraphQL Injection: {name}", "SqlInjection", 8, ("graphql", "injection")) for p, name in GRAPHQL_INJECTIONS]),
    )


def json_detections(body: Column) -> Column:
    nosql = [_hit(body, rf'"\${x}"\s*:', 98100, f"NoSQL Injection: ${x} operator", "SqlInjection", 8, ("json", "nosql", "injection")) for x in NOSQL_OPERATORS]
    prototypes = [_hit(body, p, 98101, "Prototype Pollution Attempt", "ProtocolAttack", 9, ("json", "prototype-pollution")) for p in PROTOTYPES]
    keys = [_hit(body, p, 98102, f"Suspicious JSON Key: {name}", "ProtocolAttack", base, ("json", "mass-assignment")) for p, name, base in SUSPICIOUS_KEYS]
    nesting = _limit(json_depth(body), MAX_NESTING, 98103, "JSON Excessive Nesting", "depth", 6, ("json", "dos", "nesting"))
    return only(*nosql, *prototypes, *keys, nesting)


def jwt_token(header: Column) -> Column:
    """The token of an Authorization header, null if there is none of three parts."""
    token = F.when(F.startswith(header, F.lit("Bearer ")), F.trim(F.substring(header, 8, F.char_length(header)))).when(
        header.rlike(TOKEN), F.trim(header)
    )
    return F.when(F.size(F.split(token, r"\.", -1)) == 3, token)


def jwt_part(token: Column, place: int) -> Column:
    """The text of a part; null if it is not base64url of UTF-8."""
    part = F.split_part(token, F.lit("."), F.lit(place))
    left = F.char_length(part) % 4
    padded = F.concat(F.translate(part, "-_", "+/"), F.when(left == 2, "==").when(left == 3, "=").otherwise(""))
    data = F.try_to_binary(padded, F.lit("base64"))
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def jwt_detections(header: Column, now: int, weak: bool = False, allowed: tuple[str, ...] = (), expiry: bool = True) -> Column:
    """now: Unix seconds, a parameter, so that results can be repeated."""
    decoded = lambda t: let(lambda x: _jwt_found(t["token"], x["head"], x["claims"], now, weak, allowed, expiry), head=jwt_part(t["token"], 1), claims=jwt_part(t["token"], 2))
    return let(decoded, token=jwt_token(header))


def _jwt_found(token: Column, head: Column, claims: Column, now: int, weak: bool, allowed: tuple[str, ...], expiry: bool) -> Column:
    shown = truncated(token, 50)
    made = lambda i, name, attack, base, tags: detection(i, name, attack, shown, "header:Authorization", base, tags)
    holds = lambda value, texts: reduce(Column.__or__, [F.contains(value, F.lit(t)) for t in texts])
    spelled = lambda names: [t for n in names for t in (f'"alg":"{n}"', f'"alg": "{n}"')]
    found = [F.when(holds(head, NO_ALGORITHM), made(98200, "JWT None Algorithm Attack", "ProtocolAttack", 9, ("jwt", "algorithm", "none")))]
    if weak:
        first = F.coalesce(*[F.when(holds(head, spelled([a])), made(98201, f"JWT Weak Algorithm: {a}", "ProtocolAttack", 6, ("jwt", "algorithm", "weak"))) for a in WEAK_ALGORITHMS])
        found.append(first)
    if allowed:
        found.append(F.when(~holds(head, spelled(allowed)), made(98202, "JWT Disallowed Algorithm", "ProtocolAttack", 7, ("jwt", "algorithm"))))
    found += [F.when(F.contains(claims, F.lit(t)), made(98203, f"JWT Suspicious Claim: {name}", "ProtocolAttack", 5, ("jwt", "claim"))) for t, name in SUSPICIOUS_CLAIMS]
    if expiry:
        expires = F.coalesce(*[F.nullif(F.regexp_extract(claims, f'"exp":{gap}([0-9]+)', 1), F.lit("")) for gap in ("", " ")]).try_cast("decimal(20,0)")
        found.append(F.when(expires < now, made(98204, "JWT Expired Token", "ProtocolAttack", 4, ("jwt", "expired"))))
    found.append(F.when(holds(F.lower(claims), CLAIM_INJECTIONS), made(98205, "JWT Claim Injection", "SqlInjection", 8, ("jwt", "injection"))))
    return only(*found)


def api_detections(path: Column, content_type: Column, body: Column, authorization: Column, now: int) -> Column:
    """GraphQL by path or content type, JSON by content type, JWT by header."""
    graphql = F.endswith(path, F.lit("/graphql")) | F.endswith(path, F.lit("/gql")) | F.coalesce(F.contains(content_type, F.lit("application/graphql")), F.lit(False))
    json = F.coalesce(F.contains(content_type, F.lit("application/json")) | F.contains(content_type, F.lit("+json")), F.lit(False))
    return F.concat(
        F.when(graphql & body.isNotNull(), graphql_detections(body)).otherwise(_none()),
        F.when(json & body.isNotNull(), json_detections(body)).otherwise(_none()),
        F.when(authorization.isNotNull(), jwt_detections(authorization, now)).otherwise(_none()),
    )
